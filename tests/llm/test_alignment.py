"""Alignment of two tokenizers against plain Python."""

import hashlib
import random
import re
import sys
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fraudlens.llm import alignment

SCHEMA = "doc_id long, text string, n_a string, pair string, salt string"
TEXTS = [
    None, "", " ", "a", "The reader reads unbelievable things.", "don't <|endoftext|> </s> <s>", "▁ marked ▁", "日本語 テキスト 😀 é́", "tabs\t\tand\n\n lines  ", "x" * 3000, "éè ñandú ß " * 200,
    "naïve café — “quotes” … 12345 3.14159", "a\x00b \x7f ​﻿", "unbelievable unbelievable", "The reader", "The reader",
]


def plain(rows):
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    name = {i: t for t, i in a.get_vocab().items()}
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}

    def b_bytes(i):
        piece = b.id_to_piece(i)
        hexed = re.fullmatch("<0x(..)>", piece)
        return bytes.fromhex(hexed[1]) if hexed else piece.replace("▁", " ").encode()

    found, links = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ax, by = [bytes(code[c] for c in name[k]) for k in x], [b_bytes(k) for k in y]
            if b"".join(ax) == b"".join(by) == (" " + text).encode():
                one, two, m, n, p, q = [], [], 0, 0, 0, 0
                while p < len(x) or q < len(y):
                    if m <= n and p < len(x):
                        one.append(x[p])
                        m, p = m + len(ax[p]), p + 1
                    else:
                        two.append(y[q])
                        n, q = n + len(by[q]), q + 1
                    if m == n and one and two:
                        groups.append((one, two))
                        one, two = [], []
        found.append((i, groups))
        links.update((g[0][-1], g[1][-1]) for g in groups)
    best = {}
    for (_, y), n in links.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for i, groups in found:
        told = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        some = [(g[0][-1], g[1][-1]) for g in groups]
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(some), sum(links[p] == best[p[1]] for p in some), sum(links[p] for p in some), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return out


def rows_of(frame):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted((tuple(r[x] for x in names) for r in frame.collect()), key=str)


@pytest.mark.parametrize("slice_bytes, most, joined", [(500, 7, 3), (1 << 22, 10**6, 200)])
def test_equals_plain(spark, monkeypatch, slice_bytes, most, joined):
    for name, value in (("SLICE_BYTES", slice_bytes), ("TABLE_CHUNKS", most), ("JOINED", joined)):
        monkeypatch.setattr(alignment, name, value)
    rows = list(enumerate(TEXTS)) + [(None, "The reader reads."), (4, TEXTS[4]), (4, TEXTS[11])]
    frame = spark.createDataFrame([(i, t, "a", "p", "s") for i, t in rows], SCHEMA).repartition(3)
    got, want = rows_of(alignment.align_tokenizers(frame)), sorted(plain(rows), key=str)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 10 and any(r[5] < r[4] for r in want)
    assert alignment.align_tokenizers(frame.limit(0)).count() == 0


def test_given_texts_equal_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = rows_of(alignment.align_tokenizers(docs))
    assert got == sorted(plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]), key=str)


def test_odd_white_space_equals_plain():
    """Chunks and their table against whole texts."""
    rng = random.Random(2)
    parts = ["a", "Is", "don't", "é", "12", "…", " ", " ", "  ", "\n", "\t", "\u00a0", "\u2028", "\x1c", "\x85", "\u3000", "▁", "日本", "😀", "<s>", "<|endoftext|>", "x" * 40, "'", "'s", "\u0301", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(1500)]
    table = alignment.ChunkTable(alignment.tokenizers(alignment.default_paths()), 50)
    got = [x for at in range(0, len(texts), 70) for x in zip(*(c.to_pylist() for c in table.align(texts[at : at + 70])[:4]))]
    want = [(r[1], r[2], r[3], r[7]) for r in plain(list(enumerate(texts)))]
    assert got == want and sum(x[0] > 0 for x in want) > 700
    for long in (" " * 300_000 + "a", "a " * 150_000, "\n " * 100_000):
        assert " ".join(alignment.chunks_of(long)) == long


def test_only_irregular_groups_are_pairs():
    table = alignment.ChunkTable(alignment.tokenizers(alignment.default_paths()), 50)
    t, columns = table.t, table.align(["The reader reads unbelievable things.", None])
    n_groups, same, pairs = columns[2].to_pylist(), columns[4].to_pylist(), columns[5].to_pylist()
    assert n_groups[1] == 0 and same[1] == pairs[1] == [] and len(same[0]) >= 3
    assert all(t.a_bytes[i] == t.b_bytes[t.same[i]] for i in same[0])
    assert all(t.same[p // t.span] != p % t.span for p in pairs[0]) and len(same[0]) + len(pairs[0]) <= n_groups[0]


def _peak(work):
    """What ``work`` returns, and the most bytes that Python and numpy held meanwhile beyond what they did before."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_does_not_grow_with_a_text_or_a_slice():
    """Beyond the ids that a text's row holds, 4 bytes for each group and as many while the parts' are put together."""
    table = alignment.ChunkTable(alignment.tokenizers(alignment.default_paths()), 50_000)
    short, long = ("The reader reads many unbelievable things. " * n for n in (1000, 100_000))  # 4 MB
    table.align([short])
    (columns, peak), (several, together) = _peak(lambda: table.align([long])), _peak(lambda: table.align([short] * 100))
    assert columns[2].to_pylist()[0] == sum(several[2].to_pylist()) + 1 - 100  # the last blank is a token of its own
    assert peak < 5 * len(long) and together < 5 * len(long)


def test_many_new_chunks_are_aligned_some_at_a_time(monkeypatch):
    table = alignment.ChunkTable(alignment.tokenizers(alignment.default_paths()), 50_000)
    sizes, aligned = [], alignment.Tokenizers.aligned
    monkeypatch.setattr(alignment.Tokenizers, "aligned", lambda t, texts: sizes.append(sum(len(x.split()) for x in texts)) or aligned(t, texts))
    table.align([" ".join(f"word{i}" for i in range(30_000))])
    assert sum(sizes) == 30_000 and max(sizes) <= 5_000


def test_a_remembered_chunk_is_small():
    """The table's own size for a chunk, without the chunk."""
    table = alignment.ChunkTable(alignment.tokenizers(alignment.default_paths()), 50_000)
    table.align([" ".join(f"word{i}" for i in range(20_000))])
    held = [sys.getsizeof(x) + sum(map(sys.getsizeof, x) if isinstance(x, tuple) else ()) for x in table.known.values()]
    assert len(held) == 20_000 and sum(held) / len(held) < 180


def test_a_long_text_in_parts_equals_plain(monkeypatch):
    """Parts of one text share pairs, and one part that is not spelt leaves the whole text without tokens."""
    monkeypatch.setattr(alignment, "SLICE_BYTES", 40)
    table = alignment.ChunkTable(alignment.tokenizers(alignment.default_paths()), 50)
    odd = "unbelievable things don't 日本語 end. \n Then  more\tcame, naïvely " * 9
    texts = [odd, "a " + odd + "▁ " + odd, odd[:100], None, "▁ " + odd, odd + "▁", "short"]
    rows = [(r[1], r[2], r[3], r[7]) for r in plain(list(enumerate(texts)))]
    got = table.align(texts)
    assert list(zip(*(c.to_pylist() for c in got[:4]))) == rows and [x[0] > 0 for x in rows] == [True, False, True, False, False, False, True]
    monkeypatch.setattr(alignment, "SLICE_BYTES", 1 << 20)
    whole = alignment.ChunkTable(table.t, 50).align(texts)
    assert [c.to_pylist() for c in got] == [c.to_pylist() for c in whole] and max(got[6].to_pylist()[0]) >= 9


def test_sums_over_ids_take_some_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    counts, best = rng.integers(0, 1 << 40, 1000), rng.random(1000) < 0.5
    same = [rng.integers(0, 1000, n).tolist() for n in (0, 5, 0, 7, 8, 1, 30, 0)]
    batch = pa.RecordBatch.from_pydict({x: list(range(8)) for x in ("_row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")} | {"same": pa.array(same, pa.list_(pa.int32()))})
    monkeypatch.setattr(alignment, "SUMMED", 7)
    for rows in (batch, batch.slice(2, 4), batch.slice(7), batch.slice(8)):
        (found,) = alignment._same_links(counts, best)(iter([rows]))
        assert found["total"].to_pylist() == [int(counts[x].sum()) for x in rows["same"].to_pylist()]
        assert found["best"].to_pylist() == [int(best[x].sum()) for x in rows["same"].to_pylist()]
    (found,) = alignment._vector_counts(1000)(iter([batch, batch.slice(2, 4)]))
    want = Counter(i for rows in (batch, batch.slice(2, 4)) for x in rows["same"].to_pylist() for i in x)
    assert dict(zip(found["a"].to_pylist(), found["n"].to_pylist())) == want
    monkeypatch.setattr(alignment, "SUMMED", 1 << 20)
    large = pa.RecordBatch.from_pydict({x: [0] for x in ("_row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")} | {"same": pa.array([[5] * 8_000_000], pa.list_(pa.int32()))})
    (found,), peak = _peak(lambda: list(alignment._same_links(counts, best)(iter([large]))))
    assert found["total"].to_pylist() == [8_000_000 * int(counts[5])] and peak < 40 << 20
