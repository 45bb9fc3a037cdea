"""Alignment of two tokenizers' ids over a corpus.

Tokenizer A is byte-level BPE, tokenizer B SentencePiece. Of each text both token
sequences spell the same bytes; byte offsets at which tokens of both end cut them
into groups, and the last tokens of a group, which end together, are a link.

Texts are cut at blanks between words, where tokens of both always end, so a task keeps a
bounded table of distinct chunks with their groups and aligns each new one once. Texts are taken
in slices of bounded bytes, and longer ones cut at such blanks.

Most groups are one token of each side with the same bytes. For them an array
computed once gives B's id of each A id; such groups are counted in vectors as long as A's
vocabulary, and a document keeps only their A ids. Only the other, irregular groups
go through a shuffle, as pairs of ids with their number in each document. Vectors
(a number for each id) are all that the driver and the tasks share; the pair
table may be of any size, and its joins are salted against pairs that nearly every text holds.

Defined cases: a text that is null or empty, or whose tokens do not spell a blank
and the text on both sides (B marks blanks with U+2581, so a text that holds this character does not),
has no tokens: zeros and an empty digest. Special tokens in texts are plain text. Repeated rows
count as often as they stand; ids may be null or repeated; an empty table gives no rows; other
columns are never read.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.storage import cut
from fraudlens.llm.token_orc import Bounded

#: Bytes of texts that are worked on at once (a longer text in parts of as many characters), ids summed at once, and salts of the join with pair counts.
SLICE_BYTES, SUMMED, SALTS = 1 << 20, 1 << 20, 8
#: Chunks a task remembers, chunks aligned as one text, and chunks aligned at once.
TABLE_CHUNKS, JOINED, TOGETHER = 250_000, 200, 5000
MARK = "▁"
_BREAK = re.compile(r"(?<=[^ ]) (?=\S)")
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, same array<int>, pairs array<long>, times array<int>"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_symbol() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as U+0100 and on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Tokenizers:
    """Both tokenizers, the bytes of their ids, and for each A id B's id of the same bytes (-1 if there is none)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        symbols = byte_of_symbol()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(symbols[x] for x in token) if all(x in symbols for x in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            raw = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece) if self.b.is_byte(i) else None
            self.b_bytes.append(bytes([int(raw[1], 16)]) if raw else piece.replace(MARK, " ").encode())
        whole = {x: i for i, x in reversed(list(enumerate(self.b_bytes))) if not self.b.is_byte(i) and not self.b.is_control(i)}
        single = {x: i for i, x in enumerate(self.b_bytes) if self.b.is_byte(i)}
        self.same = np.array([whole.get(x, single.get(x, -1)) for x in self.a_bytes])
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        # an id and what follows it in a group's description: "," or, at its side's end, "|" (A) or ";" (B)
        self.told = [f"{i}{x}".encode() for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for x in ends]
        self.told_size = np.array(list(map(len, self.told)))

    @property
    def span(self) -> int:
        """A pair's number is its A id times this, plus its B id."""
        return len(self.b_bytes)

    def aligned(self, texts: list[str]) -> Groups:
        """Of non-empty texts, those that both sides spell, and their groups one after another."""
        coded = zip(self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1))
        rows, a, b = [], [], []
        for i, (x, y) in enumerate(coded):
            if b"".join(map(self.a_bytes.__getitem__, x.ids)) == (" " + texts[i]).encode() == b"".join(map(self.b_bytes.__getitem__, y)):
                rows.append(i)
                a.extend(x.ids)
                b.extend(y)
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        at = np.searchsorted(b_end, a_end)
        a_last = np.flatnonzero(b_end[np.minimum(at, max(len(b_end) - 1, 0))] == a_end) if len(a) else np.empty(0, np.int64)
        return Groups(rows, a, b, a_last, at[a_last], a_end[a_last])

    def described(self, g: Groups) -> tuple[bytes, np.ndarray]:
        """All groups' ids as text, and where in it each group ends: A's ids of a group, then B's."""
        in_a, in_b = np.diff(g.a_last, prepend=-1), np.diff(g.b_last, prepend=-1)
        group = np.arange(len(g.a_last))
        codes = np.empty(len(g.a) + len(g.b), np.int64)
        for ids, first, last, behind in ((g.a, 0, g.a_last, np.repeat((g.b_last - in_b + 1)[group], in_a)), (g.b, len(self.a_bytes), g.b_last, np.repeat((g.a_last + 1)[group], in_b))):
            is_last = np.zeros(len(ids), np.int64)
            is_last[last] = 1
            codes[np.arange(len(ids)) + behind] = 2 * (first + ids) + is_last
        ends = np.cumsum(self.told_size[codes])[g.a_last + g.b_last + 1] if len(codes) else np.empty(0, np.int64)
        return b"".join(map(self.told.__getitem__, codes.tolist())), ends


@dataclass
class Groups:
    """The texts (by number) that have tokens, the tokens of all of them, for each group its last tokens' places and where it ends in the bytes of all."""

    rows: list[int]
    a: np.ndarray
    b: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    end: np.ndarray


def chunks_of(text: str) -> list[str]:
    """A text cut at single blanks that no white space follows. Tokens of
    both sides end there whatever stands around: A's pre-tokens begin with such a blank, and no
    piece of B goes on beyond a marker. So a chunk's groups do not depend on its neighbours."""
    words = text.split(" ")
    if all(words) and not any(map(str.isspace, [x[0] for x in words])):
        return words
    return _BREAK.split(text)


def together(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(number of its text, part) of all texts in order, ``SLICE_BYTES`` characters at a time. Longer texts are
    cut at the first blank behind as many that ends a chunk, so a text's chunks are those of its parts."""
    some, room = [], SLICE_BYTES
    for i, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            found = _BREAK.search(text, at + SLICE_BYTES)
            part = text[at : found.start() if found else len(text)]
            at = found.end() if found else len(text)
            if some and len(part) > room:
                yield some
                some, room = [], SLICE_BYTES
            some.append((i, part))
            room -= len(part)
    if some:
        yield some


#: What is known of a chunk begins with its tokens of A and B (0 unless both sides spell it) and the sizes of the first two of what follows:
#: groups as text, A ids of one-to-one links, irregular links. One value of bytes takes half the memory of a tuple of them.
HEAD = struct.Struct("<4I")
WRONG = bytes(HEAD.size)


class ChunkTable:
    """Groups of chunks, aligned once each. It is bounded and begun anew when full."""

    def __init__(self, t: Tokenizers, most: int):
        self.t, self.known = t, Bounded(most)

    def learn(self, chunks: list[str]) -> None:
        """Chunks without white space are aligned many together, the others, and those of a text that does not fit, each for itself."""
        plain = [x for x in chunks if MARK not in x and x.split() == [x]]
        single = list(set(chunks).difference(plain))
        some = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
        many = max(1, TOGETHER // JOINED)
        for at in range(0, len(some), many):
            single += itertools.chain.from_iterable(self._aligned(some[at : at + many]))
        for at in range(0, len(single), TOGETHER):
            self.known.update((x, WRONG) for [x] in self._aligned([[x] for x in single[at : at + TOGETHER]]))

    def _aligned(self, members: list[list[str]]) -> list[list[str]]:
        """Learns chunks, each member's as one text. Those that both sides do not spell are given back."""
        t, g = self.t, self.t.aligned(list(map(" ".join, members)))
        names = [x for i in g.rows for x in members[i]]
        told, told_end = t.described(g)
        link_a, link_b = g.a[g.a_last], g.b[g.b_last]
        same = (np.diff(g.a_last, prepend=-1) == 1) & (np.diff(g.b_last, prepend=-1) == 1) & (t.same[link_a] == link_b)
        # the groups of a chunk are those that end up to its end
        upto = np.searchsorted(g.end, np.cumsum([1 + len(x.encode()) for x in names]), side="right")
        at = lambda x: [0, *np.concatenate([[0], x])[upto].tolist()]
        n_a, n_b, text, one = at(g.a_last + 1), at(g.b_last + 1), at(told_end), at(np.cumsum(same))
        odd = [x - y for x, y in zip([0, *upto.tolist()], one)]
        same_ids, pairs = link_a[same].astype("<i4").tobytes(), (link_a * t.span + link_b)[~same].astype("<i8").tobytes()
        for k, name in enumerate(names):
            x, y = told[text[k] : text[k + 1]], same_ids[4 * one[k] : 4 * one[k + 1]]
            self.known[name] = b"".join((HEAD.pack(n_a[k + 1] - n_a[k], n_b[k + 1] - n_b[k], len(x), len(y)), x, y, pairs[8 * odd[k] : 8 * odd[k + 1]]))
        fit = set(g.rows)
        return [x for i, x in enumerate(members) if i not in fit]

    def align(self, texts: list[str | None]) -> list[pa.Array]:
        """The columns of COUNTED after doc_id."""
        n, spans = len(texts), len(self.t.a_bytes) * self.t.span
        wrong, totals, hashes = np.zeros(n, bool), np.zeros((4, n), np.int64), [None] * n
        same, irregular, times = [np.empty(0, "<i4")], [], []
        for some in together(texts):
            row = np.array([i for i, _ in some])
            fits, n_a, n_b, told, ids, pairs = self._found([part for _, part in some])
            n_same, n_pairs = np.diff(ids[1]) // 4, np.diff(pairs[1]) // 8
            wrong[row[~fits]] = True
            np.add.at(totals, (slice(None), row), [n_a, n_b, n_same + n_pairs, n_same])
            for i, x, y in zip(row.tolist(), told[1].tolist(), told[1][1:].tolist()):
                if x < y and hashes[i]:
                    hashes[i].update(b";")
                elif x < y:
                    hashes[i] = hashlib.sha256()
                if x < y:
                    hashes[i].update(told[0][x : y - 1])
            same.append(np.frombuffer(ids[0], "<i4"))
            for held, found in zip((irregular, times), np.unique(np.repeat(row, n_pairs) * spans + np.frombuffer(pairs[0], "<i8"), return_counts=True)):
                held.append(found)
        if len(irregular) == 1:
            (irregular,), (times,) = irregular, times
        else:  # parts of one text may share pairs
            irregular, which = np.unique(np.concatenate([np.empty(0, np.int64), *irregular]), return_inverse=True)
            times = np.bincount(which, np.concatenate([np.empty(0), *times]), len(irregular))
        same, kept = np.concatenate(same), ~wrong[irregular // spans]
        if wrong.any():
            same, irregular, times = same[~np.repeat(wrong, totals[3])], irregular[kept], times[kept]
            totals[:, wrong] = 0
        sha = [x.hexdigest() if x and not bad else "" for x, bad in zip(hashes, wrong)]
        return [
            *map(pa.array, totals[:3]), pa.array(sha, pa.string()), _lists(same, totals[3], pa.int32()),
            *(_lists(x, np.bincount(irregular // spans, minlength=n), kind) for x, kind in ((irregular % spans, pa.int64()), (times.astype(np.int32), pa.int32()))),
        ]

    def _found(self, parts: list[str]) -> tuple:
        """Whether each part is spelt by both sides, its tokens of A and B, and (all values on end, where each part's begin and the last one's end) of its groups as text, ids and pairs."""
        split = list(map(chunks_of, parts))
        numbered = pa.array(itertools.chain.from_iterable(split), pa.string()).dictionary_encode()
        ends = np.cumsum([0, *map(len, split)])
        del split
        names = numbered.dictionary.to_pylist()
        unknown = self.known.missing(set(names))
        if unknown:
            self.learn(list(unknown))
        found = list(map(self.known.__getitem__, names))
        n_a, n_b, *cuts = np.array(list(map(HEAD.unpack_from, found)), np.int64).T
        cuts = np.cumsum([np.full(len(found), HEAD.size), *cuts], axis=0)
        held = [[x[a:b] for x, a, b in zip(found, *at)] for at in (cuts[:2].tolist(), cuts[1:].tolist(), (cuts[2].tolist(), itertools.repeat(None)))]
        index = numbered.indices.to_numpy()
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[index])])[ends])
        return total(n_a > 0) == np.diff(ends), total(n_a), total(n_b), *(_joined(x, index, ends) for x in held)


def _joined(values: list[bytes], index: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The values of all chunks end to end, and where each row begins and the last one ends."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(index))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    data = memoryview(taken.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])]
    return data, (offsets - offsets[0])[ends]


def _lists(values: np.ndarray, per_row: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), pa.array(values, kind))


#: Tables outlive a task where Spark keeps its Python workers.
_TABLES: dict[tuple[str, str], Tokenizers] = {}
_CHUNKS: dict[tuple[tuple[str, str], int], ChunkTable] = {}


def tokenizers(paths: tuple[str, str]) -> Tokenizers:
    if paths not in _TABLES:
        _TABLES[paths] = Tokenizers(*paths)
    return _TABLES[paths]


def chunk_table(paths: tuple[str, str], most: int = TABLE_CHUNKS) -> ChunkTable:
    if (paths, most) not in _CHUNKS:
        _CHUNKS[paths, most] = ChunkTable(tokenizers(paths), most)
    return _CHUNKS[paths, most]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def _aligned(paths: tuple[str, str], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch):
                columns = chunk_table(paths, most).align(rows["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([rows["doc_id"], *columns], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "same", "pairs", "times"])

    return run


def _vector_counts(size: int):
    """Of all one-to-one groups of a task, in one vector over A's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids = batch["same"].flatten().to_numpy()
            for at in range(0, len(ids), SUMMED):
                total += np.bincount(ids[at : at + SUMMED], minlength=size)
        a = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(total[a])], names=["a", "n"])

    return run


def _sums(values: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of each row's ids' values. A row's ids begin where the one before ends; ``SUMMED`` are taken at once."""
    upto = np.zeros(len(ends), np.int64)
    for at in range(0, len(ids), SUMMED):
        running = np.concatenate([[0], np.cumsum(values[ids[at : at + SUMMED]])])
        upto += running[np.clip(ends - at, 0, len(running) - 1)]
    return np.diff(upto)


def _same_links(counts: np.ndarray, best: np.ndarray):
    """Sums over each text's one-to-one groups from the shared vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = batch["same"].flatten().to_numpy(), batch["same"].offsets.to_numpy()
            sums = [_sums(x, ids, ends - ends[0]) for x in (best.astype(np.int64), counts)]
            kept = [batch[x] for x in ("_row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums)], names=["_row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "best", "total"])

    return run


def count_pairs(aligned: DataFrame, paths: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(count of each A id's one-to-one link, highest count of each B id, irregular (pair, n) with ``best``).

    The vectors are as long as the vocabularies, whatever the corpus."""
    t = tokenizers(paths)
    found = aligned.select("same").mapInArrow(_vector_counts(len(t.a_bytes)), "a int, n long").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(t.a_bytes), np.int64)
    counts[found["a"].to_numpy()] = found["n"].to_numpy()
    pairs = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    pairs = cut(pairs, "pair_counts")
    b = F.pmod("pair", F.lit(t.span)).cast("int")
    highest = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(len(t.b_bytes), np.int64)
    best[highest["b"].to_numpy()] = highest["n"].to_numpy()
    known = t.same >= 0
    np.maximum.at(best, t.same[known], counts[known])
    shared = aligned.sparkSession.createDataFrame(pa.table({"b": pa.array(np.arange(len(best)), pa.int32()), "highest": pa.array(best)}))
    pairs = pairs.withColumn("b", b).join(F.broadcast(shared), "b")  # a row for each id of a vocabulary
    return counts, best, pairs.select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    paths = paths or default_paths()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    aligned = cut(rows.mapInArrow(_aligned(paths, TABLE_CHUNKS), COUNTED).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts, best, pairs = count_pairs(aligned, paths)
    same = tokenizers(paths).same
    regular = aligned.mapInArrow(_same_links(counts, (same >= 0) & (counts == best[same])), "_row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, best long, total long")
    links = aligned.select("_row", F.pmod("_row", F.lit(SALTS)).alias("salt"), F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", "salt", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    salted = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    irregular = links.join(salted, ["pair", "salt"]).groupBy("_row").agg(F.sum(F.col("times") * F.col("best")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_total"))
    plus = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0).cast("long"))
    return regular.join(irregular, "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), plus("best", "_best").alias("n_best"), plus("total", "_total").alias("count_sum"), "groups_sha256"
    )
