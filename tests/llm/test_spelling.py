"""Spelling variants against plain Python, with crowded nodes and odd rows."""

import random
import zlib
from collections import Counter

import duckdb
import pytest

from fraudlens.llm import spelling
from fraudlens.llm.queries import ORACLE_SQL

SCHEMA = "doc_id long, text string, word string, n string, form string"


def plain(rows):
    count = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        some = [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(some, key=lambda x: (-words[x], x), default=None)
        out[w] = [best if best and words[best] >= 2 * n else None, None, n, len(some)]
    for w, row in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        row[1] = at
    return {w: (f, root, n, k, words[f] if f else None) for w, (f, root, n, k) in out.items()}


def result(frame):
    rows = frame.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def variants(seed, letters, size=5, words=60):
    """Texts of words a few edits from each other, in uneven numbers."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(6)]
    for _ in range(words):
        w = list(rng.choice(base))
        kind, at = rng.randrange(3), rng.randrange(len(w))
        if kind < 2:
            w[at : at + kind] = [rng.choice(letters)]
        elif len(w) > 5:
            del w[at]
        base.append("".join(w))
    return [(i, " ".join(rng.choices(base, [1 / (k + 1) for k in range(len(base))], k=30)) + rng.choice([".", "7", "\n"])) for i in range(60)]


@pytest.mark.parametrize("letters", ["abc", "abcdefghijklmnopqrstuvwxyzéÿ×", "aBÀà"])
@pytest.mark.parametrize("node_words", [spelling.NODE_WORDS, 3])
def test_equals_plain(spark, letters, node_words, monkeypatch):
    rows = variants(len(letters), letters) + [(None, "NULLE nulle Nulle nulla"), (3, None), (4, ""), (5, "x" * 300 + " " + "x" * 301 + " ")] + [(6, ("y" * 300 + " ") * 2 + "y" * 299)] * 3
    monkeypatch.setattr(spelling, "NODE_WORDS", node_words)
    monkeypatch.setattr(spelling, "TASK_WORDS", 30)
    monkeypatch.setattr(spelling, "BLOCK_QUERIES", 40)
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", 100)
    frame = spark.createDataFrame([(i, t, "w", "n", "f") for i, t in rows], SCHEMA).repartition(3)
    got, want = result(spelling.spelling_variants(frame)), plain(rows)
    assert got == want and len(want) > 20 and any(x[0] for x in want.values())


def test_levels_follow_the_vocabulary(spark):
    words = spark.createDataFrame([(w, 3) for w in {x for _, t in variants(1, "abcdefgh", 7, 400) for x in t.lower().split() if x.isalpha()}], "word string, n long")
    groups = spelling.letter_groups(words)
    few, many = spelling.key_levels(words, groups, 10**6), spelling.key_levels(words, groups, 2)
    assert few == 1 < many <= spelling.MOST_KEYS
    pairs = [{(r.word, r.near) for r in spelling.near_words(words, node_words=most).collect()} for most in (10**6, 2)]
    assert pairs[0] == pairs[1] and pairs[0]


def test_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b", "", "", "")], SCHEMA)
    assert spelling.spelling_variants(frame).count() == spelling.spelling_variants(frame.limit(0)).count() == 0


def test_equals_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    duck = duckdb.connect()
    duck.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    found = duck.sql(ORACLE_SQL["op11_spelling_variants"])
    want = {r[0]: r[1:] for r in found.select("word, form, root, n, n_near, form_n").fetchall()}
    assert result(spelling.spelling_variants(docs)) == want and len(want) > 1000
