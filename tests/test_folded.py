"""Folded tables: bounded folders, repeated batches, and the jobs that keep them."""

import datetime as dt
import hashlib
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from fraudlens.folded import FoldedTable
from fraudlens.operators import embedding, graph, propagation
from fraudlens.operators.syndicate_store import SyndicateStore


def test_fifty_batches_of_fingerprints_in_bounded_folders(spark, tmp_path):
    store = lambda: FoldedTable(spark, str(tmp_path / "t"), propagation.FINGERPRINT, propagation.fingerprint_fold, 8)
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    schema = "msg_id long, ts timestamp, text string, forwarded boolean, source_channel string"
    rows = [(i, start + dt.timedelta(minutes=i), f"text {'hot' if rng.random() < 0.4 else rng.randrange(9)}", rng.random() < 0.1, rng.choice(["sms", "whatsapp", None])) for i in range(150)]
    prints = lambda some: propagation.fingerprints(spark.createDataFrame(some, schema)).coalesce(1)
    for n in range(50):
        store().put(n, prints(rows[3 * n : 3 * n + 3]))
        store().compact()
        assert len(os.listdir(tmp_path / "t/delta")) <= 16
    assert len(os.listdir(tmp_path / "t/base")) <= 2 and store().folded() == 47
    table = lambda: sorted(map(tuple, store().read().collect()))
    want = sorted(map(tuple, prints(rows).collect()))
    assert table() == want
    for n in (0, 20, 47, 48, 49):  # any batch may run again
        store().put(n, prints(rows[3 * n : 3 * n + 3]))
        store().compact()
    assert table() == want


def test_a_base_whose_write_broke_off_does_not_count(spark, tmp_path):
    table = FoldedTable(spark, str(tmp_path / "t"), "k long, n long", lambda x: x.groupBy("k").agg(F.sum("n").alias("n")), 2)
    assert table.read().count() == 0 and table.folded() == -1
    row = lambda n: spark.createDataFrame([(1, n)], "k long, n long")
    table.put(0, row(1))
    table.put(1, row(2))
    (tmp_path / "t/base/upto=1").mkdir(parents=True)
    (tmp_path / "t/base/upto=1/part-0.parquet").write_bytes(b"broken")
    assert [tuple(r) for r in table.read().collect()] == [(1, 3)]
    assert [tuple(r) for r in table.read(before=1).collect()] == [(1, 1)]
    table.compact()
    table.put(1, row(50))
    assert table.folded() == 1 and [tuple(r) for r in table.read().collect()] == [(1, 3)]
    with pytest.raises(ValueError):
        table.read(before=1)


def keys_of(rng, n, nodes):
    kinds = lambda i: f"{('phone', 'upi', 'agent')[i % 3]}:{i}"
    return [(kinds(rng.randrange(nodes)), kinds(rng.randrange(nodes))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_syndicates_of_increments_equal_one_run(spark, tmp_path, seed):
    rng, schema = random.Random(seed), "a string, b string"
    # ends that are null, self-loops, repeats, components joined late, a batch without edges
    parts = [keys_of(rng, 25, 60), keys_of(rng, 12, 60) + [("phone:999", "phone:999"), (None, "upi:1")], [], keys_of(rng, 12, 60)]
    parts[3] += parts[0][:3]
    edges = [spark.createDataFrame(p, schema).coalesce(1) for p in parts]
    store = lambda: SyndicateStore(spark, str(tmp_path / "s"), 3)
    rows = lambda frame: sorted(str(tuple(r)) for r in frame.collect())
    told = lambda: (rows(store().labels.read().select("node", "component")), rows(store().syndicates()), rows(store().members()))
    for n, part in enumerate(edges):
        store().add(n, part)
        if n == 1:
            before = told()
            store().add(n, part)  # again, before it is folded
            assert told() == before
    whole = spark.createDataFrame([e for p in parts for e in p], schema).coalesce(1)
    found = graph.syndicates(whole)
    want = (rows(graph.connected_components(whole, "a", "b")), rows(found), rows(graph.syndicate_members(whole).select(*store().members().columns)))
    assert len(want[1]) > 0 and told() == want
    named = [(r.fingerprint, hashlib.sha256("|".join(r.entities).encode()).hexdigest(), sorted(r.entities) == r.entities) for r in store().syndicates().collect()]
    assert all(a == b and in_order for a, b, in_order in named)
    store().add(0, edges[0])  # again, folded since
    assert told() == want and store().labels.folded() == 2


def plain_vector(text, size):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower) if w]
    out = [0] * size
    for gram in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
        out[int(hashlib.md5(gram.encode()).hexdigest()[:7], 16) % size] += 1
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if words else None


def test_encoder_equals_plain_python(spark):
    rng = random.Random(11)
    texts = [None, "", " .,;!\n", "Pay", "pay PAY pay", "\u00dcber Stra\u00dfe \u0928\u094c\u0915\u0930\u0940", "a\u00a0b", "x" * 5000, "a b " * 20000]
    texts += [" ".join(rng.choice(["Fee", "job", "visa,", "50-60", "\u0130\u212a"]) for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    for size in (1, 2, 64):
        rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        got = {r.id: r.v for r in rows.select("id", embedding.encoded(F.col("text"), size).alias("v")).collect()}
        for i, text in enumerate(texts):
            want = plain_vector(text, size)
            assert got[i] == want if want is None else got[i] == pytest.approx(want, abs=1e-12), (size, text[:20])
        worded = {r.id for r in rows.filter(embedding.has_words(F.col("text"))).collect()}
        assert worded == {i for i in got if got[i] is not None}


def test_centroids_of_increments_equal_one_run(spark, tmp_path):
    rng, schema = random.Random(4), "cluster string, text string, embedding array<float>"
    vector = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(rng.choice(["scam", "legitimate", None]), rng.choice(["pay now", "good job", "", None]), rng.choice([vector(), None])) for _ in range(120)]
    odd = [("scam", None, [1.0, 2.0]), ("scam", None, [float("nan")] * 8), ("scam", None, [None] * 8), ("scam", None, [float("-inf")] * 8), ("only odd", "", None)]
    zero = [("zero", None, [0.0] * 8)]
    frame = lambda some: spark.createDataFrame(some, schema).coalesce(1)
    store = lambda: embedding.centroid_store(spark, str(tmp_path / "c"), 8)
    for n, part in enumerate([rows[:50], odd, rows[50:], zero, []]):
        embedding.add_postings(store(), n, frame(part), 8)
    embedding.add_postings(store(), 2, frame(rows[50:]), 8)  # again
    got = {r.cluster: (r.sample_count, r.centroid) for r in embedding.centroids_of(store().read()).collect()}
    want = {}
    for cluster, text, v in rows + zero:
        v = v or plain_vector(text, 8)
        if v:
            want.setdefault(cluster, []).append(v)
    assert set(got) == set(want)
    for cluster, vectors in want.items():
        mean = [sum(x) / len(vectors) for x in zip(*vectors)]
        norm = math.sqrt(sum(x * x for x in mean))
        assert got[cluster][0] == len(vectors)
        assert got[cluster][1] == pytest.approx([x / norm if norm else 0.0 for x in mean], abs=1e-6)


def test_a_text_is_encoded_once(spark):
    rows = spark.createDataFrame([("scam", "pay", None)], "cluster string, text string, embedding array<float>")
    plan = embedding.centroid_sums(embedding.embed_missing(rows, 64), 64)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
