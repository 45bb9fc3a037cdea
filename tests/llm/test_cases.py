"""Null and repeated ids, repeated rows, empty tables, odd pages and the operators' own promises."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import collect, docs, repeated

#: (doc_id, text, source): null ids, an id on two equal rows and on unlike ones, copies under several ids.
ROWS = [(None, "alpha beta"), (None, "alphabeta"), (7, "seven eight nine"), (7, "seven eight nine"), (7, "unlike text here"), (8, "unlike text here"), (None, None), (9, ""), (9, None), (10, "alpha  beta ")]


def frame(spark):
    return repeated(spark, [(i, t, ("a", "b", None)[n % 3]) for n, (i, t) in enumerate(ROWS)])


def counted(rows, *fields):
    out = {}
    for r in rows:
        key = tuple(r[f] for f in fields)
        out[key] = out.get(key, 0) + 1
    return out


def want_counts(values):
    out = {}
    for v in values:
        out[v] = out.get(v, 0) + 1
    return out


def test_exact_dedup_with_null_and_repeated_ids(spark):
    from fraudlens.llm.exact_dedup import exact_dedup

    got = exact_dedup(frame(spark)).collect()
    norm = [re.sub(r"\s", "", t or "") for _, t in ROWS]
    want = []
    for n, (i, _) in zip(norm, ROWS):
        same = [(-len(t or ""), j is None, j) for m, (j, t) in zip(norm, ROWS) if m == n]
        best = min(same, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want.append((i, best, len(same), i == best, hashlib.sha256(n.encode()).hexdigest()))
    assert counted(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want_counts(want)


def test_mix_with_null_and_repeated_ids(spark):
    from fraudlens.llm.mixing import plan_mix

    got = plan_mix(frame(spark)).collect()
    assert counted(got, "doc_id", "size") == want_counts((i, len((t or "").split())) for i, t in ROWS)
    assert plan_mix(frame(spark).limit(0)).count() == 0


def test_targets_equal_a_plain_water_filling(spark):
    from fraudlens.llm.mixing import source_targets

    rng = random.Random(3)
    sizes = [(f"s{i:02}", int(2 ** rng.uniform(0, 20))) for i in range(40)] + [("zero", 0), (None, 900)]
    got = {r._source: r._target for r in source_targets(spark.createDataFrame(sizes, "_source string, _source_size long").repartition(5)).collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, (s, _) in enumerate(order)}
    target, free, left = {}, dict(order), sum(n for _, n in order)
    while True:  # cap the sources that are above, share the rest again
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * free[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * free.pop(s)
            left -= target[s]
    target |= {s: level * weight[s] for s in free}
    assert got.keys() == target.keys() and all(got[s] == pytest.approx(target[s]) for s in target)


def test_tokens_with_null_and_repeated_ids(spark):
    from fraudlens.llm.token_orc import default_tokenizer, tokens_through_orc
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    coded = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in ROWS]
    got = tokens_through_orc(frame(spark)).collect()
    assert counted(got, "doc_id", "n_tokens", "ids_crc32") == want_counts((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in coded)
    at = 0  # starts run on without gaps, in ascending order of ids
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_lookup_reads_few_rows_and_stripes_split(spark, tmp_path):
    from fraudlens.llm.token_orc import lookup_tokens, read_token_orc, write_token_orc

    folder = f"file://{tmp_path}/orc"
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(40)) for _ in range(6000)]
    table = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    write_token_orc(table, folder, stripe_bytes=64 << 10, stride_rows=1000)

    def read(frame):
        rows = frame.collect()
        plan = frame._jdf.queryExecution().executedPlan()
        return rows, plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    rows, scanned = read(lookup_tokens(spark, folder, [3 * 4321]))
    assert [r.doc_id for r in rows] == [3 * 4321] and scanned <= 2000
    rows, scanned = read(lookup_tokens(spark, folder, [3 * 4321 + 1]))  # in range, but no document: the Bloom filter says so
    assert not rows and scanned <= 1000
    bound = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 64 << 10)
        whole = read_token_orc(spark, folder)
        files = whole.select(F.input_file_name().alias("f")).distinct().count()
        assert whole.rdd.getNumPartitions() > files and whole.count() == whole.select("doc_id").distinct().count() == 6000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bound)


def test_language_id_equals_a_plain_softmax(spark):
    from fraudlens.llm import langid

    rng = random.Random(2)
    kinds = {"aa": "abcd", "bb": "cdef", "cc": "efgh"}
    rows = []
    for i in range(240):
        lang = sorted(kinds)[i % 3]
        rows.append((rng.choice([None, 5, i]), " ".join("".join(rng.choice(kinds[lang]) for _ in range(4)) for _ in range(12)), lang))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table)
    assert model.languages == sorted(kinds)
    w = model.weights
    weight = {(f, int(w.language[i])): float(w.value[i]) for f in range(len(w.first) - 1) for i in range(w.first[f], w.first[f + 1])}
    assert 0 < len(weight) < 3 * len(model.idf)

    def plain(text):
        s = " " + re.sub("[^a-z]+", " ", text.lower()).strip() + " "
        numbers = {}
        for n in (1, 2, 3):
            for k in range(len(s) - n + 1):
                h = [ord(c) for c in s[k : k + n]]
                v = h[0] * 0x9E3779B1 & 0xFFFFFFFF if n == 1 else None
                if n > 1:
                    v = ((((h[0] * 0x9E3779B1 & 0xFFFFFFFF) ^ 0x5BD1E995) * 0x85EBCA6B) + h[1] * 0xC2B2AE35) & 0xFFFFFFFF
                if n > 2:
                    v = (((v ^ 0x27D4EB2F) * 0x165667B1) + h[2] * 0x9E3779B1) & 0xFFFFFFFF
                v ^= v >> 15
                at = (v * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - int(math.log2(len(model.idf))))
                numbers[at] = numbers.get(at, 0) + 1
        x = {at: (1 + math.log(c)) * model.idf[at] for at, c in numbers.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        z = [sum(v / size * weight.get((at, k), 0.0) for at, v in x.items()) / model.temperature for k in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        return max(zip([v / sum(e) for v in e], model.languages))

    got = langid.identify(table, model=model).select("doc_id", "held_out", "lang_pred", "score").collect()
    want = sorted((str(i), zlib.crc32(str("" if i is None else i).encode()) % 4 == 2, plain(t)[1], round(plain(t)[0], 5)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 5)) for r in got) == want


def test_every_language_is_learned(spark):
    from fraudlens.llm import langid

    rows = [(4 * n + k, f"{'qwertzuiop'[n % 10]}{'asdfghjkly'[n // 10 % 10]}{'xcvbnm'[n // 100]}" * 5, f"l{n:03}") for n in range(300) for k in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table)
    assert len(model.languages) == len({lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}) > 250
    assert len(model.idf) == langid.FEATURES  # however many languages there are


def test_follow_the_leader_and_temperature_equal_plain_ones():
    from fraudlens.llm.langid import SparseWeights, fit_temperature, follow_leader

    rng = random.Random(4)
    rows = []
    for _ in range(40):
        y = rng.randrange(3)
        at = sorted(rng.sample(range(8), 3) if rng.random() < 0.4 else {y, y + 3, rng.randrange(8)})
        rows.append((np.array(at), np.array([rng.random() for _ in at]), y))
    alpha, beta, l1, l2 = 0.3, 1.0, 1.0, 0.05
    z, n = [[0.0] * 3 for _ in range(8)], [[0.0] * 3 for _ in range(8)]
    w = lambda f, k: 0.0 if abs(z[f][k]) <= l1 else -(z[f][k] - math.copysign(l1, z[f][k])) / ((beta + math.sqrt(n[f][k])) / alpha + l2)
    for _ in range(2):
        for at, x, y in rows:
            held = {(f, k): w(f, k) for f in at for k in range(3)}
            e = [math.exp(sum(v * held[f, k] for f, v in zip(at, x))) for k in range(3)]
            for f, v in zip(at, x):
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y))
                    z[f][k] += g - (math.sqrt(n[f][k] + g * g) - math.sqrt(n[f][k])) / alpha * held[f, k]
                    n[f][k] += g * g
    got = follow_leader(rows, 8, 3, epochs=2, l1=l1)
    assert np.allclose(got, [[w(f, k) for k in range(3)] for f in range(8)]) and (got == 0).any() and (got != 0).any()
    sparse = SparseWeights.of(12, np.array([0, 1, 3, 4, 5, 7, 9, 11]), got)
    at, x = np.array([1, 2, 9, 11]), np.array([0.5, 2.0, 1.0, 3.0])
    assert np.allclose(sparse.scores(at, x), 0.5 * got[1] + got[6] + 3 * got[7])
    scores, classes = np.array([x @ got[at] for at, x, _ in rows]) * 9, np.array([y for _, _, y in rows])
    loss = lambda t: -sum(math.log(math.exp(s[y] / t) / sum(math.exp(v / t) for v in s)) for s, y in zip(scores, classes))
    t = fit_temperature(scores, classes)
    assert loss(t) <= min(loss(t * 1.05), loss(t / 1.05)) + 1e-9


def test_rows_of_one_id_are_dealt(spark):
    """A third of the rows, and more, without an id or with one: no range, no shard takes them all."""
    from fraudlens.llm.exact_dedup import exact_dedup
    from fraudlens.llm.sharding import shard_by_bytes
    from fraudlens.llm.token_orc import read_token_orc, tokens_through_orc, write_token_orc

    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(5, 30)))
    rows = [(None if i < 3000 else i, "the same text" if i % 3 == 0 else text()) for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        folder = f"{spark.conf.get('spark.checkpoint.dir')}/hot_id"
        write_token_orc(table, folder)
        parts = [r["count"] for r in read_token_orc(spark, folder).groupBy("part").count().collect()]
        assert len(parts) == 8 and max(parts) < 800
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens) for r in tokens_through_orc(table).collect())
    ends = [0]
    for _, start, n in sorted(got, key=lambda r: r[1]):
        assert start == ends[-1]
        ends.append(start + n)
    assert [k for k, *_ in sorted(got, key=lambda r: r[1])] == [k for k, *_ in got]
    loads = {}
    for r in shard_by_bytes(table).collect():
        loads[r.shard] = loads.get(r.shard, 0) + r.size * (r.doc_id is None)
    assert len(loads) == 8 and max(loads.values()) < 3 * min(loads.values())
    kept = [r for r in exact_dedup(table).collect() if r.kept]
    assert len(kept) == len({t.replace(" ", "") for _, t in rows}) == len({r.text_sha256 for r in kept})


def test_placement_of_slots_equals_a_plain_one(spark):
    """Slots, largest first, each to the least loaded shard; places in the order of slots, ids, checksums."""
    from fraudlens.llm.sharding import shard_by_bytes

    rng = random.Random(6)
    rows = [(rng.choice([None, 7, i]), rng.choice([None, "", "x" * rng.randrange(1, 90), "same"])) for i in range(400)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=3, slots=32).collect()
    of = {}
    for r in got:
        assert of.setdefault((r.doc_id, r.text_crc32, r.size), r.v_slot) == r.v_slot
    slots = {}
    for i, t in rows:
        raw = (t or "").encode()
        slots.setdefault(of[i, zlib.crc32(raw), len(raw) + 1], []).append((i is not None, i or 0, zlib.crc32(raw), len(raw) + 1))
    loads, at = [0] * 3, [0] * 3
    shard = {}
    for v in sorted(slots, key=lambda v: (-sum(x[3] for x in slots[v]), v)):
        shard[v] = loads.index(min(loads))
        loads[shard[v]] += sum(x[3] for x in slots[v])
    want = []
    for v in sorted(slots):
        for some, i, crc, size in sorted(slots[v]):
            want.append((shard[v], at[shard[v]], i if some else None, crc, size))
            at[shard[v]] += 1
    assert sorted(((r.shard, r.slot, r.doc_id, r.text_crc32, r.size) for r in got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_near_components_with_null_and_repeated_ids(spark):
    from fraudlens.llm.near_dedup import near_components

    one, two = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(4, one), (4, two), (3, one + " end"), (5, two + " end"), (5, two + " end"), (None, "z " + one), (None, "lone words in a row"), (None, None), (6, None)]
    got = near_components(repeated(spark, [(i, t, "a") for i, t in rows]), words=4).collect()
    # each row is linked by its own text: id 4 stands in both components
    want = [(4, 57, 3, False), (4, 57, 4, True), (3, 58, 3, True), (5, 58, 4, False), (5, 58, 4, False), (None, 58, 3, False), (None, 2, None, True), (None, 0, None, True), (6, 0, 6, True)]
    assert counted(got, "doc_id", "n_shingles", "component_id", "kept") == want_counts(want)


def test_second_round_finds_every_link_of_any_block(spark):
    import pyarrow as pa

    from fraudlens.llm.near_dedup import _joining

    rng = np.random.default_rng(1)

    def closed(pairs, start):
        above = {c: c for c in start}

        def root(x):
            while above[x] != x:
                x = above[x]
            return x

        for a, b in pairs:
            x, y = root(start[a]), root(start[b])
            above[max(x, y)] = min(x, y)
        return [root(c) for c in start]

    for _ in range(60):
        n, base = int(rng.integers(2, 30)), rng.integers(0, 2**62, rng.integers(3, 60))
        sets = []
        for _ in range(n):
            x = base.copy()
            x[rng.choice(len(x), rng.integers(0, len(x) // 4 + 2), replace=False)] = rng.integers(0, 2**62)
            sets.append(np.unique(x[: rng.integers(max(1, len(x) - 3), len(x) + 1)]).astype("<u8"))
        start, block = rng.integers(0, n, n).tolist(), rng.integers(0, 2, n).tolist()
        found = []
        for low, high in ((0, 0), (0, 1), (1, 1)):
            m = [i for i in range(n) if block[i] in (low, high)]
            if m:
                rows = {"class": m, "component": [start[i] for i in m], "shingles": [sets[i].tobytes() for i in m], "_b": [block[i] for i in m], "_low": [low] * len(m), "_high": [high] * len(m)}
                links = _joining(80)(pa.table(rows))
                found += zip(links["a"].to_pylist(), links["b"].to_pylist())
        shared = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
        linked = [(i, j) for i in range(n) for j in range(i) if 100 * shared(i, j) >= 80 * (len(sets[i]) + len(sets[j]) - shared(i, j))]
        assert closed(found, start) == closed(linked, start)


def test_blocks_of_a_large_group_meet_all_but_the_largest_component(spark, monkeypatch):
    from fraudlens.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 100)
    monkeypatch.setattr(near_dedup, "SMALL_SHINGLES", 50)
    rows = [(1, i, 10, 0) for i in range(60)] + [(1, 60 + i, 10, 60 + i) for i in range(35)] + [(2, 0, 10, 0), (2, 99, 10, 99)]
    meets = spark.createDataFrame(rows, "first long, class long, n long, component long")
    at = {}
    for r in near_dedup._blocks(meets).collect():
        assert r._b in (r._low, r._high)
        at.setdefault((r["first"], r._low, r._high), []).append((r["class"], r._b))
    met = {(a, b) for rows in at.values() for a, x in rows for b, y in rows if a < b}
    for a, b in ((a, b) for a in range(95) for b in range(a + 1, 95)):
        assert a < 60 and b < 60 or (a, b) in met
    assert all({b for _, b in rows} == {low, high} for (_, low, high), rows in at.items())
    small = at[2, 0, 0]
    assert [k for k in at if k[0] == 2] == [(2, 0, 0)] and len(small) == 2


def test_sentencepiece_with_repeated_ids_and_many_chunks(spark):
    import sentencepiece

    from fraudlens.llm.sentencepiece_ids import default_model, encode_by_table, round_trip

    p = sentencepiece.SentencePieceProcessor(model_file=default_model())
    rng = random.Random(9)
    words = [f"w{i:x}q" for i in range(3000)]
    texts = ROWS + [(20 + k, " ".join(rng.sample(words, 900))) for k in range(12)]
    table = repeated(spark, [(i, t, "a") for i, t in texts])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = want_counts((i, len(x), sha(",".join(map(str, x))), sha(p.decode(x) if x else "")) for i, x in ((i, p.encode(t or "")) for i, t in texts))
    for most in (400_000, 500):  # more distinct chunks than the table holds, in batch after batch
        assert counted(round_trip(table, most=most).collect(), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    got = encode_by_table(table).collect()
    assert want_counts((r.doc_id, tuple(r.ids)) for r in got) == want_counts((i, tuple(p.encode(t or ""))) for i, t in texts)


def test_sharding_with_null_and_repeated_ids(spark):
    from fraudlens.llm.sharding import shard_by_bytes

    got = shard_by_bytes(frame(spark)).collect()
    assert counted(got, "doc_id", "size", "text_crc32") == want_counts((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_the_stored_map_is_edited(spark, tmp_path):
    from fraudlens.llm.sharding import place_slots, rebalance, store_map, stored_map

    folder = f"file://{tmp_path}/map"
    rng = random.Random(4)
    sizes = spark.createDataFrame([(i, rng.randrange(1, 500), 2) for i in range(400)], "v_slot int, bytes long, rows long")
    store_map(place_slots(sizes, 8), folder)
    first = collect(stored_map(spark, folder), "v_slot")

    def loads(version=None):
        out = {}
        for r in stored_map(spark, folder, version).collect():
            out[r.shard] = out.get(r.shard, 0) + r.bytes
        return [out[k] for k in sorted(out)]

    for version, shards in ((2, 9), (3, 8), (4, 6)):
        store_map(rebalance(stored_map(spark, folder), shards), folder)
        assert len(loads()) == shards and max(loads()) - min(loads()) < 1000 and len(stored_map(spark, folder).collect()) == 400
        assert {r.version for r in stored_map(spark, folder).collect()} == {version}
    assert collect(stored_map(spark, folder, 1), "v_slot") == first and loads(1) == [sum(r.bytes for r in first.values() if r.shard == k) for k in range(8)]
    # the same number of shards, but slots that grew: only what must move moves
    grown = sizes.withColumn("bytes", F.when(F.col("v_slot") < 60, F.col("bytes") * 5).otherwise(F.col("bytes")))
    edited = collect(rebalance(stored_map(spark, folder, 1), 8, grown), "v_slot")
    moved = [s for s in edited if edited[s].shard != first[s].shard]
    sums = [sum(r.bytes for r in edited.values() if r.shard == k) for k in range(8)]
    assert 0 < len(moved) < 200 and max(sums) - min(sums) < 2500 and edited.keys() == first.keys()


def test_urls_of_repeated_rows(spark):
    from fraudlens.llm.url_filter import judge_urls

    urls = ["http://a.example.net/en/1", "http://x.net/de/2", "http://free.io/z"] * 5 + [None, None]
    pages = spark.createDataFrame([(i % 4 or None, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = judge_urls(pages).collect()
    assert len(got) == len(urls) and len({(r.host, r.path, r.rule, r.verdict) for r in got}) == 4


# --- pages

LONG = "A sentence of the article, with commas, that is long enough to count. "


def test_path_ratios_equal_plain_ones():
    from fraudlens.llm.html_extract import LINK_FACTOR, leaf_values, text_leaves

    html = f"<body><ul><li><a>one</a><li><a>two, three</a></ul><div><h1>Head</h1><p>{LONG}<b>bold, text</b></p><p>{LONG * 2}</p></div><footer>foot.</footer></body>"
    leaves, _ = text_leaves(html)
    sizes = np.array([len("".join(t.split())) for _, _, t in leaves])
    path = lambda e: (path(e.parent) if e.parent else "") + "/" + e.name
    paths = {}
    for (e, _, t), n in zip(leaves, sizes):
        paths.setdefault(path(e), []).append((n, sum(c in ".,;:!?" for c in t)))
    fused = [sum(n for n, _ in paths[path(e)]) / len(paths[path(e)]) * (1 + sum(m for _, m in paths[path(e)]) / len(paths[path(e)])) for e, _, _ in leaves]
    for k, value in enumerate(leaf_values(leaves, sizes)):
        near = [(math.exp(-d * d / 2), fused[k + d]) for d in range(-2, 3) if 0 <= k + d < len(fused)]
        link = LINK_FACTOR if leaves[k][0].in_link else 1.0
        assert value == pytest.approx(sum(a * b for a, b in near) / sum(a for a, _ in near) * leaves[k][0].factor * link)


def test_names_are_evidence_only_and_ratios_decide(monkeypatch):
    from fraudlens.llm import html_extract as H

    lines = f"Related work\n{LONG.strip()}\nShort.\n{LONG.strip()}"
    body = f'<h2 id="related-work">Related work</h2><p class="share-price">{LONG}</p><p>Short.</p><p>{LONG}</p>'
    for page in (
        f'<div class="content-sidebar-wrap"><div id="main">{body}</div><div class="sidebar"><p>Other things.</p></div></div><footer>The foot, a text.</footer>',
        f'<nav><a href="/">Home</a></nav><article class="post has-comments"><header class="entry-header"></header>{body}<div class="comments"><p>Nice, thanks a lot.</p></div></article>',
        f"<div><a>Home</a> <a>About us</a></div><div>{body}</div><div><a>More of it</a></div><div>Contact</div>",
    ):
        assert H.main_text(page) == lines
    plain = f"<div><span>Home</span> <span>About</span></div><div>{body}</div><div>Contact</div>" + "<div>x</div>" * 40
    assert H.main_text(plain) == lines
    monkeypatch.setattr(H, "content_leaves", lambda leaves, sizes, share=0.5: sizes > 0)
    assert H.main_text(plain) != lines


THREADS = [
    lambda p: f'<section class="comments"><ul>{"".join(f"<li><p>{x}</p></li>" for x in p)}</ul></section>',
    lambda p: f'<div id=comments>{"".join(f"<div><p>{x}</p></div>" for x in p)}</div>',
    lambda p: f'<div class="comment-list">{"".join(f"<article class=comment><h4>A reader</h4><p>{x}</p></article>" for x in p)}</div>',
    lambda p: "".join(f'<div class="comment"><p>{x}</p></div>' for x in p),
    lambda p: f'<aside>{"".join(f"<p>{x}</p>" for x in p)}</aside>',
]


@pytest.mark.parametrize("thread", THREADS)
@pytest.mark.parametrize("times", [1, 2, 3, 8])
@pytest.mark.parametrize("many", [1, 6])
@pytest.mark.parametrize("short", [False, True])
def test_comments_go_however_long(thread, times, many, short):
    from fraudlens.llm.html_extract import main_text

    paragraphs = ["Two short lines, no more.", "This is all of it."] if short else [LONG.strip()] * 4
    body = "<h1>The title</h1>" + "".join(f"<p>{x}</p>" for x in paragraphs)
    said = thread([LONG * times] * many)
    want = "\n".join(["The title", *paragraphs])
    for page in (f"<body><nav>menu</nav><article>{body}</article>{said}</body>", f"<body><article>{body}{said}</article><footer>foot</footer></body>", f"<main><article>{body}</article>{said}</main>"):
        assert main_text(page) == want
    if not short:
        assert main_text(f"<body><div class=page><div class=story>{body}</div>{said}</div></body>") == want


def test_unnamed_thread_beside_an_article():
    from fraudlens.llm.html_extract import main_text

    page = f"<body><article><h1>T</h1><p>Two short lines, no more.</p></article><div>{'<div><p>' + LONG * 3 + '</p></div>'}</div></body>"
    assert main_text(page) == "T\nTwo short lines, no more."


def test_what_belongs_to_the_article_stays():
    from fraudlens.llm.html_extract import main_text

    p = f"<p>{LONG}</p>"
    line = LONG.strip()
    kept = '<div id="related-work">Earlier, others did so.</div><div class="share-price">It rose to 5.</div><table class="menu-prices"><tr><td>Soup 4</td></tr></table><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.</p>'
    assert main_text(f"<article>{p}{kept}{p}</article>") == f"{line}\nEarlier, others did so.\nIt rose to 5.\nSoup 4\nSo x=2.\n{line}"
    # the title and the lead of a sibling, beside menus and adverts
    page = f'<body><div class="nav"><a>Home</a></div><div class=wrap><div class=head><h1>Title</h1><p>The lead.</p></div><div class="ad-container"><p>{LONG * 2}</p></div><div class=text>{p * 4}</div></div></body>'
    assert main_text(page) == "\n".join(["Title", "The lead.", *[line] * 4])
    # a name on the wrapper of the article, or round the only text, means nothing
    for wrapper in ('<div class="widget">{}</div><div class="widget">Other</div>', '<form>{}</form>', '<div class="sidebar">{}</div>'):
        assert main_text("<body><p>skip</p>" + wrapper.format(f"<article>{p}</article>") + "</body>") == line
    assert main_text(f'<div class="comments">{p}</div>') == line
    # as browsers read them: the first > ends a CDATA section, references do not cross tags
    assert main_text(f"<article>{p}<p>a <![CDATA[ hidden > shown ]]> z</p><p>&am<b>p;lt;</b> &lt;b&gt;</p></article>") == f"{line}\na shown ]]> z\n&amp;lt; <b>"


@pytest.mark.parametrize("html", ["<b>x" * 100_000, "<b>x</i>" * 100_000, "<p>x" * 100_000, "<i><div>" * 50_000 + "<b>x</i>" * 50_000, "<div class='a b'>" * 100_000, "<!--" * 50_000, "<script>" * 50_000, '<a "' * 50_000])
def test_deep_and_broken_pages_take_linear_time(html):
    from fraudlens.llm.html_extract import main_text

    def seconds(text):
        start = time.process_time()
        main_text(text)
        return time.process_time() - start

    half = max(0.02, seconds(html[: len(html) // 2]))
    assert seconds(html) < 4 * half + 0.5


def test_pages_of_repeated_rows(spark):
    from fraudlens.llm.html_extract import extract_main_text

    rows = [(1, "u", f"<p>{LONG}"), (1, "u", f"<p>{LONG}"), (None, None, "<p>" + "word, " * 200_000)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in got) == [len(LONG) - 1, len(LONG) - 1, 6 * 200_000 - 1] and sum(r.page_id is None for r in got) == 1


# --- pipeline


def test_pipeline_of_nothing_and_of_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80))
    rows = [(n % 3 or None, text if n % 2 else f"{text} more {'kl' * n} words", "en", "s", 1, "x", "y", "z") for n in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size string, kept string"
    for name, table in (("none", spark.createDataFrame([], schema)), ("some", spark.createDataFrame(rows, schema))):
        at = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, "")
            assert at.columns == table.columns
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        n = corpus_pipeline.run(spark, str(tmp_path / name)).count()
        assert n == at.count() and (n > 0) == (name == "some")


def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece

    from fraudlens.llm.langid import UNKNOWN, identify
    from fraudlens.llm.mixing import SCHEDULES, integral
    from fraudlens.llm.sentencepiece_ids import default_model

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [" ".join(word() for _ in range(rng.randrange(20, 70))) for _ in range(60)]
    texts += [t + " " for t in texts[:6]] + [" ".join([*t.split()[:-1], word()]) for t in texts[10:18]] + [None, "12 !", "short one"]
    rows = [(n, t, "en", ("a", "b", None)[n % 3], len(t or "")) for n, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))

    known = {r.doc_id for r in identify(table).collect() if r.lang_pred != UNKNOWN and r.score >= 0.3}
    left = [r for r in rows if r[0] in known]
    best = {}
    for r in left:
        key = "".join(r[1].split())
        if key not in best or (-len(r[1]), r[0]) < (-len(best[key][1]), best[key][0]):
            best[key] = r
    left = sorted(best.values())
    sets = {r[0]: frozenset(zip(*(r[1].lower().split()[k:] for k in range(5)))) or frozenset([tuple(r[1].lower().split())]) for r in left}
    at = {i: i for i in sets}
    for i in sets:  # the links of these texts are pairs: the least id of a pair stays
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                at[j] = min(at[j], at[i])
    left = [r for r in left if at[r[0]] == r[0]]
    words = {r[0]: len(r[1].split()) for r in left}
    by_source = {}
    for r in sorted(left, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    size = {s: sum(words[r[0]] for r in by_source[s]) for s in names}
    weight = {s: integral(SCHEDULES[k % 3]) for k, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(size.values())
    while any(rest / sum(weight[s] for s in free) * weight[s] > 3 * size[s] for s in free):
        for s in [s for s in free if rest / sum(weight[x] for x in free) * weight[s] > 3 * size[s]]:
            target[s] = 3 * size[s]
            free.discard(s)
            rest -= target[s]
    target |= {s: rest / sum(weight[x] for x in free) * weight[s] for s in free}
    want = []
    p = sentencepiece.SentencePieceProcessor(model_file=default_model())
    for s in names:
        full, start = int(target[s] // size[s]), 0
        more = round(target[s] - full * size[s])
        for r in by_source[s]:
            n = words[r[0]]
            taken = full * n + max(0, min(n, more - start))
            start += n
            ids = p.encode(r[1])
            want += [(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] * int(taken / n + 0.5)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert counted(got, "doc_id", "n_tokens", "ids_sha256") == want_counts(want) and 0 < len(left) < len(known) < len(rows)
