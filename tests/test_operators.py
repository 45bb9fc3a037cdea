"""Operators on small hand-made tables, against plain Python."""

import datetime as dt
import hashlib
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fraudlens import constants as C
from fraudlens.functions import scores, text
from fraudlens.operators import dashboard, embedding, entities, graph, media_text, propagation, registry, upsert, verdict


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value, want",
    [("+91 98765 43210", "9876543210"), ("09876543210", "9876543210"), ("9876543210", "9876543210"), ("1234567890", "+1234567890"), ("+971-50-1234567", "+971501234567"), ("123", None), ("1" * 16, None), (None, None), ("", None)],
)
def test_phone_canonical(spark, value, want):
    assert one(spark, text.phone_canonical, value) == want


def test_entities_of_messages(spark):
    rows = [
        (1, "Driver required in Dubai salary 1,20,000 registration fee 500 call +91 9876543210 pay bob@okupi. Urgent, apply now"),
        (2, None), (3, ""), (4, "   "),
        (5, "Role: Electrician company Gulf Star Agency location Doha, wage: 900 contact person Ravi"),
        (6, "call 9876543210 9876543211"),
        (7, "500 rs fee"),
    ]
    got = {r.msg_id: r for r in entities.entity_columns(spark.createDataFrame(rows, "msg_id long, text string")).collect()}
    assert got[1].phones == ["9876543210"] and got[1].salary == 120000 and got[1].fee == 500 and got[1].upi_ids == ["bob@okupi"]
    assert got[1].location == "Dubai" and got[1].urgency_flags == ["urgent", "apply now"] and got[1].has_fee and got[1].has_urgency
    for k in (2, 3, 4):
        assert got[k].phones == [] and got[k].salary is None and got[k].role is None and not got[k].has_urgency
    assert (got[5].role, got[5].company, got[5].location, got[5].agent, got[5].salary) == ("Electrician", "Gulf Star Agency Location Doha", "Doha", "Ravi", 900)
    assert got[6].phones == []  # two numbers with a blank between are one candidate of too many digits
    assert got[7].fee == 500


@pytest.mark.parametrize("value, want", [("aap kaise hai", "hi"), ("one hai word here", "hi"), ("hai " + "word " * 6, "en"), ("नौकरी", "hi"), ("hello", "en"), (None, "en"), ("12", "en")])
def test_language(spark, value, want):
    assert one(spark, text.detected_language, value) == want


@pytest.mark.parametrize("value, want", [("0.5", 50), ("1", 100), ("1.4", 1), ("250", 100), ("-3", 0), ("abc", 0), (None, 0)])
def test_score_to_int(spark, value, want):
    assert one(spark, scores.score_to_int, value) == want


@pytest.mark.parametrize(
    "raw, verdict_, confidence",
    [
        ('{"verdict": "scam", "confidence": 150}', "HIGH_RISK", 100), ('x ```json\n{"verdict": "SAFE", "confidence": "abc"}\n``` y', "SAFE", 60), ('I say {"verdict": "medium", "confidence": -5} ok', "SUSPICIOUS", 0),
        ("none", "SUSPICIOUS", 55), (None, "SUSPICIOUS", 55), ("{broken", "SUSPICIOUS", 55),
        ('{"verdict":"SCAM"} trailing {x}', "SUSPICIOUS", 55), ('{"verdict":"SAFE"} or {"verdict":"SCAM"}', "SUSPICIOUS", 55), ('{"verdict":"SAFE"}], [{"verdict":"SCAM"}', "SUSPICIOUS", 55),
        ("{'verdict':'SAFE'}", "SUSPICIOUS", 55), ('```{broken}``` {"verdict":"SAFE"}', "SUSPICIOUS", 55), ('["x"] {"verdict":"SAFE","confidence":7}', "SAFE", 7), ('{"verdict":"SAFE","verdict":"SCAM","confidence":9}', "HIGH_RISK", 9),
    ],
)
def test_verdicts(spark, raw, verdict_, confidence):
    r = verdict.verdict_normalize(spark.createDataFrame([(1, raw)], "msg_id long, llm_raw string")).first()
    assert (r.verdict, r.confidence) == (verdict_, confidence)


def test_reasons(spark):
    schema = "r string, k string, d array<string>, s array<string>"
    rows = [("Why", "why", ["a", "b", "c"], ["x_y", "z"]), (None, None, None, None), ("q", "p", ["1", "2", "3", "4"], ["s_1", "s_2"])]
    got = [r.y for r in spark.createDataFrame(rows, schema).select(verdict.reasons(*map(F.col, "rkds")).alias("y")).collect()]
    assert got == [["Why", "a", "b", "x y"], ["No major contradiction identified."], ["q", "p", "1", "2", "s 1"]]


def components(pairs):
    at = {}

    def root(x):
        at.setdefault(x, x)
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return {x: root(x) for x in at}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == components(pairs)


def test_components_of_a_long_path(spark):
    order = list(range(2000))
    random.Random(7).shuffle(order)
    pairs = list(zip(order, order[1:])) + [(5000, 5001)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == components(pairs)


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([(None, 1)], "src long, dst long")).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_near_names_equal_brute_force(spark):
    rng = random.Random(1)
    names = sorted({"".join(rng.choice("ab ") for _ in range(rng.randrange(1, 8))).strip() or "a" for _ in range(60)})
    left, right = names[::2], names[1::2]
    registry_rows = [(i, n, n) for i, n in enumerate(right)]
    got = registry.near_names(spark.createDataFrame([(x,) for x in left], "key string"), spark.createDataFrame(registry_rows, "pos long, name string, target string"), 3)
    assert sorted((r.key, r.target, r.distance) for r in got.collect()) == sorted((a, b, edit(a, b)) for a in left for b in right if edit(a, b) <= 3)


def test_registry_check_of_a_blacklisted_company(spark):
    reg = spark.createDataFrame([("Gulf Star", "gulf star", "Mumbai", None, ["Oman"], ["driver"], True, 1), ("Gulf Stars", "gulf stars", "Pune", "MH", None, None, False, 2)], "name string, name_normalized string, registered_city string, registered_state string, placement_countries array<string>, allowed_job_categories array<string>, is_blacklisted boolean, pos long")
    claims = spark.createDataFrame([(1, "gulf  STAR", "Dubai", "+97150123", "Welder"), (2, "Nobody", None, None, None), (3, None, None, None, None)], "claim_id long, company string, location string, phone string, role string")
    pre = spark.createDataFrame([("+971", "UAE"), ("+971-50", "UAE"), ("+91", "India")], "prefix string, country string")
    got = {r.claim_id: r for r in registry.registry_check(claims, reg, pre).collect()}
    assert (got[1].db_checks_run, got[1].db_contradictions) == (7, 5)  # blacklist counts twice; typosquat, role, country
    assert got[1].typosquatting_target == "Gulf Stars" and got[1].phone_country == "UAE"
    assert (got[2].db_checks_run, got[2].db_contradictions) == (2, 1)
    assert (got[3].db_checks_run, got[3].db_contradictions) == (0, 0)


def test_anchored_windows_equal_a_fold(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"k{rng.randrange(3)}", start + dt.timedelta(seconds=rng.randrange(0, 400)), i) for i in range(120)]
    rows += [("edge", start + dt.timedelta(seconds=s), 1000 + s) for s in (0, 59, 60, 61)]
    got = {r.seq: r.nth for r in propagation.anchored_windows(spark.createDataFrame(rows, "key string, ts timestamp, seq long"), 60).collect()}
    want, state = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        begin, n = state.get(k, (None, 0))
        if begin is None or (t - begin).total_seconds() >= 60:
            begin, n = t, 0
        state[k] = (begin, n + 1)
        want[i] = n + 1
    assert got == want


def test_many_windows_of_one_key_over_many_ranges(spark):
    """A key of 1,500 windows beside small ones, in more ranges than it has tasks, and requests without key or time."""
    start = dt.datetime(2024, 1, 1)
    rng = random.Random(4)
    rows = [("hot", start + dt.timedelta(seconds=40 * i + rng.randrange(40)), i) for i in range(3000)] + [("hot", start, 3000 + i) for i in range(50)] + [(f"k{i}", start + dt.timedelta(seconds=i), 5000 + i) for i in range(40)]
    frame = spark.createDataFrame(rows + [(None, start, 1), ("x", None, 2)], "key string, ts timestamp, seq long")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.seq: (r.nth, r.begin) for r in propagation.anchored_windows(frame, 60).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want, state = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        begin, n = state.get(k, (None, 0))
        if begin is None or (t - begin).total_seconds() >= 60:
            begin, n = t, 0
        state[k] = (begin, n + 1)
        want[i] = (n + 1, int((begin - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000)
    assert got == want and len({b for _, b in got.values()}) > 1200
    assert propagation.anchored_windows(frame.limit(0), 60).count() == 0


def test_upsert_takes_the_latest(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, v long, x string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 5, "d"), (3, 0, "e")], "k long, v long, x string")
    assert sorted((r.k, r.x) for r in upsert.upsert_latest(base, new, ["k"], "v").collect()) == [(1, "c"), (2, "d"), (3, "e")]


def test_embedding_score_edges(spark):
    v = spark.createDataFrame([(1, "scam", [1.0, 0.0]), (2, "legitimate", [0.0, 1.0]), (3, "scam", [0.0, 0.0]), (4, "scam", None)], "vec_id long, cluster string, embedding array<float>")
    c = embedding.centroids(v.filter("vec_id < 3"))
    got = {r.vec_id: (r.embedding_score, r.status) for r in embedding.embedding_score(v, c).collect()}
    assert got == {1: (1.0, "ok"), 2: (0.0, "ok"), 3: (0.5, "ok"), 4: (0.5, "no_embedding")}
    none = embedding.embedding_score(v, c.filter("cluster = 'scam'")).first()
    assert (none.embedding_score, none.status) == (0.5, "no_centroids")


def test_document_rows(spark):
    rows = [(1, "Infosis Technologies. GST 27ABCDE1234F1Z5."), (2, "pay the registration fee, urgent"), (3, None)]
    fields = media_text.document_fields(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.score, r.risk) for r in media_text.document_forgery(fields).collect()}
    assert got == {1: (25, "low"), 2: (100, "high"), 3: (45, "medium")}


def test_empty_reports(spark):
    from fraudlens.sources.adapters import reports_view

    empty = reports_view(spark, "/root/testdata/sf0.001").limit(0)
    assert dashboard.dashboard_stats(empty).first().total_reports == 0
    assert [r["count"] for r in dashboard.risk_distribution(empty).collect()] == [0, 0, 0]
    assert dashboard.report_trend(empty).count() == 0 and dashboard.report_trend(empty, 3, "2024-05-01").count() == 3


def test_names_are_fixed_lists():
    assert len(C.URGENCY_PHRASES) == 18 and len(C.LOCATIONS) == 40 and not re.search("[A-Z]", "".join(C.STOP_TOKENS))


# --- hand-worked values


@pytest.mark.parametrize(
    "value, salary, fee",
    [
        ("salary 1,20,000 fee 500", 120000, 500), ("Salary: Rs. 25000.75 per month", 25000, None), ("salary is inr 900", 900, None), ("salary=AED 7", 7, None), ("12000 rs salary", 12000, None), ("300 fee", None, 300),
        ("pay2000", None, None), ("salary 20k", None, None), ("wage 12th", None, None), ("5000rs salary", None, None), ("salary rs5000", None, None), ("salary 20k then salary 30", 30, None),
        ("unpay 50", None, None), ("salary\n\t: 40", 40, None), ("salaryis 5", None, None), ("x1,20,000 salary", 20000, None), ("salary 10.5.2", 10, None), (None, None, None), ("", None, None),
    ],
)
def test_amounts(spark, value, salary, fee):
    row = spark.createDataFrame([(value,)], "x string").select(text.amount(F.col("x"), C.SALARY_WORDS).alias("s"), text.amount(F.col("x"), C.FEE_WORDS).alias("f")).first()
    assert (row.s, row.f) == (salary, fee)


def test_amounts_equal_another_reading(spark):
    import duckdb

    from fraudlens.plans import sql

    rng = random.Random(11)
    parts = ["salary", "Wage", "fee", "pay", "is", ":", "=", "rs", "rs.", "INR", "aed", " ", " ", "  ", "\n", "500", "1,20,000", "2.5", "k", ".", ",", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    got = [(r.s, r.f) for r in spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(text.amount(F.col("text"), C.SALARY_WORDS).alias("s"), text.amount(F.col("text"), C.FEE_WORDS).alias("f")).collect()]
    duck = duckdb.connect()
    duck.execute("create table t (i int, text varchar)")
    duck.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    want = duck.sql(f"select {sql._amount(C.SALARY_WORDS)}, {sql._amount(C.FEE_WORDS)} from t order by i").fetchall()
    assert [(t, g) for t, g, w in zip(texts, got, want) if g != w] == []


@pytest.mark.parametrize(
    "value, place, role",
    [("Cook Dubai salary 5", "Dubai", "Cook"), ("Oman works (Oman) now", "Oman", None), ("Womanly work Oman", "Oman", "Womanly work"), ("dubai cook", "Dubai", None), ("Chef", None, "Chef"), ("Helper-Goa", "Goa", "Helper"), ("Role: Driver salary 9", "Pune", "Driver")],
)
def test_role_before_a_whole_place(spark, value, place, role):
    row = spark.createDataFrame([(value, place)], "x string, p string").select(text.role(F.col("x"), F.col("p")).alias("y")).first()
    assert row.y == role


def test_report_lines(spark):
    rows = [("Acme", "Cook", 900, 50, "a@upi"), ("", None, 0, 7, None), (None, None, None, None, ""), (None, "Cook", None, None, "a@upi")]
    got = [r.m for r in spark.createDataFrame(rows, "c string, r string, s long, f long, u string").select(dashboard.report_message(*map(F.col, "crsfu")).alias("m")).collect()]
    assert got == ["Acme | Cook | Salary 900 | Fee 50 | a@upi", "Fee 7", "Scam report received", "Cook | a@upi"]


@pytest.mark.parametrize(
    "value, want",
    [("2024-05-06T07:08:09Z", "2024-05-06T07:08:09+00:00"), ("2024-05-06T07:08:09+05:30", "2024-05-06T01:38:09+00:00"), ("2024-05-06 07:08:09", "2024-05-06T07:08:09+00:00"), ("2024-05-06", "2024-05-06T00:00:00+00:00"), ("2024-05-06T07:08:09.123456", "2024-05-06T07:08:09+00:00"), ("2024-13-06", None), ("soon", None), ("", None), (None, None)],
)
def test_timestamps(spark, value, want):
    assert one(spark, lambda x: text.iso_timestamp(text.parsed_timestamp(x)), value) == want


def test_timestamps_equal_the_iso_reader_of_python(spark):
    rng = random.Random(21)
    days = ["2024-05-06", "20240506", "2024-W19-1", "2024W191", "2024-W19", "2024W19", "2020-W53-7", "2021-W53-1", "2024-02-30", "0000-01-01", "2024-W00-1", "2024-W19-8", "2024-0506", "9999-W52-7", "2024"]
    seps = ["T", " ", "t", "-", "_", "\u0928", "1", "", "+"]
    clocks = ["07", "0708", "07:08", "070809", "07:08:09", "07:08:09.5", "070809,123456789", "23:59:59.999999", "24:00", "07:60", "0708:09", "7:08", "07:0", "10", ""]
    offsets = ["", "", "Z", "+05", "-0530", "+05:30", "+05:30:15", "-053015", "+24:00", "+5", "z", "ZZ", " ", "\n"]
    texts = [a + b + c + d for a in days for b in seps for c in clocks for d in rng.sample(offsets, 5)] + days + [" 2024-05-06", "2024-05-06Z", "2024-05-06\n", "2024-05-06T", "\u0968024-05-06"]
    # digits right after the day of a week are left out: what they mean is not defined
    texts = [t for t in texts if not re.match("[0-9]{4}(W[0-9]{2}[1-7]?[0-9]|-W[0-9]{2}-[0-9]{3})", t) or len(t) == 8]

    def plain(v):
        try:
            at = dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
            at = at if at.tzinfo else at.replace(tzinfo=dt.UTC)
            return round((at - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))
        except ValueError:
            return None

    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").coalesce(1).select(F.unix_micros(text.parsed_timestamp(F.col("x"))).alias("t")).collect()]
    assert [(t, g, plain(t)) for t, g in zip(texts, got) if g != plain(t)] == []
    assert sum(g is not None for g in got) > 500
    assert one(spark, text.parsed_timestamp, "2024W19107") is None


def test_network_view_falls_back(spark):
    reports = spark.createDataFrame([(1, "9876543210", "a@upi", "Cook", " ")], "id long, scam_phone string, upi_id string, job_role string, company_name string")
    edges = spark.createDataFrame([("phone:1", "upi:2", "phone", "upi", dt.datetime(2024, 1, 1))], "entity_a string, entity_b string, entity_a_type string, entity_b_type string, last_seen timestamp")
    rows = lambda frame: sorted(str(tuple(r)) for r in frame.collect())
    assert rows(dashboard.network_view(edges, reports)) == rows(dashboard.network_from_edges(edges))
    fallen = dashboard.network_view(edges.filter("false"), reports)
    assert rows(fallen.drop("links")) == rows(dashboard.network_nodes(reports)) and fallen.count() > 0
    assert fallen.filter("links IS NOT NULL").count() == 0


def test_a_giant_component_is_digested_in_flat_memory(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit("phone:0").alias("component"), F.concat(F.lit("phone:"), F.col("id").cast("string")).alias("node"))
    few = spark.createDataFrame([("a", "phone:b|1"), ("a", "phone:b|1"), ("a", "upi:\u00e9"), ("a", "phone:"), ("a", "plain"), ("a", "phone:b"), ("e", "phone:")], "component string, node string")
    got = {r.component: r for r in graph.component_digests(rows.unionByName(few).withColumn("extra", F.lit(1))).collect()}
    want = hashlib.sha256("|".join(sorted(f"phone:{i}" for i in range(n))).encode()).hexdigest()
    assert (got["phone:0"].fingerprint, got["phone:0"].cluster_size, got["phone:0"].n_phones, got["phone:0"].n_upis) == (want, n, n, 0)
    mixed = sorted({"phone:b|1", "upi:\u00e9", "plain", "phone:b"}, key=str.encode)
    assert got["a"].fingerprint == hashlib.sha256("|".join(mixed).encode()).hexdigest()
    assert (got["a"].cluster_size, got["a"].n_phones, got["a"].n_upis, got["a"].is_potential_syndicate) == (4, 2, 1, True) and set(got) == {"phone:0", "a"}
    assert graph.component_digests(rows.filter("false")).count() == 0

    # batches as a task gets them: what is held does not grow with the members
    def batches(size):
        for lo in range(0, size, 1000):
            yield pa.RecordBatch.from_pydict({"component": ["c"] * 1000, "node": [f"phone:{i:07d}" for i in range(lo, lo + 1000)], "kind": ["phone"] * 1000})

    peaks = []
    for size in (20_000, 400_000):
        tracemalloc.start()
        assert sum(b.num_rows for b in graph._digests(batches(size))) == 1
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_stored_graph_exchanges_the_other_side_only(spark):
    vertices = spark.createDataFrame([(str(i), "phone", f"v{i}") for i in range(50)] + [("1", "phone", "v1"), (None, "upi", "x")], "id string, entity_type string, value string")
    edges = spark.createDataFrame([(str(i), str(i * 7 % 60)) for i in range(50)] + [(None, "1"), ("1", None)], "source_id string, target_id string")
    rows = lambda frame: sorted(str(tuple(r)) for r in frame.collect())
    graph.store_vertices(vertices.filter("id < '3'"), "kept_vertices", 4)
    for _ in range(2):
        stored = graph.store_vertices(vertices, "kept_vertices", 4)
    assert rows(stored) == rows(vertices.filter("id IS NOT NULL").distinct())
    kept = graph.store_edges(edges, "kept_edges", 4)
    found = graph.edges_resolved(kept, stored)
    assert rows(found) == rows(graph.edges_resolved(edges, vertices.filter("id IS NOT NULL").distinct())) and found.count() > 0
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = graph.edges_resolved(kept, stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql("DROP TABLE kept_vertices")
        spark.sql("DROP TABLE kept_edges")
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_evidence(spark):
    row = {"msg_id": 1, "text": " hi ", "company": "", "phones": ["1", "2"], "salary": 0, "fee": 5, "location": None, "role": "Cook", "upi_ids": [], "urgency_flags": None, "sim_to_legitimate": 0.25, "sim_to_scam": None, "boundary_distance": 0.1,
           "embedding_score": 0.5, "contradictions": 0, "checks": None, "contradiction_details": ["x"], "seen_count": 3, "source_channels_count": 1, "forwarded_flag": True, "propagation_score": 0.3, "is_broadcast": False, "media_context": None}
    schema = "msg_id long, text string, company string, phones array<string>, salary long, fee long, location string, role string, upi_ids array<string>, urgency_flags array<string>, sim_to_legitimate double, sim_to_scam double, boundary_distance double, embedding_score double, contradictions long, checks long, contradiction_details array<string>, seen_count long, source_channels_count long, forwarded_flag boolean, propagation_score double, is_broadcast boolean, media_context map<string,string>"
    got = verdict.evidence_bundle(spark.createDataFrame([tuple(row.values())], schema)).first().evidence.split("\n")
    assert got == [
        "=== MESSAGE ===", "hi", "", "=== EXTRACTED ENTITIES ===", "Company: N/A", "Phones: ['1', '2']", "Salary claimed: N/A", "Fee requested: 5", "Claimed location: N/A", "Job role: Cook", "UPI IDs: N/A", "Urgency phrases: N/A",
        "", "=== LAYER 1 - EMBEDDING SIMILARITY ===", "Similarity to legitimate cluster: 0.25", "Similarity to scam cluster: None", "Boundary distance: 0.1", "Embedding scam score: 0.5",
        "", "=== LAYER 2 - CROSS-REFERENCE CONSISTENCY ===", "Total contradictions: 0", "Checks run: None", "DB details: ['x']",
        "", "=== LAYER 3 - PROPAGATION ANALYSIS ===", "Seen count: 3", "Source channels: 1", "Forwarded many times: True", "Broadcast score: 0.3", "Broadcast pattern: False",
    ]


def test_replies(spark):
    rows = [(1, 0.7, ["Pay first "], "en"), (2, 0.4, [], "en"), (3, 0.1, None, "hi")]
    got = {r.msg_id: r.reply for r in verdict.reply_table(spark.createDataFrame(rows, "msg_id long, risk_score double, reasons array<string>, language string")).collect()}
    line = "-" * 31
    foot = "\n\nReply *HI* to view this in Hindi.\n_We never ask for money, OTP, or Aadhaar._"
    assert got[1] == f"*Job Safety Check*\n{line}\nVerdict: DANGER\nRisk Score: 70%\n\nReasons:\n* Pay first\n\nAdvice: Do not send any payment. Verify the company and contact first." + foot
    assert got[2] == f"*Job Safety Check*\n{line}\nVerdict: SUSPICIOUS\nRisk Score: 40%\n\nReasons:\n* No clear red flags found\n\nAdvice: Avoid payment for now. Verify company registration and contact details." + foot
    assert got[3].startswith(f"*जॉब सेफ्टी चेक*\n{line}\nवर्डिक्ट: कम जोखिम\nरिस्क स्कोर: 10%\n\nकारण:\n* ") and got[3].endswith("_हम कभी पैसे, OTP, या आधार नहीं मांगते।_")


def test_company_names_equal_one_pattern(spark):
    rng = random.Random(5)
    parts = ["Ltd", "Tech", "Pvt Ltd", "group", "Inc.", "Ab", "x", "Acme", " ", " ", "\n", ",", ".", "9", "&", "(", " " * 50, "word" * 14]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    pattern = re.compile(media_text.COMPANY.replace("(?i)", ""), re.I)
    want = [" ".join(re.sub("[ \t\n\r\f]+", " ", m[1]).split(" ")).strip(" ") if (m := pattern.search(t)) else None for t in texts]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(media_text.company_name(F.col("t")).alias("c")).collect()]
    assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w] == []


def test_long_names_give_few_probes(spark):
    row = spark.createDataFrame([("ab" * 150,)], "x string").select(F.size(registry.probes(F.col("x"), F.lit(300), 3)).alias("p"), F.size(registry.pieces(F.col("x"), 3)).alias("q")).first()
    assert row.p <= 196 and row.q == 4


def test_history_of_a_hot_text_equals_a_fold(spark):
    rng = random.Random(12)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=rng.randrange(300)), rng.choice(["Hot text"] * 3 + ["rare", None, f"t{i}"]), rng.random() < 0.05, rng.choice(["sms", " Web", None])) for i in range(600)]
    got = {r.msg_id: (r.is_new_message, r.seen_count, r.source_channels_count, r.forwarded_flag) for r in propagation.propagation_history(spark.createDataFrame(rows, "msg_id long, ts timestamp, text string, forwarded boolean, source_channel string")).collect()}
    want, state = {}, {}
    for i, _, t, f, c in sorted(rows, key=lambda r: (r[1], r[0])):
        s = state.setdefault((t or "").strip().lower(), [0, set(), False])
        s[0] += 1
        s[1].add((c or "").strip().lower() or "dashboard")
        s[2] |= f
        want[i] = (s[0] == 1, s[0], len(s[1]), s[2])
    assert got == want


def test_blank_texts_have_no_embedding_score(spark):
    c = spark.createDataFrame([("scam", [1.0, 0.0]), ("legitimate", [0.0, 1.0])], "cluster string, centroid array<double>")
    v = spark.createDataFrame([(1, " \n", [1.0, 0.0]), (2, "x", [1.0, 0.0]), (3, None, None)], "vec_id long, text string, embedding array<float>")
    got = {r.vec_id: (r.embedding_score, r.status) for r in embedding.embedding_score(v, c).collect()}
    assert got == {1: (0.5, "empty_input"), 2: (1.0, "ok"), 3: (0.5, "empty_input")}


def test_debounce_and_unstored_vertices(spark):
    start = dt.datetime(2024, 1, 1)
    turns = spark.createDataFrame([("a", start + dt.timedelta(milliseconds=m), m) for m in (0, 300, 900, 1400)], "key string, ts timestamp, n long")
    assert sorted(r.n for r in propagation.debounced(turns, "key", ("ts", "n")).collect()) == [300, 900, 1400]
    found = spark.createDataFrame([("1", "phone"), ("2", "upi")], "id string, entity_type string")
    assert [r.id for r in graph.new_vertices(found, found.filter("id = '1'")).collect()] == ["2"]
