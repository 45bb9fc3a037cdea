"""Cases that reviews of larger and odder inputs found."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fraudlens.functions import text
from fraudlens.operators import embedding, graph, media_text, verdict
from fraudlens.plans.catalog import ORACLE_SQL, QUERIES


def test_evidence_keeps_the_sign_of_a_score_rounded_to_zero(spark):
    one = [("legitimate", [1.0, 0.0]), ("scam", [0.0, 1.0])]
    found = spark.createDataFrame(one, "cluster string, centroid array<double>")
    v = spark.createDataFrame([(1, [-0.00001, 1.0]), (2, [0.00001, 1.0]), (3, [-0.0002, 1.0])], "vec_id long, embedding array<double>")
    scored = embedding.embedding_score(v, found)
    entities = {"text": "string", "company": "string", "phones": "array<string>", "salary": "long", "fee": "long", "location": "string", "role": "string", "upi_ids": "array<string>", "urgency_flags": "array<string>", "contradictions": "long", "checks": "long", "contradiction_details": "array<string>", "seen_count": "long", "source_channels_count": "long", "forwarded_flag": "boolean", "propagation_score": "double", "is_broadcast": "boolean", "media_context": "map<string,string>"}
    rows = scored.withColumnRenamed("vec_id", "msg_id").select("*", *[F.lit(None).cast(k).alias(c) for c, k in entities.items()])
    told = {r.msg_id: [x.split(": ")[1] for x in r.evidence.split("\n") if x.startswith("Similarity")] for r in verdict.evidence_bundle(rows).collect()}
    assert told == {1: ["-0.0", "1.0"], 2: ["0.0", "1.0"], 3: ["-0.0002", "1.0"]}


def _reading(pattern: str, x: str) -> list[str]:
    """First groups of all matches, where the character before a match is taken too."""
    return [m[1] for m in re.finditer(pattern, x)]


def test_entities_are_found_as_by_patterns_that_take_the_character_before(spark):
    rng = random.Random(11)
    parts = ["+91 98765 43210", "9876543210", " ", "-", "(", "0", "77", "x", "_", "é", "😀", "ab@okupi", "a.b-c@gmail.com", "@", ".", "u_1@ybl9", "\n", "call", "1234567890123"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(800)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", text.phones(F.col("text")).alias("p"), text.upi_ids(F.col("text")).alias("u"))
    canonical = spark.createDataFrame([(c,) for c in sorted({c for x in texts for c in _reading(r"(?:^|[^A-Za-z0-9_])(\+?[0-9][0-9 \t\n\r\f()\-]{8,}[0-9])", x)})], "c string")
    canonical = {r.c: r.p for r in canonical.select("c", text.phone_canonical(F.col("c")).alias("p")).collect()}
    for r in rows.collect():
        phones = [canonical[c] for c in _reading(r"(?:^|[^A-Za-z0-9_])(\+?[0-9][0-9 \t\n\r\f()\-]{8,}[0-9])", texts[r.n])]
        assert r.p == list(dict.fromkeys(p for p in phones if p)), texts[r.n]
        assert r.u == list(dict.fromkeys(u.lower() for u in _reading(r"(?:^|[^A-Za-z0-9_])([a-zA-Z0-9_][a-zA-Z0-9.\-_]+@[a-zA-Z]{2,})(?![a-zA-Z0-9_])", texts[r.n]))), texts[r.n]


def test_a_role_stands_before_a_place_behind_wide_characters(spark):
    rows = spark.createDataFrame([("😀😀 Welder needed Doha now", "Doha"), ("Doha welder", "Doha"), ("Welder Dohar", "Doha")], "text string, place string")
    got = [r[0] for r in rows.select(text.role(F.col("text"), F.col("place"))).collect()]
    assert got == ["😀😀 Welder needed", None, "Welder Dohar"]


def _exchanged(node):
    """The columns of each exchange of a plan."""
    if node.nodeName() == "Exchange":
        yield node.output().toString()
    for i in range(node.children().size()):
        yield from _exchanged(node.children().apply(i))


def _fixed_plan(spark, query):
    """The physical plan of a query without broadcasts and without changes at run time."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        return query()._jdf.queryExecution().executedPlan()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["entity_prevalence", "report_rows"])
def test_no_text_is_exchanged_with_its_entities(spark, name):
    columns = list(_exchanged(_fixed_plan(spark, lambda: QUERIES[name](spark, "/root/testdata/sf0.001"))))
    assert columns and not [x for x in columns if re.search(r"\btext#", x)]


def test_ocr_words_in_any_order_are_exchanged_once(spark):
    rng = random.Random(3)
    words = [(d, line // 3, 1, line, pos, rng.choice(["a", " b ", "c\x00d", "\x00", "é", "", " "]), rng.choice([-1, 0, 50])) for d in range(6) for line in range(7) for pos in range(9)]
    words += [(None, 0, 1, None, 2, "y", 1), (None, 0, 1, None, 1, "x", 1), (9, 0, 1, 0, None, "n", 1), (9, 0, 1, 0, 0, "z", 1)]
    want = {}
    for d, block, _, line, pos, w, conf in sorted(words, key=lambda x: tuple(-1 if v is None else v for v in x[:5])):
        if conf >= 0 and w.strip(" "):
            want.setdefault(d, {}).setdefault((block, line), []).append(w.strip(" "))
    told = {}
    for d, lines in want.items():
        blocks = {}
        for (block, _), ws in lines.items():
            blocks.setdefault(block, []).append(" ".join(ws))
        told[d] = "\n\n".join("\n".join(x) for x in blocks.values())
    schema = "doc_id long, block long, par long, line long, pos long, word string, conf long"
    for order in (words, rng.sample(words, len(words))):
        out = media_text.ocr_lines(spark.createDataFrame(order, schema))
        assert {r.doc_id: r.text for r in out.collect()} == told
    assert len(list(_exchanged(_fixed_plan(spark, lambda: media_text.ocr_lines(spark.createDataFrame(words, schema)))))) == 1


def test_places_of_phones_do_not_multiply(spark):
    """A company of many phones and many places: no join makes a row of each phone and place."""
    v = [("c", "company", "C"), *((f"p{i}", "phone", str(9000000000 + i)) for i in range(40)), *((f"l{i}", "location", f"L{i}") for i in range(30)), ("q", "phone", "1"), ("d", "company", "D")]
    e = [*(("c", f"p{i}", "contact_phone") for i in range(40)), *(("c", f"l{i}", "located_in") for i in range(30)), ("d", "q", "contact_phone"), ("d", "l0", "located_in"), ("q", "l0", "located_in")]
    vertices, edges = spark.createDataFrame(v, "id string, entity_type string, value string"), spark.createDataFrame(e, "source_id string, target_id string, relationship_type string")
    out = graph.consistency_counts(vertices, edges)
    # checks: two companies with places, two companies' contacts, 41 phones; against: C's places, D's phone is too short, C's 40 phones
    assert tuple(out.first())[:2] == (1 + 1 + 40, 2 + 2 + 41)
    plan = _fixed_plan(spark, lambda: graph.consistency_counts(vertices, edges))
    assert "count(distinct" not in plan.toString() and "Expand" not in plan.toString()


def test_only_every_fourth_message_is_blank(spark, tmp_path):
    """Documents whose own text is missing or blank are scored as the SQL does, with and without a vector."""
    texts = ["x", None, "", " \n\t\r\f ", None, "", "\u00a0", "y", "", " ", None, "z", None, "", None, "w"]
    docs = [*enumerate(texts), (None, None), (None, "x"), (-1, ""), (-4, "v"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rng = random.Random(7)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 10) for i in [*range(-4, 12), 5]]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = duck.sql(ORACLE_SQL["message_embedding_score"])
    got = QUERIES["message_embedding_score"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
