"""Streams give what the batch jobs give once all input is read."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from fraudlens.operators import propagation
from fraudlens.streaming import inbound


def drain(frame, name, mode, folder):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name)


def test_inbound_stores_messages_reports_edges_and_fingerprints(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    good = [{"conv_id": i, "turn": 1, "from_number": "whatsapp:+9198", "body_text": "CHECK company Gulf Star salary 500 urgent call 9876543210", "media_count": "1", "forwarded_many_times": "true", "source": "sms"} for i in range(3)]
    (source / "a.json").write_text("\n".join(map(json.dumps, good)) + "\nnot json\n")
    # message 2 has no result: a failed analysis
    analyse = lambda m: m.filter("msg_id <> '2-1'").select("msg_id", F.when(F.col("msg_id") == "0-1", 0.6).otherwise(0.9).alias("risk_score"))
    inbound.start_inbound(spark, str(source), sink, analyse).awaitTermination()
    read = lambda part: spark.read.parquet(f"{sink}/{part}")
    assert read("messages").count() == 3
    r = read("messages").first()
    assert (r.salary, r.forwarded, r.source_channel, r.urgency_flags) == (500, True, "dashboard", ["urgent"])
    assert {r.msg_id: (r.risk_score, r.failed) for r in read("results").collect()} == {"0-1": (0.6, False), "1-1": (0.9, False), "2-1": (0.5, True)}
    assert [(r.msg_id, r.scam_phone, r.company_name, r.risk_score) for r in read("reports").collect()] == [("1-1", "9876543210", "Gulf Star", 90)]
    assert [(r.source_value, r.relationship_type, r.target_value) for r in read("edges").collect()] == [("Gulf Star", "contact_phone", "9876543210")]
    inbound.start_syndicates(spark, sink).awaitTermination()
    joined = lambda: {(r.node, r.component) for r in inbound.stored_syndicates(spark, sink).labels.read().collect()}
    assert joined() == {("company:Gulf Star", "company:Gulf Star"), ("phone:9876543210", "company:Gulf Star")}
    # a line that arrives later is read by the next run alone; the fingerprint's states are merged
    (source / "b.json").write_text(json.dumps(good[0] | {"conv_id": 9}))
    inbound.start_inbound(spark, str(source), sink).awaitTermination()
    assert read("messages").count() == 4 and read("reports").count() == 1
    assert [r.seen_count for r in inbound.stored_fingerprints(spark, sink).collect()] == [4]
    # a batch that runs again replaces what it wrote
    inbound.store_batch(read("messages").filter("batch = 0").drop("batch"), 7, sink, analyse)
    inbound.store_batch(read("messages").filter("batch = 0").drop("batch"), 7, sink, analyse)
    assert read("reports").count() == 2
    # edges of later batches reach the syndicates
    more = [("9876543210", "9876543211"), ("9876543212", "9876543213")]
    for n, pair in enumerate(more):
        spark.createDataFrame([("phone", pair[0], "phone", pair[1])], "source_type string, source_value string, target_type string, target_value string").coalesce(1).write.parquet(f"{sink}/edges/batch={8 + n}")
    inbound.start_syndicates(spark, sink).awaitTermination()
    assert joined() >= {("phone:9876543211", "company:Gulf Star"), ("phone:9876543213", "phone:9876543212")}
    assert [r.phones for r in inbound.stored_syndicates(spark, sink).syndicates().collect()] == []
    spark.createDataFrame([("phone", "9876543211", "phone", "9876543212")], "source_type string, source_value string, target_type string, target_value string").coalesce(1).write.parquet(f"{sink}/edges/batch=10")
    inbound.start_syndicates(spark, sink).awaitTermination()
    assert [r.phones for r in inbound.stored_syndicates(spark, sink).syndicates().collect()] == [[f"987654321{i}" for i in range(4)]]


def test_stream_of_messages_is_deduplicated(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=h), t, "web") for i, (h, t) in enumerate([(0, "a"), (1, "a"), (2, "b"), (30, "a")])]
    schema = "msg_id long, ts timestamp, text string, source_channel string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "m"))
    got = drain(inbound.dedupe_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "m")), 24 * 3600), "deduped", "append", tmp_path)
    assert sorted(r.seq for r in got.collect()) == [0, 2, 3]


def test_rate_limit_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = sorted(((f"k{rng.randrange(3)}", start + dt.timedelta(seconds=rng.randrange(0, 600)), i) for i in range(90)), key=lambda r: r[1])
    schema = "key string, ts timestamp, seq long"
    stream = batches(spark, tmp_path / "in", schema, [rows[at : at + 30] for at in (0, 30, 60)])
    got = drain(inbound.rate_limit_stream(stream, 3, 60), "limited", "append", tmp_path)
    want = propagation.rate_limit_flags(spark.createDataFrame(rows, schema), 3, 60)
    key = lambda df: sorted((r.key, r.seq, r.nth, r.allowed) for r in df.collect())
    assert key(got) == key(want)


def test_fingerprints_and_counters_equal_batch(spark, tmp_path):
    rows = [("Pay now", True, "whatsapp"), ("pay  NOW", False, "dashboard"), ("other", False, "dashboard")]
    schema = "text string, forwarded boolean, source_channel string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "m"))
    got = {r.seen_count: (r.forwarded_flag, r.source_channels) for r in drain(inbound.fingerprint_stream(stream), "prints", "update", tmp_path).collect()}
    assert got == {2: (True, ["dashboard", "whatsapp"]), 1: (False, ["dashboard"])}
    times = [(dt.datetime(2024, 1, 1 + i % 3, 5), f"p{i % 2}") for i in range(12)]
    reports = spark.createDataFrame(times, "report_time timestamp, location string")
    reports.coalesce(1).write.parquet(str(tmp_path / "r"))
    live = drain(inbound.report_counters(spark.readStream.schema(reports.schema).parquet(str(tmp_path / "r"))), "days", "complete", tmp_path)
    want = reports.groupBy(F.to_date("report_time").alias("day"), "location").count()
    key = lambda df: sorted((r.day, r.location, r["count"]) for r in df.collect())
    assert key(live) == key(want)


def batches(spark, folder, schema, parts):
    """A stream that gives each part in a micro-batch of its own, in order."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{n}"))
        for f in (folder / f"{n}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def state_keys(spark, folder, name):
    return sorted(r.key.key for r in spark.read.format("statestore").option("stateVarName", name).load(str(folder)).collect())


T0 = dt.datetime(2024, 1, 1)


def test_window_state_expires(spark, tmp_path):
    """Keys of windows that ended before the watermark are gone; numbers equal the batch job's."""
    schema = "key string, ts timestamp, seq long"
    at = lambda hours, seconds=0: T0 + dt.timedelta(hours=hours, seconds=seconds)
    parts = [[(f"k{i % 20}", at(0, i), i) for i in range(60)], [("z", at(5), 100), ("k1", at(5, 1), 101)], [("z", at(5, 70), 102), ("k1", at(9), 103)], [("z", at(9, 5), 104)]]
    stream = batches(spark, tmp_path / "in", schema, parts)
    got = drain(inbound.rate_limit_stream(stream, 2, 60), "expiring", "append", tmp_path)
    want = propagation.rate_limit_flags(spark.createDataFrame([r for rows in parts for r in rows], schema), 2, 60)
    key = lambda df: sorted((r.key, r.seq, r.nth, r.allowed, r.ts) for r in df.collect())
    assert key(got) == key(want)
    assert state_keys(spark, tmp_path / "expiring", "window") == ["k1", "z"]  # of 21 keys


def test_latest_value_keeps_the_latest_and_expires(spark, tmp_path):
    schema = "key string, ts timestamp, value string"
    day = lambda n, s=0: T0 + dt.timedelta(days=n, seconds=s)
    parts = [[("u1", day(0), "en"), ("u1", day(1), "hi"), ("u2", day(0), "en"), ("u1", day(0, 5), "en")], [("u3", day(20), "hi")], [("u2", day(29), "hi")], [("u4", day(45), "en")]]
    known = spark.createDataFrame([("u1", day(-5), "fr"), ("u5", day(-1), "ta"), ("u5", day(-2), "en")], schema)
    got = drain(inbound.preference_stream(batches(spark, tmp_path / "in", schema, parts), known=known), "prefs", "update", tmp_path).collect()
    told = {}
    for r in got:
        told.setdefault(r.key, []).append((r.value, r.ts))
        assert r.valid_until - r.ts == dt.timedelta(days=30)
    # the snapshot's value ends at its own lifetime unless a newer one came; a null value is an end
    assert told == {"u1": [("hi", day(1)), (None, day(1))], "u2": [("en", day(0)), ("hi", day(29))], "u3": [("hi", day(20))], "u4": [("en", day(45))], "u5": [(None, day(-1))]}
    assert state_keys(spark, tmp_path / "prefs", "latest") == ["u2", "u3", "u4"]


def test_last_results(spark, tmp_path):
    results = spark.createDataFrame([("a", day, n, "LOW") for n, day in enumerate([T0, T0 + dt.timedelta(days=2)])] + [("b", T0, 9, "HIGH"), (None, T0, 10, "HIGH")], "sender string, ts timestamp, msg_id long, risk_level string")
    rows = inbound.last_results(results)
    assert sorted((r.key, json.loads(r.value)["msg_id"]) for r in rows.collect()) == [("a", 0), ("a", 1), ("b", 9)]
    later = [("c", T0 + dt.timedelta(days=8), "{}")]
    parts = [[tuple(r) for r in rows.collect()], later]
    got = drain(inbound.last_result_stream(batches(spark, tmp_path / "in", rows.schema, parts)), "last", "update", tmp_path)
    assert sorted((r.key, json.loads(r.value)["msg_id"] if r.value else -1) for r in got.collect() if r.key < "c") == [("a", 1), ("b", -1), ("b", 9)]
    assert state_keys(spark, tmp_path / "last", "latest") == ["a", "c"]
