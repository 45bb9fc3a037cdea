"""Propagation of messages: fingerprints, running history, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fraudlens import constants as C
from fraudlens.functions import scores, text
from fraudlens.storage import discard, written


def channel_name(x: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(x)), F.lit("")), F.lit("dashboard"))


def hashed(messages: DataFrame) -> DataFrame:
    normal = text.text_normalized(F.coalesce("text", F.lit("")))
    return messages.select("msg_id", "ts", F.sha2(normal, 256).alias("message_hash"), F.length(normal).alias("text_length"), F.coalesce("forwarded", F.lit(False)).alias("forwarded"), channel_name(F.col("source_channel")).alias("channel"))


def fingerprints(messages: DataFrame) -> DataFrame:
    """State of each fingerprint after all messages. A text that fills the
    table leaves each task as one row; channels are few."""
    return hashed(messages).groupBy("message_hash").agg(
        F.min("ts").alias("first_seen_at"),
        F.max("ts").alias("last_seen_at"),
        F.count(F.lit(1)).alias("seen_count"),
        F.bool_or("forwarded").alias("forwarded_flag"),
        F.sort_array(F.collect_set("channel")).alias("source_channels"),
        F.max("text_length").cast("long").alias("text_length"),
    )


def propagation_score(fps: DataFrame) -> DataFrame:
    args = (F.col("forwarded_flag"), F.col("seen_count"), F.size("source_channels"), F.col("text_length"))
    out = fps.select("message_hash", "seen_count", F.size("source_channels").cast("long").alias("source_channels_count"), scores.propagation_score(*args).alias("propagation_score"), scores.propagation_signals(*args).alias("signals"))
    return out.withColumn("is_broadcast", F.col("propagation_score") >= C.BROADCAST_FROM)


def propagation_history(messages: DataFrame) -> DataFrame:
    """What each message sees on arrival: running count, channels, forwarded
    flag and score.

    Messages are sorted in ranges of (hash, time, id), so one text that fills the
    table is spread over ranges. Running values inside a range are added to
    what the hash's earlier ranges hold, one row for each range of a hash."""
    order = ("ts", "msg_id")
    narrow = written(hashed(messages), "hashed")  # texts are read once, not again for the ranges' bounds
    rows = written(narrow.repartitionByRange("message_hash", *order).withColumn("_part", F.spark_partition_id()), "history")
    discard(narrow)
    running = Window.partitionBy("message_hash", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy("message_hash", "_part").agg(F.count(F.lit(1)).alias("n"), F.bool_or("forwarded").alias("f"), F.collect_set("channel").alias("c"))
    ahead = Window.partitionBy("message_hash").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<string>")
    before = parts.select("message_hash", "_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_n"), F.coalesce(F.bool_or("f").over(ahead), F.lit(False)).alias("_f"), F.coalesce(F.array_distinct(F.flatten(F.collect_list("c").over(ahead))), none).alias("_c"))
    rows = rows.select("*", F.row_number().over(running).alias("_nth"), F.bool_or("forwarded").over(running).alias("_flag"), F.collect_set("channel").over(running).alias("_channels")).join(before, ["message_hash", "_part"])
    rows = rows.select(
        "msg_id", "message_hash", "text_length", (F.col("_n") + F.col("_nth")).alias("seen_count"), F.size(F.array_union("_c", "_channels")).cast("long").alias("source_channels_count"), (F.col("_f") | F.col("_flag")).alias("forwarded_flag")
    )
    args = (F.col("forwarded_flag"), F.col("seen_count"), F.col("source_channels_count"), F.col("text_length"))
    return rows.select("msg_id", "message_hash", (F.col("seen_count") == 1).alias("is_new_message"), "seen_count", "source_channels_count", "forwarded_flag", scores.propagation_score(*args).alias("propagation_score"))


FINGERPRINT = "message_hash string, first_seen_at timestamp, last_seen_at timestamp, seen_count long, forwarded_flag boolean, source_channels array<string>, text_length long"


def fingerprint_fold(states: DataFrame) -> DataFrame:
    """States of fingerprints, several of one key perhaps, as one of each key."""
    return states.groupBy("message_hash").agg(
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.sum("seen_count").alias("seen_count"),
        F.bool_or("forwarded_flag").alias("forwarded_flag"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("source_channels")))).alias("source_channels"),
        F.max("text_length").alias("text_length"),
    )


def fingerprint_upsert(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge two fingerprint states: the union, folded by key."""
    return fingerprint_fold(base.unionByName(updates))


def _ranged(rows: DataFrame, *order: str, label: str) -> DataFrame:
    """``rows`` as a table sorted in ranges of ``order``; ``_part`` is a row's range. A key of any size is spread over ranges."""
    return written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)


def _next_times(times: DataFrame, span: int) -> DataFrame:
    """(key, at, next) of distinct (key, at): the key's first time at least ``span`` later, if there is one.

    Times and the moments to look from are sorted together in ranges; the next time is the one
    that follows in the range, or the first of the key's later ranges, one row for each of a key's ranges."""
    both = times.select("key", "at", F.lit(1).alias("is_time")).unionByName(times.select("key", (F.col("at") + span).alias("at"), F.lit(0).alias("is_time")))
    rows = _ranged(both, "key", "at", "is_time", label="next_times")
    time = F.when(F.col("is_time") == 1, F.col("at"))
    later = Window.partitionBy("key").orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = rows.groupBy("key", "_part").agg(F.min(time).alias("_first")).select("key", "_part", F.min("_first").over(later).alias("_beyond"))
    following = Window.partitionBy("key", "_part").orderBy(F.col("at").desc(), F.col("is_time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select("key", "_part", "at", "is_time", F.last(time, ignorenulls=True).over(following).alias("_here")).filter("is_time = 0").join(beyond, ["key", "_part"])
    return found.select("key", (F.col("at") - span).alias("at"), F.coalesce("_here", "_beyond").alias("next")).filter("next IS NOT NULL")


def window_begins(times: DataFrame, span: int) -> DataFrame:
    """(key, begin) of each window of distinct (key, at): the first time, then over and over the first one at least ``span`` later.

    Pointers to the next begin are doubled until none is left, so steps of 1, 2, 4, ... windows are tables;
    taken back from the longest, they lead from each key's first time to all begins. There are as many rounds as the logarithm of
    the most windows of a key; each is an equi-join on key and time, and no round gathers a key in one place."""
    times = written(times, "times")
    steps = [written(_next_times(times, span), "step")]
    while not steps[-1].isEmpty():
        ahead = steps[-1].select("key", F.col("at").alias("next"), F.col("next").alias("_then"))
        steps.append(written(steps[-1].join(ahead, ["key", "next"]).select("key", "at", F.col("_then").alias("next")), "step"))
    begins = times.groupBy("key").agg(F.min("at").alias("at"))
    for step in reversed(steps[:-1]):
        begins = begins.unionByName(begins.join(step, ["key", "at"]).select("key", F.col("next").alias("at")))
        begins = written(begins, "begins")
    return begins.select("key", F.col("at").alias("begin"))


def anchored_windows(requests: DataFrame, window_s: int) -> DataFrame:
    """(key, ts, seq) with ``begin`` and ``nth``: the request's window and its number in it. A window
    begins at the first request after the window before has ended. Requests without key or time are left out.

    Windows begin at least their length apart, so a bucket of that length has one beginning at most, and a request's
    window begins in its bucket or the one before: an equi-join on key and bucket. The number is the request's rank in its key,
    counted in ranges, less the rank of the window's first; so neither a key nor a window has to be in one task."""
    span = window_s * 1_000_000
    bucket = lambda t: t - F.pmod(t, F.lit(span))
    rows = requests.select("key", "ts", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).filter("key IS NOT NULL AND at IS NOT NULL")
    rows = _ranged(rows, "key", "at", "seq", label="requests")
    ahead = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("key", "_part").count().select("key", "_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_ahead"))
    rank = F.row_number().over(Window.partitionBy("key", "_part").orderBy("at", "seq"))
    ranked = rows.withColumn("_rank", rank).join(before, ["key", "_part"]).select("key", "ts", "seq", "at", (F.col("_rank") + F.col("_ahead")).alias("rank"), bucket(F.col("at")).alias("bucket"))
    begins = window_begins(rows.select("key", "at").distinct(), span)
    places = F.array(F.struct(bucket(F.col("begin")).alias("bucket"), F.col("begin").alias("own")), F.struct((bucket(F.col("begin")) + span).alias("bucket"), F.lit(None).cast("bigint").alias("own")))
    begins = begins.select("key", "begin", F.explode(places).alias("p")).groupBy("key", "p.bucket").agg(F.max("p.own").alias("own"), F.max(F.when(F.col("p.own").isNull(), F.col("begin"))).alias("before"))
    placed = ranked.join(begins, ["key", "bucket"]).withColumn("begin", F.when(F.col("at") >= F.col("own"), F.col("own")).otherwise(F.col("before")))
    placed = written(placed.select("key", "ts", "seq", "rank", "begin"), "placed")
    first = placed.groupBy("key", "begin").agg(F.min("rank").alias("first"))
    return placed.join(first, ["key", "begin"]).select("key", "ts", "seq", "begin", (F.col("rank") - F.col("first") + 1).cast("long").alias("nth"))


def rate_limit_flags(requests: DataFrame, limit: int = C.RATE_LIMIT, window_s: int = C.RATE_WINDOW_S) -> DataFrame:
    return anchored_windows(requests, window_s).select("key", "ts", "seq", "nth", (F.col("nth") <= limit).alias("allowed"))


def analysis_dedupe(messages: DataFrame, ttl_s: int = C.DEDUPE_TTL_S) -> DataFrame:
    """Messages with ``analysed``: the first of its cache key in a lifetime that
    begins at an analysis and is not renewed by repeats."""
    key = text.analysis_key(F.coalesce("text", F.lit("")), F.col("source_channel"))
    keyed = messages.select(key.alias("key"), "ts", F.col("msg_id").alias("seq"))
    return anchored_windows(keyed, ttl_s).select(F.col("seq").alias("msg_id"), F.col("key").alias("cache_key"), (F.col("nth") == 1).alias("analysed"))


def consecutive_dedupe(turns: DataFrame, key: str = "conv_id", order: str = "turn", body: str = "text") -> DataFrame:
    """Rows whose text differs from the one before of the same client."""
    before = F.lag(body).over(Window.partitionBy(key).orderBy(order))
    return turns.withColumn("_before", before).filter(~F.col(body).eqNullSafe(F.col("_before"))).drop("_before")


def debounced(turns: DataFrame, key: str, order: tuple[str, ...], gap_ms: int = 500) -> DataFrame:
    """Rows that no other row of the client follows within the gap; the first of ``order`` is the time."""
    at = F.unix_micros(F.col(order[0]).cast("timestamp"))
    after = F.lead(at).over(Window.partitionBy(key).orderBy(*order))
    return turns.withColumn("_after", after).filter(F.col("_after").isNull() | (F.col("_after") - at >= gap_ms * 1000)).drop("_after")


def latest_per_user(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each user; an aggregate, so no user's rows are sorted in one task."""
    latest = F.max_by(F.struct("*"), F.struct(*order))
    return rows.groupBy(F.col(key).alias("_key")).agg(latest.alias("x")).select("x.*")


def language_mix(messages: DataFrame) -> DataFrame:
    return messages.groupBy(channel_name(F.col("source_channel")).alias("channel"), text.detected_language(F.col("text")).alias("language")).count()
