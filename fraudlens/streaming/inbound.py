"""Structured Streaming jobs: the inbound pipeline and its keyed state.

Sources are at least once, sinks are idempotent: each micro-batch writes a
folder named by its batch id, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fraudlens import constants as C
from fraudlens.folded import FoldedTable
from fraudlens.functions import text
from fraudlens.operators import entities, graph, propagation, verdict
from fraudlens.operators.syndicate_store import SyndicateStore

JOB = "conv_id long, turn long, from_number string, body_text string, media_count string, forwarded_many_times string, source string, ts timestamp"
#: Rows of an Arrow batch that a stateful operator gives.
ROWS_OUT = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def job_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of JSON; a line that does not parse is dropped."""
    lines = spark.readStream.text(folder)
    return lines.select(F.from_json("value", JOB).alias("j")).select("j.*").filter("conv_id IS NOT NULL")


def as_messages(jobs: DataFrame) -> DataFrame:
    rows = entities.normalize_inbound(jobs, "ts")
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("msg_id"), F.coalesce("ts", F.current_timestamp()).alias("ts"), F.col("from_number").alias("sender"), F.col("body_text").alias("text"), "forwarded", F.col("source").alias("source_channel")
    )


Analysis = Callable[[DataFrame], DataFrame]


def store_batch(messages: DataFrame, batch_id: int, sink_dir: str, analyse: Analysis | None = None) -> None:
    """One batch of messages with entities and text: the messages, what is
    known of their fingerprints, and of those whose risk is above the bound the
    reports and the edges between their entities.

    ``analyse`` gives (msg_id, risk_score) of messages; a message without a
    result counts as a failed analysis, which is stored with the default score
    and never reported. Each part is a folder of the batch's number, so a batch
    that runs again replaces what it wrote; fingerprints are folded as well."""
    spark = messages.sparkSession
    at = lambda part: f"{sink_dir}/{part}/batch={batch_id}"
    messages.write.mode("overwrite").parquet(at("messages"))
    kept = spark.read.schema(messages.schema).parquet(at("messages"))
    prints = fingerprint_store(spark, sink_dir)
    prints.put(batch_id, propagation.fingerprints(kept))
    prints.compact()
    found = analyse(kept).select("msg_id", "risk_score") if analyse else spark.createDataFrame([], "msg_id string, risk_score double")
    failed = F.col("risk_score").isNull()
    scored = kept.join(found, "msg_id", "left").select(*kept.columns, F.when(failed, F.lit(C.FAILED_SCORE)).otherwise(F.col("risk_score")).alias("risk_score"), failed.alias("failed"), F.col("source_channel").alias("source"))
    scored.select("msg_id", "risk_score", "failed").write.mode("overwrite").parquet(at("results"))
    results = kept.join(spark.read.parquet(at("results")), "msg_id").withColumn("source", F.col("source_channel"))
    verdict.report_rows(results).write.mode("overwrite").parquet(at("reports"))
    graph.graph_edges(verdict.high_risk_reports(results)).write.mode("overwrite").parquet(at("edges"))


def start_inbound(spark: SparkSession, source_dir: str, sink_dir: str, analyse: Analysis | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Jobs to stored messages, fingerprints, results, reports and edges, one folder for each batch."""
    rows = as_messages(job_stream(spark, source_dir))
    rows = entities.entity_columns(rows.withColumn("_text", F.col("text"))).withColumnRenamed("_text", "text")
    write = lambda batch, batch_id: store_batch(batch, batch_id, sink_dir, analyse)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{sink_dir}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def fingerprint_store(spark: SparkSession, sink_dir: str) -> FoldedTable:
    return FoldedTable(spark, f"{sink_dir}/fingerprints", propagation.FINGERPRINT, propagation.fingerprint_fold)


def stored_fingerprints(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The state of all fingerprints: a base, and the few batches after it merged into it."""
    return fingerprint_store(spark, sink_dir).read()


def start_syndicates(spark: SparkSession, sink_dir: str, trigger: dict | None = None) -> StreamingQuery:
    """Edges that ``start_inbound`` stored to the components, syndicates and members of ``stored_syndicates``.

    A batch of edges that was stored again is read again, which changes no component."""
    stored = spark.readStream.schema(spark.read.parquet(f"{sink_dir}/edges").schema).parquet(f"{sink_dir}/edges")
    keys = stored.select(text.entity_key(F.col("source_type"), F.col("source_value")).alias("a"), text.entity_key(F.col("target_type"), F.col("target_value")).alias("b"))
    add = lambda edges, batch_id: stored_syndicates(spark, sink_dir).add(batch_id, edges)
    return keys.writeStream.foreachBatch(add).option("checkpointLocation", f"{sink_dir}/syndicates/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def stored_syndicates(spark: SparkSession, sink_dir: str) -> SyndicateStore:
    return SyndicateStore(spark, f"{sink_dir}/syndicates/tables")


def fingerprint_stream(messages: DataFrame) -> DataFrame:
    """Live state of each fingerprint (update mode)."""
    normal = text.text_normalized(F.coalesce("text", F.lit("")))
    return messages.groupBy(F.sha2(normal, 256).alias("message_hash")).agg(
        F.count(F.lit(1)).alias("seen_count"), F.bool_or("forwarded").alias("forwarded_flag"), F.sort_array(F.collect_set(propagation.channel_name(F.col("source_channel")))).alias("source_channels")
    )


def report_counters(reports: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Reports of each day and place, for rows no later than ``lateness``."""
    timed = reports.withColumn("event_time", F.col("report_time").cast("timestamp")).withWatermark("event_time", lateness)
    return timed.groupBy(F.window("event_time", "1 day").alias("w"), "location").count().select(F.to_date("w.start").alias("day"), "location", "count")


class AnchoredWindow(StatefulProcessor):
    """Numbers requests in windows that begin at the first request after the
    window before. State of a key: start of its window and count. A timer at the window's
    end, in the rows' own time, removes the key; the next request would begin a window anyway."""

    def __init__(self, window_s: int):
        self.span = window_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "start long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # of a key's rows in this batch only times and numbers are held, to sort them
        times, seqs = zip(*((x["at"].to_numpy(), x["seq"].to_numpy()) for x in rows))
        at, seq = np.concatenate(times), np.concatenate(seqs)
        order = np.lexsort((seq, at))
        at, seq, nth = at[order], seq[order], np.empty(len(order), np.int64)
        start, n = self.state.get() if self.state.exists() else (None, 0)
        before, done = start, 0
        while done < len(at):
            upto = done if start is None else int(np.searchsorted(at, start + self.span))
            if upto <= done:  # the window has ended
                start, n = int(at[done]), 0
            else:
                nth[done:upto] = np.arange(n + 1, n + 1 + upto - done)
                n, done = n + upto - done, upto
        if start != before:
            if before is not None:
                self.handle.deleteTimer(_millis(before + self.span))
            self.handle.registerTimer(_millis(start + self.span))
        self.state.update((start, n))
        for first in range(0, len(at), ROWS_OUT):
            some = slice(first, first + ROWS_OUT)
            yield pd.DataFrame({"key": key[0], "at": at[some], "seq": seq[some], "nth": nth[some]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The first whole millisecond that is not before."""
    return -(-micros // 1000)


def _timed(rows: DataFrame, lateness: str, *columns: str) -> DataFrame:
    """Key, columns and the time as microseconds, which no zone changes, under a watermark."""
    return rows.select("key", "ts", F.unix_micros("ts").alias("at"), *columns).withWatermark("ts", lateness)


def anchored_stream(requests: DataFrame, window_s: int = C.RATE_WINDOW_S, lateness: str = "1 hour") -> DataFrame:
    """(key, ts, seq, nth) of a stream of (key, ts, seq): rate limits and lifetimes. Rows later than
    ``lateness`` behind the newest are dropped; a window that ended before that has no state."""
    numbered = _timed(requests, lateness, "seq").groupBy("key").transformWithStateInPandas(AnchoredWindow(window_s), "key string, at long, seq long, nth long", "Append", "EventTime")
    return numbered.select("key", F.timestamp_micros("at").alias("ts"), "seq", "nth")


def rate_limit_stream(requests: DataFrame, limit: int = C.RATE_LIMIT, window_s: int = C.RATE_WINDOW_S, lateness: str = "1 hour") -> DataFrame:
    return anchored_stream(requests, window_s, lateness).withColumn("allowed", F.col("nth") <= limit)


def dedupe_stream(messages: DataFrame, ttl_s: int = C.DEDUPE_TTL_S, lateness: str = "1 hour") -> DataFrame:
    """Messages whose key was not analysed in the lifetime before (msg_id long, ts, text, source_channel)."""
    key = text.analysis_key(F.coalesce("text", F.lit("")), F.col("source_channel"))
    keyed = messages.select(key.alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("msg_id").cast("long").alias("seq"))
    return anchored_stream(keyed, ttl_s, lateness).filter("nth = 1")


class LatestValue(StatefulProcessor):
    """The latest value of a key by the rows' own times, for a lifetime that each new
    value renews. A timer at its end removes the key and tells it with a null value. Timers are in
    the rows' time, so a run over what is available ends."""

    def __init__(self, ttl_s: int):
        self.ttl = ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", "at long, value string")

    def _take(self, at: int, value: str | None) -> None:
        if self.state.exists():
            self.handle.deleteTimer(_millis(self.state.get()[0] + self.ttl))
        self.handle.registerTimer(_millis(at + self.ttl))
        self.state.update((at, value))

    @staticmethod
    def _newest(rows: pd.DataFrame) -> tuple[int, str | None]:
        row = rows.sort_values(["at", "value"]).iloc[-1]
        return int(row["at"]), row["value"]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """What a batch job knew: a row of a key, or the newest of several."""
        self._take(*self._newest(initialState))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else None
        best = held
        for some in rows:  # one Arrow batch of the key's rows at a time
            row = self._newest(some)
            if best is None or best[0] <= row[0]:
                best = row
        if best is not held:
            self._take(*best)
        yield self._told(key, *best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.state.get()[0]
        self.state.clear()
        yield self._told(key, at, None)

    def _told(self, key, at: int, value: str | None) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "at": [at], "value": pd.Series([value], dtype=object)})

    def close(self) -> None:
        pass


def latest_stream(rows: DataFrame, ttl_s: int, known: DataFrame | None = None, lateness: str = "1 hour") -> DataFrame:
    """(key, ts, value, valid_until) after each batch for each key in it, and with a null value once its lifetime
    is over. ``known`` (key, ts, value) is a batch table to begin with; it is read by the first run only."""
    begun = None if known is None else known.select("key", F.unix_micros("ts").alias("at"), "value").groupBy("key")
    latest = _timed(rows, lateness, "value").groupBy("key").transformWithStateInPandas(LatestValue(ttl_s), "key string, at long, value string", "Update", "EventTime", begun)
    return latest.select("key", F.timestamp_micros("at").alias("ts"), "value", F.timestamp_micros(F.col("at") + ttl_s * 1_000_000).alias("valid_until"))


def preference_stream(rows: DataFrame, ttl_days: int = C.PREFERENCE_DAYS, known: DataFrame | None = None, lateness: str = "1 hour") -> DataFrame:
    """The reply language of each user."""
    return latest_stream(rows, ttl_days * 86400, known, lateness)


def last_result_stream(rows: DataFrame, ttl_days: int = C.LAST_RESULT_DAYS, known: DataFrame | None = None, lateness: str = "1 hour") -> DataFrame:
    """The last analysis result of each user, a JSON text."""
    return latest_stream(rows, ttl_days * 86400, known, lateness)


def last_results(results: DataFrame, key: str = "sender") -> DataFrame:
    """(key, ts, value) of results with the sender and time of their messages, for ``last_result_stream`` or as its snapshot."""
    told = [c for c in results.columns if c not in (key, "ts")]
    return results.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.to_json(F.struct(*told)).alias("value"))
