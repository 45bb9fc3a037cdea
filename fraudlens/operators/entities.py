"""Entity tables of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens import constants as C
from fraudlens.functions import text


def entity_columns(messages: DataFrame) -> DataFrame:
    """Messages with their entities as columns; the text itself is dropped. The
    place is a step of its own, since the role depends on it."""
    t = F.col("text")
    rows = messages.withColumns({"location": text.location(t), "fee": text.amount(t, C.FEE_WORDS), "urgency_flags": text.urgency_flags(t)})
    rows = rows.withColumns({"role": text.role(t, F.col("location")), "phones": text.phones(t), "upi_ids": text.upi_ids(t)})
    rows = rows.withColumns({"salary": text.amount(t, C.SALARY_WORDS), "agent": text.agent(t), "company": text.company(t)})
    return rows.withColumns({"has_fee": F.col("fee").isNotNull(), "has_urgency": F.size("urgency_flags") > 0}).drop("text")


def _entity_rows(rows: DataFrame) -> DataFrame:
    e = F.col
    item = lambda kind, v, i: F.struct(F.lit(kind).alias("entity_type"), v.cast("string").alias("value"), i.cast("long").alias("pos"))
    listed = lambda c, k: F.transform(e(c), lambda v, i: item(k, v, i))
    many = [listed(c, k) for c, k in (("phones", "phone"), ("upi_ids", "upi"), ("urgency_flags", "urgency"))]
    single = F.array(*[item(k, e(k), F.lit(0)) for k in ("salary", "fee", "role", "location", "agent", "company")])
    found = F.filter(F.concat(*many, single), lambda x: x["value"].isNotNull())
    return rows.select("msg_id", F.explode(found).alias("x")).select("msg_id", "x.*")


def entity_table(messages: DataFrame) -> DataFrame:
    """(msg_id, entity_type, value, pos): one row for each entity of a message."""
    return _entity_rows(entity_columns(messages))


def entity_prevalence(texts: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages, channels and times of each entity in ``texts`` (msg_id, text); ``messages`` has msg_id, ts and source_channel.

    A message's entities are exchanged as one row and before they are listed, and no text is exchanged."""
    found = _entity_rows(entity_columns(texts.select("msg_id", "text")).repartition("msg_id"))
    rows = found.select("msg_id", "entity_type", "value").distinct().join(messages.select("msg_id", "ts", "source_channel"), "msg_id")
    return rows.groupBy("entity_type", "value").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("source_channel").alias("channels"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def amount_profile(messages: DataFrame) -> DataFrame:
    """Salaries and fees by location."""
    rows = messages.select(text.location(F.col("text")).alias("location"), text.amount(F.col("text"), C.SALARY_WORDS).alias("salary"), text.amount(F.col("text"), C.FEE_WORDS).alias("fee"))
    stats = [f(c).alias(f"{n}_{c}") for c in ("salary", "fee") for n, f in (("min", F.min), ("max", F.max))]
    means = [F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("salary", "fee")]
    return rows.groupBy(F.coalesce("location", F.lit("unknown")).alias("location")).agg(F.count(F.lit(1)).alias("messages"), *stats, *means, F.round(F.avg(F.col("fee").isNotNull().cast("double")), 6).alias("fee_share"))


def normalize_inbound(jobs: DataFrame, *more: str) -> DataFrame:
    """Raw chat jobs with typed, cleaned fields, and ``more`` columns as they are."""
    return jobs.select(
        "conv_id",
        "turn",
        F.trim(F.regexp_replace("from_number", "^whatsapp:", "")).alias("from_number"),
        F.trim(F.replace(F.coalesce("body_text", F.lit("")), F.lit("CHECK"), F.lit(""))).alias("body_text"),
        text.parsed_bool(F.col("forwarded_many_times")).alias("forwarded"),
        F.coalesce(text.safe_int(F.col("media_count")), F.lit(0)).alias("media_count"),
        text.source_name(F.col("source")).alias("source"),
        *more,
    )
