"""Mixing sources to target weights that vary over training.

Each source has a schedule: its weight as a piecewise linear function of
training time 0..1. The schedule's integral is the source's share. A source
gives its documents in a fixed shuffled order, again from the start when it is
used up; the words before a document in that stream, set against the source's
cumulative demand, give by inversion the training time at which it is read.
Documents are then range-sorted by that position.

Running sums over a source use two levels (buckets of a source, rows of a
bucket), so a source with a third of all rows is spread over many tasks.

Defined cases: null text has size 0; null source is a source of its own, last
in order; documents of size 0 are never taken; an empty table gives an empty
result; ids may be null or repeated, rows with equal ids are ordered by size,
then by a hash of all columns; other columns are ignored by ``plan_mix`` and
kept by ``training_order``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fraudlens.llm.storage import cut, row_hash

WORD = r"[^\x20\x09-\x0D]+"
#: Schedules by rank of the source: (time, weight), linear between; their integrals are 5, 2 and 1.
SCHEDULES = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 2.0), (0.5, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
MOST_REPEATS = 3
#: Hex digits of the shuffling hash that make a bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def invert(knots: Sequence[tuple[float, float]], share: Column) -> Column:
    """The time at which ``share`` (0..1) of a schedule's integral is reached."""
    need = share * F.lit(integral(knots))
    out, done = None, 0.0
    segments = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        slope, part = (w1 - w0) / (t1 - t0), need - F.lit(done)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * part))
        segments.append((done + area, F.lit(t0) + F.when(part <= 0, F.lit(0.0)).otherwise(2 * part / (F.lit(w0) + root))))
        done += area
    for end, time in reversed(segments):
        out = time if out is None else F.when(need <= F.lit(end), time).otherwise(out)
    return F.least(F.lit(knots[-1][0]), out)


def ranked_sources(sources: DataFrame) -> DataFrame:
    """``_rank`` of each _source in code point order, null last, from 0.

    Sources are sorted in ranges; a source's rank is its place in its range
    plus the sizes of the ranges before, one row for each range."""
    key = F.struct(F.col("_source").isNull().alias("none"), F.col("_source").alias("name"))
    ranges = cut(sources.withColumn("_key", key).repartitionByRange("_key").withColumn("_part", F.spark_partition_id()), "sources")
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_from"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_key")) - 1
    return ranges.withColumn("_place", place).join(F.broadcast(sizes), "_part").select(*sources.columns, (F.col("_from") + F.col("_place")).alias("_rank"))


def source_targets(sources: DataFrame, schedules=SCHEDULES, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """Targets of sources (_source, _source_size): shares by schedule integral
    in code point order, none above ``most_repeats`` times its source, the
    excess reshared by weight until none is above.

    ``level`` is the target of weight 1. Each round caps the sources that it
    would overfill and shares what is left among the others, which raises it; it
    stays once no further source is capped. A round is one sum over the sources."""
    n = len(schedules)
    kind = F.pmod(F.col("_rank"), F.lit(n)).cast("int")
    weight = reduce(lambda out, i: F.when(F.col("_kind") == i, F.lit(float(integral(schedules[i])))).otherwise(out), range(n), F.lit(0.0))
    ranked = cut(ranked_sources(sources).withColumn("_kind", kind).withColumn("_weight", weight).withColumn("_most", F.col("_source_size") * most_repeats), "ranked_sources")
    level, capped = 0.0, -1
    while True:
        over = F.col("_most") < F.lit(level) * F.col("_weight")
        sums = ranked.agg(
            F.sum("_source_size").alias("all"), F.sum(F.when(over, F.col("_most"))).alias("held"), F.sum(F.when(~over, F.col("_weight"))).alias("left"), F.count(F.when(over, F.lit(1))).alias("capped")
        ).first()
        if sums["capped"] == capped or not sums["left"]:
            break
        level, capped = (sums["all"] - (sums["held"] or 0)) / sums["left"], sums["capped"]
    most = F.col("_most").cast("double")
    return ranked.select("_source", "_kind", "_source_size", F.least(F.lit(level) * F.col("_weight"), most).alias("_target"))


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules=SCHEDULES, most_repeats: int = MOST_REPEATS, carry: bool = False
) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken,
    and first_position (null if not taken) in training time, plus _start (words
    before it in its source's stream) and _kind. With ``carry`` the document's
    own columns come along as the struct _doc, and _tie orders rows of equal id and size."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    # null ids are dealt by their row, so that many of them do not meet in one bucket
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row "), row_hash(docs).cast("string"))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("_source"), words.alias("size"), order.alias("_hash"), *([row_hash(docs).alias("_tie"), F.struct(*[docs[c] for c in docs.columns]).alias("_doc")] if carry else []))
    rows = rows.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    # plain keys, equal for a null source as well: the window and the join below share one shuffle
    rows = rows.withColumn("_none", F.col("_source").isNull()).withColumn("_name", F.coalesce(F.col("_source").cast("string"), F.lit("")))
    buckets = cut(rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_bucket_size")), "mix_buckets")
    sources = source_targets(buckets.groupBy("_source").agg(F.sum("_bucket_size").alias("_source_size")), schedules, most_repeats)
    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = buckets.select("_source", "_bucket", F.coalesce(F.sum("_bucket_size").over(ahead), F.lit(0)).alias("_from")).alias("b")
    begins = begins.join(sources.alias("s"), F.col("b._source").eqNullSafe(F.col("s._source"))).select("b._source", "b._bucket", "_from", "_kind", "_source_size", "_target")
    begins = begins.withColumn("_none", F.col("_source").isNull()).withColumn("_name", F.coalesce(F.col("_source").cast("string"), F.lit("")))
    carried = ["_tie", "_doc"] if carry else []
    inside = Window.partitionBy("_none", "_name", "_bucket").orderBy("_hash", "doc_id", "size", *carried[:1]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r")
    both = rows.join(begins.drop("_source").alias("b"), ["_none", "_name", "_bucket"])
    full = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("_target") - full * F.col("_source_size")).cast("long")
    start = F.col("_from") + F.col("_ahead")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - start)).cast("long")
    planned = both.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), start.alias("_start"), (full * F.col("size") + part).alias("taken"), "_kind", *carried)
    return planned.withColumn("first_position", F.when(F.col("taken") > 0, _position(F.col("_start"), schedules)))


def _position(offset: Column, schedules) -> Column:
    share = F.least(F.lit(1.0), offset / F.greatest(F.col("target"), F.lit(1e-9)))
    return reduce(lambda out, i: F.when(F.col("_kind") == i, invert(schedules[i], share)).otherwise(out), range(len(schedules)), F.lit(None).cast("double"))


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules=SCHEDULES, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """The documents as training reads them: all their columns, a row for each
    reading, range-sorted by position. A last reading that the demand cuts
    counts if at least half of the document is in it. Each row is planned with
    its own columns, so ids may be null or repeated."""
    plan = plan_mix(docs, id_col, text_col, source_col, schedules, most_repeats, carry=True)
    plan = plan.withColumn("_times", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")).filter("_times > 0")
    reads = plan.select("doc_id", "_tie", "_doc", F.explode(F.transform(F.sequence(F.lit(0), F.col("_times") - 1), lambda k: _position(F.col("_start") + k * F.col("source_size"), schedules))).alias("_position"))
    return reads.orderBy("_position", "doc_id", "_tie").select("_doc.*")
