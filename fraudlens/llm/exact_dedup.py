"""Exact deduplication by skew-safe combining.

1. Rows are combined where they are read (the map side of the first
   aggregation), so a content that fills a third of the table leaves each task
   as one row.
2. What is left is merged by digest, full content and a salt, so that copies
   of one content meet in several tasks.
3. The winners of the salts are combined by digest and full content.

Grouping keys hold the content itself at each step: a digest alone never
decides that two texts are equal.

Defined cases: a null text is the empty text; an empty table gives an empty
result; of rows with equal content the one with most code points stays, ties go
to the smallest id, null ids come last; rows that repeat an id and a content
share one answer in ``exact_dedup``, but of copies that all have no id one is kept, while
``drop_exact_copies`` keeps one row of each content whatever the ids. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.storage import cut, row_hash

SPACES = r"[\x20\x09-\x0D]+"
#: Groups with at least this share of all rows are joined by broadcast; there are at most so many of them.
HOT_GROUPS = 4096


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256_hex,
    tie: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): ``rows`` has a narrow row for each document (_id, _n, _row,
    _digest, _check), ``groups`` one for each content (_digest, _check, _keep,
    _size, and _best, the rank of the row that stays, in which ``tie`` comes last). ``_check`` is a second hash that tells contents of equal digest
    apart; should both agree for different contents the job fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ties = [] if tie is None else ["_tie"]
    base = docs.select(F.col(id_col).alias("_id"), F.char_length(text).alias("_n"), F.regexp_replace(text, SPACES, "").alias("_content"), F.monotonically_increasing_id().alias("_row"), *([] if tie is None else [tie.alias("_tie")]))
    base = base.select("_id", "_n", "_row", "_content", *ties, digest(F.col("_content")).alias("_digest"))
    rank = F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), *[F.col(c).alias("tie") for c in ties])
    salted = (
        base.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
        .groupBy("_digest", "_content", "_salt")
        .agg(F.min(rank).alias("_best"), F.count(F.lit(1)).alias("_size"))
    )
    contents = salted.groupBy("_digest", "_content").agg(F.min("_best").alias("_best"), F.sum("_size").alias("_size"))
    groups = (
        contents.select("_digest", F.xxhash64("_content").alias("_check"), "_best", "_size")
        .groupBy("_digest", "_check")
        .agg(F.min("_best").alias("_best"), F.sum("_size").alias("_size"), F.count(F.lit(1)).alias("_contents"))
        .select(
            "_digest",
            "_check",
            F.when(F.col("_contents") > 1, F.raise_error(F.lit("two contents share both hashes"))).otherwise(F.col("_best.id")).alias("_keep"),
            "_size",
            *(["_best"] if ties else []),
        )
    )
    return base.select("_id", "_n", "_row", "_digest", F.xxhash64("_content").alias("_check")), cut(groups, "exact_groups")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    The rows meet their group by its hashes. Groups that hold over 1/4096 of
    all rows (so at most 4,096 groups) come by broadcast and their rows are
    spread over the join's tasks; all others are small beside the table.
    """
    rows, groups = exact_groups(docs, id_col, text_col, salts, digest)
    rows = cut(rows, "exact_rows")  # its row numbers decide below
    total = groups.agg(F.sum("_size")).first()[0] or 0
    hot = groups.filter(F.col("_size") * HOT_GROUPS >= F.lit(total)).filter(F.col("_size") > 1)
    hot = hot.select("_digest", "_check", F.col("_keep").alias("_hot_keep"), F.col("_size").alias("_hot_size"))
    spread = F.concat(F.lit("hot "), F.pmod(F.xxhash64("_row"), F.lit(HOT_GROUPS)).cast("string"))
    # of the longest copies without an id the first row; it counts where such a row is what stays
    nameless = rows.filter("_id IS NULL").groupBy("_digest", "_check").agg(F.min(F.struct((-F.col("_n")).alias("n"), "_row")).alias("_first"))
    nameless = nameless.select(F.col("_first._row").alias("_row"), F.lit(True).alias("_is_first"))
    rows = rows.join(F.broadcast(hot), ["_digest", "_check"], "left").withColumn("_at", F.when(F.col("_hot_size").isNull(), F.col("_digest")).otherwise(spread))
    rest = groups.select(F.col("_digest").alias("_at"), "_check", "_keep", "_size")
    keep = F.when(F.col("_hot_size").isNull(), F.col("_keep")).otherwise(F.col("_hot_keep"))
    return rows.join(rest, ["_at", "_check"], "left").join(nameless, "_row", "left").select(
        F.col("_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("_hot_size", "_size").alias("group_size"),
        F.coalesce(F.col("_id") == keep, F.col("_id").isNull() & keep.isNull() & F.coalesce("_is_first", F.lit(False))).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each content, with all its columns; ids may be null or repeated.

    A row is known by its content's hashes, length, id and a hash of all its
    columns; rows that agree in all of these are copies of which one stays. They
    are combined where they are read, and combining and the join with the
    winners share one shuffle."""
    tie = row_hash(docs)
    _, groups = exact_groups(docs, id_col, text_col, tie=tie)
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.regexp_replace(text, SPACES, "")
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_doc")
    by = ["_digest", "_check", "_n", "_no_id", "_id", "_tie"]
    rows = docs.select(sha256_hex(content).alias("_digest"), F.xxhash64(content).alias("_check"), F.char_length(text).alias("_n"), F.col(id_col).isNull().alias("_no_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), tie.alias("_tie"), whole)
    winners = groups.select("_digest", "_check", (-F.col("_best.n")).alias("_n"), F.col("_best.no_id").alias("_no_id"), F.coalesce(F.col("_best.id").cast("string"), F.lit("")).alias("_id"), F.col("_best.tie").alias("_tie"))
    return rows.groupBy(*by).agg(F.first("_doc").alias("_doc")).join(winners, by, "left_semi").select("_doc.*")
