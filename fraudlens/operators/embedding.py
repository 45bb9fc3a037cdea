"""Centroids of embedding clusters and scores against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.folded import FoldedTable


def vector_parse(x: Column) -> Column:
    """``[a,b]`` as an array, null if it does not parse."""
    return F.from_json(x, "array<double>")


def missing_embeddings(rows: DataFrame, vector: str = "embedding", text: str = "text") -> DataFrame:
    return rows.filter(F.col(vector).isNull() & F.col(text).isNotNull())


def centroids(vectors: DataFrame) -> DataFrame:
    """cluster, sample_count, centroid: the element-wise mean, scaled to length 1."""
    usable = vectors.filter(F.col("embedding").isNotNull())
    items = usable.select("cluster", F.posexplode("embedding").alias("pos", "x"))
    means = items.groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p")).select("cluster", F.transform("p", lambda e: e["x"]).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))
    counts = usable.groupBy("cluster").agg(F.count(F.lit(1)).alias("sample_count"))
    return packed.join(counts, "cluster").select("cluster", "sample_count", F.when(norm > 0, F.transform("mean", lambda x: x / norm)).otherwise(F.col("mean")).alias("centroid"))


def cosine(a: Column, b: Column) -> Column:
    """0 if one vector is zero."""
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    under = norm(a) * norm(b)
    return F.when(under == 0, F.lit(0.0)).otherwise(dot / under)


def _rounded(x: Column) -> Column:
    """Four places; what is rounded to 0 keeps its sign, as floats do."""
    return F.when((x < 0) & (F.round(x, 4) == 0), F.lit(-0.0)).otherwise(F.round(x, 4))


def embedding_score(vectors: DataFrame, found: DataFrame) -> DataFrame:
    """Nearness to the scam against the legitimate centroid, 0 to 1; 0.5 where a
    vector or a centroid is missing. Where there is a column ``text``, a blank one
    is not compared either. The centroids come as one broadcast row."""
    one = found.filter(F.col("cluster").isin("legitimate", "scam")).agg(F.max(F.when(F.col("cluster") == "legitimate", F.col("centroid"))).alias("_legit"), F.max(F.when(F.col("cluster") == "scam", F.col("centroid"))).alias("_scam"))
    rows = vectors.crossJoin(F.broadcast(one)).withColumn("_l", cosine(F.col("embedding"), F.col("_legit"))).withColumn("_s", cosine(F.col("embedding"), F.col("_scam")))
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\r\\f]+", " ")) == "" if "text" in vectors.columns else F.lit(False)
    both = F.col("_l").isNotNull() & F.col("_s").isNotNull() & ~blank
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_s") - F.col("_l") + 1) / 2))
    status = F.when(blank, "empty_input").when(F.col("embedding").isNull(), "no_embedding").when(~both, "no_centroids").otherwise("ok")
    return rows.select(
        "vec_id",
        F.when(blank, F.lit(0.0)).when(both, _rounded(F.col("_l"))).alias("sim_to_legitimate"),
        F.when(blank, F.lit(0.0)).when(both, _rounded(F.col("_s"))).alias("sim_to_scam"),
        F.when(blank, F.lit(0.0)).when(both, F.round(F.abs(F.col("_s") - F.col("_l")), 4)).alias("boundary_distance"),
        F.when(both, F.round(score, 4)).otherwise(F.lit(0.5)).alias("embedding_score"),
        status.alias("status"),
    )


#: What parts words: blanks, control characters and punctuation of ASCII.
WORD_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def has_words(text: Column) -> Column:
    return text.rlike(WORD_BREAKS.replace("[", "[^", 1).rstrip("+"))


def _with(x: Column, f) -> Column:
    """``f`` of ``x``, which is evaluated once however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def encoded(text: Column, size: int) -> Column:
    """A text as a vector of length 1: counts of its words and pairs of neighbouring words, each in the slot of its hash.

    Words are lower-cased in A-Z only. Null for a text without words. Slots are
    sorted together with one entry of each, so a run's length tells a count: n log n in the
    words, whatever the size, and no shuffle.
    """
    lower = F.translate(text, UPPER, LOWER)
    words = F.filter(F.split(lower, WORD_BREAKS), lambda w: w != "")
    pairs = lambda ws: F.filter(F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
    slot = lambda g: F.pmod(F.conv(F.substring(F.md5(g.cast("binary")), 1, 7), 16, 10).cast("int"), F.lit(size))
    slots = _with(words, lambda ws: F.transform(F.concat(ws, pairs(ws)), slot))

    def counts(runs: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(runs) - 1), lambda i: (i == 0) | (F.get(runs, i) != F.get(runs, i - 1)))
        return _with(begins, lambda b: F.zip_with(b, F.concat(F.slice(b, 2, size), F.array(F.size(runs))), lambda s, e: (e - s - 1).cast("double")))

    counted = _with(F.sort_array(F.concat(slots, F.sequence(F.lit(0), F.lit(size - 1)))), counts)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return _with(counted, lambda v: _with(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))))


def embed_missing(rows: DataFrame, size: int, vector: str = "embedding", text: str = "text") -> DataFrame:
    """``rows`` where a vector that is missing is encoded from the text, if that has words."""
    kind = rows.schema[vector].dataType
    return rows.withColumn(vector, F.coalesce(F.col(vector), encoded(F.col(text), size).cast(kind)))


CENTROID_SUMS = "cluster string, sample_count long, sums array<double>"


def _sums(of: str, size: int) -> Column:
    return F.array(*[F.sum(F.get(of, F.lit(i)).cast("double")) for i in range(size)]).alias("sums")


def centroid_sums(vectors: DataFrame, size: int) -> DataFrame:
    """(cluster, sample_count, sums): what a batch adds to centroids. A cluster leaves a
    task as one row. Vectors that are missing, of another length, or with a component
    that is null or not finite are left out."""
    whole = lambda e: (F.size(e) == size) & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    # not a filter, which would be pushed down and encode a text once more for each time it names the vector
    usable = vectors.select("cluster", _with(F.col("embedding"), lambda e: F.when(whole(e), e)).alias("v"))
    return usable.groupBy("cluster").agg(F.count("v").alias("sample_count"), _sums("v", size)).filter("sample_count > 0")


def centroid_fold(size: int):
    """Sums of batches as one row of each cluster, the fold of a ``FoldedTable``."""
    return lambda states: states.groupBy("cluster").agg(F.sum("sample_count").alias("sample_count"), _sums("sums", size))


def centroids_of(sums: DataFrame) -> DataFrame:
    """cluster, sample_count, centroid, as ``centroids`` gives them."""
    mean = _with(F.transform("sums", lambda x: x / F.col("sample_count")), lambda m: _with(F.sqrt(F.aggregate(m, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.when(n > 0, F.transform(m, lambda x: x / n)).otherwise(m)))
    return sums.select("cluster", "sample_count", mean.alias("centroid"))


def add_postings(store: FoldedTable, batch: int, rows: DataFrame, size: int) -> None:
    """One batch of postings (cluster, text, embedding): missing vectors are encoded, and the centroids' sums grow by the batch."""
    store.put(batch, centroid_sums(embed_missing(rows, size), size))
    store.compact()


def centroid_store(spark: SparkSession, folder: str, size: int) -> FoldedTable:
    return FoldedTable(spark, folder, CENTROID_SUMS, centroid_fold(size))
