"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraudlens.llm.mixing import plan_mix

    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.orderBy(F.col("first_position").asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("first_position", 9).alias("first_position"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraudlens.llm.html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraudlens.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraudlens.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraudlens.llm.token_orc import tokens_through_orc

    return tokens_through_orc(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraudlens.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraudlens.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraudlens.llm.near_dedup import near_components

    return near_components(table(spark, sf_dir, "documents"), words=4)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraudlens.llm.sentencepiece_ids import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op10_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraudlens.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraudlens.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraudlens.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fraudlens.llm.alignment import align_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"))


CORPUS = (
    op1_mix_sources, op2_main_text, op3_exact_dedup, op4_ann_search, op5_token_orc, op6_language_id, op7_url_filter, op8_near_dedup,
    op9_sentencepiece, op10_shard_slots, op11_spelling_variants, op12_personal_data, op13_align_tokenizers,
)
QUERIES = {f.__name__: f for f in CORPUS}

ORACLE_SQL = {
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
r AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
s AS (
  SELECT source, sum(size) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (
  SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 3 * s AS most FROM s),
l AS (
  SELECT *, (sum(s) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT *, most < level * weight AS capped FROM l),
t AS (
  SELECT *, least(CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE max(CASE WHEN NOT capped THEN level END) OVER () * weight END, CAST(most AS DOUBLE)) AS target FROM c),
j AS (
  SELECT r.*, t.rank, t.s, t.target, CASE WHEN t.s > 0 THEN CAST(floor(t.target / t.s) AS BIGINT) ELSE 0 END AS full_times
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, full_times * size + greatest(0, least(size, CAST(round(target - full_times * s) AS BIGINT) - start)) AS taken,
         least(1.0, start / greatest(target, 1e-9)) AS share FROM j)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, round(target, 6) AS target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN round(CASE rank % 3
         WHEN 0 THEN 2 * share * 5 / (6 + sqrt(36 - 4 * share * 5))
         WHEN 1 THEN share
         ELSE 2 * share / (0.5 + sqrt(0.25 + 2 * share)) END, 9) END AS first_position
FROM k""",
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content FROM documents),
g AS (
  SELECT doc_id, content, first_value(doc_id) OVER (PARTITION BY content ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY content) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM g""",
    "op11_spelling_variants": r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda c: list_reduce([c] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc_table),
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
c AS (
  SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 5 GROUP BY doc_id, run),
h AS (
  SELECT run, k, xor(list_reduce([4294967295] || flatten(list_transform(string_split(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run), ''),
           lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END)),
           lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM c, t),
d AS (
  SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM h),
w AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
x AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
v AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM x),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM v AS a JOIN v AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.rest = w.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.rest = w.word),
b AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS rank, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM w LEFT JOIN b ON w.word = b.word AND b.rank = 1),
chain AS (
  SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON chain.at = f.word WHERE f.form IS NOT NULL),
ends AS (
  SELECT chain.word, chain.at FROM chain JOIN f ON chain.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, ends.at AS root, f.n, f.n_near, f.form_n FROM f JOIN ends ON f.word = ends.word""",
}
