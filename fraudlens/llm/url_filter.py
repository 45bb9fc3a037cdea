"""URL filter: host rules, and a character language-model ratio for the rest.

DataFrame functions only. URLs that a rule decides are the labelled rows: two
variable-order Markov models over characters (contexts of two, one or no
characters, each order smoothed into the next shorter one after Witten and
Bell, unseen contexts falling back) are estimated from the accepted and the
rejected ones. A URL's score is the difference of its log-likelihoods divided
by its length; the cut is calibrated on labelled URLs held out from the counts.

The alphabet has 43 symbols, so the models have at most 43**3 rows whatever the
input: that bound is what allows them to be broadcast.

Defined cases: a null URL or one without ``://`` has an empty host and path, no
rule, and is scored as it stands (null as empty); with no labelled URL of one
kind every score is 0 and the verdict ``allow``; repeated rows are judged
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fraudlens.llm.storage import cut

#: (verdict, host/path), as given with the job.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
START, END = "^", "$"
#: Letters, one digit class, URL punctuation, one class for all else.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0/.-_?=&%#:~+@*"
BINS_A_NAT = 100


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return ascii_lower, path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        at = text.index("/")
        name, start = text[:at], text[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """The URL without its scheme in the model's alphabet, with start and end marks."""
    text = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    text = F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), r"(?s)[^a-z0/.\-_?=&%#:~+@]", "*")
    return F.concat(F.lit(START * 2), text, F.lit(END))


def _grams(rows: DataFrame) -> DataFrame:
    """Each symbol with the two before it."""
    return rows.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length("_text") - 2), lambda i: F.substring(F.col("_text"), i, F.lit(3)))))


def _next_order(grams: DataFrame, shorter: DataFrame, order: int) -> DataFrame:
    """All symbols after every seen context of ``order`` characters: gram, p_a, p_r."""
    context = F.substring("gram", 1, order)
    kinds = ("a", "r")
    contexts = grams.groupBy(context.alias("_context")).agg(
        *[F.sum(f"n_{k}").alias(f"all_{k}") for k in kinds], *[F.sum((F.col(f"n_{k}") > 0).cast("long")).alias(f"types_{k}") for k in kinds]
    )
    full = contexts.withColumn("_symbol", F.explode(F.array(*[F.lit(x) for x in SYMBOLS + END])))
    full = full.withColumn("gram", F.concat("_context", "_symbol")).join(grams, "gram", "left")
    less = shorter.select(F.col("gram").alias("_less"), *[F.col(f"p_{k}").alias(f"less_{k}") for k in kinds])
    full = full.join(less, F.substring("gram", 2, order) == F.col("_less"), "left")
    smooth = lambda k: F.when(F.col(f"all_{k}") == 0, F.col(f"less_{k}")).otherwise(
        (F.coalesce(f"n_{k}", F.lit(0)) + F.col(f"types_{k}") * F.col(f"less_{k}")) / (F.col(f"all_{k}") + F.col(f"types_{k}"))
    )
    # a longer context is seen only if its end is, so the shorter order always has the row
    return full.select("gram", *[smooth(k).alias(f"p_{k}") for k in kinds])


def markov_models(labelled: DataFrame) -> DataFrame:
    """(gram, ratio): log ratio of a gram's last symbol after its context, for
    all symbols after every seen context of 0, 1 and 2 characters. Input:
    _text and _accepted."""
    counts = lambda rows: rows.agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in ("a", "r")])
    three = cut(counts(_grams(labelled).select("gram", F.col("_accepted").cast("long").alias("n_a"), (~F.col("_accepted")).cast("long").alias("n_r")).groupBy("gram")), "grams")
    two = counts(three.groupBy(F.substring("gram", 2, 2).alias("gram")))
    one = counts(two.groupBy(F.substring("gram", 2, 1).alias("gram")))
    n = len(SYMBOLS) + 1
    total = one.agg(F.coalesce(F.sum("n_a"), F.lit(0)).alias("all_a"), F.coalesce(F.sum("n_r"), F.lit(0)).alias("all_r"))
    zero = total.withColumn("gram", F.explode(F.array(*[F.lit(x) for x in SYMBOLS + END]))).join(one, "gram", "left")
    zero = zero.select("gram", *[((F.coalesce(f"n_{k}", F.lit(0)) + 1) / (F.col(f"all_{k}") + n)).alias(f"p_{k}") for k in ("a", "r")])
    first = _next_order(two, zero, 1)
    second = _next_order(three, first, 2)
    return zero.unionByName(first).unionByName(second).select("gram", (F.log("p_a") - F.log("p_r")).alias("ratio"))


def scored(rows: DataFrame, models: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``score``: mean log ratio over a row's symbols. Rows meet the models by
    broadcast; the sums of a row are complete before anything is shuffled."""
    grams = _grams(rows.withColumn("_row", F.monotonically_increasing_id()))
    for order in (2, 1, 0):
        size = order + 1
        model = models.filter(F.length("gram") == size).select(F.col("gram").alias(f"_gram_{order}"), F.col("ratio").alias(f"_ratio_{order}"))
        grams = grams.join(F.broadcast(model), F.substring("gram", 3 - order, size) == F.col(f"_gram_{order}"), "left")
    ratio = F.coalesce("_ratio_2", "_ratio_1", "_ratio_0", F.lit(0.0))
    return grams.groupBy("_row", *keep).agg(F.avg(ratio).alias("score")).drop("_row")


def calibrate(judged: DataFrame) -> float:
    """The cut on ``score`` with the least sum of error rates over labelled rows
    (score, _accepted), from a histogram: a bounded number of bins meets in one
    task. A cut lies in the middle between two filled bins; of equal cuts the
    one nearest to 0 is taken."""
    most = 10 * BINS_A_NAT
    at = F.least(F.lit(most), F.greatest(F.lit(-most), F.floor(F.col("score") * BINS_A_NAT))).cast("int")
    bins = judged.groupBy(at.alias("bin")).agg(F.sum(F.col("_accepted").cast("long")).alias("a"), F.sum((~F.col("_accepted")).cast("long")).alias("r"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    lost = F.coalesce(F.sum("a").over(below), F.lit(0)) / F.greatest(F.sum("a").over(whole), F.lit(1))
    missed = (F.sum("r").over(whole) - F.coalesce(F.sum("r").over(below), F.lit(0))) / F.greatest(F.sum("r").over(whole), F.lit(1))
    middle = (F.col("bin") + F.coalesce(F.lag("bin").over(Window.orderBy("bin")) + 1, F.col("bin"))) / 2
    best = bins.select(middle.alias("cut"), (lost + missed).alias("error")).orderBy("error", F.abs(F.col("cut")), "cut").first()
    return best["cut"] / BINS_A_NAT if best else 0.0


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, held_out: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict, score. One in ``held_out`` labelled
    URLs (by checksum) is left out of the counts and calibrates the cut."""
    host, path = host_and_path(F.col(url_col))
    rule, verdict = rule_of(host, path, rules)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("_verdict"), symbols(F.col(url_col)).alias("_text"))
    rows = rows.withColumn("_held", F.pmod(F.crc32(F.col("_text").cast("binary")), F.lit(held_out)) == 0)
    labelled = rows.filter(F.col("_verdict").isNotNull() & ~F.col("_held")).select("_text", (F.col("_verdict") == "allow").alias("_accepted"))
    models = cut(markov_models(labelled), "url_models")
    both = labelled.agg(F.count_distinct("_accepted")).first()[0] == 2
    if not both:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    judged = cut(scored(rows, models, ["page_id", "host", "path", "rule", "_verdict", "_held"]), "url_scores")
    least = calibrate(judged.filter(F.col("_verdict").isNotNull() & F.col("_held")).select("score", (F.col("_verdict") == "allow").alias("_accepted")))
    by_score = F.when(F.col("score") >= F.lit(least), F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_verdict", by_score).alias("verdict"), "score")
