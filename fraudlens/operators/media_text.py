"""Tables around media: files, recognised words, transcripts, offer letters, pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fraudlens import constants as C
from fraudlens.functions import scores, text


def media_kind(mime: Column) -> Column:
    m = F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(m.startswith("image/"), "image").when(m.startswith("audio/") | m.startswith("video/"), "audio")
        .when(m.contains("pdf") | m.contains("msword") | m.contains("officedocument.wordprocessingml.document"), "document")
    )


def media_inventory(files: DataFrame) -> DataFrame:
    """path, length, kind, format, accepted of (path, length, content), as the binaryFile source gives them."""
    ending = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(ending.isin(".pdf", ".docx", ".doc"), "document").when(ending.isin(".ogg", ".mp3", ".wav", ".m4a", ".mp4", ".webm"), "audio").when(ending.isin(".jpg", ".jpeg", ".png", ".webp", ".bmp"), "image")
    most = F.when(kind == "audio", C.MEDIA_MOST_MB["audio"]).when(kind == "image", C.MEDIA_MOST_MB["image"]).when(kind == "document", C.MEDIA_MOST_MB["document"])
    sniffed = F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B"), "docx")
    return files.select("path", "length", kind.alias("kind"), sniffed.alias("format"), F.coalesce(F.col("length") <= most * 1024 * 1024, F.lit(False)).alias("accepted"))


#: What parts the words of a run; a word that holds it is a run of its own.
_PART = "\x00"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (doc_id, block, par, line, pos, w) that follow one another in a batch and in a line, as one row each."""
    keys = ("doc_id", "block", "par", "line")
    for batch in batches:
        n, words = batch.num_rows, batch["w"]
        if not n:
            continue
        apart = pc.match_substring(words, _PART).to_numpy(zero_copy_only=False)
        new = apart.copy()
        new[1:] |= apart[:-1]
        for c in keys:  # a null begins a run
            new[1:] |= pc.fill_null(pc.not_equal(batch[c][1:], batch[c][:-1]), True).to_numpy(zero_copy_only=False)
        new[0] = True
        starts = np.flatnonzero(new)
        ends = pa.array(np.append(starts, n).astype(np.int32))
        told = pc.binary_join(pa.ListArray.from_arrays(ends, words), _PART)
        yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(starts)) for c in keys), pa.ListArray.from_arrays(ends, batch["pos"]), told], names=[*keys, "pos", "t"])


def ocr_lines(words: DataFrame) -> DataFrame:
    """(doc_id, text): words joined to lines in order, a blank line where the
    block changes. Words of negative confidence and empty words are dropped.

    Neighbouring words of a line leave a task as one row, and rows are exchanged once, by document."""
    good = words.filter((F.col("conf") >= 0) & (F.trim("word") != "")).select("doc_id", "block", "par", "line", "pos", F.trim("word").alias("w"))
    kinds = dict(good.dtypes)
    runs = good.mapInArrow(_runs, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "block", "par", "line")) + f", pos array<{kinds['pos']}>, t string").repartition("doc_id")
    pieces = F.when(F.size("pos") == 1, F.array("t")).otherwise(F.split("t", _PART))
    items = F.zip_with("pos", pieces, lambda p, w: F.struct(p.alias("pos"), w.alias("w")))
    lines = runs.groupBy("doc_id", "block", "par", "line").agg(F.collect_list(items).alias("i"))
    lines = lines.select("doc_id", "block", "par", "line", F.array_join(F.transform(F.sort_array(F.flatten("i")), lambda x: x["w"]), " ").alias("t"))
    ordered = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block", "par", "line", "t"))).alias("l"))
    spaced = F.transform("l", lambda x, i: F.when((i > 0) & (F.get(F.col("l"), i - 1)["block"] != x["block"]), F.concat(F.lit("\n"), x["t"])).otherwise(x["t"]))
    return ordered.select("doc_id", F.array_join(spaced, "\n").alias("text"))


def ocr_best_pass(words: DataFrame, order: tuple[int, ...] = C.OCR_PASSES, good: float = C.OCR_GOOD_CONFIDENCE) -> DataFrame:
    """(doc_id, pass, confidence): passes in order up to the first of mean
    confidence ``good`` or more, of these the best, the first of equals."""
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("pass").cast("int"))
    usable = words.filter((F.trim("word") != "") & (F.col("conf") > 0)).withColumn("rank", rank).filter("rank > 0")
    means = usable.groupBy("doc_id", "pass", "rank").agg(F.avg("conf").alias("mean"))
    stop = F.min(F.when(F.col("mean") >= good, F.col("rank"))).over(Window.partitionBy("doc_id"))
    tried = means.withColumn("stop", stop).filter("stop IS NULL OR rank <= stop")
    return tried.groupBy("doc_id").agg(F.max(F.struct("mean", (-F.col("rank")).alias("first"), "pass")).alias("b")).select("doc_id", F.col("b.pass").alias("pass"), F.round("b.mean", 4).alias("confidence"))


def two_column_merge(columns: DataFrame) -> DataFrame:
    """(doc_id, text) of (doc_id, left_text, right_text): lines in turn, blank ones and a right line equal to the left one skipped."""
    lines = lambda c: F.transform(F.split(F.col(c), "\n"), lambda x: F.trim(x))
    pair = F.zip_with(lines("left_text"), lines("right_text"), lambda a, b: F.array(a, F.when(~a.eqNullSafe(b), b)))
    merged = F.array_join(F.filter(F.flatten(pair), lambda x: x.isNotNull() & (x != "")), "\n")
    both = (F.coalesce("left_text", F.lit("")) != "") & (F.coalesce("right_text", F.lit("")) != "")
    return columns.select("doc_id", F.when(both, merged).otherwise(F.coalesce(F.nullif("left_text", F.lit("")), "right_text", F.lit(""))).alias("text"))


def transcript_stats(transcripts: DataFrame) -> DataFrame:
    """Confidence, duration, language name and urgency of each transcript."""
    n = F.size("segments")
    mean = F.when(n > 0, F.aggregate("segments", F.lit(0.0), lambda a, s: a + F.coalesce(s["avg_logprob"], F.lit(0.0))) / n).otherwise(0.0)
    end = F.coalesce(F.try_element_at("segments", F.lit(-1))["end"], F.lit(0.0))
    low = F.lower(F.coalesce("text", F.lit("")))
    urgent = F.exists(F.array(*[F.lit(w) for w in C.TRANSCRIPT_URGENCY]), low.contains)
    names = F.create_map(*[F.lit(x) for pair in C.LANGUAGE_NAMES.items() for x in pair])
    return transcripts.select("doc_id", F.round(mean, 6).alias("confidence"), end.alias("duration_seconds"), F.coalesce(F.try_element_at(names, F.col("language")), F.upper("language")).alias("language_name"), urgent.alias("urgency_detected"))


def transcript_audit(stats: DataFrame) -> DataFrame:
    return stats.groupBy("language_name").agg(F.count(F.lit(1)).alias("transcripts"), F.round(F.sum("duration_seconds"), 4).alias("seconds"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(F.col("urgency_detected").cast("double")), 6).alias("urgency_share"))


# Company suffixes, tax and registration numbers, phrases of fees and of urgency.
SUFFIX = (
    r"(?:Pvt\.?[ \t\n\r]*Ltd\.?|Private[ \t\n\r]+Limited|Ltd\.?|Limited|Inc\.?|LLP|Enterprises?|Solutions?|Services?|Consultanc(?:y|ies)|Agenc(?:y|ies)|"
    r"Recruitment|International|Intl\.?|Overseas|Manpower|Technologies|Tech\.?|Group|Corp\.?|Corporation)"
)
#: A name of 3 to 46 characters that ends before a suffix, and what such names are made of.
COMPANY = rf"(?i)([A-Z][A-Za-z0-9 \t\n\r&.\-]{{2,45}}?)[ \t\n\r]*{SUFFIX}"
COMPANY_RUN = r"[A-Za-z0-9 \t\n\r&.\-]{4,}"
GST = r"(?:^|[^A-Za-z0-9_])([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z])(?:[^A-Za-z0-9_]|$)"
CIN = r"(?:^|[^A-Za-z0-9_])([LU][0-9]{5}[A-Z]{2}[0-9]{4}(?:PLC|PTC|OPC|NPL|GAP|GOI)[0-9]{6})(?:[^A-Za-z0-9_]|$)"
FEE = r"(?i)(?:registration|medical|processing|security|visa|advance|joining)[ \t\n\r]*(?:fee|fees|charge|deposit)"
URGENT = r"(?i)(?:^|[^A-Za-z0-9_])(?:urgent|immediately|asap|today only|limited time|act now)(?:[^A-Za-z0-9_]|$)"


def company_name(x: Column) -> Column:
    """The first name before a company suffix.

    A name lies in one run of its characters, so runs without a suffix are
    passed over, and of the others only what is near enough before the first
    suffix, and what follows, is matched."""

    def match(x: Column) -> Column:
        blanks = F.length(x["head"]) - F.length(F.regexp_replace(x["head"], "[ \\t\\n\\r]+$", ""))
        near = F.substring(x["run"], F.greatest(F.lit(1), F.length(x["head"]) + 1 - blanks - 46), F.length(x["run"]))
        return F.nullif(F.regexp_extract(near, COMPANY, 1), F.lit(""))

    # each step is a struct, so the suffix of a run is looked for once
    runs = F.regexp_extract_all(x, F.lit(COMPANY_RUN), F.lit(0))
    placed = F.filter(F.transform(runs, lambda run: F.struct(run.alias("run"), F.regexp_instr(run, F.lit(f"(?i){SUFFIX}")).alias("at"))), lambda x: x["at"] > 0)
    heads = F.transform(placed, lambda x: F.struct(x["run"].alias("run"), F.substring(x["run"], F.lit(1), x["at"] - 1).alias("head")))
    found = F.filter(F.transform(heads, match), lambda name: name.isNotNull())
    return F.trim(F.regexp_replace(F.get(found, F.lit(0)), text.BLANKS, " "))


def document_fields(letters: DataFrame) -> DataFrame:
    """Company, tax and registration numbers, fee and urgency phrases of offer letters (doc_id, text)."""
    t = F.coalesce("text", F.lit(""))
    found = {"gst": F.regexp_extract(t, GST, 1), "cin": F.regexp_extract(t, CIN, 1)}
    rows = letters.select("doc_id", company_name(t).alias("company"), *[x.alias(c) for c, x in found.items()], t.rlike(FEE).alias("asks_fee"), t.rlike(URGENT).alias("urgent"))
    return rows.withColumns({c: F.nullif(c, F.lit("")) for c in found})


def _near_brand(company: Column) -> Column:
    """struct(d, b): the first brand in the fixed list at distance 1 to 3."""
    low = F.lower(F.trim(company))
    hits = F.array(*[F.struct(F.levenshtein(low, F.lit(b.lower()), 3).alias("d"), F.lit(b).alias("b")) for b in C.BRANDS])
    return F.get(F.filter(hits, lambda x: x["d"].between(1, 3)), F.lit(0))


def brand_impersonation(fields: DataFrame) -> DataFrame:
    """(doc_id, similar_to, distance): the first brand in the list at distance 1 to 3."""
    return fields.select("doc_id", _near_brand(F.col("company")).alias("x")).select("doc_id", F.col("x.b").alias("similar_to"), F.col("x.d").cast("long").alias("distance"))


def document_forgery(fields: DataFrame) -> DataFrame:
    """Score, band and the first three reasons, from one reading of each document."""
    rows = fields.withColumn("resembles", _near_brand(F.col("company")).isNotNull())
    tests = (
        (F.col("company").isNull(), 25, "No company name found in document"),
        (F.col("gst").isNull(), 20, "No GST number found"),
        (F.col("resembles"), 25, "Company name resembles a known brand (possible impersonation)"),
        (F.col("asks_fee"), 40, "Document asks for upfront fee"),
        (F.col("urgent"), 15, "Urgency language is unusual for formal offer documents"),
    )
    total = F.least(F.lit(100), sum((F.when(t, F.lit(n)).otherwise(F.lit(0)) for t, n, _ in tests), F.lit(0)))
    why = F.slice(F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, _, r in tests])), 1, 3)
    rows = rows.select("doc_id", total.cast("long").alias("score"), why.alias("reasons"))
    return rows.select("doc_id", "score", F.when(F.col("score") >= 60, "high").when(F.col("score") >= 30, "medium").otherwise("low").alias("risk"), "reasons")


def document_audit(forgery: DataFrame) -> DataFrame:
    return forgery.groupBy("risk").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("score"), 4).alias("avg_score"))


def image_quality(images: DataFrame) -> DataFrame:
    """Images (width, height) with a quality label by their area."""
    return images.withColumn("quality", scores.quality_label(F.col("width"), F.col("height")))
