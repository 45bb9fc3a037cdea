"""Verdicts: parsing model answers, reasons, evidence, report rows, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens import constants as C
from fraudlens.functions import scores, text

ANSWER = "struct<verdict:string,confidence:string,reasoning:string,key_contradiction:string,hindi_worker_message:string>"


def _json_object(x: Column) -> Column:
    """``x`` as an answer if it is one JSON object and nothing else. It is read as the first of
    two elements of an array whose second is a digest of ``x``, which ``x`` cannot
    contain, so neither text behind the object nor a second value passes."""
    strict, digest = {"allowSingleQuotes": "false"}, F.sha2(x, 256)
    pair = F.from_json(F.concat(F.lit("["), x, F.lit(', "'), digest, F.lit('"]')), "array<string>", strict)
    whole = x.rlike(r"(?s)^\{.*\}$") & (F.size(pair) == 2) & (F.try_element_at(pair, F.lit(2)) == digest)
    return F.when(whole, F.from_json(x, ANSWER, strict))


def verdict_parse(raw: Column) -> Column:
    """The JSON object of a model answer: the whole text, else a fenced block, else
    what stands from the first brace to the last; null if that does not parse."""
    whole = text.stripped(raw)
    fenced = F.regexp_extract(whole, r"(?is)```(?:json)?[ \t\n\r]*(\{.*?\})[ \t\n\r]*```", 1)
    inline = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
    return F.coalesce(_json_object(whole), _json_object(F.when(fenced != "", fenced).otherwise(inline)))


def verdict_normalize(answers: DataFrame) -> DataFrame:
    """msg_id and the verdict columns of (msg_id, llm_raw). An answer that is
    missing or cannot be parsed gives the failure row."""
    rows = answers.select("msg_id", verdict_parse(F.col("llm_raw")).alias("a"), F.col("llm_raw").isNull().alias("none"))
    failed = F.col("a").isNull()
    verdict = F.when(failed, "SUSPICIOUS").otherwise(scores.verdict_of(F.col("a.verdict")))
    rows = rows.withColumn("verdict", verdict)
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    contradiction = filled(F.col("a.key_contradiction"))
    advice = F.when(F.col("verdict") == "HIGH_RISK", "Yeh offer high risk lag raha hai, paise mat bhejiye.").when(F.col("verdict") == "SUSPICIOUS", "Is offer ko verify kiye bina koi payment mat kijiye.").otherwise("Offer filhal theek lagta hai, fir bhi details verify kar lijiye.")
    return rows.select(
        "msg_id",
        "verdict",
        F.when(failed, F.lit(C.FAILED_CONFIDENCE)).otherwise(scores.confidence_of(F.col("a.confidence"))).cast("long").alias("confidence"),
        F.when(failed, F.when(F.col("none"), "AI investigator unavailable (no answer).").otherwise("AI investigator unavailable (answer is not valid JSON).")).otherwise(F.coalesce(filled(F.col("a.reasoning")), F.lit("Evidence indicates inconsistent recruitment behavior."))).alias("reasoning"),
        F.when(F.lower(contradiction) != "null", contradiction).alias("key_contradiction"),
        F.when(failed, "System busy hai, verification ke bina payment na karein.").otherwise(F.coalesce(filled(F.col("a.hindi_worker_message")), advice)).alias("hindi_worker_message"),
        scores.verdict_score(F.col("verdict")).alias("risk_score"),
    )


def reasons(reasoning: Column, contradiction: Column, details: Column, signals: Column) -> Column:
    """Up to five reasons: the reasoning, the contradiction, details until there
    are four (one at least), signals until there are five (one at least), the
    first of equals whatever their case."""
    filled = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    head = filled(F.array(F.trim(reasoning), contradiction))
    details = F.transform(filled(details), lambda x: F.trim(x))
    taken = F.concat(head, F.slice(details, F.lit(1), F.greatest(F.lit(1), 4 - F.size(head))))
    told = F.transform(filled(signals), lambda x: F.replace(x, F.lit("_"), F.lit(" ")))
    taken = F.concat(taken, F.slice(told, F.lit(1), F.greatest(F.lit(1), 5 - F.size(taken))))
    low = lambda a: F.transform(a, lambda x: F.lower(x))
    once = F.filter(taken, lambda x, i: F.array_position(low(taken), F.lower(x)) == i + 1)
    return F.when(F.size(once) > 0, F.slice(once, 1, 5)).otherwise(F.array(F.lit("No major contradiction identified.")))


def evidence_bundle(rows: DataFrame) -> DataFrame:
    """msg_id and the evidence text: fixed sections, ``N/A`` for entities that
    are missing, empty or 0, ``None`` for missing layer results, media lines where there are any."""
    kinds = dict(rows.dtypes)

    def named(c: str) -> Column:
        x = F.col(c)
        return F.coalesce(F.when(x != (F.lit("") if kinds[c] == "string" else F.lit(0)), x.cast("string")), F.lit("N/A"))

    def told(c: str) -> Column:
        x = F.col(c).cast("string") if c in kinds else F.lit(None).cast("string")
        if kinds.get(c) == "boolean":
            x = F.initcap(x)
        if kinds.get(c) == "double":  # four places at most, without an exponent
            shown = F.regexp_replace(F.regexp_replace(F.col(c).cast("decimal(20,4)").cast("string"), "0+$", ""), "[.]$", ".0")
            x = F.when(x == "-0.0", x).otherwise(shown)  # a decimal has no negative zero
        return F.coalesce(x, F.lit("None"))

    listed = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))).otherwise("N/A")
    title = lambda x: [F.lit(""), F.lit(f"=== {x} ===")]
    line = lambda name, x: F.concat(F.lit(name + ": "), x)
    lines = [
        *title("MESSAGE")[1:], text.stripped(F.coalesce("text", F.lit(""))),
        *title("EXTRACTED ENTITIES"), line("Company", named("company")), line("Phones", listed("phones")), line("Salary claimed", named("salary")), line("Fee requested", named("fee")),
        line("Claimed location", named("location")), line("Job role", named("role")), line("UPI IDs", listed("upi_ids")), line("Urgency phrases", listed("urgency_flags")),
        *title("LAYER 1 - EMBEDDING SIMILARITY"), line("Similarity to legitimate cluster", told("sim_to_legitimate")), line("Similarity to scam cluster", told("sim_to_scam")),
        line("Boundary distance", told("boundary_distance")), line("Embedding scam score", told("embedding_score")),
        *title("LAYER 2 - CROSS-REFERENCE CONSISTENCY"), line("Total contradictions", told("contradictions")), line("Checks run", told("checks")), line("DB details", listed("contradiction_details")),
        *title("LAYER 3 - PROPAGATION ANALYSIS"), line("Seen count", told("seen_count")), line("Source channels", told("source_channels_count")), line("Forwarded many times", told("forwarded_flag")),
        line("Broadcast score", told("propagation_score")), line("Broadcast pattern", told("is_broadcast")),
    ]
    media = F.transform(F.map_entries(F.coalesce("media_context", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    extra = F.when(F.size(media) > 0, F.concat(F.array(*title("MEDIA CONTEXT")), media)).otherwise(F.array().cast("array<string>"))
    return rows.select("msg_id", F.array_join(F.concat(F.array(*lines), extra), "\n").alias("evidence"))


def verdict_rows(layers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One result row for each message. ``layers``: msg_id, source_channel,
    contradiction_details, contradictions, signals, propagation_score, embedding_score."""
    rows = layers.join(verdicts, "msg_id", "left")
    score = F.coalesce(F.nullif("risk_score", F.lit(0.0)), F.lit(C.DEFAULT_SCORE))
    confidence = F.coalesce(F.nullif("confidence", F.lit(0)), F.lit(C.FAILED_CONFIDENCE)).cast("long")
    return rows.select(
        "msg_id",
        F.round(score, 2).alias("risk_score"),
        scores.risk_level(score).alias("risk_level"),
        (score >= C.SCAM_FROM).alias("is_scam"),
        F.coalesce("verdict", F.lit("SUSPICIOUS")).alias("verdict"),
        confidence.alias("confidence"),
        reasons(F.col("reasoning"), F.col("key_contradiction"), F.col("contradiction_details"), F.col("signals")).alias("reasons"),
        "key_contradiction",
        "hindi_worker_message",
        F.coalesce(F.trim("reasoning"), F.lit("")).alias("english_summary"),
        F.struct(F.col("embedding_score").alias("embedding"), F.col("contradictions").alias("consistency_contradictions"), F.col("propagation_score").alias("propagation"), confidence.alias("llm_confidence")).alias("layer_scores"),
        F.col("source_channel").alias("source"),
    )


def verdict_table(results: DataFrame) -> DataFrame:
    return results.groupBy("risk_level", "verdict").agg(F.count(F.lit(1)).alias("messages"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


def cacheable_results(results: DataFrame) -> DataFrame:
    """Results of an analysis that did not fail."""
    sign = "ai investigator unavailable"
    return results.filter(~(F.lower("english_summary").contains(sign) | F.exists("reasons", lambda r: F.lower(r).contains(sign))))


def high_risk_reports(results: DataFrame) -> DataFrame:
    return results.filter(F.col("risk_score") > C.STORE_ABOVE)


def report_rows(results: DataFrame) -> DataFrame:
    """Report columns of risky results with their entities (msg_id, risk_score,
    source, ts, phones, company, location, role, salary, fee, upi_ids)."""
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    return high_risk_reports(results).select(
        "msg_id",
        filled(F.get("phones", F.lit(0))).alias("scam_phone"),
        filled(F.get("upi_ids", F.lit(0))).alias("upi_id"),
        filled(F.col("company")).alias("company_name"),
        filled(F.col("role")).alias("job_role"),
        filled(F.col("location")).alias("location"),
        "salary",
        "fee",
        scores.score_to_int(F.col("risk_score")).cast("long").alias("risk_score"),
        F.lit(0.0).alias("trust_weight"),
        F.coalesce("ts", F.localtimestamp()).alias("report_time"),
        text.source_name(F.col("source")).alias("source"),
    )


def _translated(items: Column, words: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.transform(items, lambda r: F.coalesce(F.try_element_at(table, F.lower(F.trim(r))), F.trim(r)))


def reply_table(results: DataFrame) -> DataFrame:
    """The reply to each result (msg_id, risk_score, reasons, language), in English or Hindi."""
    percent = scores.score_percent(F.col("risk_score"))
    band = scores.reply_band(percent)
    three = F.slice(F.coalesce("reasons", F.array().cast("array<string>")), 1, 3)

    def reply(words: dict, reasons: Column) -> Column:
        """Fixed parts (see constants) round the verdict, score, reasons and advice."""
        pick = lambda kind: F.when(band == "DANGER", words[kind][0]).when(band == "SUSPICIOUS", words[kind][1]).otherwise(words[kind][2])
        bullets = F.when(F.size(reasons) > 0, F.array_join(F.transform(reasons, lambda r: F.concat(F.lit("* "), r)), "\n")).otherwise(F.lit("* " + words["none"]))
        score = F.concat(F.lit(words["score"] + ": "), percent.cast("string"), F.lit("%"))
        said = (F.concat(F.lit(words[k] + sep), x) for k, sep, x in (("verdict", ": ", pick("verdicts")), ("why", ":\n", bullets), ("advice", ": ", pick("advices"))))
        verdict, why, advice = said
        head = F.concat_ws("\n", F.lit(f"*{words['title']}*"), F.lit("-" * 31), verdict, score)
        return F.concat_ws("\n\n", head, why, advice, F.lit(words["switch"] + "\n" + words["foot"]))

    english, hindi = reply(C.REPLY_EN, F.transform(three, lambda r: F.trim(r))), reply(C.REPLY_HI, _translated(three, C.REASONS_HI))
    return results.select("msg_id", "language", percent.cast("long").alias("percent"), F.when(F.col("language") == "hi", hindi).otherwise(english).alias("reply"))


def roman_reply(results: DataFrame) -> DataFrame:
    """The romanised reply: headline, judgement, reasons, advice."""
    percent = scores.score_percent(F.col("risk_score"))
    title = scores.headline(F.upper(F.coalesce("risk_level", F.lit(""))), percent)
    judged = F.when(percent >= 30, "Yeh naukri sandesh farzi ho sakta hai.").otherwise("Yeh naukri sandesh filhal kam jokhim wala lagta hai.")
    listed = F.coalesce("reasons", F.array().cast("array<string>"))
    why = F.when(F.size(listed) > 0, F.concat(F.lit("Karan:\n"), F.array_join(F.transform(_translated(listed, C.REASONS_ROMAN), lambda r: F.concat(F.lit("* "), r)), "\n"), F.lit("\n\n"))).otherwise("")
    advice = F.when(percent >= 60, "Paise mat bhejein.").when(percent >= 30, "Pehle company aur offer verify karein.").otherwise("Phir bhi documents aur company details verify karein.")
    return results.select("msg_id", F.concat(title, F.lit("\n\n"), judged, F.lit("\n\nRisk: "), percent.cast("string"), F.lit("%\n\n"), why, advice).alias("reply"))


def reply_language(rows: DataFrame) -> DataFrame:
    """msg_id and language: explicit, else that of the extracted text, else the
    stored preference, else that of the body, else English."""
    extracted = F.when(F.trim(F.coalesce("extracted_text", F.lit(""))) != "", text.detected_language(F.col("extracted_text")))
    body = F.when(F.trim(F.coalesce("body_text", F.lit(""))) != "", text.detected_language(F.col("body_text")))
    return rows.select("msg_id", F.coalesce(text.language_code(F.col("explicit")), extracted, text.language_code(F.col("preference")), body, F.lit("en")).alias("language"))
