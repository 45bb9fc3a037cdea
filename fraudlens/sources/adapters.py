"""Views of the standard tables as the domain tables.

Each view is one lazy DataFrame; nothing is cached or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def _channel(number: Column) -> Column:
    return F.when(number % 3 == 0, "dashboard").when(number % 3 == 1, "whatsapp").otherwise("extension")


def reports_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scam reports: events with their customer and nation."""
    events = table(spark, sf_dir, "events").withColumn("k", _k())
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = events.join(customer, events["user_id"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    return joined.select(
        F.col("event_id").cast("string").alias("id"),
        F.sha2("c_name", 256).alias("reporter_hash"),
        F.concat(F.lit("+91-9"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("scam_phone"),
        F.concat(F.lit("k"), F.col("k").cast("string"), F.lit("@upi")).alias("upi_id"),
        F.concat("c_mktsegment", F.lit(" "), (F.col("k") % 20).cast("string")).alias("company_name"),
        F.col("event_type").alias("job_role"),
        F.lit(None).cast("long").alias("salary"),
        F.when(F.col("event_type") == "purchase", F.floor("value").cast("long")).alias("fee"),
        F.col("n_name").alias("location"),
        F.least(F.lit(100), F.floor("value")).cast("int").alias("risk_score"),
        F.when(F.col("event_type") == "error", F.lit(1.0)).otherwise(F.lit(0.1)).alias("trust_weight"),
        F.col("ts").alias("report_time"),
        _channel(F.col("event_id")).alias("source"),
    )


def _time(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(1_704_067_200) + seconds).cast("timestamp_ntz")


def messages_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages: documents as they are."""
    number = F.regexp_extract("source", "([0-9]+)", 1)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("msg_id"),
        _time(F.col("doc_id") * 60).alias("ts"),
        F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string")).alias("sender"),
        "text",
        (F.col("doc_id") % 7 == 0).alias("forwarded"),
        _channel(F.when(number != "", number).otherwise(F.lit("0")).cast("long")).alias("source_channel"),
    )


#: (share, parts): texts and columns that make the sentence put before a document; the share is doc_id modulo 6.
SENTENCES = (
    (0, ("Driver required in Dubai salary ", "salary", " registration fee ", "fee", " call +91 98", "digits", " pay to user", "user", "@okupi. Urgent, apply now.")),
    (1, ("Role: Electrician company Gulf Star Agency location Doha, wage: 1,20,000 contact person Ravi 097", "digits", " limited seats")),
    (2, ("Cook job at Muscat ", "salary", " rs salary only today. fee is ", "fee", " mail bob", "user", "@gmail.com")),
    (3, ("aap kaise hai, jaldi naukri. Agent: Kumar. +971 50 1", "digits")),
    (4, ("Interview for nurse. wage = inr ", "salary", ".50, processing: rs. ", "fee")),
    (5, ("Broker Anil posted in Kochi. phone 9", "nine", " hurry, last date")),
)


def job_texts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_id, text, n_chars): a recruiting sentence, made of the row's own values, before the whole document."""
    docs = table(spark, sf_dir, "documents")
    words = {
        "salary": (F.col("n_chars") * 10).cast("string"),
        "fee": F.col("n_chars").cast("string"),
        "digits": F.lpad(F.col("doc_id").cast("string"), 8, "0"),
        "nine": F.lpad(F.col("doc_id").cast("string"), 9, "0"),
        "user": (F.col("doc_id") % 50).cast("string"),
    }
    sentence = None
    for share, parts in SENTENCES:
        text = F.concat(*[words[p] if p in words else F.lit(p) for p in parts])
        sentence = F.when(F.col("doc_id") % 6 == share, text) if sentence is None else sentence.when(F.col("doc_id") % 6 == share, text)
    return docs.select(F.col("doc_id").alias("msg_id"), F.concat(sentence, F.lit(".\n"), "text").alias("text"), "n_chars")


def message_heads_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without their texts."""
    return messages_view(spark, sf_dir).drop("text")


def job_messages_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the texts of ``job_texts_view``."""
    return message_heads_view(spark, sf_dir).join(job_texts_view(spark, sf_dir), "msg_id")


def typed_edges_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges ``phone:<user>`` - ``upi:<k>`` of all events that have both."""
    events = table(spark, sf_dir, "events").select("user_id", _k().alias("k"), "ts").filter("user_id IS NOT NULL AND k IS NOT NULL")
    return events.select(
        F.concat(F.lit("phone:"), F.col("user_id").cast("string")).alias("source_id"),
        F.concat(F.lit("upi:"), F.col("k").cast("string")).alias("target_id"),
        F.lit("paid_with").alias("relationship_type"),
        "ts",
    )


def registry_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company registry: the distinct part names, with attributes made of the first part of that name."""
    parts = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("pos"), F.min("p_type").alias("p_type"), F.max("p_size").alias("p_size"))
    return parts.select(
        F.col("p_name").alias("name"),
        F.lower("p_name").alias("name_normalized"),
        F.when(F.col("pos") % 2 == 0, "Mumbai").otherwise("Delhi").alias("registered_city"),
        F.when(F.col("pos") % 5 != 0, F.when(F.col("pos") % 2 == 0, "Maharashtra").otherwise("NCR")).alias("registered_state"),
        F.when(F.col("pos") % 3 == 0, F.array(F.lit("UAE"), F.lit("Qatar"))).otherwise(F.array(F.lit("Oman"))).alias("placement_countries"),
        F.array(F.lower("p_type"), F.lit("driver")).alias("allowed_job_categories"),
        (F.col("p_size") % 10 == 0).alias("is_blacklisted"),
        "pos",
    )


def claims_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims: each customer names a registered company, in three of four cases misspelt."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    joined = c.join(p, F.col("c_custkey") % 200 == F.col("p_partkey"))
    kind, name = F.col("c_custkey") % 4, F.col("p_name")
    company = (
        F.when(kind == 0, name).when(kind == 1, F.substring(name, F.lit(1), F.length(name) - 1)).when(kind == 2, F.concat(F.substring(name, 1, 1), name)).otherwise(F.concat(name, F.lit("xyz")))
    )
    place = F.col("c_nationkey") % 5
    location = F.when(place == 0, "Dubai").when(place == 1, "Doha, Qatar").when(place == 2, "New Delhi").when(place == 3, "Mumbai Maharashtra").otherwise(F.lit(None))
    digits = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    phone = F.when(kind == 0, F.concat(F.lit("98"), digits)).when(kind == 1, F.concat(F.lit("+97150"), digits)).when(kind == 2, F.concat(F.lit("+974"), digits)).otherwise(F.lit(None))
    role = F.when(F.col("c_custkey") % 3 == 0, "Driver").when(F.col("c_custkey") % 3 == 1, "Welder")
    return joined.select(F.col("c_custkey").alias("claim_id"), company.alias("company"), location.alias("location"), phone.alias("phone"), role.alias("role"))


def prefixes_view(spark: SparkSession) -> DataFrame:
    """Phone prefixes: a fixed list."""
    from fraudlens.constants import PHONE_PREFIXES

    return spark.createDataFrame(PHONE_PREFIXES, "prefix string, country string")


def vectors_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") <= 4, "legitimate").otherwise("scam").alias("cluster"), "embedding")


#: Components of the vectors in ``embeddings``.
VECTOR_SIZE = 64


def postings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings to learn from: documents with the vector of their id, if there is one."""
    v = vectors_view(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(v, F.col("doc_id") == F.col("vec_id"), "left")
    return d.select("doc_id", "text", F.coalesce("cluster", F.when(F.col("doc_id") % 2 == 0, "legitimate").otherwise("scam")).alias("cluster"), "embedding")


def requests_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("seq"))


def inbound_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations as chat messages with raw, untyped fields."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    flag = F.when(F.col("conv_id") % 3 == 0, "Yes").when(F.col("conv_id") % 3 == 1, "0").otherwise(" TRUE ")
    return turns.select(
        "conv_id",
        "turn",
        F.concat(F.lit("wa:"), (F.col("conv_id") % 97).cast("string")).alias("from_number"),
        F.col("text").alias("body_text"),
        flag.alias("forwarded_many_times"),
        F.when(F.col("turn") % 2 == 0, F.lit("2.0")).otherwise(F.lit("x")).alias("media_count"),
        F.when(F.col("conv_id") % 4 == 0, "browser_extension").when(F.col("conv_id") % 4 == 1, " WhatsApp ").when(F.col("conv_id") % 4 == 2, "sms").alias("source"),
    )


def words_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as word tables, as text recognition gives them: lines are the
    document's, a block is three lines, confidence follows from the word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "line_text"))
    words = docs.select("doc_id", "line", F.posexplode(F.split("line_text", " ")).alias("pos", "word"))
    number = F.col("line").cast("long")
    return words.select(
        "doc_id",
        F.floor(number / 3).cast("long").alias("block"),
        F.lit(1).cast("long").alias("par"),
        number.alias("line"),
        F.col("pos").cast("long").alias("pos"),
        "word",
        ((F.length("word") * 17 + F.col("pos") * 7 + F.col("doc_id")) % 103 - 2).cast("long").alias("conf"),
    )


def transcripts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: a segment for each turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    segment = F.struct(F.col("turn").alias("n"), (-(F.length("text") % 40) / F.lit(100.0)).alias("avg_logprob"), ((F.col("turn") + 1) * 1.5).cast("double").alias("end"), "text")
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(segment)).alias("s"))
    lang = F.col("conv_id") % 4
    return grouped.select(
        F.col("conv_id").alias("doc_id"),
        F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"),
        F.when(lang == 0, "hi").when(lang == 1, "en").when(lang == 2, "xx").otherwise("unknown").alias("language"),
        F.transform("s", lambda x: F.struct(x["avg_logprob"].alias("avg_logprob"), x["end"].alias("end"))).alias("segments"),
    )


#: Sentences put before whole documents for the checks of offer letters; the share is doc_id modulo 5.
LETTERS = (
    "Infosis Technologies. GST 27ABCDE1234F1Z5. CIN U12345MH2001PTC123456. ",
    "pay the registration fee. urgent. ",
    "Gulf Star Manpower pvt ltd. security  deposit. act now. ",
    "Wipra Services. ",
    "",
)


def letters_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    start = F.lit(LETTERS[4])
    for share in range(4):
        start = F.when(F.col("doc_id") % 5 == share, F.lit(LETTERS[share])).otherwise(start)
    return docs.select("doc_id", F.concat(start, "text").alias("text"))


def llm_raw_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers of many shapes, made of labels and documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    n = F.col("doc_id")
    word = F.when(n % 7 == 0, "HIGH_RISK").when(n % 7 == 1, "safe").when(n % 7 == 2, "scam").when(n % 7 == 3, "medium").when(n % 7 == 4, "SUSPICIOUS").when(n % 7 == 5, "odd").otherwise("")
    confidence = F.when(n % 5 == 0, F.lit('"abc"')).when(n % 5 == 1, F.lit("150")).when(n % 5 == 2, F.lit("-5")).otherwise((F.col("n_chars") % 100).cast("string"))
    contradiction = F.when(n % 3 == 0, F.lit("null")).when(n % 3 == 1, F.lit('"NULL"')).otherwise(F.concat(F.lit('"salary of '), F.col("n_chars").cast("string"), F.lit('"')))
    json = F.concat(F.lit('{"verdict": "'), word, F.lit('", "confidence": '), confidence, F.lit(', "reasoning": "text of '), F.col("n_chars").cast("string"), F.lit(' signs", "key_contradiction": '), contradiction, F.lit("}"))
    raw = F.when(n % 11 == 0, F.lit(None)).when(n % 11 == 1, F.lit("no answer")).when(n % 11 == 2, F.concat(F.lit("Here:\n```json\n"), json, F.lit("\n```\nDone."))).when(n % 11 == 3, F.concat(F.lit("I think "), json, F.lit(" is right.")))
    # none of these is one JSON object: text behind it, two of them, a broken block before a good one
    raw = raw.when(n % 11 == 4, F.concat(json, F.lit(" trailing {x}"))).when(n % 11 == 5, F.concat(json, F.lit(" or "), json)).when(n % 11 == 6, F.concat(F.lit("```json\n{broken}\n```\n"), json)).otherwise(json)
    return docs.select(F.col("doc_id").alias("msg_id"), raw.alias("llm_raw"))
