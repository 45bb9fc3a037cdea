"""Aggregates over scam reports: KPIs, trends, heat map, network, phones.

No row caps: statistics cover all reports; limits are parameters of lists only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fraudlens import constants as C
from fraudlens.functions import scores, text

REPORT_COLUMNS = ("id", "scam_phone", "upi_id", "company_name", "job_role", "salary", "fee", "location", "risk_score", "trust_weight", "report_time")


def _filled(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def scan_latest_reports(reports: DataFrame, n: int = 1000) -> DataFrame:
    """The latest n reports; ties by id."""
    return reports.select(*REPORT_COLUMNS).orderBy(F.desc("report_time"), "id").limit(n)


def phone_reputation(reports: DataFrame) -> DataFrame:
    """Reports, trust and reputation of each phone."""
    trust = F.round(F.sum(F.coalesce("trust_weight", F.lit(0.0))), 2)
    grouped = reports.filter(F.col("scam_phone").isNotNull()).groupBy("scam_phone").agg(F.count(F.lit(1)).alias("report_count"), trust.alias("trust_score"))
    return grouped.withColumn("reputation", scores.reputation(F.col("trust_score")))


def dashboard_stats(reports: DataFrame) -> DataFrame:
    """One row of KPIs. ``companies_seen_once`` is also given by the name the dashboard shows it under."""
    rows = reports.select(F.nullif(text.digits(F.col("scam_phone")), F.lit("")).alias("phone"), _filled("upi_id").alias("upi"), _filled("company_name").alias("company"))
    totals = rows.agg(F.count(F.lit(1)).alias("total_reports"), F.count_distinct("phone").alias("suspicious_numbers"))
    shared = lambda key: rows.filter(f"{key} IS NOT NULL AND phone IS NOT NULL").groupBy(key).agg(F.count_distinct("phone").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias(f"shared_{key}"))
    once = rows.filter("company IS NOT NULL").groupBy("company").count().agg(F.coalesce(F.sum((F.col("count") == 1).cast("long")), F.lit(0)).alias("companies_seen_once"))
    one = totals.crossJoin(shared("upi")).crossJoin(shared("company")).crossJoin(once)  # four single rows
    return one.select("total_reports", "suspicious_numbers", (F.col("shared_upi") + F.col("shared_company")).alias("detected_syndicates"), "companies_seen_once", F.col("companies_seen_once").alias("verified_companies"))


def report_message(company: Column, role: Column, salary: Column, fee: Column, upi: Column) -> Column:
    """What a report names, in one line; empty texts and zero amounts are left out."""
    plain = lambda x: F.nullif(x, F.lit(""))
    amount = lambda name, x: F.when(x != 0, F.concat(F.lit(name + " "), x.cast("string")))
    joined = F.concat_ws(" | ", plain(company), plain(role), amount("Salary", salary), amount("Fee", fee), plain(upi))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("Scam report received"))


def recent_reports(reports: DataFrame, limit: int = 10) -> DataFrame:
    top = reports.orderBy(F.desc("report_time"), "id").limit(max(limit, 1))
    return top.select(
        "id",
        F.coalesce(F.nullif("scam_phone", F.lit("")), F.lit("Unknown")).alias("phone"),
        report_message(*[F.col(c) for c in ("company_name", "job_role", "salary", "fee", "upi_id")]).alias("message"),
        scores.risk_label(F.col("risk_score")).alias("risk"),
        F.coalesce(F.nullif("location", F.lit("")), F.lit("Unknown")).alias("location"),
        F.coalesce(F.date_format("report_time", "yyyy-MM-dd hh:mm a"), F.lit("Unknown")).alias("timestamp"),
    )


def report_heatmap(reports: DataFrame) -> DataFrame:
    """Reports of each location, most first; ties by name."""
    return reports.filter(_filled("location").isNotNull()).groupBy(F.trim("location").alias("state")).count().orderBy(F.desc("count"), "state")


def heatmap_points(heat: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Map points: counts by label of the places with coordinates (key, label,
    lat, lng), with intensity, colour, radius and bar width."""
    key = F.regexp_replace(F.lower(F.coalesce("state", F.lit(""))), "[^a-z]", "")
    grouped = heat.withColumn("key", key).join(coordinates, "key").groupBy("label").agg(F.sum("count").alias("count"), F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    share = F.col("count") / F.greatest(F.max("count").over(Window.partitionBy()), F.lit(1))
    out = grouped.withColumn("intensity", F.round(share, 6))
    return out.select("label", "count", "lat", "lng", "intensity", scores.heat_colour(F.col("intensity")).alias("colour"), F.round(8 + F.col("intensity") * 16, 4).alias("radius"), F.round(F.greatest(F.lit(4.0), F.col("intensity") * 100), 4).alias("bar"))


def top_locations(points: DataFrame, n: int = 8) -> DataFrame:
    """The n map points of most reports, ties by label."""
    return points.orderBy(F.desc("count"), "label").limit(n)


def report_trend(reports: DataFrame, days: int = 7, as_of: str | None = None) -> DataFrame:
    """Reports of each of the last ``days`` days (1 to 30), zero where none. The
    last day is ``as_of`` or the latest report's."""
    days = min(max(days, 1), C.TREND_DAYS_MOST)
    counts = reports.filter(F.col("report_time").isNotNull()).groupBy(F.to_date("report_time").alias("day")).count()
    last = reports.sparkSession.range(1).select(F.to_date(F.lit(as_of)).alias("last")) if as_of else counts.agg(F.max("day").alias("last"))
    spine = last.filter("last IS NOT NULL").select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return spine.join(counts, "day", "left").select("day", F.date_format("day", "MM-dd").alias("date"), F.coalesce("count", F.lit(0)).alias("count"))


def risk_labels(reports: DataFrame) -> DataFrame:
    return reports.select("id", scores.risk_label(F.col("risk_score")).alias("risk"))


def risk_distribution(reports: DataFrame) -> DataFrame:
    """Counts of the three labels, zero where none."""
    counts = risk_labels(reports).groupBy("risk").count()
    labels = reports.sparkSession.createDataFrame([("High Risk",), ("Suspicious",), ("Safe",)], "risk string")
    return labels.join(counts, "risk", "left").select("risk", F.coalesce("count", F.lit(0)).alias("count"))


def phone_lookup(reports: DataFrame, phones: DataFrame) -> DataFrame:
    """The profile of each phone in ``phones`` (number), whatever its format."""
    key = text.digits
    wanted = phones.select("number", key(F.col("number")).alias("normalized_number"))
    rows = reports.withColumn("normalized_number", key(F.col("scam_phone"))).join(wanted.select("normalized_number").distinct(), "normalized_number", "left_semi")
    grouped = rows.groupBy("normalized_number").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.coalesce("trust_weight", F.lit(0.0))), 2).alias("trust"),
        F.sort_array(F.collect_set(_filled("company_name"))).alias("companies"),
        F.sort_array(F.collect_set(_filled("upi_id"))).alias("upi_ids"),
        F.max("report_time").alias("last"),
    )
    out = wanted.join(grouped, "normalized_number", "left")
    none = F.col("n").isNull()
    return out.select(
        "number",
        "normalized_number",
        F.when(none, "Safe").when((F.col("trust") >= 3) | (F.col("n") >= 3), "High Risk").otherwise("Suspicious").alias("risk"),
        F.coalesce("n", F.lit(0)).alias("report_count"),
        F.coalesce("trust", F.lit(0.0)).alias("trust_score"),
        F.coalesce("companies", F.array().cast("array<string>")).alias("companies"),
        F.coalesce("upi_ids", F.array().cast("array<string>")).alias("upi_ids"),
        F.when(none, "N/A").otherwise(F.coalesce(F.date_format("last", "yyyy-MM-dd hh:mm a"), F.lit("Unknown"))).alias("last_seen"),
    )


def phone_recent(reports: DataFrame, n: int = 5) -> DataFrame:
    """The latest n reports of each phone."""
    order = Window.partitionBy(text.digits(F.col("scam_phone"))).orderBy(F.desc("report_time"), "id")
    rows = reports.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    return rows.select(text.digits(F.col("scam_phone")).alias("normalized_number"), F.col("place").cast("long").alias("place"), "id", "company_name", "job_role", scores.risk_label(F.col("risk_score")).alias("risk"), "location", "report_time")


def check_phone(reputations: DataFrame, phones: DataFrame) -> DataFrame:
    """Reported or not, for each phone asked for."""
    rows = phones.join(reputations, phones["number"] == reputations["scam_phone"], "left")
    n = F.coalesce("report_count", F.lit(0))
    return rows.select("number", (n > 0).alias("reported"), n.alias("report_count"), F.coalesce("trust_score", F.lit(0.0)).alias("trust_score"), F.coalesce("reputation", F.lit("UNKNOWN")).alias("reputation"))


def _trimmed(reports: DataFrame) -> DataFrame:
    return reports.select("id", *[F.coalesce(F.trim(F.col(c)), F.lit("")).alias(n) for c, n in (("scam_phone", "phone"), ("upi_id", "upi"), ("job_role", "role"), ("company_name", "company"))])


def network_links(reports: DataFrame) -> DataFrame:
    """How many reports name both ends, for the four kinds of pairs."""
    pair = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("target"))
    pairs = F.array(pair("phone", "upi"), pair("phone", "role"), pair("role", "company"), pair("upi", "company"))
    rows = _trimmed(reports).select(F.explode(pairs).alias("p")).select("p.*").filter("source <> '' AND target <> '' AND source <> target")
    return rows.groupBy("source", "target").agg(F.count(F.lit(1)).alias("value"))


def network_nodes(reports: DataFrame) -> DataFrame:
    """Distinct nodes; a node of several kinds takes the first kind."""
    kinds = (("phone", 1, "Phone Number"), ("upi", 2, "UPI ID"), ("role", 3, "Job Role"), ("company", 4, "Company Name"))
    nodes = F.array(*[F.struct(F.col(c).alias("node"), F.lit(g).cast("long").alias("group"), F.lit(label).alias("label")) for c, g, label in kinds])
    rows = _trimmed(reports).select(F.explode(nodes).alias("x")).select("x.*").filter("node <> ''")
    return rows.groupBy("node").agg(F.min(F.struct("group", "label")).alias("x")).select("node", "x.group", "x.label")


def network_from_edges(edges: DataFrame, newest: int = 300) -> DataFrame:
    """Nodes of the newest stored edges, with group and label."""
    top = edges.orderBy(F.desc("last_seen"), "entity_a", "entity_b").limit(newest)
    ends = top.select(F.explode(F.array(F.struct(F.col("entity_a").alias("node"), F.col("entity_a_type").alias("kind")), F.struct(F.col("entity_b").alias("node"), F.col("entity_b_type").alias("kind")))).alias("x")).select("x.*")
    kind = F.lower(F.trim(F.coalesce("kind", F.lit("agent"))))
    group, label = F.lit(C.EDGE_OTHER[0]), F.lit(C.EDGE_OTHER[1])
    for name, (g, text_) in C.EDGE_GROUPS.items():
        group, label = F.when(kind == name, F.lit(g)).otherwise(group), F.when(kind == name, F.lit(text_)).otherwise(label)
    rows = ends.filter(F.trim("node") != "").select(F.trim("node").alias("node"), group.cast("long").alias("group"), label.alias("label"))
    return rows.groupBy("node").agg(F.min(F.struct("group", "label")).alias("x"), F.count(F.lit(1)).alias("links")).select("node", "x.group", "x.label", "links")


def network_view(edges: DataFrame, reports: DataFrame) -> DataFrame:
    """Nodes of stored edges, or of the reports (``links`` null) if no edge is stored. Decided when it runs, by a one-row count of at most one edge."""
    stored = network_from_edges(edges)
    none = edges.limit(1).agg((F.count(F.lit(1)) == 0).alias("_none"))
    told = network_nodes(reports).withColumn("links", F.lit(None).cast("long"))
    return stored.unionByName(told.crossJoin(F.broadcast(none)).filter("_none").drop("_none"))
