"""Cross-checks against the company registry and the phone prefixes.

Names are compared once for each distinct pair of spellings. Fuzzy matches are
found by segments: a name cut into d + 1 pieces keeps one of them unchanged, and
at most d characters from its place, in every string within d edits. An equi-join
on pieces finds all candidates; their number a name depends on d alone, and
neither side is broadcast or crossed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens import constants as C
from fraudlens.functions import text


def _signature(length: Column, piece: int, part: Column) -> Column:
    return F.concat_ws("|", length.cast("string"), F.lit(str(piece)), part)


def pieces(target: Column, most: int) -> Column:
    """The ``most + 1`` signatures (length, number, piece) of a registered name."""
    n = F.length(target)
    cut = lambda i: F.floor(n * i / (most + 1)).cast("int")
    return F.array(*[_signature(n, i, F.substring(target, cut(i) + 1, cut(i + 1) - cut(i))) for i in range(most + 1)])


def probes(key: Column, m: Column, most: int) -> Column:
    """The signatures of all names of length ``m`` within ``most`` edits that a key may share a piece with: pieces up to ``most`` characters off."""
    n = F.length(key)
    cut = lambda i: F.floor(m * i / (most + 1)).cast("int")
    found = []
    for i in range(most + 1):
        for shift in range(-most, most + 1):
            at, size = cut(i) + shift, cut(i + 1) - cut(i)
            found.append(F.when((at >= 0) & (at + size <= n), _signature(m, i, F.substring(key, at + 1, size))))
    return F.array_distinct(F.array_compact(F.array(*found)))


def near_names(names: DataFrame, registry: DataFrame, most: int) -> DataFrame:
    """(key, pos, name, target, distance) of registry names within ``most`` edits of each key. Keys look only for lengths that a registered name has."""
    n = F.length("key")
    lengths = registry.select(F.length("target").alias("m")).distinct()
    left = names.select("key").distinct().withColumn("m", F.explode(F.sequence(F.greatest(F.lit(0), n - most), n + most))).join(lengths, "m")
    left = left.select("key", F.explode(probes(F.col("key"), F.col("m"), most)).alias("v"))
    right = registry.select("pos", "name", "target").withColumn("v", F.explode(pieces(F.col("target"), most)))
    pairs = left.join(right, "v").select("key", "pos", "name", "target").distinct()
    return pairs.withColumn("distance", F.levenshtein("key", "target", most)).filter("distance >= 0")


def nearest(near: DataFrame, match_max: int, typo_max: int) -> DataFrame:
    """For each key of ``near`` the best match, and the best name that differs from the key, each within its bound (null if there is none)."""
    best = lambda x: F.min(F.when(x, F.struct("distance", "pos", "name")))
    return near.groupBy("key").agg(best(F.col("distance") <= match_max).alias("match"), best((F.col("distance") > 0) & (F.col("distance") <= typo_max)).alias("typo"))


def _targets(registry: DataFrame) -> DataFrame:
    return registry.withColumn("target", text.name_key(F.coalesce("name_normalized", "name"))).filter("target <> ''")


def _keyed(claims: DataFrame) -> DataFrame:
    return claims.withColumn("key", text.name_key(F.col("company")))


def registry_exact(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Claims with the registered company of equal name key, the first by position."""
    first = _targets(registry).groupBy("target").agg(F.min(F.struct("pos", "name")).alias("x"))
    return _keyed(claims).join(first, F.col("key") == F.col("target"), "left").select("claim_id", "company", F.col("x.name").alias("registered_name"))


def registry_fuzzy(claims: DataFrame, registry: DataFrame, most: int = C.MATCH_MAX) -> DataFrame:
    """The exact company, else the nearest within ``most`` edits, the first of equals."""
    keyed = _keyed(claims)
    best = nearest(near_names(keyed.filter("key <> ''"), _targets(registry), most), most, 0)
    return keyed.join(best, "key", "left").select("claim_id", "company", F.col("match.name").alias("registered_name"), F.col("match.distance").cast("long").alias("distance"), F.col("match.pos").alias("pos"))


def typosquat(claims: DataFrame, registry: DataFrame, most: int = C.TYPO_MAX) -> DataFrame:
    """The nearest registered name that differs from the claimed one, within ``most`` edits."""
    keyed = _keyed(claims)
    best = nearest(near_names(keyed.filter("key <> ''"), _targets(registry), most), 0, most)
    return keyed.join(best, "key", "left").select("claim_id", "company", F.col("typo").isNotNull().alias("typo_suspected"), F.col("typo.name").alias("typo_target"), F.col("typo.distance").cast("long").alias("distance"))


def phone_country(phones: DataFrame, prefixes: DataFrame, longest: int = 15) -> DataFrame:
    """(phone, country) of each distinct phone by its longest prefix: an equi-join on each phone's own heads."""
    digits = text.digits(F.col("phone"))
    full = F.when((F.length(digits) == 10) & F.substring(digits, 1, 1).isin("6", "7", "8", "9"), F.concat(F.lit("91"), digits)).otherwise(digits)
    heads = phones.select("phone").distinct().withColumn("d", full).filter("d <> ''").select("phone", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("d")))).alias("n"), "d")
    heads = heads.select("phone", "n", F.substring(F.col("d"), F.lit(1), F.col("n")).alias("head"))
    known = prefixes.select(text.digits(F.col("prefix")).alias("head"), "country").filter("head <> ''").dropDuplicates(["head"])
    return heads.join(known, "head").groupBy("phone").agg(F.max_by(F.nullif(F.trim("country"), F.lit("")), "n").alias("country"))


def work_country(location: Column, word_bounds: bool = False) -> Column:
    """The country of the first alias in a location, in the list's order."""
    key = text.name_key(location)
    found = [F.when(key.rlike(f"{text.START}{alias}{text.END}") if word_bounds else key.contains(alias), F.lit(country)) for alias, country in C.COUNTRY_ALIASES]
    return F.coalesce(*found, F.when(key.isin("india", "bharat"), F.lit("India")))


def role_supported(role: Column, allowed: Column) -> Column:
    r = text.name_key(role)
    fits = F.exists(F.transform(F.coalesce(allowed, F.array().cast("array<string>")), text.name_key), lambda a: (a != "") & (r.contains(a) | a.contains(r)))
    return F.when(F.coalesce(role, F.lit("")) != "", fits)


def registry_check(claims: DataFrame, registry: DataFrame, prefixes: DataFrame, typo_max: int = C.TYPO_MAX, match_max: int = C.MATCH_MAX, skip_exact_typo: bool = False) -> DataFrame:
    """All registry checks of each claim (claim_id, company, location, phone,
    role): counts, details in order, and what was found."""
    trimmed = claims.select("claim_id", *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("company", "location", "phone", "role")])
    # candidates within the larger bound hold those within the smaller one
    keyed = _keyed(trimmed)
    best = nearest(near_names(keyed.filter("key <> ''"), _targets(registry), max(typo_max, match_max)), match_max, typo_max)
    rows = keyed.join(best, "key", "left").select(*trimmed.columns, F.col("match.pos").alias("_pos"), F.col("match.distance").alias("_d"), F.col("typo").isNotNull().alias("typo_suspected"), F.col("typo.name").alias("typo_target"))
    rows = rows.join(registry.withColumnRenamed("pos", "_rpos"), F.col("_pos") == F.col("_rpos"), "left").join(phone_country(trimmed, prefixes).withColumnRenamed("country", "phone_country"), "phone", "left")
    rows = rows.withColumn("work_country", work_country(F.col("location"))).withColumn("found", F.col("_pos").isNotNull())
    named, placed, has_role = F.col("company") != "", F.col("location") != "", F.col("role") != ""
    found, abroad = F.col("found"), F.col("work_country").isNotNull() & (F.col("work_country") != "India")
    typo_hit = named & F.coalesce("typo_suspected", F.lit(False))
    if skip_exact_typo:
        typo_hit = typo_hit & ~F.col("_d").eqNullSafe(0)
    city, state, loc = text.name_key(F.col("registered_city")), text.name_key(F.col("registered_state")), text.name_key(F.col("location"))
    off_place = found & placed & (city != "") & ~loc.contains(city) & ~city.contains(loc) & (state != "") & ~loc.contains(state)
    off_role = found & (role_supported(F.col("role"), F.col("allowed_job_categories")) == F.lit(False))
    countries = F.transform(F.coalesce("placement_countries", F.array().cast("array<string>")), text.name_key)
    off_country = found & abroad & ~F.array_contains(countries, text.name_key(F.col("work_country")))
    black = found & F.coalesce("is_blacklisted", F.lit(False))
    phoned = (F.col("phone") != "") & F.col("work_country").isNotNull()
    off_phone = phoned & F.col("phone_country").isNotNull() & (text.name_key(F.col("phone_country")) != text.name_key(F.col("work_country")))
    n = lambda x, k=1: F.when(x, F.lit(k)).otherwise(F.lit(0)).cast("long")
    checks = n(named, 2) + n(found) + n(found & placed) + n(found & has_role) + n(found & abroad) + n(phoned)
    fails = n(named & ~found) + n(typo_hit) + n(black, 2) + n(off_place) + n(off_role) + n(off_country) + n(off_phone)
    say = F.concat
    details = F.array_compact(
        F.array(
            F.when(named & ~found, F.lit("Company not registered in known agency registry.")),
            F.when(typo_hit, say(F.lit("Company name looks like impersonation of '"), "typo_target", F.lit("'."))),
            F.when(black, F.lit("Company is marked as blacklisted in registry.")),
            F.when(off_place, say(F.lit("Claimed location '"), "location", F.lit("' does not match registered location."))),
            F.when(off_role, say(F.lit("Role '"), "role", F.lit("' not listed in company's allowed job categories."))),
            F.when(off_country, say(F.lit("Company has no placement registration for "), "work_country", F.lit("."))),
            F.when(off_phone, say(F.lit("Phone country '"), "phone_country", F.lit("' conflicts with claimed work location '"), "work_country", F.lit("'."))),
        )
    )
    return rows.select(
        "claim_id", "company", fails.alias("db_contradictions"), checks.alias("db_checks_run"), details.alias("contradiction_details"), found.alias("company_found_in_registry"), black.alias("company_is_blacklisted"),
        typo_hit.alias("typosquatting_suspected"), F.when(typo_hit, F.col("typo_target")).alias("typosquatting_target"), "work_country", "phone_country",
    )


def full_consistency(graph_counts: DataFrame, checked: DataFrame) -> DataFrame:
    """Registry counts of each claim with the counts of the whole graph added (one row, broadcast)."""
    g = graph_counts.select(F.col("contradictions").alias("graph_contradictions"), F.col("checks").alias("graph_checks"))
    rows = checked.crossJoin(F.broadcast(g))
    fails, checks = F.col("db_contradictions") + F.col("graph_contradictions"), F.col("db_checks_run") + F.col("graph_checks")
    return rows.select(
        "claim_id", fails.alias("contradictions"), checks.alias("checks"), F.round(F.when(checks > 0, fails / checks).otherwise(0.0), 4).alias("consistency_score"), "graph_contradictions", "graph_checks", "db_contradictions", "db_checks_run",
        "contradiction_details", "company_found_in_registry", "company_is_blacklisted", "typosquatting_suspected", "typosquatting_target",
    )


def registry_report(checked: DataFrame) -> DataFrame:
    """Totals of each claimed company."""
    return checked.groupBy("company").agg(
        F.count(F.lit(1)).alias("claims"), F.sum("db_contradictions").alias("contradictions"), F.sum("db_checks_run").alias("checks"), F.bool_or("company_found_in_registry").alias("found"), F.bool_or("typosquatting_suspected").alias("typosquatting")
    )
