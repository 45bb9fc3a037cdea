"""Graph operators over edge tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.functions import scores, text
from fraudlens.storage import discard, selected, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every endpoint; a component is named by its least node.

    Each round a node is hooked to the least of its neighbours and itself, the
    hooks are followed to their ends by pointer doubling, and edges and labels
    are contracted to those ends. A node that no hook joins to another is less
    than its neighbours, all of which then belong to something less, so it is
    joined in the next round: two rounds halve the nodes at least, and rounds
    grow with the logarithm of the nodes, whatever the diameter. Rounds end when
    no edge is left; only counts reach the driver.

    What a round gives is written, so plans stay small and a lost executor
    repeats one round at most; both sides of each join are then plain scans,
    whose skew AQE can split. Hub nodes meet their neighbours after a map-side
    minimum. Null endpoints and self-loops are ignored (a node of self-loops
    only is its own component).
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    links = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = None
    while True:
        # all nodes in the first round, then those that still have edges
        hooks = written(links.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("up")), "hooks")
        while True:
            above = hooks.select(F.col("node").alias("at"), F.col("up").alias("next"))
            jumped = written(hooks.join(above, hooks["up"] == above["at"]).select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "hooks")
            discard(hooks)
            hooks = jumped
            if hooks.filter("moved").isEmpty():
                break
        to = lambda end: hooks.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up"))
        if labels is None:
            joined = hooks.select("node", F.col("up").alias("label"))
        else:
            joined = labels.join(to("label"), "label", "left").select("node", F.coalesce("label_up", "label").alias("label"))
        labels, old = written(joined, "labels"), labels
        left, done = links.filter("a <> b").join(to("a"), "a").join(to("b"), "b").filter("a_up <> b_up"), links
        links = written(left.select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).distinct(), "links")
        discard(old, hooks, done)
        if links.isEmpty():
            discard(links)
            return selected(labels, "node", F.col("label").alias("component"))


def component_changes(labels: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component, was) of the nodes whose component new edges set or change; ``was`` is null for a new node.

    ``labels`` is (node, component) of all edges before, components named by their
    least node. The edges are contracted to stored components, so rounds go over
    no more than the new edges; the stored labels are read to find the ends and,
    if components were joined, once more to rename members. Components only grow, so changed labels laid over the stored ones
    equal ``connected_components`` of all edges. Null endpoints are ignored. The result is a written table.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    end = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"{x}_was"))
    ends = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
    contracted = written(ends.select(F.coalesce("a_was", "a").alias("a"), F.coalesce("b_was", "b").alias("b"), (F.col("a_was").isNull() | F.col("b_was").isNull()).alias("new")).filter("new OR a <> b").distinct(), "contracted")
    found = connected_components(contracted, "a", "b")
    discard(contracted)
    renamed = found.filter("node <> component").select(F.col("node").alias("was"), F.col("component").alias("_to"))
    moved = labels.join(renamed, labels["component"] == renamed["was"]).select("node", F.col("_to").alias("component"), "was")
    # what is no stored component's name is a new node
    fresh = found.join(labels.select("node"), "node", "left_anti").select("node", "component", F.lit(None).cast(labels.schema["component"].dataType).alias("was"))
    changes = written(moved.unionByName(fresh), "changes")
    discard(found)
    return changes


def _filled(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def edges_resolved(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(a, b) entity keys of edges. A key stored on the edge wins over the key
    found by id; unresolved ends and self-loops go."""
    keys = vertices.select(F.col("id").alias("_id"), text.entity_key(F.col("entity_type"), F.col("value")).alias("_key"))
    stored = lambda name: _filled(F.col(name)) if name in edges.columns else F.lit(None).cast("string")
    out = edges.withColumn("_a", stored("source_key")).withColumn("_b", stored("target_key"))
    for end, col in (("_a", "source_id"), ("_b", "target_id")):
        out = out.join(keys.withColumnsRenamed({"_id": f"{end}_id", "_key": f"{end}_key"}), F.col(col) == F.col(f"{end}_id"), "left").withColumn(end, F.coalesce(end, f"{end}_key")).drop(f"{end}_id", f"{end}_key")
    return out.filter("_a IS NOT NULL AND _b IS NOT NULL AND _a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def _append(frame: DataFrame, table: str, key: str, buckets: int, folder: str | None) -> None:
    writer = frame.repartition(buckets, key).write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", f"{folder}/{table}") if folder else writer).saveAsTable(table)


def store_vertices(vertices: DataFrame, table: str, buckets: int = 256, folder: str | None = None) -> DataFrame:
    """The vertices (id, entity_type, value) of ``table``, after those that it lacks were appended.

    The table is bucketed by id, so look-ups by id exchange the other side only,
    and finding the new rows exchanges none of the stored ones. A null id is not stored; of equal ids one row
    is. ``buckets`` is set once for a table: about the stored bytes over 256 MB. May run again.
    """
    spark = vertices.sparkSession
    found = vertices.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("entity_type", "value")).alias("v")).select("id", "v.entity_type", "v.value")
    if spark.catalog.tableExists(table):
        found = new_vertices(found, spark.table(table))
    _append(found, table, "id", buckets, folder)
    return spark.table(table)


def store_edges(edges: DataFrame, table: str, buckets: int = 256, folder: str | None = None) -> DataFrame:
    """Edges appended to ``table``, which is bucketed by source_id; an edge without one is kept in the bucket of null."""
    _append(edges, table, "source_id", buckets, folder)
    return edges.sparkSession.table(table)


def adjacency(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct (node, neighbour) in both directions, without self-loops."""
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour"))
    both = one.unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("neighbour")))
    return both.filter("node <> neighbour AND node <> '' AND neighbour <> ''").distinct()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint and counts of each component of batches sorted by (component, node).

    What is held is one batch and the state of one hash, however many members a component has.
    """
    now, schema = None, None

    def closed() -> dict:
        return {"component": now["component"], "fingerprint": now["hash"].hexdigest(), **{c: now[c] for c in ("cluster_size", "phone", "upi")}}

    for batch in batches:
        schema = pa.schema([batch.schema.field("component"), ("fingerprint", pa.string()), ("cluster_size", pa.int64()), ("phone", pa.int64()), ("upi", pa.int64())])
        done = []
        for name, node, kind in zip(*(batch.column(c).to_pylist() for c in ("component", "node", "kind"))):
            if now is None or name != now["component"]:
                if now:
                    done.append(closed())
                now = {"component": name, "hash": hashlib.sha256(), "last": None, "cluster_size": 0, "phone": 0, "upi": 0}
            if node == now["last"]:
                continue
            now["hash"].update(node.encode() if now["last"] is None else b"|" + node.encode())
            now["last"], now["cluster_size"] = node, now["cluster_size"] + 1
            if kind in ("phone", "upi"):
                now[kind] += 1
        yield pa.RecordBatch.from_pylist(done, schema)
    if now:
        yield pa.RecordBatch.from_pylist([closed()], schema)


def component_digests(components: DataFrame) -> DataFrame:
    """One narrow row for each component of entity keys (component, node): fingerprint, member counts, risk, whether it qualifies.

    A fingerprint is the SHA-256 of the sorted members, which has to be taken in
    order: the rows are sorted (a sort spills) and pass by it in batches, so a
    component of any number of members needs no more memory than a small one.
    Keys without a value are left out; a key that comes twice counts once.
    """
    parts = components.select("component", "node", text.entity_key_parts(F.col("node")).alias("p")).filter("p.entity_value <> ''")
    ordered = parts.select("component", "node", F.col("p.entity_type").alias("kind")).repartition("component").sortWithinPartitions("component", "node")
    kind = components.schema["component"].dataType.simpleString()
    found = ordered.mapInArrow(_digests, f"component {kind}, fingerprint string, cluster_size long, phone long, upi long")
    phones, upis, n = F.col("phone"), F.col("upi"), F.col("cluster_size")
    return found.select(
        "component",
        "fingerprint",
        "cluster_size",
        phones.alias("n_phones"),
        upis.alias("n_upis"),
        scores.cluster_risk(phones, upis, n).alias("risk_score"),
        ((phones >= 3) | ((phones >= 2) & (upis >= 1))).alias("is_potential_syndicate"),
    )


def qualifying(digests: DataFrame) -> DataFrame:
    return digests.filter("is_potential_syndicate").drop("is_potential_syndicate")


def digest_members(components: DataFrame, digests: DataFrame) -> DataFrame:
    """(fingerprint, entity_key, entity_type, entity_value, risk_score), one row for each
    member of the components of ``digests``. A join, so no row holds all members of a component and AQE can split a giant one."""
    rows = components.select("component", F.col("node").alias("entity_key"), text.entity_key_parts(F.col("node")).alias("p")).filter("p.entity_value <> ''")
    return rows.join(digests.select("component", "fingerprint", "risk_score"), "component").select("fingerprint", "entity_key", "p.entity_type", "p.entity_value", "risk_score")


def with_lists(digests: DataFrame, members: DataFrame) -> DataFrame:
    """``digests`` with the sorted phones, payment ids and entities of each, for readers that want
    a syndicate as one row; one too large for a row is read from ``members``."""
    of = lambda k: F.sort_array(F.collect_set(F.when(F.col("entity_type") == k, F.col("entity_value"))))
    lists = members.groupBy("fingerprint").agg(of("phone").alias("phones"), of("upi").alias("upis"), F.sort_array(F.collect_set("entity_key")).alias("entities"))
    return digests.join(lists, "fingerprint").select("fingerprint", "cluster_size", "phones", "upis", "entities", "risk_score")


def syndicates(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an edge table that qualify, with their lists."""
    components = connected_components(edges, a, b)
    found = qualifying(component_digests(components))
    return with_lists(found, digest_members(components, found))


def syndicate_members(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Members of the components of an edge table that qualify."""
    components = connected_components(edges, a, b)
    return digest_members(components, qualifying(component_digests(components)))


def syndicate_membership(entity_rows: DataFrame, members: DataFrame) -> DataFrame:
    """Does a message (msg_id, entity_type, value) name a member of a syndicate?"""
    known = members.select(F.col("entity_type").alias("_t"), F.col("entity_value").alias("_v")).distinct().withColumn("_in", F.lit(True))
    joined = entity_rows.join(known, (F.col("entity_type") == F.col("_t")) & (F.col("value") == F.col("_v")), "left")
    return joined.groupBy("msg_id").agg(F.bool_or(F.coalesce("_in", F.lit(False))).alias("in_syndicate"), F.sum(F.coalesce(F.col("_in").cast("long"), F.lit(0))).alias("matches"))


def vertex_id(kind: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws(":", kind, value), 256)


_LISTS = (("company", "company"), ("phones", "phone"), ("location", "location"), ("agent", "person"), ("upi_ids", "upi"))


def _lists(entity_rows: DataFrame) -> DataFrame:
    """Entity columns as arrays of trimmed values that are not empty."""
    kinds = dict(entity_rows.dtypes)
    as_list = lambda c: F.col(c) if kinds[c].startswith("array") else F.array(F.col(c))
    clean = lambda c: F.array_distinct(F.filter(F.transform(as_list(c), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return entity_rows.select("msg_id", *[clean(c).alias(k) for c, k in _LISTS])


def graph_edges(entity_rows: DataFrame) -> DataFrame:
    """Typed edges of messages (msg_id, company, phones, location, agent,
    upi_ids): a company with each of its phones, places, people and payment
    ids, and a phone with each payment id. ``weight`` counts messages."""
    rows = _lists(entity_rows)

    def triples(left: str, relation: str, right: str) -> Column:
        triple = lambda a, b: F.struct(F.lit(left).alias("source_type"), a.alias("source_value"), F.lit(relation).alias("relationship_type"), F.lit(right).alias("target_type"), b.alias("target_value"))
        return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: triple(a, b))))

    kinds = (("company", "contact_phone", "phone"), ("company", "located_in", "location"), ("company", "hr_contact", "person"), ("company", "payment_upi", "upi"), ("phone", "uses_upi", "upi"))
    flat = rows.select("msg_id", F.explode(F.array_distinct(F.concat(*[triples(*k) for k in kinds]))).alias("t")).select("msg_id", "t.*")
    grouped = flat.groupBy("source_type", "source_value", "relationship_type", "target_type", "target_value").agg(F.count(F.lit(1)).alias("weight"))
    ends = [vertex_id(F.col(f"{e}_type"), F.col(f"{e}_value")).alias(f"{e}_id") for e in ("source", "target")]
    return grouped.select(*ends, "relationship_type", "source_type", "source_value", "target_type", "target_value", "weight")


def graph_vertices(entity_rows: DataFrame) -> DataFrame:
    """Distinct nodes with an id made of type and value."""
    rows = _lists(entity_rows)
    typed = lambda k: F.transform(k, lambda v: F.struct(F.lit(k).alias("entity_type"), v.alias("value")))
    nodes = F.concat(*[typed(k) for _, k in _LISTS])
    flat = rows.select(F.explode(nodes).alias("n")).select("n.*").distinct()
    return flat.select(vertex_id(F.col("entity_type"), F.col("value")).alias("id"), "entity_type", "value")


def new_vertices(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Those that are not stored yet: append these and the write can be repeated."""
    return found.join(existing.select("id"), "id", "left_anti")


def cooccurrence_edges(entity_rows: DataFrame) -> DataFrame:
    """Unordered pairs of the phones, payment ids and agents of one message:
    weight counts messages, last_seen is the latest. Needs ts as well."""
    kinds = dict(entity_rows.dtypes)
    values = lambda c: F.col(c) if kinds[c].startswith("array") else F.array(F.col(c))
    keys = lambda c, k: F.transform(F.filter(F.transform(values(c), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), lambda v: F.concat(F.lit(k + ":"), v))
    nodes = F.array_sort(F.array_distinct(F.concat(keys("phones", "phone"), keys("upi_ids", "upi"), keys("agent", "agent"))))
    rows = entity_rows.select("msg_id", "ts", nodes.alias("nodes")).filter(F.size("nodes") > 1)
    pairs = F.flatten(F.transform("nodes", lambda a, i: F.transform(F.filter("nodes", lambda b: b > a), lambda b: F.struct(a.alias("entity_a"), b.alias("entity_b")))))
    flat = rows.select("ts", F.explode(pairs).alias("p")).select("ts", "p.*")
    grouped = flat.groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("weight"), F.max("ts").alias("last_seen"))
    kind = lambda c: F.get(F.split(c, ":", 2), F.lit(0))
    return grouped.select("entity_a", "entity_b", kind("entity_a").alias("entity_a_type"), kind("entity_b").alias("entity_b_type"), "weight", "last_seen")


ROLE_RELATIONS = ("has_role", "role", "offers_role", "job_role")
LICENCE_RELATIONS = ("has_license", "license", "licensed_as", "license_number")


def consistency_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: contradictions, checks and their ratio over a whole graph.

    Checks: companies and phones with more than one location; companies with a
    role whose licences are not exactly one; companies with neither a valid
    phone nor a named contact."""
    v = vertices.select(F.trim("id").alias("id"), F.lower(F.trim(F.coalesce("entity_type", F.lit("")))).alias("kind"), F.trim("value").alias("value")).filter("id <> ''")
    v = written(v, "graph_vertices")  # both tables are read several times below, what they are made of once
    end = lambda p: v.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "kind", "value")])
    rel = F.lower(F.trim(F.coalesce("relationship_type", F.lit(""))))
    e = edges.select(F.trim("source_id").alias("s_id"), F.trim("target_id").alias("t_id"), rel.alias("rel")).filter("s_id <> '' AND t_id <> '' AND rel <> ''")
    e = written(e.join(end("s"), "s_id").join(end("t"), "t_id"), "graph_edges")
    low = F.nullif(F.lower("t_value"), F.lit(""))
    from_company = F.col("s_kind") == "company"
    cleaned = F.regexp_replace(F.coalesce("t_value", F.lit("")), r"[ \t\n\r\f()\-]", "")
    # whether there are none, one or more values follows from the least and the largest, so values need not be counted apart
    ends = lambda x, name: (F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max"))
    number = lambda name: F.when(F.col(f"{name}_min").isNull(), 0).when(F.col(f"{name}_min") == F.col(f"{name}_max"), 1).otherwise(2)
    tests = {
        "place": F.when((F.col("rel") == "located_in") & (F.col("t_kind") == "location"), low),
        "role": F.when(F.col("rel").isin(*ROLE_RELATIONS) | (F.col("t_kind") == "role"), low),
        "licence": F.when(F.col("rel").isin(*LICENCE_RELATIONS) | F.col("t_kind").isin("license", "license_number"), low),
        "has_phone": (F.col("rel") == "contact_phone") & (F.col("t_kind") == "phone") & cleaned.rlike("^[+]?[0-9]{10,15}$"),
        "has_person": F.col("rel").isin("hr_contact", "contact_person") & F.col("t_kind").isin("person", "agent") & low.isNotNull(),
    }
    # distinct first, by hash and in each task: most edges of a company say the same
    told = e.filter(from_company).select(F.col("s_id").alias("id"), *[F.coalesce(x, F.lit(False)).alias(n) if n.startswith("has") else x.alias(n) for n, x in tests.items()]).distinct()
    by_company = told.groupBy("id").agg(*[x for n in ("place", "role", "licence") for x in ends(n, n)], F.bool_or("has_phone").alias("has_phone"), F.bool_or("has_person").alias("has_person"))
    companies = v.filter("kind = 'company'").select("id").join(by_company, "id", "left").na.fill(False, ["has_phone", "has_person"])
    companies = companies.withColumns({"places": number("place"), "roles": number("role"), "licences": number("licence")})
    located = e.filter("rel = 'located_in' AND t_kind = 'location'").select("s_id", "s_kind", low.alias("place")).filter("place IS NOT NULL").distinct()
    direct = located.filter("s_kind = 'phone'").select(F.col("s_id").alias("phone"), F.col("place").alias("place_min"), F.col("place").alias("place_max"))
    contacts = e.filter(from_company & (F.col("rel") == "contact_phone") & (F.col("t_kind") == "phone")).select(F.col("s_id").alias("company"), F.col("t_id").alias("phone"))
    # one row for each company, so a phone meets each of its companies once and not all their places
    places = located.filter("s_kind = 'company'").groupBy(F.col("s_id").alias("company")).agg(*ends("place", "place"))
    through = contacts.join(places, "company").select("phone", "place_min", "place_max")
    phones = direct.unionByName(through).distinct().groupBy("phone").agg(F.min("place_min").alias("place_min"), F.max("place_max").alias("place_max")).select("phone", number("place").alias("places"))
    check = lambda test, fails: (F.sum(test.cast("long")), F.sum((test & fails).cast("long")))
    sums = {"company_location": check(F.col("places") > 0, F.col("places") > 1), "role_licence": check(F.col("roles") > 0, F.col("licences") != 1), "contact": check(F.lit(True), ~F.col("has_phone") & ~F.col("has_person"))}
    columns = [x.alias(f"{n}_{k}") for n, pair in sums.items() for k, x in zip(("checks", "fails"), pair)]
    one = companies.agg(*columns).crossJoin(phones.agg(F.count(F.lit(1)).alias("phone_checks"), F.sum((F.col("places") > 1).cast("long")).alias("phone_fails"))).na.fill(0)
    checks = F.col("company_location_checks") + F.col("role_licence_checks") + F.col("contact_checks") + F.col("phone_checks")
    fails = F.col("company_location_fails") + F.col("role_licence_fails") + F.col("contact_fails") + F.col("phone_fails")
    return one.select(fails.alias("contradictions"), checks.alias("checks"), F.round(F.when(checks > 0, fails / checks).otherwise(F.lit(0.0)), 4).alias("consistency_score"))
