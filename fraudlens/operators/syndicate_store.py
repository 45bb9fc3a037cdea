"""Syndicates kept from batch to batch: labels, syndicates and members as folded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.folded import COMPACT_AFTER, FoldedTable
from fraudlens.operators import graph
from fraudlens.storage import discard, written

LABELS = "node string, component string, batch long"
SYNDICATES = "fingerprint string, component string, cluster_size long, n_phones long, n_upis long, risk_score double, active boolean, batch long"
MEMBERS = "fingerprint string, entity_key string, entity_type string, entity_value string, risk_score double, active boolean, batch long"


def latest(*keys: str):
    """A fold that keeps of each key the row of its last batch."""

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "batch").alias("_row")).select("_row.*")

    return fold


class SyndicateStore:
    """Tables of a graph whose edges arrive in batches.

    ``labels``: the component of each node. ``syndicates``: upserted by fingerprint;
    one that grew or was joined to another has a new fingerprint, and the old row
    is set inactive in the same batch. ``members``: upserted by (fingerprint, entity_key), inactive with their syndicate.
    Whatever the batches, what is active equals ``graph.syndicates`` of all edges.

    All three deltas of a batch are computed from the tables before it and written
    before any is folded, so a batch that breaks off can run again, and one that was
    folded changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, compact_after: int = COMPACT_AFTER):
        table = lambda name, schema, *keys: FoldedTable(spark, f"{folder}/{name}", schema, latest(*keys), compact_after)
        self.labels = table("labels", LABELS, "node")
        self.all_syndicates = table("syndicates", SYNDICATES, "fingerprint")
        self.all_members = table("members", MEMBERS, "fingerprint", "entity_key")
        self._tables = (self.labels, self.all_syndicates, self.all_members)

    def add(self, batch: int, edges: DataFrame, a: str = "a", b: str = "b") -> None:
        """The edges of a batch; batches are numbered in ascending order."""
        if batch > max(t.folded() for t in self._tables):
            self._write(batch, edges, a, b)
        for t in self._tables:
            t.compact()

    def _write(self, batch: int, edges: DataFrame, a: str, b: str) -> None:
        labels = self.labels.read(before=batch).select("node", "component")
        stored = self.all_syndicates.read(before=batch).filter("active")
        given = written(edges.select(a, b).distinct(), "edges")  # a batch of a stream is read once
        changes = graph.component_changes(labels, given, a, b)
        grown = changes.select("component").distinct()
        # members of the components that changed: those that were there under that name, and the changed ones
        kept = labels.join(grown, "component", "left_semi").join(changes.select("node"), "node", "left_anti")
        whole = kept.unionByName(changes.select("node", "component"))
        now = graph.qualifying(graph.component_digests(whole))
        now = written(now.withColumns({"active": F.lit(True), "batch": F.lit(batch).cast("long")}), "syndicates")
        touched = grown.union(changes.filter("was IS NOT NULL").select("was")).distinct()
        old = stored.join(touched, "component", "left_semi").join(now.select("fingerprint"), "fingerprint", "left_anti")
        old = old.withColumns({"active": F.lit(False), "batch": F.lit(batch).cast("long")})
        old = written(old, "old")
        # members of the new ones, and those stored of the ones that go
        fresh = graph.digest_members(whole, now).withColumn("active", F.lit(True))
        gone = self.all_members.read(before=batch).join(old.select("fingerprint"), "fingerprint", "left_semi").drop("batch").withColumn("active", F.lit(False))
        self.labels.put(batch, changes.select("node", "component", F.lit(batch).cast("long").alias("batch")))
        self.all_syndicates.put(batch, now.unionByName(old))
        self.all_members.put(batch, fresh.unionByName(gone).withColumn("batch", F.lit(batch).cast("long")))
        discard(given, changes, now, old)

    def digests(self) -> DataFrame:
        """The active syndicates without their members."""
        return self.all_syndicates.read().filter("active").drop("component", "active", "batch")

    def syndicates(self) -> DataFrame:
        return graph.with_lists(self.digests(), self.members())

    def members(self) -> DataFrame:
        return self.all_members.read().filter("active").drop("active", "batch")
