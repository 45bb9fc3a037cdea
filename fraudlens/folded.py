"""Tables kept as a base and the deltas of the batches after it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fraudlens.storage import _path

#: Deltas after which they are folded into a new base.
COMPACT_AFTER = 16


class FoldedTable:
    """A keyed table whose rows of one key can be folded into one, in any grouping.

    A batch writes ``delta/batch=N``, so a batch that runs again replaces what it
    wrote. ``compact`` folds the base and the deltas after it into ``base/upto=N`` once there
    are enough of them; a batch up to N that runs again then finds its rows in the base and changes nothing. A base
    counts once its writer has committed (``_SUCCESS``). The base before it and that base's
    deltas stay for readers that have begun; what is older is removed. So a read
    scans one base and at most ``compact_after`` deltas, however many batches there were.

    One writer at a time, batches in ascending order, as in ``foreachBatch``.
    ``fold`` takes rows of the table's schema and gives one row of it for each key.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, fold: Callable[[DataFrame], DataFrame], compact_after: int = COMPACT_AFTER):
        self.spark, self.folder, self.schema, self.fold, self.compact_after = spark, folder.rstrip("/"), schema, fold, compact_after

    def _numbers(self, kind: str) -> list[int]:
        """Committed folders of a kind, ascending. Their number is bounded by ``compact`` and not by the rows."""
        files, path = _path(self.spark, f"{self.folder}/{kind}")
        if not files.exists(path):
            return []
        inside = [s.getPath() for s in files.listStatus(path) if s.isDirectory()]
        done = [p for p in inside if files.exists(_path(self.spark, f"{p.toString()}/_SUCCESS")[1])]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def _remove(self, kind: str, number: int) -> None:
        files, path = _path(self.spark, f"{self.folder}/{kind}={number}")
        files.delete(path, True)

    def folded(self) -> int:
        """The last batch that the base holds, -1 without a base."""
        return max(self._numbers("base"), default=-1)

    def put(self, batch: int, rows: DataFrame) -> None:
        if batch > self.folded():
            rows.write.mode("overwrite").parquet(f"{self.folder}/delta/batch={batch}")

    def read(self, before: int | None = None) -> DataFrame:
        """The table, or as it was before a batch that the base does not hold yet."""
        upto = self.folded()
        if before is not None and before <= upto:
            raise ValueError(f"batch {before} is folded into the base up to {upto}")
        later = [n for n in self._numbers("delta") if n > upto and (before is None or n < before)]
        paths = [f"{self.folder}/base/upto={upto}"] * (upto >= 0) + [f"{self.folder}/delta/batch={n}" for n in later]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return self.fold(rows) if later else rows

    def compact(self) -> None:
        """Fold the deltas into a new base if there are ``compact_after`` of them."""
        upto, deltas = self.folded(), self._numbers("delta")
        later = [n for n in deltas if n > upto]
        if len(later) < self.compact_after:
            return
        self.read().write.mode("overwrite").parquet(f"{self.folder}/base/upto={later[-1]}")
        for n in deltas:
            if n <= upto:
                self._remove("delta/batch", n)
        for n in self._numbers("base"):
            if n < upto:
                self._remove("base/upto", n)
