"""How the operators cut a lineage, and names for rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.storage import discard, shared_folder, written

__all__ = ["cut", "discard", "numbered", "row_hash", "shared_folder"]

cut = written


def row_hash(frame: DataFrame) -> Column:
    """A hash of all columns that can be hashed, to order rows the same way in every run; never a row's name."""
    return F.xxhash64(*[frame[name] for name, kind in frame.dtypes if "map<" not in kind and kind != "variant"])


def numbered(frame: DataFrame, label: str, name: str = "_row") -> DataFrame:
    """``frame`` with a long of its own for each row, written so that it stays the same in all that follows."""
    return cut(frame.withColumn(name, F.monotonically_increasing_id()), label)
