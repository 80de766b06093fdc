"""What was done to which message, kept so that a day's work never moves the history.

The ledger is a Parquet table in buckets by its keys, as (id, category). A day's rows are dealt to
the same buckets and matched bucket by bucket: the history is read where it lies,
without a shuffle. Files carry a Bloom filter on the id, which a search for a few ids
uses to skip row groups.

The ledger is made from published versions of another table. It remembers which of them
it holds, and takes in what it lacks when it is opened; it can be thrown away and made
anew, which is also what another number of buckets does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .published import VERSION, PublishedTable, read_or_none

BUCKETS = 64
_TAKEN = StructType([StructField(VERSION, StringType())])


class Ledger:
    """A ledger at `path`; `buckets` should give each task a part of the history that fits it."""

    def __init__(
        self, spark: SparkSession, path: str, buckets: int = BUCKETS, keys: tuple[str, ...] = ("id", "category")
    ):
        self.spark, self.buckets, self.keys = spark, buckets, keys
        self.path = f"{path}/buckets-{buckets}"
        # The catalog knows buckets, a path does not. The name follows from the path.
        self.name = "mailmill_ledger_" + hashlib.md5(self.path.encode()).hexdigest()
        columns = ", ".join(f"{k} string" for k in keys)
        spark.sql(
            f"create table if not exists {self.name} ({columns}) using parquet "
            f"options ('parquet.bloom.filter.enabled#id' = 'true') "
            f"clustered by ({', '.join(keys)}) into {buckets} buckets location '{self.path}/rows'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def taken(self) -> DataFrame:
        """Versions whose rows the ledger holds."""
        return read_or_none(self.spark, f"{self.path}/taken", _TAKEN)

    def add(self, rows: DataFrame, versions: DataFrame) -> None:
        """Takes in the keys of the rows, then notes their versions.

        Stopped in between, it takes them in once more, which changes no answer.
        """
        keys = rows.select(*self.keys).dropna().distinct()
        keys.repartition(self.buckets, *self.keys).sortWithinPartitions(*self.keys).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        versions.select(VERSION).coalesce(1).write.mode("append").parquet(f"{self.path}/taken")

    def take_in(self, table: PublishedTable, outcomes: Iterable[str] | None = None) -> "Ledger":
        """Adds what was published, with one of the outcomes if given, and is not in the ledger yet.

        Every version counts, also one that was replaced since: what it did was done.
        """
        missing = table.records(self.spark).select(VERSION).join(self.taken(), VERSION, "left_anti")
        versions = [r[VERSION] for r in missing.collect()]
        if versions:
            schema = StructType([*table.schema.fields, *[StructField(k, StringType()) for k in (*table.keys, VERSION)]])
            rows = read_or_none(self.spark, f"{table.path}/data", schema).where(F.col(VERSION).isin(versions))
            if outcomes is not None:
                rows = rows.where(F.col("outcome").isin(list(outcomes)))
            self.add(rows, self.spark.createDataFrame([(v,) for v in versions], _TAKEN))
        return self

    def without_done(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys are not in the ledger. The history is not moved."""
        return rows.join(self.rows(), list(self.keys), "left_anti")

    def among(self, ids: list[str]) -> DataFrame:
        """What was done to a few messages."""
        return self.rows().where(F.col("id").isin(ids))
