"""Tables whose partitions are published in versions, each valid from the moment of its commit.

Rows of a partition are written to a folder of their own version; then one commit
record names that version. Readers take the version of the newest record of each
partition, so they see all of a version or nothing of it. A writer that stops before
its record leaves a folder that nothing reads. A version without rows is valid too: it
empties its partition. Earlier versions stay until they are removed; `stale_versions`
lists them.

A task that runs twice, or a write that is repeated, adds no rows: the file committer
takes one attempt of a task, and a repeated write is a version of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..operators.bounded import small_rows
from ..schemas import extended

VERSION = "version"


def read_or_none(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table, without rows where there is no folder yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class PublishedTable:
    """A table of `schema` at `path`, in partitions named by the text columns `keys`.

    `inner` are columns of the schema by which the files of a version are split.
    """

    path: str
    schema: StructType
    keys: tuple[str, ...]
    inner: tuple[str, ...] = ()

    @property
    def _record(self) -> StructType:
        fields = [StructField(k, StringType()) for k in (*self.keys, VERSION)]
        fields += [StructField("sequence", LongType()), StructField("row_count", LongType())]
        return StructType([*fields, StructField("committed_at", TimestampType())])

    def records(self, spark: SparkSession) -> DataFrame:
        """Every commit ever made."""
        return read_or_none(spark, f"{self.path}/commits", self._record)

    def valid(self, spark: SparkSession) -> DataFrame:
        """The newest commit of each partition; of two of one number the greater version."""
        newest = F.max(F.struct("sequence", VERSION, "row_count", "committed_at")).alias("newest")
        return self.records(spark).groupBy(*self.keys).agg(newest).select(*self.keys, "newest.*")

    def is_published(self, spark: SparkSession, **of: str) -> bool:
        return not self._of(self.records(spark), of).isEmpty()

    @staticmethod
    def _of(df: DataFrame, of: Mapping[str, str]) -> DataFrame:
        for key, value in of.items():
            df = df.where(F.col(key) == value)
        return df

    def publish(self, rows: DataFrame, first: bool = False, **of: str) -> str:
        """Replaces the partition `of` by the rows; gives the new version.

        `first` says that the partition is known to have no commit yet.
        """
        if set(of) != set(self.keys):
            raise ValueError(f"a partition is named by {self.keys}, not {tuple(of)}")
        spark = rows.sparkSession
        version = uuid.uuid4().hex
        before = None if first else self._of(self.records(spark), of).agg(F.max("sequence").alias("last")).first().last
        counted = Observation()
        names = {**{k: F.lit(v) for k, v in of.items()}, VERSION: F.lit(version)}
        found = rows.select(*self.schema.names).observe(counted, F.count(F.lit(1)).alias("row_count"))
        by = (*self.keys, VERSION, *self.inner)
        found.withColumns(names).write.mode("append").partitionBy(*by).parquet(f"{self.path}/data")
        self.commit(spark, version, -1 if before is None else before, counted.get["row_count"], **of)
        return version

    def commit(self, spark: SparkSession, version: str, before: int, row_count: int, **of: str) -> None:
        """The one write that makes a version valid: one record, so one file."""
        told = {**of, VERSION: version, "sequence": before + 1, "row_count": row_count}
        values = [F.lit(told[f.name]) if f.name in told else F.current_timestamp() for f in self._record.fields]
        record = [v.cast(f.dataType).alias(f.name) for v, f in zip(values, self._record.fields)]
        spark.range(0, 1, 1, 1).select(*record).write.mode("append").parquet(f"{self.path}/commits")

    def read(self, spark: SparkSession, **of: str) -> DataFrame:
        """Valid rows of all partitions, or of those that `of` names, with the keys beside them.

        Versions become constants of the partition filter as long as they are few;
        else they are joined.
        """
        keys = {k: "string" for k in (*self.keys, VERSION)}
        data = read_or_none(spark, f"{self.path}/data", extended(self.schema, **keys))
        data = self._of(data, of)
        valid = self._of(self.valid(spark), of).where(F.col("row_count") > 0).select(VERSION)
        known = small_rows(valid)
        if known is None:
            data = data.join(valid, VERSION, "left_semi")
        else:
            data = data.where(F.col(VERSION).isin([r[VERSION] for r in known]))
        return data.select(*self.schema.names, *self.keys)

    def stale_versions(self, spark: SparkSession) -> DataFrame:
        """(keys, version) of the commits that newer ones replaced; their folders may be removed."""
        old = self.records(spark).join(self.valid(spark), VERSION, "left_anti")
        return old.select(*self.keys, VERSION)
