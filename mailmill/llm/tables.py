"""Small helpers shared by the operators: reading tables, cutting lineage, binding a value."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailmill.session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Makes the session ready for Python in tasks.

    Sends this package's code to the executors, once per application, so that it
    need not be installed there. Texts may be long, so the session's Arrow batches are
    bounded to fewer rows and bytes from then on.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    context = spark.sparkContext
    if getattr(context, "_mailmill_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    bundle = Path(tempfile.mkdtemp(prefix="mailmill-code-")) / "mailmill_code.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(bundle))
    context._mailmill_shipped = True


def give_back() -> None:
    """Returns freed memory to the system.

    Workers are used again by later stages; one that keeps what an earlier stage
    needed takes it from the executor for good.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a partition that gives memory back when it ends."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared work folder and read again.

    Lineage ends there: a lost executor costs the tasks that read, not what made the rows.
    What was shuffled to make them leaves the disk once they are written.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
