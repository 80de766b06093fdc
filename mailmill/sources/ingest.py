"""Landing files taken into a store, each once, with what could not be read put aside.

A run lists the landing folder, takes the files no committed run has taken, parses
them once, and publishes good and bad lines as one version: good lines with the scope
flags and the time as columns, bad ones as their text with the reason. What the run
takes is noted before; the commit of the store alone makes it count. So a run that
stops leaves its files to the next one.

The store lies by day of ingest and scope flags, so that files hold one combination of
them and a scope reads its own files only. Each task writes its own files; records are
not shuffled on the way.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

from ..functions.times import epoch_millis
from ..operators.bounded import broadcast_if_small, small_rows
from ..operators.predicates import in_scope, scope_flags
from ..schemas import RAW, extended
from .landing import NO_LIMITS
from .published import PublishedTable

MESSAGE, REJECT = "message", "reject"
BAD_LINE, NO_ID = "not a JSON object of the schema", "no id"
_LINE = "_corrupt_record"
FLAGS = ("is_inbox", "is_unread", "is_primary")
_FILE_URI = "_metadata.file_path"

FILE = StructType([
    StructField("path", StringType()), StructField("uri", StringType()),
    StructField("modified", TimestampType()), StructField("length", LongType()),
])
STORED = StructType([
    *[StructField(f.name, f.dataType) for f in RAW.fields],
    StructField("internal_ts", TimestampType()),
    *[StructField(name, BooleanType()) for name in FLAGS],
    StructField("arrived", TimestampType()), StructField("file", StringType()), StructField("row", LongType()),
    StructField("reject_reason", StringType()), StructField("line", StringType()), StructField("kind", StringType()),
])


def _day(day: date) -> str:
    return day.isoformat()


class MessageStore:
    """The store of a landing folder, under `root`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.rows = PublishedTable(f"{root}/ingested", STORED, ("ingest_day", "batch"), inner=("kind", *FLAGS))
        self.files = PublishedTable(f"{root}/ingested_files", FILE, ("batch",))

    def taken_files(self) -> DataFrame:
        """Files of committed runs. A file that was replaced is another one."""
        committed = self.rows.valid(self.spark).select("batch")
        return self.files.read(self.spark).join(broadcast_if_small(committed), "batch", "left_semi")

    def new_files(self, landing: str) -> DataFrame:
        try:
            listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(landing)
        except AnalysisException as fault:
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], FILE)
        # Without the content column the files are listed, not read.
        found = listed.select("path", F.col(_FILE_URI).alias("uri"), F.col("modificationTime").alias("modified"), "length")
        return found.join(self.taken_files().select(*FILE.names), FILE.names, "left_anti")

    def ingest(self, landing: str, day: date) -> str | None:
        """Takes what is new; gives the name of the batch, None where nothing is."""
        batch = uuid.uuid4().hex
        files = self.new_files(landing)
        if files.isEmpty():
            return None
        self.files.publish(files, batch=batch)
        mine = self.files.read(self.spark, batch=batch).select("path", "uri")
        self.rows.publish(self._parsed(landing, mine), ingest_day=_day(day), batch=batch)
        return batch

    def _parsed(self, landing: str, paths: DataFrame) -> DataFrame:
        schema = extended(RAW, **{_LINE: "string"})
        reader = self.spark.read.schema(schema).options(
            **NO_LIMITS, mode="PERMISSIVE", columnNameOfCorruptRecord=_LINE, recursiveFileLookup="true")
        few = small_rows(paths)
        whole = reader.json(landing if few is None else [r.path for r in few])
        raw = whole.select("*", F.col(_FILE_URI).alias("uri"), F.col("_metadata.file_modification_time").alias("arrived"))
        if few is None:
            raw = raw.join(paths, "uri", "left_semi")
        reason = F.when(F.col(_LINE).isNotNull(), BAD_LINE).when(F.col("id").isNull(), NO_ID)
        flags = scope_flags(F.col("labelIds"))
        return raw.select(
            *[F.when(reason.isNull(), F.col(c)).alias(c) for c in RAW.names],
            F.when(reason.isNull(), F.timestamp_millis(epoch_millis(F.col("internalDate")))).alias("internal_ts"),
            *[F.when(reason.isNull(), test).alias(name) for name, test in flags.items()],
            "arrived", F.col("uri").alias("file"),
            F.monotonically_increasing_id().alias("row"), reason.alias("reject_reason"),
            # A record of the schema without an id is kept as what was read of it.
            F.when(reason.isNotNull(), F.coalesce(_LINE, F.to_json(F.struct(*RAW.names)))).alias("line"),
            F.when(reason.isNull(), MESSAGE).otherwise(REJECT).alias("kind"),
        )

    def messages(self, scope: str, since: date | None = None) -> DataFrame:
        """The newest copy of each message, of those that are in scope now.

        Which copy is the newest is settled on ids and times alone; records are read
        of the copies that count. `since` leaves out what came in before.
        """
        kept = self.rows.read(self.spark).where(F.col("kind") == MESSAGE)
        if since is not None:
            kept = kept.where(F.col("ingest_day") >= _day(since))
        copy = F.struct("arrived", "file", "row", "batch")
        # Counted and compared before the shuffle, so very many copies of one id are a row a task.
        several = kept.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.max(copy).alias("newest"))
        several = several.where("copies > 1").select("id", "newest")
        chosen = in_scope(kept, scope, ids="labelIds").join(broadcast_if_small(several), "id", "left")
        return chosen.where(F.col("newest").isNull() | (copy == F.col("newest"))).drop("newest")

    def raw(self, scope: str, since: date | None = None) -> DataFrame:
        return self.messages(scope, since).select(*RAW.names)

    def rejects(self) -> DataFrame:
        """(ingest_day, batch, file, reject_reason, line) of every line put aside."""
        kept = self.rows.read(self.spark).where(F.col("kind") == REJECT)
        return kept.select("ingest_day", "batch", "file", "reject_reason", "line")

    def manifest(self) -> DataFrame:
        """(ingest_day, batch, file, messages, rejects) of every file that was taken."""
        kept = self.rows.read(self.spark).select("ingest_day", "batch", "file", "kind")
        return kept.groupBy("ingest_day", "batch", "file").agg(
            F.count_if(F.col("kind") == MESSAGE).alias("messages"), F.count_if(F.col("kind") == REJECT).alias("rejects"))
