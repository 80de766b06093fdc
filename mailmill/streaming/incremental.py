"""The daily run as a stream: what is new since the last run, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.times import DEFAULT_ZONE
from ..operators import actions as act
from ..operators.bounded import small_rows
from ..operators.predicates import UNREAD, in_scope
from ..operators.scoring import Scorer, score_messages
from ..plans.normalise import normalise_messages
from ..schemas import ACTION, SCORED
from ..sources.landing import ARRIVED, stream_raw
from ..sources.ledger import BUCKETS, Ledger
from ..sources.published import PublishedTable

LIFETIME = "30 days"
"""How long an id stays in the state of the stream. The ledger of seen ids holds it for good."""

_BATCH = ("stream_id", "batch_id")
_DONE = (act.PENDING, act.APPLIED)


def once_per_id(raw: DataFrame, within: str | None = LIFETIME) -> DataFrame:
    """Each message once, as far back as the state reaches.

    An id is forgotten `within` after it came; a copy that comes later passes.
    Without a bound every id ever seen stays in the state store. What counts is when
    the file came, not when the message was sent: an old message in a new file must
    not be taken for a late one.
    """
    if within is None:
        return raw.dropDuplicates(["id"])
    return raw.withWatermark(ARRIVED, within).dropDuplicatesWithinWatermark(["id"])


def stream_table(path: str, schema: StructType) -> PublishedTable:
    """A table written by streams, one partition for each batch of each."""
    return PublishedTable(path, schema, _BATCH)


def start_incremental(
    spark: SparkSession,
    landing: str,
    label_dim: DataFrame,
    scorer: Scorer,
    root: str,
    checkpoint: str,
    scope: str = UNREAD,
    zone: str = DEFAULT_ZONE,
    within: str | None = LIFETIME,
    files_per_batch: int | None = None,
    dry_run: bool = False,
    connect: Callable[[], act.AddLabel] | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Normalise, score and act on the files that came since the checkpoint, then stop.

    Each batch of each stream is published once; a batch run again after a failure
    goes on where it stopped. A new checkpoint is a new stream, whose batches stand
    beside those of the old one. What the state has forgotten the ledgers know: a
    message that any batch published is not published again, an action that was done
    is not done again. `checkpoint` and `root` must lie in storage that outlives the
    executors.
    """
    scored, actions = stream_table(f"{root}/scored", SCORED), stream_table(f"{root}/label_actions", ACTION)
    # Read once for all batches where it is small.
    known = small_rows(label_dim)
    labels = label_dim if known is None else spark.createDataFrame(known, label_dim.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # The id of a stream lies in its checkpoint.
        stream_id = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        mine = {"stream_id": stream_id, "batch_id": str(batch_id)}
        if scored.is_published(session, **mine):
            # The state of the stream is only kept for a batch that was read to its end.
            batch.write.format("noop").mode("overwrite").save()
        else:
            seen = Ledger(session, f"{root}/seen_ids", buckets, keys=("id",)).take_in(scored)
            messages = normalise_messages(seen.without_done(batch), labels, zone)
            scored.publish(score_messages(messages, scorer), first=True, **mine)
        if dry_run or actions.is_published(session, **mine):
            return
        done = Ledger(session, f"{root}/done_actions", buckets).take_in(actions, _DONE)
        planned = act.plan_actions(scored.read(session, **mine), labels)
        fresh = done.without_done(planned.where(F.col("outcome") == act.PENDING)).select(*ACTION.names)
        due = planned.where(F.col("outcome") == act.SKIPPED).select(*ACTION.names).unionByName(fresh)
        actions.publish(due if connect is None else act.apply_actions(due, connect), first=True, **mine)

    # The scope comes first: a message read when it first came and unread now is
    # new to the scope, and ids outside it never enter the state.
    arriving = in_scope(stream_raw(spark, landing, files_per_batch), scope, "labelIds")
    fresh = once_per_id(arriving, within)
    return (
        fresh.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_stream_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What the streams published, with stream and batch of each row."""
    return stream_table(path, schema).read(spark)


def pending_actions(spark: SparkSession, root: str) -> DataFrame:
    return read_stream_table(spark, f"{root}/label_actions", ACTION).where(
        F.col("outcome") == act.PENDING
    )
