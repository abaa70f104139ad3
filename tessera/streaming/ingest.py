"""Incremental ingest as a stream: state knows every file, and a batch reads only what is new.

Each batch lists the folder (``sources.folder``).  Keyed state holds a file's fingerprint: a file that is new
or has another one is due, and a file that no listing has told of for a while is gone, by a timer.  Only
files that are due are read, parsed and saved.  A batch that is run again, after a failure, finds in the
index what it saved before and does nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import build
from tessera.operators import index as I
from tessera.shipping import ship
from tessera.sources.folder import FolderListing

#: Milliseconds without a sign after which a file counts as deleted.
GRACE = 60_000


def changes(listings: DataFrame, grace: int = GRACE) -> DataFrame:
    """(path, action, mtime, size) of a stream of ``listings`` (path, mtime, size): ``index`` for files that are
    new or changed, ``removed`` for those that were not listed for ``grace`` milliseconds."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            mtime, size = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "action": ["removed"], "mtime": [mtime], "size": [size]})
            return
        last = max((tuple(row) for frame in frames for row in frame[["mtime", "size"]].itertuples(index=False)), default=None)
        if last is None:
            return
        known = state.get if state.exists else None
        state.update((float(last[0]), int(last[1])))
        state.setTimeoutDuration(grace)
        if known is None or (float(known[0]), int(known[1])) != (float(last[0]), int(last[1])):
            yield pd.DataFrame({"path": [key[0]], "action": ["index"], "mtime": [float(last[0])], "size": [int(last[1])]})

    return listings.groupBy("path").applyInPandasWithState(run, "path string, action string, mtime double, size long", "mtime double, size long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def watch(spark: SparkSession, raw_root: str, store: I.Store, checkpoint: str, *, once: bool = True, every: str = "30 seconds", grace: int = GRACE, started: list | None = None) -> StreamingQuery:
    """Follow a raw folder; ``once`` looks at it a single time.  ``started`` gets what each batch did."""
    ship(spark)
    spark.dataSource.register(FolderListing)
    listings = spark.readStream.format("folder_listing").load(raw_root)

    def run(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            done = build.sync_files(spark, raw_root, store, batch.filter("action = 'index'").select("path"), batch.filter("action = 'removed'").select("path"))
        finally:
            batch.unpersist()
        if started is not None:
            started.append(done)

    writer = changes(listings, grace).writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=every)).start()


def admissions(events: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Requests per user and window of an event stream (ts, user_id), late ones within ``late`` counted."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("requests"))
