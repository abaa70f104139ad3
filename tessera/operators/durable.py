"""Intermediate tables that outlive executors, and broadcasts behind a check of their size."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that setting is absent (a bare local test session) is a folder made here.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder:
        return folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


class _Open(threading.local):
    """Paths written inside the open ``scratch`` blocks of a thread, innermost last."""

    def __init__(self) -> None:
        self.blocks: list[list[str]] = []


_OPEN = _Open()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside the block go when it ends, unless they were kept.  What
    reads them must have been written by then."""
    _OPEN.blocks.append([])
    try:
        yield
    finally:
        drop(spark, _OPEN.blocks.pop())


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str, *, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, never a recomputation of what led here.
    ``keep`` saves the table from the end of a ``scratch`` block.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if _OPEN.blocks and not keep:
        _OPEN.blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows (or its ``weight`` sums to at most
    that); otherwise as it is, for a join by exchange.  Meant for written tables, which count fast."""
    size = df.count() if weight is None else (df.agg(F.sum(weight)).first()[0] or 0)
    return F.broadcast(df) if size <= most else df


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` over all shuffle partitions, however few bytes they are: for what costs time
    rather than bytes, where merging small partitions would leave one task with all the work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: What was made of a table in a session, by application, path, state and name.
_KEPT: dict[tuple[str, ...], object] = {}


def state(spark: SparkSession, path: str) -> str:
    """What tells whether a table changed: how many files it has, their bytes, and when it was last written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    told = fs.getContentSummary(at)
    return f"{told.getFileCount()}:{told.getLength()}:{fs.getFileStatus(at).getModificationTime()}"


def kept(spark: SparkSession, path: str, name: str, make: Callable[[], object]) -> object:
    """What ``make`` makes of the table at ``path`` (tables it writes with ``keep``), made once as long as the
    table does not change."""
    key = (spark.sparkContext.applicationId, path, state(spark, path), name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]
