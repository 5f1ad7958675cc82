"""Session helpers: shared work folder, lineage cuts, bounded lookups."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

# A lookup side of at most this many rows is sent to every executor.
LOOKUP_ROWS = 50_000


_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
_OPEN = threading.local()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; the session's own settings are only read. A local session
    without one gets a folder of its own, because its executors are on the same machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if sc.applicationId not in _LOCAL:
            _LOCAL[sc.applicationId] = "file:" + tempfile.mkdtemp(prefix="tabflow-")
        named = _LOCAL[sc.applicationId]
    return f"{named.rstrip('/')}/tabflow-{sc.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has written to yet; ``release`` deletes it."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    if getattr(_OPEN, "paths", None) is not None:
        _OPEN.paths.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far and return how many there were.

    For callers who are done with all results: a DataFrame that still reads from one of them fails afterwards.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def forget(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table that nothing reads any more."""
    _WRITTEN.get(spark.sparkContext.applicationId, []).remove(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing_steps(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables that this thread writes inside, at the end: for work whose result is a number, not a DataFrame."""
    outer, _OPEN.paths = getattr(_OPEN, "paths", None), []
    try:
        yield
    finally:
        written, _OPEN.paths = _OPEN.paths, outer
        for path in written:
            if path in _WRITTEN.get(spark.sparkContext.applicationId, []):
                forget(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder so later steps start from the written rows.

    A table, unlike a plain checkpoint, lets those steps read only the columns they need.
    """
    path = fresh_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(taken: Sequence[str], base: str) -> str:
    """A column name that starts with ``base`` and is not taken, in whatever case."""
    used = {c.lower() for c in taken}
    name, i = base, 0
    while name.lower() in used:
        i += 1
        name = f"{base}_{i}"
    return name


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that was read from too few splits.

    For fits and scoring, which work long on each row. Tables of many files stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def in_parallel(spark: SparkSession, jobs: Sequence[Callable[[], object]], most: int) -> list:
    """Results of several driver-side calls, in order; their Spark jobs share the cluster."""
    if not jobs:
        return []
    start = inheritable_thread_target(spark)
    with ThreadPool(min(most, len(jobs))) as pool:
        return pool.map(lambda job: start(job)(), jobs)


def attach(df: DataFrame, stats: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join per-group values back onto rows without shuffling ``df`` where that is safe.

    ``stats`` is evaluated once. Up to ``LOOKUP_ROWS`` rows it travels as a broadcast; beyond
    that both sides are shuffled and adaptive execution splits hot keys.
    """
    rows = stats.limit(LOOKUP_ROWS + 1).collect()
    if len(rows) <= LOOKUP_ROWS:
        stats = F.broadcast(df.sparkSession.createDataFrame(rows, stats.schema))
    return df.join(stats, on, how)
