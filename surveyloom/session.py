"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar
from weakref import WeakKeyDictionary

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

R = TypeVar("R")


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("surveyloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; a cluster is refused,
    since its executors would each write to their own disk.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set spark.checkpoint.dir to a folder all executors of {context.master} share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="surveyloom-"))
        current = context.getCheckpointDir()
    return current


_RUN_DIRS: dict[str, str] = {}


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when Python ends."""
    application = spark.sparkContext.applicationId
    if application not in _RUN_DIRS:
        _RUN_DIRS[application] = f"{shared_dir(spark).rstrip('/')}/run-{application}-{uuid.uuid4().hex[:8]}"
        atexit.register(drop_run_dir, spark, _RUN_DIRS[application])
    return _RUN_DIRS[application]


def drop_run_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system it lies in; without a session to do it the folder stays."""
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the gateway may be gone by now
        return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a frame as parquet in the shared folder and read it back.

    Like a checkpoint, but columnar: later readers prune columns, push filters and see its true size.
    """
    return settle_at(df, scratch_path(df.sparkSession, name))


#: Where the frames of :func:`settle` that are still in use lie.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def settle_at(df: DataFrame, path: str, schema: StructType | None = None) -> DataFrame:
    """Write a frame to a path of its own and read it back, with another ``schema`` of the same content if one is given; :func:`release` can drop it."""
    df.write.parquet(path)
    found = df.sparkSession.read.schema(schema or df.schema).parquet(path)
    _PLACES[found] = path
    return found


def is_settled(df: DataFrame) -> bool:
    return df in _PLACES


def settled_bytes(df: DataFrame) -> int:
    """What a settled frame takes on disk."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_PLACES[df])
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def release(*frames: DataFrame) -> None:
    """Drop settled frames that nothing reads any more, and let Spark drop the shuffles of queries that are gone: a run's disk then holds what it still
    needs, not all it ever wrote. Other frames are left alone.
    """
    for df in frames:
        path = _PLACES.pop(df, None)
        if path is not None:
            drop_run_dir(df.sparkSession, path)
    if frames:
        gc.collect()
        frames[0].sparkSession._jvm.System.gc()


def packed(df: DataFrame, rows: int, rows_per_task: int = 20_000, least: int = 2_000) -> DataFrame:
    """Fewer partitions for a small training table, where scheduling would cost more than each pass; large ones stay.

    While a task keeps ``least`` rows there is one per core, since a fit passes over the rows very many times.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, -(-rows // rows_per_task), min(cores, -(-rows // least))))


def side_by_side(steps: Sequence[Callable[[], R]], workers: int = 4) -> list[R]:
    """Run independent fits from driver threads, so that one job's tasks fill the cores another leaves idle."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(steps)))) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
        return [f.result() for f in futures]
