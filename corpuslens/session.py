"""Session defaults and the one place where a lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from multiprocessing.pool import ThreadPool
from threading import Lock
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_local_stage_dir: str | None = None
#: Folders that `stage` wrote inside the innermost `staged_alone`.
_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)
#: Spark then deletes the shuffle files of an execution at its end, not when the driver collects its garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning: list[str] = []
_lock = Lock()


def get_spark(app: str = "corpuslens", **conf: str) -> SparkSession:
    """A session for tests and local runs; a cluster brings its own."""
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (`spark.checkpoint.dir`).

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its executor.
    """
    global _local_stage_dir
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_stage_dir is None:
        _local_stage_dir = tempfile.mkdtemp(prefix="corpuslens-stage-")
    return _local_stage_dir


@contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files; the session's setting comes back with the last of them."""
    with _lock:
        _cleaning.append(_cleaning[0] if _cleaning else spark.conf.get(CLEAN_SHUFFLES, "false"))
        spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        with _lock:
            before = _cleaning.pop()
            if not _cleaning:
                spark.conf.set(CLEAN_SHUFFLES, before)


def stage(df: DataFrame, name: str = "stage", **options) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where an expensive table feeds several later jobs. The result survives
    the loss of executors, keeps column pruning, and is computed exactly once
    (an eager `checkpoint()` would compute the table twice). Its shuffle files go with
    the write: nothing reads them again. `options` are the writer's.
    """
    spark = df.sparkSession
    path = os.path.join(stage_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if (mine := _staged.get()) is not None:
        mine.append(path)
    with _clean_shuffles(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str = "stage") -> DataFrame:
    """Stage the result of `make` and delete the tables that it staged on the way (in this thread)."""
    mine: list[str] = []
    token = _staged.set(mine)
    try:
        try:
            found = make()
        finally:
            _staged.reset(token)
        return stage(found, name)
    finally:
        for path in mine:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def side_by_side(tasks: list[Callable[[], T]], threads: int = 4) -> list[T]:
    """Results of independent Spark jobs submitted from a few driver threads."""
    if len(tasks) < 2:
        return [task() for task in tasks]
    with ThreadPool(min(threads, len(tasks))) as pool:
        return pool.map(lambda task: task(), tasks, chunksize=1)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan by `key` when it has fewer splits than the cluster has cores.

    A corpus of many splits already feeds every core and is left alone. A single
    small file would run the per-row text work on one core.
    """
    parallelism = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= parallelism:
        return scan
    return scan.repartition(parallelism, key)
