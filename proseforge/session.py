"""Session defaults and the shared working folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def local_session(cpus: str | int = 8, app: str = "proseforge") -> SparkSession:
    """A single-machine session for tests and the benchmark.

    On a cluster the session comes from spark-submit; nothing in the package
    depends on the settings made here.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


@lru_cache
def _own_folder() -> str:
    """One temporary folder per process."""
    return tempfile.mkdtemp(prefix="proseforge-")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the folder that every executor can reach.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local master
    may go without it; there a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _own_folder()
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")


#: Seconds that Spark's cleaner has after each round of garbage collection.
CLEANING_S = 0.3

#: Most rows of an Arrow batch with texts.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches have ``BATCH_ROWS`` rows at most; a setting below that stays.

    The default is made for narrow rows.  Ten thousand texts at a time, as Arrow, Python objects and results
    beside each other, cost each worker of an executor several hundred megabytes.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def cut_lineage(df, label: str, **options: str):
    """Write ``df`` to the shared folder and read it back; ``options`` are the writer's.

    Later stages then restart from files, so a lost executor does not replay
    the plan that led here.
    """
    path = work_dir(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Remove the shuffle files of frames that are out of use.

    Spark does so when the driver's garbage is collected, which can be half an hour later.  A frame
    that is still in use keeps its files.
    """
    # What holds a shuffle is let go after the first round only.
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(CLEANING_S)
