"""Tables in numbered versions with a log of commits, so that readers see one whole version.

A version is written to a folder of its own, and only then is a line put into the log.  Spark commits a
file of the log in one step, so a reader finds the line or does not; what a reader has opened is never
overwritten.  A writer that is lost leaves a folder that no line names.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "version long, folder string, note string"


def history(spark: SparkSession, path: str) -> DataFrame:
    """(version, folder, note) of all commits; none where nothing was committed."""
    try:
        return spark.read.schema(LOG).json(os.path.join(path, "_log"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def current(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, str] | None:
    """(version, folder) of the last commit, or of the last one of a given number; None if there is none.

    Writers that commit the same number at once are told apart by their folders, alike for every reader.
    """
    log = history(spark, path)
    if version is not None:
        log = log.filter(F.col("version") == version)
    last = log.agg(F.max(F.struct("version", "folder")).alias("last")).first()["last"]
    return None if last is None else (last["version"], last["folder"])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last committed version, or a given one; later commits do not change what is returned."""
    found = current(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"nothing was committed to {path}" + (f" as version {version}" if version is not None else ""))
    return spark.read.parquet(os.path.join(path, found[1]))


def write(df: DataFrame, path: str, note: str = "") -> DataFrame:
    """Write ``df`` as the next version, commit it and read it back; ``df`` may come from an earlier version."""
    spark = df.sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(os.path.join(path, folder))
    before = current(spark, path)
    number = 1 if before is None else before[0] + 1
    line = spark.createDataFrame([(number, folder, note)], LOG)
    line.coalesce(1).write.mode("append").json(os.path.join(path, "_log"))
    return spark.read.schema(df.schema).parquet(os.path.join(path, folder))
