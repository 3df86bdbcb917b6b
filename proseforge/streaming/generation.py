"""Batch generation whose finished prompts and models are committed as it goes."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseforge.operators.generate import generate
from proseforge.operators.joins import pending
from proseforge.sources import versions

KEYS = ["prompt", "model_type"]
MOST_BATCHES = 100  # a list of any length is done in so many


def fix_work(prompts: DataFrame, models: list[str], iterations: int, state: str, done: DataFrame | None, keys_per_batch: int) -> str:
    """The folder with the (prompt, model_type) pairs to do, written once per ``state``; a file is a batch of them.

    ``done`` holds sentences of earlier runs, one per row; pairs with enough of them are left out.  A batch has about
    ``keys_per_batch`` pairs, in a long list a hundredth of it, so that the cost of committing does not grow with the list.
    """
    spark, path = prompts.sparkSession, os.path.join(state, "work")
    found = versions.current(spark, path)
    if found is None:
        pairs = prompts.select("prompt").distinct().withColumn("model_type", F.explode(F.array(*[F.lit(m) for m in models])))
        if done is not None:
            pairs = pending(pairs, done, KEYS, iterations)
        files = min(MOST_BATCHES, -(-max(1, pairs.count()) // keys_per_batch))
        versions.write(pairs.repartition(files, *KEYS), path)
        found = versions.current(spark, path)
    return os.path.join(path, found[1])


def generate_in_batches(
    prompts: DataFrame,
    generators: dict[str, Callable[[list[str]], list[str]]],
    iterations: int,
    out: str,
    state: str,
    done: DataFrame | None = None,
    keys_per_batch: int = 10_000,
    batch: int = 64,
) -> DataFrame:
    """Generated sentences (prompt, model_type, iter, sentence, elapsed_s), one batch of pairs after another.

    The work list is a stream of files.  A micro-batch generates all iterations of its pairs, writes them
    under its own number and is then committed in the checkpoint.  A generator that fails ends the run; the next
    run with the same ``out`` and ``state`` repeats that batch only, over what it may have left, so
    no pair is done twice or lost.  Pairs are taken from ``prompts`` and ``done`` in the first run.
    """
    spark = prompts.sparkSession
    work = fix_work(prompts, list(generators), iterations, state, done, keys_per_batch)

    def write(pairs: DataFrame, number: int) -> None:
        tasks = pairs.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
        generate(tasks, generators, batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        spark.readStream.schema("prompt string, model_type string").option("maxFilesPerTrigger", 1).parquet(work)
        .writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sentences(spark, out)


def sentences(spark: SparkSession, out: str) -> DataFrame:
    """What all batches have written so far."""
    schema = "prompt string, model_type string, iter int, sentence string, elapsed_s double"
    return spark.read.schema(schema + ", batch int").parquet(out).drop("batch")
