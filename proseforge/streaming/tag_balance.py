"""Tag a stream of labelled texts and append class-balanced batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.functions.draws import uniform
from proseforge.operators.classify import tag
from proseforge.operators.numbering import even_bucket, key_bucket, number_rows

CLASSES = ["sentiment", "formality"]
COUNTERS = T.StructType([T.StructField(n, T.LongType()) for n in ("rows_read", "buffers", "carried", "batch")])


def buffer_rows(write_every: int, batch: int) -> int:
    """Rows in a full buffer: whole scoring batches up to ``write_every``."""
    return math.ceil(write_every / batch) * batch


def balance_buffers(
    tagged: DataFrame, order: Sequence[str], bucket: Column, seed: int,
    write_every: int = 10_000, batch: int = 64,
) -> DataFrame:
    """The batch form: balance each full buffer, keep the last partial one whole.

    Buffers are consecutive stretches of the row order, so every window here
    is bounded by the buffer size.
    """
    size = buffer_rows(write_every, batch)
    rows = number_rows(tagged, order, bucket).withColumn(
        "buffer", F.floor((F.col("row_no") - 1) / size).cast("long")
    )
    return _balanced_within(rows.drop("row_no"), size, order, seed)


def _balanced_within(rows: DataFrame, size: int, order: Sequence[str], seed: int) -> DataFrame:
    """Rows with a ``buffer`` number: full buffers balanced, others whole.  Windows hold one buffer."""
    in_class = Window.partitionBy("buffer", *CLASSES)
    draw = uniform(seed, "balance", *[F.col(k) for k in order])
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(in_class)).withColumn(
        "_rank", F.row_number().over(in_class.orderBy(draw, *order))
    )
    whole = Window.partitionBy("buffer")
    rows = rows.withColumn("_smallest", F.min("_n").over(whole)).withColumn(
        "_rows", F.count(F.lit(1)).over(whole)
    )
    tail = F.col("_rows") < size
    return rows.filter(tail | (F.col("_rank") <= F.col("_smallest"))).drop("_n", "_rank", "_smallest", "_rows")


def run_stream(
    stream: DataFrame,
    tagger: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    out: str,
    state: str,
    seed: int,
    write_every: int = 10_000,
    batch: int = 64,
) -> DataFrame:
    """Score a stream, balance it buffer by buffer, and append the result; return the counters.

    Rows fill buffers in the order of their micro-batches, and of ``keys`` within one.  Full buffers
    are balanced and written; what is left over is carried to the next micro-batch, and what is left
    at the end is written whole.  All that a micro-batch writes lies in folders named by its number and
    is overwritten when it is repeated, and it reads only what the one before it carried over; a
    restart therefore neither adds nor loses rows.  Counters are written beside and outlive the run.
    """
    size = buffer_rows(write_every, batch)
    spark = stream.sparkSession
    at = lambda what, number: f"{state}/{what}/batch={number}"
    # Rows that an earlier run wrote as its end are carried into this one.
    spark.range(0).write.mode("overwrite").json(f"{out}/batch=tail")
    # A stream without files has no micro-batch, and counts nothing.
    spark.range(0).write.mode("overwrite").json(f"{state}/counters/batch=-1")
    carried: dict[int, int] = {}

    def rows_before(number: int) -> int:
        """Rows that the micro-batch before carried over; after a restart they are looked up."""
        if number == 0:
            return 0
        if number - 1 not in carried:
            carried[number - 1] = spark.read.schema(COUNTERS).json(at("counters", number - 1)).first()["carried"]
        return carried[number - 1]

    def write(rows: DataFrame, number: int) -> None:
        # What is counted is counted while rows are written.
        seen = Observation()
        ends = [F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high")]
        tagged = tagger(rows)
        tagged.observe(seen, F.count(F.lit(1)).alias("rows"), *ends).write.mode("overwrite").parquet(at("tagged", number))
        new, held_over = int(seen.get["rows"]), rows_before(number)
        held = held_over + new
        numbered = _numbered(spark.read.schema(tagged.schema).parquet(at("tagged", number)), keys, seen.get)
        numbered = numbered.withColumn("_at", F.col("row_no") - 1 + held_over).drop("row_no")
        if held_over:
            numbered = _tail_of(spark, at("balanced", number - 1), numbered).unionByName(numbered)
        numbered = numbered.withColumn("buffer", F.floor(F.col("_at") / size).cast("long"))
        tail = F.col("buffer") >= held // size
        kept = _balanced_within(numbered, size, keys, seed)
        kept = kept.withColumn("_at", F.col("_at") - held // size * size).withColumn("_tail", tail.cast("int")).drop("buffer")
        kept.write.mode("overwrite").partitionBy("_tail").parquet(at("balanced", number))
        full = spark.read.schema(kept.schema).parquet(at("balanced", number)).filter("_tail = 0")
        full.drop("_tail", "_at").write.mode("overwrite").json(f"{out}/batch={number}")
        carried[number] = held % size
        counters = spark.range(1).select(*[F.lit(v).cast("long").alias(n) for n, v in (("rows_read", new), ("buffers", held // size), ("carried", held % size))])
        counters.write.mode("overwrite").json(at("counters", number))

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    done = spark.read.schema(COUNTERS).json(f"{state}/counters")
    none = F.lit(0).cast("long")
    totals = done.agg(
        F.coalesce(F.sum("rows_read"), none).alias("rows_read"), F.coalesce(F.sum("buffers"), none).alias("buffers"),
        F.count("rows_read").alias("batches"), F.max("batch").alias("_last"),
    )
    last = totals.first()["_last"]
    if last is not None:
        rows = spark.read.parquet(at("balanced", last))
        rows.filter("_tail = 1").drop("_tail", "_at").write.mode("overwrite").json(f"{out}/batch=tail")
    return totals.drop("_last")


def _numbered(tagged: DataFrame, keys: Sequence[str], seen: dict[str, object]) -> DataFrame:
    """Rows of a micro-batch with ``row_no`` in order of ``keys``, by ranges known from writing them if these are even."""
    bucket = None
    if len(keys) == 1 and isinstance(tagged.schema[keys[0]].dataType, T.IntegralType):
        bucket = even_bucket(keys[0], seen["low"], seen["high"], seen["rows"])
    if bucket is None:
        bucket = key_bucket(tagged, keys)
    return number_rows(tagged.withColumn("_order", F.struct(*keys)), ["_order"], bucket).drop("_order")


def _tail_of(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Rows carried over by an earlier micro-batch, with the columns of ``like``."""
    schema = T.StructType([*like.schema.fields, T.StructField("_tail", T.IntegerType())])
    return spark.read.schema(schema).parquet(path).filter("_tail = 1").select(*like.columns)


def naive_bayes_tagger(model: DataFrame, keys: Sequence[str], text: str, label: str) -> Callable[[DataFrame], DataFrame]:
    return lambda batch: tag(batch, keys, text, label, model)
