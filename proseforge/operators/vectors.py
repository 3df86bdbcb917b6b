"""Noise schedules and embedding-table operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proseforge.functions.draws import normal, uniform


def linear_schedule(spark: SparkSession, steps: int, start: float = 1e-4, end: float = 0.02) -> DataFrame:
    t = F.col("t")
    beta = F.lit(start) + F.lit(end - start) * t / F.lit(max(1, steps - 1))
    return _with_alphas(spark.range(steps).select(F.col("id").cast("int").alias("t")).withColumn("beta", beta))


def cosine_schedule(spark: SparkSession, steps: int, s: float = 0.008) -> DataFrame:
    def level(i: Column) -> Column:
        return F.pow(F.cos((i / steps + s) / (1 + s) * math.pi / 2), 2)

    t = F.col("t")
    beta = F.greatest(F.lit(1e-8), F.least(F.lit(0.999), 1 - level(t + 1) / level(t)))
    return _with_alphas(spark.range(steps).select(F.col("id").cast("int").alias("t")).withColumn("beta", beta))


def _with_alphas(betas: DataFrame) -> DataFrame:
    """Add alpha and its running product; a schedule has one row per step."""
    so_far = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = betas.withColumn("alpha", 1 - F.col("beta"))
    return out.withColumn("alpha_hat", F.exp(F.sum(F.log("alpha")).over(so_far)))


def random_step(seed: int, steps: int, keys: Sequence[Column]) -> Column:
    return F.floor(uniform(seed, "step", *keys) * steps).cast("int")


def add_noise(df: DataFrame, vec: str, schedule: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """Forward noising at step ``t``: sqrt(a) x + sqrt(1 - a) eps."""
    cols = [F.col(k) for k in keys]
    joined = df.join(schedule.select("t", "alpha_hat"), "t")
    a = F.col("alpha_hat")

    def noisy(x: Column, i: Column) -> Column:
        eps = normal(uniform(seed, "n1", *cols, i), uniform(seed, "n2", *cols, i))
        return F.sqrt(a) * x.cast("double") + F.sqrt(1 - a) * eps

    return joined.withColumn("noisy", F.transform(vec, noisy)).drop("alpha_hat")


def sanitise(vec: Column, limit: float = 10.0) -> Column:
    """Non-finite values to 0, the rest clamped to +-``limit``."""

    def fix(x: Column) -> Column:
        bad = F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(bad, F.lit(0.0)).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))

    return F.transform(vec, lambda x: fix(x.cast("double")))


def drop_condition(vec: Column, flag: Column) -> Column:
    """The vector times its 0/1 flag."""
    return F.transform(vec, lambda x: x * flag)


def align_vectors(target: DataFrame, source: DataFrame, vectors: DataFrame, dims: int, seed: int) -> DataFrame:
    """Initialise vectors of ``target`` (token, id) from tokens shared with ``source``.

    Tokens that ``source`` does not have get normal noise with the standard
    deviation of all source values.  ``vectors`` is (id, vec) of the source.
    """
    known = source.join(vectors, "id").select("token", F.col("vec").alias("_vec"))
    values = F.transform("vec", lambda x: x.cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    sums = vectors.agg(
        F.sum(F.size("vec")).alias("n"),
        F.sum(total(values)).alias("s"),
        F.sum(total(F.transform(values, lambda x: x * x))).alias("q"),
    )
    std = sums.select(F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))
    row = F.col("id")
    noise = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: F.col("_std") * normal(uniform(seed, "n1", row, i), uniform(seed, "n2", row, i)),
    )
    return (
        target.join(known, "token", "left")
        .withColumn("_std", std.scalar())
        .select(
            "token", "id",
            F.coalesce(F.col("_vec").cast("array<double>"), noise).alias("vec"),
            F.col("_vec").isNotNull().alias("copied"),
        )
    )
