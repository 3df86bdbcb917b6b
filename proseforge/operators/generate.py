"""Batch generation: the work list, pluggable generators and the built-in sampler."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseforge.functions.draws import uniform
from proseforge.operators.candidates import softmax, top_k, top_p
from proseforge.operators.joins import pending
from proseforge.operators.ngram_lm import successors
from proseforge.operators.tokens import EOS, Lookup
from proseforge.session import cut_lineage

BROADCAST_CHOICES = 10_000_000
CUT_EVERY = 8  # sampling steps between two writes to the shared folder


def work_list(prompts: DataFrame, models: Sequence[str], done: DataFrame | None, iterations: int) -> DataFrame:
    """(prompt, model_type, iter) still to generate.

    ``done`` holds earlier sentences, one per row.  Models and iterations are
    parameters, so the product is an explode of literals; finished
    (prompt, model) pairs leave by an anti join.
    """
    pairs = prompts.select("prompt").distinct().withColumn(
        "model_type", F.explode(F.array(*[F.lit(m) for m in models]))
    )
    if done is not None:
        pairs = pending(pairs, done, ["prompt", "model_type"], iterations)
    return pairs.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))


def generate(
    tasks: DataFrame,
    generators: dict[str, Callable[[list[str]], list[str]]],
    batch: int = 64,
    partitions: int | None = None,
) -> DataFrame:
    """Run a generator per model over the work list, timing every call.

    A generator maps a list of prompts to as many texts.  The time of a call
    is shared evenly by its rows.  Generators must be picklable; state such as
    a loaded model belongs in the callable, created on first use.

    The list is small in bytes but costly per row, so it is spread over a
    stated number of tasks, by default all cores; adaptive coalescing would
    otherwise merge it into one.
    """
    partitions = partitions or tasks.sparkSession.sparkContext.defaultParallelism
    tasks = tasks.repartition(partitions, "prompt", "model_type", "iter")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for model, rows in part.groupby("model_type", sort=False):
                for at in range(0, len(rows), batch):
                    chunk = rows.iloc[at : at + batch]
                    began = time.perf_counter()
                    texts = generators[model](chunk["prompt"].tolist())
                    took = (time.perf_counter() - began) / len(chunk)
                    yield chunk.assign(sentence=texts, elapsed_s=took)

    return tasks.select("prompt", "model_type", "iter").mapInPandas(
        run, "prompt string, model_type string, iter int, sentence string, elapsed_s double"
    )


def to_records(sentences: DataFrame, per_record: int = 1000) -> DataFrame:
    """Generation records for export: the sentences of a prompt and model as arrays.

    The long form, a sentence per row, is what the engine stores and resumes from.  An array holds the
    iterations of one stretch of ``per_record``, so that it is bounded; every record of a prompt and
    model carries the mean time over all their sentences.
    """
    ordered = F.array_sort(F.collect_list(F.struct("iter", "sentence")))
    part = F.floor(F.col("iter") / per_record).alias("_part")
    parts = sentences.groupBy("prompt", "model_type", part).agg(
        F.transform(ordered, lambda x: x["sentence"]).alias("generated_sentences"),
        F.sum("elapsed_s").alias("_time"),
        F.count("elapsed_s").alias("_n"),
    )
    # One row per stretch is left, so the window is small.
    whole = Window.partitionBy("prompt", "model_type")
    mean = F.sum("_time").over(whole) / F.sum("_n").over(whole)
    return parts.withColumn("avg_inference_time", mean).drop("_part", "_time", "_n")


def next_token_table(bigrams: DataFrame, k: int = 50, p: float = 0.9, temperature: float = 1.0) -> DataFrame:
    """(ctx, open, free): cumulative choices per context, without and with the end token.

    At most V rows of at most ``k`` choices, plus ties, whatever the corpus.
    """

    order = Window.partitionBy("ctx").orderBy(F.desc("p"), "token_id")

    def choices(cand: DataFrame, name: str) -> DataFrame:
        kept = softmax(top_p(top_k(cand, ["ctx"], k), ["ctx"], p), ["ctx"])
        # Sums are rounded so that a draw falls on the same side everywhere.
        summed = kept.withColumn("cum", F.round(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)), 9))
        ranked = summed.withColumn("rank", F.row_number().over(order))
        return ranked.groupBy("ctx").agg(
            F.array_sort(F.collect_list(F.struct("rank", "cum", "token_id"))).alias(name)
        )

    cand = successors(bigrams).withColumn("logit", F.col("logit") / max(1e-6, temperature))
    return choices(cand.filter(F.col("token_id") != EOS), "open").join(choices(cand, "free"), "ctx", "full")


def sample_texts(
    prompts: DataFrame, keys: Sequence[str], last_id: str, table: DataFrame, seed: int,
    min_new: int = 32, max_new: int = 64,
) -> DataFrame:
    """(keys, new_ids): tokens sampled one after another from the bigram table.

    Every step looks up the current token.  The table has a row per vocabulary
    id, but ties at the cut-off can lengthen its rows; its entries are counted
    first, and only a small table is broadcast, so that sampling never
    shuffles.  Every few steps the state is written to the shared folder to
    keep the plan short and recovery cheap.
    """
    table = cut_lineage(table, "next-token")
    entries = F.sum(F.coalesce(F.size("open"), F.lit(0)) + F.coalesce(F.size("free"), F.lit(0)))
    if (table.agg(entries).first()[0] or 0) <= BROADCAST_CHOICES:
        table = F.broadcast(table)
    state = prompts.select(
        *keys, F.col(last_id).cast("int").alias("cur"),
        F.array().cast("array<int>").alias("new_ids"), F.lit(False).alias("over"),
    )
    key_cols: list[Column] = [F.col(k) for k in keys]
    for step in range(1, max_new + 1):
        options = F.col("open") if step <= min_new else F.col("free")
        u = uniform(seed, f"step{step}", *key_cols)
        state = (
            state.join(table.withColumnRenamed("ctx", "cur"), "cur", "left")
            .withColumn("_o", options)
            .withColumn("_u", u)
            .withColumn("_hit", F.get(F.filter("_o", lambda x: x["cum"] > F.col("_u")), F.lit(0))["token_id"])
            .withColumn("_t", F.coalesce("_hit", F.try_element_at("_o", F.lit(-1))["token_id"]))
            .withColumn("over", F.col("over") | F.col("_t").isNull() | (F.col("_t") == EOS))
            .withColumn("new_ids", F.when(F.col("over"), F.col("new_ids")).otherwise(F.array_append("new_ids", F.col("_t"))))
            .withColumn("cur", F.when(F.col("over"), F.col("cur")).otherwise(F.col("_t")))
            .select(*keys, "cur", "new_ids", "over")
        )
        if step % CUT_EVERY == 0 and step < max_new:
            state = cut_lineage(state, f"sample-{step}")
    return state.select(*keys, "new_ids")


def last_known_id(df: DataFrame, keys: Sequence[str], tokens_col: Column, vocab: DataFrame, unk: int) -> DataFrame:
    """(keys, last_id): id of each prompt's last token; an empty prompt starts at the end token."""
    words = df.select(*keys, F.try_element_at(tokens_col, F.lit(-1)).alias("_token"))
    coded = Lookup(vocab).ids(words, "_token", "_id", keys)
    return coded.select(
        *keys, F.when(F.col("_token").isNull(), EOS).otherwise(F.coalesce("_id", F.lit(unk))).alias("last_id")
    )
