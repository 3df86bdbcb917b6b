"""A bigram language model over a capped vocabulary.

It stands in for the reference model of the perplexity report and feeds the
built-in sampler.  Tokens outside the vocabulary are [UNK], so there are at
most V contexts of at most V successors each, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.functions.text import tokens
from proseforge.operators.joins import lookup
from proseforge.operators.tokens import UNK, Lookup, held_ids, token_ids
from proseforge.session import cut_lineage, small_batches

HELD_PAIRS = 2_000_000  # pairs, and different ones, that a task counts before it passes them on
HELD_MODEL = 2_000_000  # pairs of a model that every Python worker holds


def token_pairs(tokens_col: Column) -> Column:
    """Adjacent token pairs of a row, as structs (left, right)."""
    n = F.greatest(F.size(tokens_col) - 1, F.lit(0))
    zipped = F.arrays_zip(
        F.slice(tokens_col, 1, n).alias("left"), F.slice(tokens_col, 2, n).alias("right")
    )
    return zipped


def _to_ids(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Replace the token columns ``left`` and ``right`` by ids ``ctx`` and ``token_id``."""
    words, keys = Lookup(vocab), [c for c in pairs.columns if c not in ("left", "right", "n")] or ["left", "right"]
    coded = words.ids(words.ids(pairs, "left", "ctx", keys), "right", "token_id", keys)
    return (
        coded.withColumn("ctx", F.coalesce("ctx", F.lit(UNK)))
        .withColumn("token_id", F.coalesce("token_id", F.lit(UNK)))
        .drop("left", "right")
    )


def count_bigrams(df: DataFrame, text: str, vocab: DataFrame, end: str | None = None) -> DataFrame:
    """(ctx, token_id, n).  Pairs are counted by ids where the texts are read, and a row per pair leaves the task.

    If the vocabulary is too large for that, pairs are counted by ids or, beyond what is broadcast, by tokens before they
    are looked up.  ``end`` adds an end token behind every text.
    """
    held = held_ids(vocab)
    if held is not None:
        small_batches(df.sparkSession)
        counted = df.select(text).mapInArrow(_pair_counter(held, end), "ctx int, token_id int, n long")
        return counted.groupBy("ctx", "token_id").agg(F.sum("n").alias("n"))
    words = tokens(F.col(text))
    if end is not None:
        words = F.concat(words, F.array(F.lit(end)))
    pairs = df.select(words.alias("_t")).select(F.inline(token_pairs(F.col("_t"))))
    if Lookup(vocab).rest is None:
        return _to_ids(pairs, vocab).groupBy("ctx", "token_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))
    return _to_ids(pairs, vocab).groupBy("ctx", "token_id").agg(F.sum("n").alias("n"))


def _pair_counter(held, end: str | None):
    """A step from batches of texts to (ctx, token_id, n) of their adjacent tokens; a pair is one 64-bit number meanwhile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, fresh, waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        for batch in batches:
            ids, ends = token_ids(batch.column(0), held.value, end=end)
            inside = np.ones(max(len(ids) - 1, 0), bool)
            borders = ends[1:-1]
            inside[borders[(borders > 0) & (borders < len(ids))] - 1] = False
            wide = ids.astype(np.int64)
            fresh.append(((wide[:-1] << 32) | wide[1:])[inside])
            waiting += len(fresh[-1])
            if waiting >= HELD_PAIRS:
                codes, counts = _merged(codes, counts, fresh)
                fresh, waiting = [], 0
                if len(codes) >= HELD_PAIRS:
                    yield _pair_rows(codes, counts)
                    codes, counts = codes[:0], counts[:0]
        codes, counts = _merged(codes, counts, fresh)
        if len(codes):
            yield _pair_rows(codes, counts)

    return run


def _merged(codes: np.ndarray, counts: np.ndarray, fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers and how often they occur, those of ``fresh`` added."""
    new, n = np.unique(np.concatenate([codes[:0], *fresh]), return_counts=True)
    both, weights = np.concatenate([codes, new]), np.concatenate([counts, n])
    order = np.argsort(both, kind="stable")
    both, weights = both[order], weights[order]
    first = np.flatnonzero(np.r_[[True] * min(1, len(both)), both[1:] != both[:-1]])
    return both[first], np.add.reduceat(weights, first) if len(first) else weights


def _pair_rows(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    ids = [(codes >> 32).astype(np.int32), (codes & 0xFFFFFFFF).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(ids[0]), pa.array(ids[1]), pa.array(counts)], names=["ctx", "token_id", "n"])


def context_totals(bigrams: DataFrame) -> DataFrame:
    return bigrams.groupBy("ctx").agg(F.sum("n").alias("ctx_n"))


def id_pairs(df: DataFrame, keys: Sequence[str], text: str, vocab: DataFrame) -> DataFrame:
    """(keys, pos, ctx, token_id): adjacent id pairs of every text."""
    pairs = df.select(*keys, tokens(F.col(text)).alias("_t")).select(
        *keys, F.posexplode(token_pairs(F.col("_t"))).alias("pos", "_p")
    )
    return _to_ids(pairs.select(*keys, "pos", "_p.*"), vocab)


def sentence_perplexity(
    df: DataFrame, keys: Sequence[str], text: str, bigrams: DataFrame, vocab: DataFrame, k: float = 0.1
) -> DataFrame:
    """(keys, perplexity): exp of the mean negative log probability.

    The first token has no context and is not scored, so texts of fewer than
    two tokens have no value and are dropped, like blank ones.

    Pairs that are frequent in the model are scored where the texts are read, and a text leaves the task as
    one row; only other pairs travel to the rest of the model.
    """
    keys = list(keys)
    held = held_ids(vocab)
    if held is None:
        parts = _losses_by_joins(df, keys, text, bigrams, vocab, k)
    else:
        codes = bigrams.select(_code(), "ctx", "n")
        fewest, whole = _held_count(codes)
        model = _Model(codes.filter(F.col("n") >= fewest), context_totals(bigrams), vocab.count(), k, whole)
        rows = df.select(*keys, F.col(text).alias("_text"))
        step = _scorer(held, df.sparkSession.sparkContext.broadcast(model))
        small_batches(df.sparkSession)
        schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(_SCORED).fields])
        parts = rows.mapInArrow(step, schema)
        if not whole:
            # What is left to look up is counted and joined.
            parts = cut_lineage(parts, "scored-pairs")
            rest = codes.filter(F.col("n") < fewest).select("_code", "n")
            asked = lookup(parts.filter("_code is not null"), rest, ["_code"], ["n"], keys)
            loss = -F.log((F.coalesce("n", F.lit(0)) + F.lit(k)) / F.col("_below")) * F.col("_n")
            parts = parts.filter("_code is null").select(*keys, "_loss", "_n").unionByName(asked.select(*keys, loss.alias("_loss"), "_n"))
    out = parts.groupBy(*keys).agg(F.exp(F.sum("_loss") / F.sum("_n")).alias("perplexity"))
    return out.filter(~F.isnan("perplexity") & (F.col("perplexity") < float("inf")))


def _losses_by_joins(df: DataFrame, keys: Sequence[str], text: str, bigrams: DataFrame, vocab: DataFrame, k: float) -> DataFrame:
    """(keys, _loss, _n): a row per pair, for a vocabulary that workers cannot hold."""
    coded = id_pairs(df, keys, text, vocab)
    scored = lookup(coded, bigrams, ["ctx", "token_id"], ["n"], [*keys, "pos"])
    size = vocab.agg(F.count(F.lit(1)))
    p = (F.coalesce("n", F.lit(0)) + F.lit(k)) / (
        F.coalesce("ctx_n", F.lit(0)) + F.lit(k) * size.scalar()
    )
    return scored.join(context_totals(bigrams), "ctx", "left").select(*keys, (-F.log(p)).alias("_loss"), F.lit(1).cast("long").alias("_n"))


_SCORED = "_code long, _below double, _loss double, _n long"


def _code() -> Column:
    """A pair of ids as one number, as in ``_pair_counter``."""
    return F.shiftleft(F.col("ctx").cast("long"), 32).bitwiseOR(F.col("token_id").cast("long")).alias("_code")


def _held_count(pairs: DataFrame) -> tuple[int, bool]:
    """The smallest count from which on at most ``HELD_MODEL`` pairs have it, and whether all have it."""
    from_top = Window.orderBy(F.desc("n"))  # one row per distinct count
    counts = pairs.groupBy("n").agg(F.count(F.lit(1)).alias("_m")).withColumn("_reach", F.sum("_m").over(from_top))
    found = counts.agg(F.min(F.when(F.col("_reach") <= HELD_MODEL, F.col("n"))).alias("fewest"), F.min("n").alias("lowest"), F.max("n").alias("top")).first()
    fewest = found.fewest if found.fewest is not None else (found.top or 0) + 1
    return fewest, found.lowest is None or fewest <= found.lowest


class _Model:
    """The frequent pairs of a model and the totals of all contexts, as sorted arrays that a worker holds."""

    def __init__(self, pairs: DataFrame, totals: DataFrame, size: int, k: float, whole: bool):
        self.k, self.whole, self.unseen = k, whole, k * size
        self.contexts, self.totals = _sorted_arrays(totals.select("ctx", "ctx_n").toArrow())
        self.codes, self.counts = _sorted_arrays(pairs.select("_code", "n").toArrow())

    def losses(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, loss, below): whether a pair's count is known, its loss then, and what its count is divided by."""
        _, n_ctx = _looked_up(self.contexts, self.totals, codes >> 32)
        found, n = _looked_up(self.codes, self.counts, codes)
        below = n_ctx + self.unseen
        return (np.ones(len(codes), bool) if self.whole else found), -np.log((n + self.k) / below), below


def _sorted_arrays(pairs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, values = (pairs.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each number is among sorted ``keys``, and its value, 0 without one."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return found, np.where(found, values[at], 0)


def _scorer(held, model):
    """A step from (keys, text) to ``_SCORED`` rows: one with the known losses of a text, and one for each pair left to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = token_ids(batch.column(batch.num_columns - 1), held.value)
            lengths = np.diff(ends)
            row = np.repeat(np.arange(len(lengths)), lengths)
            inside = row[1:] == row[:-1]
            wide = ids.astype(np.int64)
            codes, row = ((wide[:-1] << 32) | wide[1:])[inside], row[1:][inside]
            found, loss, below = model.value.losses(codes)
            scored = np.unique(row[found])
            sums = np.bincount(row[found], loss[found], len(lengths))[scored]
            sizes = np.bincount(row[found], minlength=len(lengths))[scored]
            # A pair that a text repeats travels once.
            left, first, times = np.unique(np.stack([row[~found], codes[~found]]), axis=1, return_index=True, return_counts=True)
            take = pa.array(np.r_[scored, left[0]].astype(np.int64))
            known = np.r_[np.ones(len(scored), bool), np.zeros(left.shape[1], bool)]
            blank = np.zeros(len(scored))
            columns = [
                pa.array(np.r_[np.zeros(len(scored), np.int64), left[1]], mask=known), pa.array(np.r_[blank, below[~found][first]], mask=known),
                pa.array(np.r_[sums, np.zeros(left.shape[1])], mask=~known), pa.array(np.r_[sizes, times].astype(np.int64)),
            ]
            rows = [c.take(take) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*rows, *columns], names=[*batch.schema.names[:-1], "_code", "_below", "_loss", "_n"])

    return run


def successors(bigrams: DataFrame) -> DataFrame:
    """(ctx, token_id, logit): the candidate table of the model."""
    return bigrams.select("ctx", "token_id", F.log(F.col("n").cast("double")).alias("logit"))

