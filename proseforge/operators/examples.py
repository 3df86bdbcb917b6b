"""Training examples as fixed-length id arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.functions.arrays import IGNORE, cut, fit, last, mask
from proseforge.functions.draws import geometric_gap, randint, reached, uniform
from proseforge.operators.tokens import EOS, MASK, PAD, SPECIAL_TOKENS
from proseforge.session import small_batches


#: Fixed values: (share of rows, least length, largest length) of the kinds of sampled prefixes; the
#: last kind takes the other rows and reaches up to the longest prefix.
PREFIX_KINDS = ((0.60, 0, 0), (0.35, 3, 8), (None, 9, None))
LONGEST_PREFIX = 16


def prefix_length(n: Column, u_kind: Column, u_length: Column, longest: int = LONGEST_PREFIX, kinds=PREFIX_KINDS) -> Column:
    """Length of a prefix of ``n`` tokens that leaves one to continue.

    The kind follows from ``u_kind`` by the running sum of the shares.  Within a kind the length is
    uniform, after its bounds are cut to what the row can give; the last kind begins at one where the
    row cannot give its least length.
    """
    room = F.least(F.lit(longest), F.greatest(F.lit(1), n - 1))
    *early, (_, low, _) = kinds
    length = randint(u_length, F.when(room >= low, low).otherwise(1), room)
    for i, (_, low, high) in reversed(list(enumerate(early))):
        drawn = randint(u_length, F.least(F.lit(low), room), F.least(F.lit(high), room)) if high else F.lit(0)
        length = F.when(u_kind < sum(share for share, _, _ in early[: i + 1]), drawn).otherwise(length)
    return length


def sample_prefix(
    df: DataFrame, ids: str, seed: int, keys: Sequence[str], kinds=PREFIX_KINDS
) -> DataFrame:
    """Add ``k`` (prefix length), ``c`` (cut position) and ``prefix``.

    Sequences of fewer than two ids get an empty prefix and cut 0.
    """
    n = F.size(ids)
    key_cols = [F.col(k) for k in keys]
    length = prefix_length(n, uniform(seed, "kind", *key_cols), uniform(seed, "length", *key_cols), kinds=kinds)
    out = df.withColumn("k", F.when(n >= 2, length).otherwise(0))
    at = randint(uniform(seed, "cut", *key_cols), F.greatest(F.lit(1), F.col("k")), n - 1)
    out = out.withColumn("c", F.when(n >= 2, at).otherwise(0))
    return out.withColumn("prefix", cut(F.col(ids), F.col("c") - F.col("k"), F.col("k")))


def prefix_examples(
    df: DataFrame, ids: str, seed: int, keys: Sequence[str], seq_len: int = 256,
    kinds=PREFIX_KINDS,
) -> DataFrame:
    """Prefix plus masked continuation, labels only on the continuation.

    Sequences of fewer than two ids give no example.
    """
    drawn = sample_prefix(df.filter(F.size(ids) >= 2), ids, seed, keys, kinds)
    rest = cut(F.col(ids), F.col("c"), F.greatest(F.lit(1), seq_len - F.col("k")))
    drawn = drawn.withColumn("_rest", F.slice(rest, 1, F.greatest(seq_len - F.col("k"), F.lit(0))))
    filled = F.col("k") + F.size("_rest")
    return drawn.select(
        *keys,
        fit(F.concat("prefix", F.array_repeat(F.lit(MASK), F.size("_rest"))), seq_len, PAD).alias("input_ids"),
        fit(F.concat(F.array_repeat(F.lit(IGNORE), F.col("k")), "_rest"), seq_len, IGNORE).alias("labels"),
        mask(filled, seq_len).alias("attention_mask"),
    )


def random_mask(ids: Column, probability: Column | float, seed: int, keys: Sequence[Column], name: str = "mask") -> Column:
    """Each id becomes [MASK] with the given probability."""
    return F.transform(
        ids,
        lambda x, i: F.when(uniform(seed, name, *keys, i) < probability, F.lit(MASK)).otherwise(x),
    )


def mask_ramp(epoch: Column, epochs: int, final: float = 0.5, start: float = 0.15) -> Column:
    """Masking probability of an epoch, rising linearly to ``final``."""
    return F.least(F.lit(start) + F.lit(final - start) * (epoch / F.lit(max(1, epochs - 1))), F.lit(final))


def pack_distilled(prompt: Column, masked: Column, target: Column, length: int = 128) -> list[Column]:
    """Prompt and masked target in one sequence, labels only on the target."""
    full = F.concat(prompt, masked)
    labels = F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt)), target)
    return [
        fit(full, length, PAD).alias("input_ids"),
        mask(F.size(full), length).alias("attention_mask"),
        fit(labels, length, IGNORE).alias("labels"),
    ]


def mlm_draws(
    ids: Column, vocab_size: Column | int, seed: int, keys: Sequence[Column], probability: float = 0.15, control: int = 0
) -> Column:
    """(input, label) of every id of a masked-LM batch: of the chosen ids 80% masked, 10% random, 10% kept.

    Special ids, and the last ``control`` ids of the vocabulary, are never chosen; ids not chosen carry
    the ignore label.
    """
    size = F.lit(vocab_size) if isinstance(vocab_size, int) else vocab_size

    def drawn(x: Column, i: Column) -> Column:
        ordinary = (x >= len(SPECIAL_TOKENS)) & (x < size - control)
        chosen = (uniform(seed, "choose", *keys, i) < probability) & ordinary
        action = uniform(seed, "action", *keys, i)
        other = F.floor(uniform(seed, "token", *keys, i) * size).cast("int")
        changed = F.when(action < 0.8, F.lit(MASK)).when(action < 0.9, other).otherwise(x)
        both = lambda a, b: F.struct(a.alias("input"), b.alias("label"))
        return F.when(chosen, both(changed, x)).otherwise(both(x, F.lit(IGNORE)))

    return F.transform(ids, drawn)


def collate_mlm(
    ids: Column, vocab_size: Column | int, seed: int, keys: Sequence[Column], probability: float = 0.15, control: int = 0
) -> list[Column]:
    """``input_ids`` and ``labels`` of the masked-LM batch of ``mlm_draws``, each with draws of its own evaluation."""
    draws = mlm_draws(ids, vocab_size, seed, keys, probability, control)
    return [F.transform(draws, lambda x: x["input"]).alias("input_ids"), F.transform(draws, lambda x: x["label"]).alias("labels")]


def collate_mlm_rows(
    df: DataFrame, ids: str, vocab_size: Column | int, seed: int, keys: Sequence[str], probability: float = 0.15, control: int = 0
) -> DataFrame:
    """(keys, input_ids, labels): the same, every draw made once, beside the ids of its row."""
    prefix = F.concat(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), F.lit(":"))
    size = F.lit(vocab_size) if isinstance(vocab_size, int) else vocab_size
    rows = df.select(*keys, prefix.alias("_prefix"), size.cast("long").alias("_size"), F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("_ids")
            flat = codes.flatten().to_numpy(zero_copy_only=False)
            ends = codes.offsets.to_numpy() - codes.offsets[0].as_py()
            inputs, labels = flat.copy(), np.full(len(flat), IGNORE, np.int32)
            for start, end, row, size in zip(ends[:-1], ends[1:], batch.column("_prefix").to_pylist(), batch.column("_size").to_pylist()):
                _mask_row(flat[start:end], inputs[start:end], labels[start:end], row.encode(), size, probability, control)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()), mask=codes.is_null() if codes.null_count else None) for x in (inputs, labels)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *lists], names=[*keys, "input_ids", "labels"])

    small_batches(df.sparkSession)
    arrays = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("input_ids", "labels")]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(keys)], *arrays]))


def _mask_row(ids: np.ndarray, inputs: np.ndarray, labels: np.ndarray, prefix: bytes, size: int, probability: float, control: int) -> None:
    """The draws of ``mlm_draws`` for the ids of one row, written into ``inputs`` and ``labels``."""
    limits = [reached(p) for p in (probability, 0.8, 0.9)]
    value = lambda i, name: int.from_bytes(md5(b"%b%d:%b" % (prefix, i, name), usedforsecurity=False).digest()[:4], "big")
    for i in np.flatnonzero((ids >= len(SPECIAL_TOKENS)) & (ids < size - control)).tolist():
        if value(i, b"choose") < limits[0]:
            labels[i] = ids[i]
            action = value(i, b"action")
            if action < limits[1]:
                inputs[i] = MASK
            elif action < limits[2]:
                inputs[i] = math.floor(value(i, b"token") / 4294967296.0 * size)


def cap_document(ids: Column, prefix_len: int, target_len: int, slack: int = 64) -> Column:
    """At most as many ids as a prefix, a target and some slack need."""
    return F.slice(ids, 1, prefix_len + target_len + slack)


def encoder_decoder_examples(
    df: DataFrame, ids: str, seed: int, keys: Sequence[str],
    prefix_len: int = 16, target_len: int = 64, gap_mean: float | None = None,
    drop_prob: float = 0.1, kinds=PREFIX_KINDS, carry: Sequence[str] = (), pad: int | str = PAD,
) -> DataFrame:
    """Prefix for the encoder, continuation for the decoder, both with masks.

    The cut lies in [k, max(k + 1, n - 1) - 1], an optional geometric gap
    follows it, and ``keep_condition`` is 0 with probability ``drop_prob``.  ``pad`` has the type of the ids,
    which may be text; all arrays then are.
    """
    marks = ("1", "0") if isinstance(pad, str) else (1, 0)
    n = F.size(ids)
    key_cols = [F.col(c) for c in keys]
    draw = lambda name: uniform(seed, name, *key_cols)
    out = df.filter(n >= 2).withColumn("k", prefix_length(n, draw("kind"), draw("length"), prefix_len, kinds))
    out = out.withColumn(
        "c", randint(draw("cut"), F.col("k"), F.greatest(F.col("k") + 1, n - 1) - 1)
    )
    start = F.col("c")
    if gap_mean:
        gap = F.least(geometric_gap(draw("gap"), gap_mean), F.greatest(n - 1 - F.col("c"), F.lit(0)))
        start = F.col("c") + gap
    out = out.withColumn("start", F.least(start, n - 1))
    prefix = cut(F.col(ids), F.col("c") - F.col("k"), F.col("k"))
    target = cut(F.col(ids), F.col("start"), target_len)
    return out.select(
        *keys, *carry, "k", "c", "start",
        fit(prefix, prefix_len, pad).alias("encoder_input_ids"),
        mask(F.size(prefix), prefix_len, marks).alias("encoder_attention_mask"),
        fit(target, target_len, pad).alias("decoder_input_ids"),
        mask(F.size(target), target_len, marks).alias("decoder_attention_mask"),
        F.when(draw("drop") < drop_prob, 0).otherwise(1).alias("keep_condition"),
    )


def masked_canvas(prompt_ids: Column, length: int) -> Column:
    """The prompt followed by [MASK] up to ``length``; a longer prompt stays as it is."""
    return F.concat(prompt_ids, F.array_repeat(F.lit(MASK), F.greatest(length - F.size(prompt_ids), F.lit(0))))


def keep_context(prompt_ids: Column, context: int, new_tokens: int = 64) -> Column:
    """The last ids of a prompt that leave room for the new tokens."""
    return last(prompt_ids, max(8, context - new_tokens))


def seed_if_empty(prompt_ids: Column, seed_id: int = EOS) -> Column:
    return F.when(F.size(prompt_ids) == 0, F.array(F.lit(seed_id))).otherwise(prompt_ids)
