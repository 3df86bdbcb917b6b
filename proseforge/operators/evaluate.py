"""Evaluation tables over generated sentences.

Sentences are rows (group columns, order column, text).  No operator gathers
a group in one task: n-grams are keyed by themselves, and order inside a
group is resolved over bounded stretches.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from proseforge.functions.prompts import parse_formality, parse_sentiment
from proseforge.functions.text import fixed_decimals, tokens
from proseforge.operators.joins import first_match
from proseforge.operators.numbering import number_rows
from proseforge.session import cut_lineage, drop_shuffles, small_batches


SALTS = 32
HELD_TOKENS = 1_000_000  # tokens of sentences that are compared at once
HELD_ROWS = 2_000_000  # n-grams that a task is to count
PASS_ROWS = 32_000_000  # n-grams of a pass, if sentences have no more tokens
SHARES = 2  # passes over a size that has more
SECOND = 11  # sets the second code of a token apart from the first

CODE = np.dtype([("a", "<u8"), ("b", "<u2")])
STEP = np.uint64(0x9E3779B97F4A7C15)


def coded_sentences(df: DataFrame, by: Sequence[str], order: str, text: str) -> DataFrame:
    """(by, order, _name, _len, _codes): tokens of each sentence, as their number and as bytes with 80 bits for each; written once.

    Texts are read and cut here only.  An n-gram is named by a pair made of the codes of its tokens; the second
    number tells apart n-grams that share the first, so no text of an n-gram is moved.
    """
    second = lambda t: F.shiftright(F.xxhash64(F.lit(SECOND), t), 48).cast("short")
    codes = F.transform(
        F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")),
        lambda t: F.struct(F.xxhash64(t).alias("a"), second(t).alias("b")),
    )
    df = df.select(*by, order, F.monotonically_increasing_id().alias("_name"), codes.alias("_codes"))
    kept = [f for f in df.schema if f.name != "_codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, flat = batch.column("_codes"), batch.column("_codes").flatten()
            ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            both = np.empty(len(flat), CODE)
            for name in CODE.names:
                both[name] = flat.field(name).to_numpy(zero_copy_only=False).view(CODE[name])
            buffers = [None, pa.py_buffer(ends * CODE.itemsize), pa.py_buffer(both.tobytes())]
            codes = pa.Array.from_buffers(pa.large_binary(), len(lists), buffers).cast(pa.binary())
            rest = [batch.column(f.name) for f in kept]
            lengths = pa.array(np.diff(ends), pa.int32())
            yield pa.RecordBatch.from_arrays([*rest, lengths, codes], names=[*[f.name for f in kept], "_len", "_codes"])

    small_batches(df.sparkSession)
    schema = StructType([*kept, StructField("_len", IntegerType()), StructField("_codes", BinaryType())])
    # The same words come again and again.
    return cut_lineage(df.mapInArrow(run, schema), "coded-sentences", compression="zstd")


def _held_parts(rows: int) -> int:
    """In how many parts n-grams are counted, so that each can be counted in memory."""
    return max(1, min(400, -(-rows // HELD_ROWS)), -(-rows // (2 * HELD_ROWS)))


def _passes(sizes: Sequence[int], total: int) -> list[list[tuple[int, int, int]]]:
    """The (size, share, number of shares) of n-grams that are counted together, where sentences have ``total`` tokens."""
    shares = SHARES if total > PASS_ROWS else 1
    units = [(n, k, shares) for n in sizes for k in range(shares)]
    most = max(1, PASS_ROWS * shares // max(1, total))
    return [units[i : i + most] for i in range(0, len(units), most)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all 64-bit numbers, one to one, 0 to 0 (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd factors of the tokens of an n-gram, by their place; the first is that of the group and the size.
FACTORS = _mixed(np.arange(1, 66, dtype=np.uint64) * STEP) | np.uint64(1)


class _Stretch(NamedTuple):
    """Sentences that are compared at once, and the codes of their tokens, one after another."""

    names: np.ndarray
    groups: np.ndarray
    only: np.ndarray  # the size they are for, or 0
    lengths: np.ndarray
    codes: np.ndarray


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[_Stretch]:
    """A stretch holds a bounded number of tokens, or one sentence."""
    whole = lambda held: _Stretch(*[np.concatenate(x) for x in zip(*held)])
    held, room = [], HELD_TOKENS
    for batch in batches:
        names, groups, only = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_name", "_group", "_only"))
        column = batch.column("_t").cast(pa.large_binary())
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        codes = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].view(CODE)
        ends = (at - at[0]) // CODE.itemsize
        begin = 0
        while begin < len(names):
            end = int(np.searchsorted(ends, ends[begin] + room, "right")) - 1
            end = max(end, begin if held else begin + 1)
            if end > begin:
                some = slice(begin, end)
                held.append((names[some], groups[some], only[some], np.diff(ends[begin : end + 1]), codes[ends[begin] : ends[end]]))
                room -= int(ends[end] - ends[begin])
            if end < len(names):
                yield whole(held)
                held, room = [], HELD_TOKENS
            begin = end
    if held:
        yield whole(held)


def _sorted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs by the first number, equal pairs together as they came; and whether each equals the one before.

    Numbers are sorted with their places in the lowest bits, which is several times as fast as sorting places.
    """
    bits = np.uint64(max(1, (len(x) - 1).bit_length()))
    places = np.arange(len(x), dtype=np.uint64)
    keys = np.sort(x >> bits << bits | places)
    order = (keys & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    near, equal = np.zeros(len(x), bool), np.zeros(len(x), bool)
    near[1:] = keys[1:] >> bits == keys[:-1] >> bits
    later = np.flatnonzero(near)
    one, other = order[later], order[later - 1]
    equal[later] = (x[one] == x[other]) & (y[one] == y[other])
    if len(later) and not equal[later].all():
        # Different numbers share the highest bits.
        run = np.cumsum(~near)
        some = np.flatnonzero(np.isin(run, run[later[~equal[later]]]))
        order[some] = order[some][np.lexsort((order[some], y[order[some]], x[order[some]], run[some]))]
        one, other = order[later], order[later - 1]
        equal[later] = (x[one] == x[other]) & (y[one] == y[other])
    return order, equal


def _held_within(stretch: _Stretch, unit: tuple[int, int, int], every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of a stretch, in order of their first numbers: both numbers, and the place of the sentence that holds it, or -1.

    With ``every``, an n-gram comes once for each r for which some sentence has an r-th occurrence, numbered
    with r; it has no place if several sentences have one.  Otherwise it comes once, with the first sentence.
    """
    n, share, shares = unit
    lengths = np.where((stretch.only == 0) | (stretch.only == n), stretch.lengths, 0)
    sentence = np.repeat(np.arange(len(lengths), dtype=np.int32), stretch.lengths)
    # Places too close to the end of their sentence begin no n-gram.
    left = np.repeat(np.cumsum(stretch.lengths) - stretch.lengths + lengths, stretch.lengths) - np.arange(len(sentence))
    at = np.flatnonzero(left >= n)
    group = _mixed(stretch.groups.view(np.uint64) * FACTORS[0] + np.uint64(n))
    a, b = np.ascontiguousarray(stretch.codes["a"]), stretch.codes["b"].astype(np.uint32)
    x, y = a * FACTORS[1], b * np.uint32(FACTORS[1] >> np.uint64(32) | np.uint64(1))
    for k in range(1, n):
        f = FACTORS[1 + k % 64] + np.uint64(k // 64 * 2)
        x[: len(x) - k] += a[k:] * f
        y[: len(y) - k] += b[k:] * np.uint32(f >> np.uint64(32) | np.uint64(1))
    x = x[at] + group[sentence[at]]
    if shares > 1:
        mine = np.flatnonzero(x % np.uint64(shares) == share)
        x, at = x[mine], at[mine]
    who = sentence[at]
    y = ((y[at] + (group >> np.uint64(32)).astype(np.uint32)[who]) >> np.uint32(16)).astype(np.uint16)
    order, equal = _sorted(x, y)
    x, y, who = x[order], y[order], who[order]
    first = np.flatnonzero(~equal)
    if not every or len(first) == len(x):
        return x[first], y[first], who[first]
    # Where an n-gram comes several times, its r-th occurrences, from 0, in each sentence.
    many = equal | np.r_[equal[1:], False]
    some = np.flatnonzero(many)
    again, gram = equal[some], np.cumsum(~equal[some])
    again[1:] &= who[some][1:] == who[some][:-1]
    new = np.flatnonzero(~again)
    r = np.arange(len(some)) - np.repeat(new, np.diff(np.r_[new, len(some)]))
    places = who[first]
    several = np.bincount(gram[new])[1:] > 1
    places[np.flatnonzero(many[first])[several]] = -1
    # Later occurrences are few: equal (n-gram, r) meet, and one stays.
    later = np.flatnonzero(r)
    pair = gram[later] << 32 | r[later]
    rank = np.argsort(pair)
    pair, later = pair[rank], later[rank]
    begin = np.flatnonzero(np.r_[[True] * min(1, len(pair)), pair[1:] != pair[:-1]])
    times = np.diff(np.r_[begin, len(pair)])
    r, later = r[later[begin]], some[later[begin]]
    x2, y2 = x[later] + _mixed(r.astype(np.uint64) * STEP), y[later] ^ r.astype(np.uint16)
    who2 = np.where(times > 1, np.int32(-1), who[later])
    rank = np.argsort(x2)
    x, y, x2, y2, who2 = x[first], y[first], x2[rank], y2[rank], who2[rank]
    to = np.searchsorted(x, x2)
    return np.insert(x, to, x2), np.insert(y, to, y2), np.insert(places, to, who2)


def _held(words: DataFrame, by: Sequence[str], n: int, every: bool = True) -> DataFrame:
    """(_a, _b, _holder): what ``_held_within`` finds in each stretch of sentences, with the holder's name or null.

    As rows, which ``_counts`` sends packed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in _stretches(batches):
            x, y, who = _held_within(stretch, (n, 0, 1), every)
            holder = pa.array(stretch.names[who], pa.int64(), mask=who < 0)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int16)), holder], names=["_a", "_b", "_holder"])

    return _grouped(words, by).mapInArrow(run, "_a long, _b short, _holder long")


def _grouped(words: DataFrame, by: Sequence[str]) -> DataFrame:
    """(_name, _group, _only, _t): sentences as ``_stretches`` takes them."""
    small_batches(words.sparkSession)
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")
    only = F.col("_only") if "_only" in words.columns else F.lit(0)
    return words.select("_name", group.alias("_group"), only.cast("int").alias("_only"), "_t")


def _packed(x: np.ndarray, y: np.ndarray, who: np.ndarray, low: int) -> bytes:
    """N-grams in order, from ``low``: first numbers as steps, in as many bytes as the longest needs; 2 bytes of the second; the places."""
    steps = np.diff(x, prepend=np.uint64(low))
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return b"".join((
        struct.pack("<IBB", len(x), width, who.itemsize), steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), y.tobytes(), who.tobytes()
    ))


def _unpacked(data: bytes, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, width, size = struct.unpack_from("<IBB", data)
    steps = np.zeros((m, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, m * width, 6).reshape(m, width)
    x = np.cumsum(steps.view(np.uint64).ravel()) + np.uint64(low)
    y = np.frombuffer(data, np.uint16, m, 6 + m * width)
    return x, y, np.frombuffer(data, f"<u{size}", m, 6 + m * (width + 2))


def _low(part: int, parts: int) -> int:
    """The least 64-bit number of a part."""
    return -(-(part << 64) // parts)


def _rows(schema: Sequence[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows), schema)], names=[c for c, _ in schema])


SLICES = [("_part", pa.int32()), ("_stretch", pa.int64()), ("_n", pa.int32()), ("_data", pa.binary())]
NAMES = 0  # as ``_n``: the names of the sentences of a stretch


def _slices(words: DataFrame, by: Sequence[str], units: list[tuple[int, int, int]], parts: int, every: bool) -> DataFrame:
    """(_part, _stretch, _n, _data): for each stretch, its n-grams in each range of numbers, packed; and the names of its sentences."""
    bounds = np.array([_low(p, parts) for p in range(1, parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, stretch in enumerate(_stretches(batches), task):
            kind = np.dtype("<u2") if len(stretch.names) < 2**16 else np.dtype("<u4")
            yield _rows(SLICES, [(number % parts, number, NAMES, stretch.names.tobytes())])
            for unit in units:
                x, y, who = _held_within(stretch, unit, every)
                who = who.astype(kind)
                ends = [0, *np.searchsorted(x, bounds).tolist(), len(x)]
                found = [
                    (p, number, unit[0], _packed(x[i:j], y[i:j], who[i:j], _low(p, parts)))
                    for p, (i, j) in enumerate(zip(ends, ends[1:])) if j > i
                ]
                if found:
                    yield _rows(SLICES, found)

    return _grouped(words, by).mapInArrow(run, "_part int, _stretch long, _n int, _data binary")


def _counted_slices(parts: int, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From all slices of some parts: (_stretch, _n, _data) with the places that an n-gram counts for; names pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, seen = [], [], set()
        for batch in batches:
            for p, stretch, n, data in zip(*[batch.column(c).to_pylist() for c, _ in SLICES]):
                if n == NAMES:
                    yield _rows(SLICES[1:], [(stretch, n, data)])
                else:
                    keys.append((stretch, n))
                    found.append(_unpacked(data, _low(p, parts)))
                    seen.add(p)
        if not found:
            return
        x, y = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        places = [f[2] for f in found]
        del found
        # Numbers of a part have few values, so that after a shift more bits tell them apart.
        low = _low(min(seen), parts)
        spare = 64 - (_low(max(seen) + 1, parts) - low - 1).bit_length()
        order, equal = _sorted((x - np.uint64(low)) << np.uint64(spare), y)
        alone = ~equal
        if every:
            alone[:-1] &= ~equal[1:]
        counts = np.zeros(len(x), bool)
        counts[order[alone]] = True
        out, begin = [], 0
        for (stretch, n), who in zip(keys, places):
            mine = who[counts[begin : begin + len(who)]]
            begin += len(who)
            mine = np.sort(mine[mine != np.iinfo(who.dtype).max])
            if len(mine):
                # Steps from one place to the next are small.
                data = struct.pack("<IB", len(mine), mine.itemsize) + pa.compress(np.diff(mine, prepend=mine.dtype.type(0)).tobytes(), "zstd", asbytes=True)
                out.append((stretch, n, data))
            if len(out) >= 1_000:
                yield _rows(SLICES[1:], out)
                out = []
        if out:
            yield _rows(SLICES[1:], out)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all places of some stretches: (_name, _n, _count) of their sentences."""
    names, counts = {}, {}
    for batch in batches:
        for stretch, n, data in zip(*[batch.column(c).to_pylist() for c, _ in SLICES[1:]]):
            if n == NAMES:
                names[stretch] = np.frombuffer(data, np.int64)
                continue
            m, size = struct.unpack_from("<IB", data)
            steps = np.frombuffer(pa.decompress(data[5:], m * size, "zstd"), f"<u{size}")
            found = np.bincount(np.cumsum(steps, dtype=np.int64))
            old = counts.get((stretch, n), found[:0])
            long, short = (found, old) if len(found) > len(old) else (old, found)
            long[: len(short)] += short
            counts[stretch, n] = long
    for (stretch, n), found in counts.items():
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[stretch][some]), pa.array(np.full(len(some), n, np.int32)), pa.array(found[some])], names=["_name", "_n", "_count"]
        )


def _counts(words: DataFrame, by: Sequence[str], sizes: Sequence[int], total: int, every: bool) -> DataFrame:
    """(_name, _n, _count): how many n-grams count for a sentence; all have ``total`` tokens.

    With ``every`` these are the (n-gram, r) that no other sentence of the group holds; otherwise each distinct
    n-gram of a group counts for one of its sentences.  A task finds n-grams of sentences that it reads together, and sends
    them in slices: a slice has those with numbers in a range, of 80 bits and the place of a sentence each, and
    all slices of a range meet.  Passes take the sizes one after another, and the
    files that a pass shuffles are removed before the next, so that the disk need not hold all n-grams.
    """
    done = []
    passes = _passes(sizes, total)
    for units in passes:
        if len(passes) > 1:
            drop_shuffles(words.sparkSession)
        parts = _held_parts(sum(total // shares for _, _, shares in units))
        found = (
            _slices(words, by, units, parts, every).repartitionById(parts, "_part")
            .mapInArrow(_counted_slices(parts, every), "_stretch long, _n int, _data binary")
            .repartition(parts, "_stretch").mapInArrow(_summed, "_name long, _n int, _count long")
        )
        done.append(cut_lineage(found, "gram-counts"))
        del found
    return reduce(DataFrame.unionByName, done)


def _borders(ends: DataFrame, by: Sequence[str], reach: int) -> DataFrame:
    """(by, _name, _last, _tail): the last codes of a sentence and the first ones of those behind it.

    ``ends`` is (by, row_no, _name, _first, _last) with the outermost codes of each
    non-blank sentence.  A sentence offers its first tokens to the sentences
    before it; the key is the sentence number, so no group is gathered.
    """
    offers = ends.select(
        *by, "row_no", "_first", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_back")
    ).select(*by, (F.col("row_no") - F.col("_back")).alias("row_no"), "_back", "_first")
    ordered = F.array_sort(F.collect_list(F.struct("_back", "_first")))
    tails = offers.groupBy(*by, "row_no").agg(
        F.aggregate(ordered, F.lit(b""), lambda tail, x: F.concat(tail, x["_first"])).alias("_tail")
    )
    return cut_lineage(ends.select(*by, "row_no", "_name", "_last").join(tails, [*by, "row_no"]).drop("row_no"), "borders")


def _across(borders: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """(by, _name, _t): codes whose n-grams are those that start in a sentence and end in a later one."""
    return borders.select(*by, "_name", F.concat(_last("_last", n - 1), _first("_tail", n - 1)).alias("_t"))


def _first(codes: str, n: int) -> Column:
    """The codes of the first ``n`` tokens, or all when there are fewer."""
    return F.substring(codes, 1, n * CODE.itemsize)


def _last(codes: str, n: int) -> Column:
    """The codes of the last ``n`` tokens, or all when there are fewer."""
    start = F.greatest(F.octet_length(codes) - n * CODE.itemsize, F.lit(0))
    return F.substring(F.col(codes), start + 1, F.lit(n * CODE.itemsize))


def distinct_n(
    df: DataFrame, by: Sequence[str], order: str, text: str, sizes: Sequence[int], bucket: Column, coded: DataFrame | None = None
) -> DataFrame:
    """Columns ``d{n}``: share of distinct n-grams among all n-grams of a group.

    The sentences of a group are read as one token sequence in ``order``, so
    n-grams cross sentence borders.  Groups with fewer than ``n`` tokens score
    0.  ``bucket`` is an order-preserving bucket of ``order``.

    Neither texts nor sentences are shuffled: of equal n-grams that are read together one leaves the task
    (see ``_counts``), and only outermost codes travel for the n-grams across borders.  ``coded`` is the
    result of ``coded_sentences``, if it is there already.
    """
    by = list(by)
    coded = coded_sentences(df, by, order, text) if coded is None else coded
    words = coded.filter(F.col("_len") > 0).withColumnRenamed("_codes", "_t")
    totals = words.groupBy(*by).agg(F.sum("_len").alias("_len"))
    every = [words.select(*by, "_name", F.lit(0).alias("_only"), "_t")]
    reach = max(sizes) - 1
    if reach:
        ends = words.select(*by, order, "_name", _first("_t", reach).alias("_first"), _last("_t", reach).alias("_last"))
        borders = _borders(number_rows(ends, [order], bucket, by), by, reach)
        every += [_across(borders, by, n).withColumn("_only", F.lit(n)) for n in sizes if n > 1]
    length = words.agg(F.sum("_len")).first()[0] or 0
    found = _counts(reduce(DataFrame.unionByName, every), by, sizes, length, every=False)
    found = found.groupBy("_name").agg(*[F.sum(F.when(F.col("_n") == n, F.col("_count")).otherwise(0)).alias(f"_m{n}") for n in sizes])
    shares = totals.join(
        words.select(*by, "_name").join(found, "_name").groupBy(*by).agg(*[F.sum(f"_m{n}").alias(f"_m{n}") for n in sizes]), by
    ).select(*by, *[F.try_divide(F.col(f"_m{n}"), F.greatest(F.col("_len") - (n - 1), F.lit(0))).alias(f"d{n}") for n in sizes])
    groups = coded.select(*by).distinct()
    return groups.join(shares, by, "left").fillna(0.0, [f"d{n}" for n in sizes])


def self_bleu(
    df: DataFrame, by: Sequence[str], order: str, text: str, max_n: int = 4, out: str = "self_bleu", coded: DataFrame | None = None
) -> DataFrame:
    """Mean BLEU of each sentence against the others of its group.

    A sentence's n-gram count is clipped by the largest count among the
    others.  Numbering the occurrences of an n-gram inside its sentence turns
    that into set membership: the r-th occurrence matches when some other
    sentence has an r-th one too.  So the matches are all n-grams less those
    (n-gram, r) that only one sentence of the group holds.  One count per
    (n-gram, r) decides that: no pairs of sentences, no group in one task.
    Sentences that are read together are compared at once; what leaves their
    task is each (n-gram, r) once, with its only holder if it has one (see ``_counts``).

    (by, order) identifies a sentence.  ``coded`` is the result of ``coded_sentences``, if it is there already.
    """
    by = list(by)
    sizes = range(1, max_n + 1)
    coded = coded_sentences(df, by, order, text) if coded is None else coded
    words = coded.filter(F.col("_len") > 0).withColumnRenamed("_codes", "_t")

    lengths = words.groupBy(*by, "_len").agg(F.count(F.lit(1)).alias("_same"))
    # One row per distinct length: bounded by the longest sentence.
    near = Window.partitionBy(*by).orderBy("_len")
    below, above = F.lag("_len").over(near), F.lead("_len").over(near)
    nearest = (
        F.when(F.col("_same") > 1, F.col("_len"))
        .when(below.isNull(), above)
        .when(above.isNull(), below)
        .when(F.col("_len") - below <= above - F.col("_len"), below)
        .otherwise(above)
    )
    lengths = lengths.withColumn("_ref", nearest).select(*by, "_len", "_ref")

    length = words.agg(F.sum("_len")).first()[0] or 0
    lost = _counts(words, by, sizes, length, every=True).groupBy("_name").agg(
        *[F.sum(F.when(F.col("_n") == n, F.col("_count"))).alias(f"_lost{n}") for n in sizes]
    )
    # Many sentences of one group may share a length; salting spreads them.
    salt = F.pmod(F.xxhash64("_name"), F.lit(SALTS)).cast("int")
    salted = lengths.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    scored = (
        words.select(*by, "_name", "_len", salt.alias("_salt"))
        .join(salted, [*by, "_len", "_salt"]).drop("_salt")
        .join(lost, "_name", "left")
    )
    log_sum = F.lit(0.0)
    for n in sizes:
        total = F.greatest(F.col("_len") - (n - 1), F.lit(0))
        scored = scored.withColumn(f"_hits{n}", total - F.coalesce(F.col(f"_lost{n}"), F.lit(0)))
        smooth = F.when(F.col(f"_hits{n}") == 0, F.lit(0.1)).otherwise(F.col(f"_hits{n}").cast("double"))
        log_sum = log_sum + F.log(smooth / F.greatest(total, F.lit(1))) / max_n
    brevity = F.when(F.col("_len") > F.col("_ref"), F.lit(1.0)).otherwise(F.exp(1 - F.col("_ref") / F.col("_len")))
    score = F.when(F.col("_hits1") == 0, F.lit(0.0)).otherwise(brevity * F.exp(log_sum))
    # A sentence without any other to compare with has no reference length.
    mean = scored.filter(F.col("_ref").isNotNull()).groupBy(*by).agg(F.avg(score).alias(out))
    return coded.select(*by).distinct().join(mean, by, "left").fillna(0.0, [out])


def prompt_confusion(df: DataFrame, by: Sequence[str], prompt: str, sentiment: str, formality: str) -> DataFrame:
    """TP, FP, TN, FN per group and attribute, from predicted and prompted values.

    A prompt that leaves an attribute unspecified makes every prediction wrong.
    """
    asked_s, asked_f = parse_sentiment(F.col(prompt)), parse_formality(F.col(prompt))

    def cells(said: Column, asked: Column, yes: str, no: str, tag: str) -> list[Column]:
        said_yes = said == yes
        tests = (
            ("tp", said_yes & (asked == yes)), ("fp", said_yes & (asked != yes)),
            ("tn", ~said_yes & (asked == no)), ("fn", ~said_yes & (asked != no)),
        )
        return [F.count_if(test).alias(f"{tag}_{name}") for name, test in tests]

    return df.groupBy(*by).agg(
        *cells(F.col(sentiment), asked_s, "Positive", "Negative", "sentiment"),
        *cells(F.col(formality), asked_f, "Formal", "Informal", "formality"),
    )


def match_accuracy(confusion: DataFrame, tag: str) -> Column:
    """(TP + TN) / all of one attribute; null when nothing was predicted."""
    right = F.col(f"{tag}_tp") + F.col(f"{tag}_tn")
    return F.try_divide(
        right.cast("double"), (right + F.col(f"{tag}_fp") + F.col(f"{tag}_fn")).cast("double")
    )


def perplexity_summary(
    records: DataFrame, details: DataFrame, by: Sequence[str], order: str, text: str, elapsed: str
) -> DataFrame:
    """Mean perplexity, number of valid values, mean time and an example per group.

    ``details`` is (by, order, perplexity).
    """
    base = records.groupBy(*by).agg(
        F.avg(elapsed).alias("avg_inference_time"), F.min_by(text, order).alias("example_output")
    )
    scores = details.groupBy(*by).agg(
        F.avg("perplexity").alias("avg_perplexity"), F.count(F.lit(1)).alias("n_valid")
    )
    return base.join(scores, list(by), "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))


def display_summary(summary: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Numbers as fixed-point text, missing values as N/A."""
    for name, d in digits.items():
        summary = summary.withColumn(name, fixed_decimals(F.col(name), d))
    return summary.withColumn("example_output", F.coalesce("example_output", F.lit("N/A")))


def join_summary(metrics: DataFrame, base: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Metrics with the first matching perplexity row; N/A where there is none."""
    out = first_match(metrics, base, keys, order)
    return out.withColumn("avg_perplexity", F.coalesce("avg_perplexity", F.lit("N/A")))


def mean_batch_loss(df: DataFrame, batch: Sequence[str], loss: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of batch means, which is not the mean over all tokens."""
    per_batch = df.groupBy(*by, *batch).agg(F.avg(loss).alias("_loss"))
    return per_batch.groupBy(*by).agg(F.avg("_loss").alias("eval_loss"))


def early_stopping(history: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """Per run: the best epoch kept and the epoch at which training stops.

    Only a strict improvement resets the counter.  A run has one row per
    epoch, which bounds the windows.
    """
    order = Window.partitionBy(run).orderBy(epoch)
    before = F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumn("_better", F.coalesce(F.col(loss) < before, F.lit(True)).cast("int"))
    marked = marked.withColumn("_island", F.sum("_better").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    waiting = F.row_number().over(Window.partitionBy(run, "_island").orderBy(epoch)) - 1
    marked = marked.withColumn("_waiting", waiting)
    stops = marked.groupBy(run).agg(
        F.min(F.when(F.col("_waiting") >= patience, F.col(epoch))).alias("stop_epoch"),
        F.max(epoch).alias("_last"),
    )
    until = marked.join(stops, run).filter(F.col(epoch) <= F.coalesce("stop_epoch", "_last"))
    best = F.max_by(F.struct(F.col(epoch), F.col(loss)), F.when(F.col("_better") == 1, F.col(epoch)))
    return until.groupBy(run).agg(
        best.alias("_best"), F.max("stop_epoch").alias("stop_epoch"), F.count(F.lit(1)).alias("epochs_run")
    ).select(
        run, F.col("_best")[epoch].alias("best_epoch"), F.col("_best")[loss].alias("best_loss"),
        "stop_epoch", "epochs_run",
    )
