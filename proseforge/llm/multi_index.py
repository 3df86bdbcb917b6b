"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, and each half has its own centroids; a cell is a pair of them.  For a
query, cells are visited in falling order of the summed nearness of their two centroids, which a heap
yields one by one, until enough entries have been seen.  The entries of the visited cells are then
ranked by their exact nearness.  The members of the fitting sample that a query visits give it a lowest
nearness that its neighbours must reach, so shards need not return entries that cannot be among them.

The centroids are fitted to a bounded sample; every vector is indexed.  Cells are packed into shards
of bounded size (a large cell fills several), queries into blocks, and a query goes only to shards
that hold cells it visits.  A task works on one shard and one block at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseforge.llm.common import quoted
from proseforge.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the vectors that centroids are fitted to; ``visit`` is the share of entries to see."""

    centroids: int = 64
    sample: int = 20_000
    rounds: int = 10
    visit: float = 0.6
    shard: int = 2_048
    block: int = 1_024
    seed: int = 1


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): rows whose vector takes part, its components as doubles.

    Null, zero and empty vectors, those with null or non-finite components, and rows without a key are
    left out; so are vectors whose length is not the most frequent one.
    """
    v = F.transform(F.col(quoted(vector)), lambda x: x.cast("double"))
    rows = df.select(F.col(quoted(key)).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (common["n"] if common else 0))


def fit_half(points: np.ndarray, settings: Settings) -> np.ndarray:
    """Centroids of one half by Lloyd's algorithm from a random start."""
    if not points.shape[1]:  # the first half of vectors with one component
        return np.zeros((1, 0))
    draw = np.random.default_rng(settings.seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[draw.permutation(len(distinct))[: settings.centroids]].copy()
    for _ in range(settings.rounds):
        near = nearest(points, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, points[:, d], len(centres)) for d in range(points.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def fit(rows: DataFrame, settings: Settings) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray] | None:
    """Centroids of both halves, and the sample (ids, vectors) that they are fitted to; None without vectors.

    The sample is drawn by a hash of key and vector, and holds an id once.
    """
    draw = F.xxhash64(F.lit(settings.seed), "vec_id", "v")
    sample = rows.orderBy(draw, "vec_id").limit(settings.sample).toArrow()
    if not sample.num_rows:
        return None
    ids, once = np.unique(sample.column("vec_id").to_numpy(), return_index=True)
    points = np.array(sample.column("v").to_pylist())[once]
    half = points.shape[1] // 2
    return (fit_half(points[:, :half], settings), fit_half(points[:, half:], settings)), ids, points


def visited(query: np.ndarray, centres: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, wanted: int) -> list[int]:
    """Non-empty cells in falling order of summed inner product until ``wanted`` entries are seen."""
    half = centres[0].shape[1]
    first, second = centres[0] @ query[:half], centres[1] @ query[half:]
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y, counts, width = (-first[a]).tolist(), (-second[b]).tolist(), sizes.tolist(), len(b)
    # done[i] is how many of the second centroids have been taken with the i-th first one.
    done, heap, found, seen = [0] * len(a), [(x[0] + y[0], 0, 0)], [], 0
    while heap and seen < wanted:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        cell = a[i] * width + b[j]
        if counts[cell]:
            found.append(cell)
            seen += counts[cell]
        if j + 1 < width and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
    return found


def pack(sizes: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each cell: cells fill shards in order, and large ones have their own."""
    first, many = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    now = held = 0
    for cell, n in enumerate(sizes.tolist()):
        if n > shard:
            now += held > 0
            first[cell], many[cell] = now, -(-n // shard)
            now, held = now + int(many[cell]), 0
            continue
        if held + n > shard:
            now, held = now + 1, 0
        first[cell] = now
        held += n
    return first, many


def exact(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Inner products pair by pair, summed in order of the components in double precision."""
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        total += queries[:, d] * entries[:, d]
    return total


def cells_in(points: np.ndarray, centres: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    half = centres[0].shape[1]
    return nearest(points[:, :half], centres[0]) * len(centres[1]) + nearest(points[:, half:], centres[1])


def best_of_shard(ids: np.ndarray, cells: np.ndarray, vectors: np.ndarray, own: np.ndarray, points: np.ndarray,
                  least: np.ndarray, cells_of: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores): of the cells that each query visits, the ``k`` nearest in this shard that reach ``least``."""
    order = np.lexsort((ids, cells))
    ids, cells, vectors = ids[order], cells[order], vectors[order]
    step = max(1, 2_000_000 // max(1, len(ids)))
    for begin in range(0, len(own), step):
        rough = points[begin : begin + step] @ vectors.T
        for i, row in enumerate(rough):
            q = begin + i
            open_ = np.isin(cells, cells_of[q]) & (ids != own[q]) & (row >= least[q])
            at = np.flatnonzero(open_)
            if not len(at):
                continue
            score = row[at]
            # Rounding of the product is far below this margin, so no true neighbour is lost.
            margin = 1e-9 * max(1.0, float(np.abs(score).max()))
            if len(at) > k:
                at = at[score >= np.partition(score, -k)[-k] - margin]
                if len(np.unique(ids[at])) < k:
                    at = np.flatnonzero(open_)
            true = exact(np.broadcast_to(points[q], (len(at), points.shape[1])), vectors[at])
            by = np.lexsort((ids[at], -true))
            found, true = ids[at][by], true[by]
            if len(found) > 1:
                # Of rows that share an id the nearest stands.
                _, once = np.unique(found, return_index=True)
                once.sort()
                found, true = found[once], true[once]
            yield q, found[:k], true[:k]


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
           settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row that ``is_query`` holds.

    Nearness is the inner product; all rows but those with the query's own id are candidates, and ties
    go to the smaller id.  A query with fewer candidates gets what there is.  Rows without a usable
    vector (see ``usable``) are neither queries nor candidates; of rows that share an id the nearest
    stands, and repeated query rows count once.  ``is_query`` may use ``vec_id`` only.
    """
    spark = df.sparkSession
    rows = cut_lineage(usable(df, key, vector), "vectors")
    fitted = fit(rows, settings)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centres, sample_ids, sample = fitted
    # The settings bound both.
    shipped = spark.sparkContext.broadcast(centres)
    drawn = spark.sparkContext.broadcast((sample_ids, sample, cells_in(sample, centres)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            cells = cells_in(points, shipped.value)
            packed = pa.array([p.tobytes() for p in points], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.int32()), packed], names=["vec_id", "cell", "v"])

    entries = cut_lineage(rows.mapInArrow(assign, "vec_id long, cell int, v binary"), "entries")
    # At most one row per cell, and the number of cells is a setting.
    sizes = np.zeros(len(centres[0]) * len(centres[1]), np.int64)
    for r in entries.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    wanted = max(int(np.ceil(settings.visit * sizes.sum())), min(int(sizes.sum()), 10 * (k + 1)))
    first, many = pack(sizes, settings.shard)
    layout = spark.sparkContext.broadcast((sizes, first, many))
    queries = entries.filter(is_query).select("vec_id", "v")
    blocks = max(1, -(-queries.count() // settings.block))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, first, many = layout.value
        known, points, places = drawn.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                out: list[tuple[int, int, bytes, float, list[int]]] = []
                for own, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    query = np.frombuffer(raw)
                    cells = np.array(visited(query, shipped.value, sizes, wanted))
                    seen = np.zeros(len(sizes), bool)
                    seen[cells] = True
                    score = (points @ query)[seen[places] & (known != own)]
                    # A margin far above the rounding of the product.
                    least = np.partition(score, -k)[-k] - 1e-9 * max(1.0, np.abs(score).max()) if len(score) >= k else -np.inf
                    shards: dict[int, list[int]] = {}
                    for cell, begins, n in zip(cells.tolist(), first[cells].tolist(), many[cells].tolist()):
                        for s in range(begins, begins + n):
                            shards.setdefault(s, []).append(cell)
                    out += [(s, own, raw, float(least), cs) for s, cs in shards.items()]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.list_(pa.int32()))
                names = ["shard", "query_id", "q", "least", "cells"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    routed = queries.mapInArrow(route, "shard long, query_id long, q binary, least double, cells array<int>")
    routed = routed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, many = layout.value
        for batch in batches:
            ids, cells = np.array(batch.column(0)), np.array(batch.column(1))
            # A large cell is dealt by a hash of the id, so rows of one id stay together.
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            shard = first[cells] + mixed.astype(np.int64) % many[cells]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *batch.columns], names=["shard", "vec_id", "cell", "v"])

    placed = entries.mapInArrow(place, "shard long, vec_id long, cell int, v binary")
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, cells = left.column("vec_id").to_numpy(), left.column("cell").to_numpy()
            vectors = np.frombuffer(b"".join(left.column("v").to_pylist())).reshape(len(ids), -1)
            own = right.column("query_id").to_numpy()
            points = np.frombuffer(b"".join(right.column("q").to_pylist())).reshape(len(own), -1)
            cells_of = [np.array(c) for c in right.column("cells").to_pylist()]
            least = right.column("least").to_numpy()
            for q, found, score in best_of_shard(ids, cells, vectors, own, points, least, cells_of, k):
                out[0] += [int(own[q])] * len(found)
                out[1] += found.tolist()
                out[2] += score.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    near = placed.groupBy("shard", "block").cogroup(routed.groupBy("shard", "block"))
    near = near.applyInArrow(compare, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
