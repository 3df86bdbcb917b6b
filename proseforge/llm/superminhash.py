"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

Each element of a set visits the places of a signature in a random order of its own, and the value it
leaves at a place begins with its rank in that order.  The values at different places are thus
correlated, which makes estimates less variable than with independent hashes; and once no place holds
a value with a rank as high as the current one, no element can change the signature and it is done.

Signatures are cut into bands, and documents that agree in a band are candidates.  Links are confirmed
on the full sets.  Nothing is done for all pairs of a bucket:

1. Equal sets are one class; only the document with the smallest number goes on.
2. Every document is compared with one pivot of its buckets.  This joins most of a large group.
3. Buckets that still hold several components are gathered into clusters.  Within a cluster every
   document outside its largest component is compared with all others, in blocks of bounded size.
   A block gives back no more links than it needs to join what belongs together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.llm.common import fresh, map_texts, quoted, small_batches
from proseforge.session import cut_lineage

WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
#: Elements whose orders are held at a time.
ELEMENTS = 50_000
#: Most document numbers that are broadcast to a scan of texts; eight bytes each.
BROADCAST_ROWS = 1_000_000
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """A pair at the limit of 80 % agrees in one of 42 bands of 6 values but for 3 in a million."""

    shingle: int = 4
    percent: int = 80
    bands: int = 42
    rows: int = 6
    #: Most documents and, unless a single document has more, shingles of a block.
    block: int = 512
    elements: int = 1_000_000

    @property
    def places(self) -> int:
        return self.bands * self.rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; of all words if there are fewer."""
    import xxhash

    # Lower-casing bytes changes A to Z only.
    words = WORDS(text.encode("utf-8", "replace").lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = _mix(h * _GOLD + w[i : i + n])
    return np.unique(h)


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """SuperMinHash signatures, one row per non-empty set: rank in the upper half, a draw in the lower."""
    out = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order: np.ndarray | None = None
    every = np.arange(len(elements))
    for rank in range(places):
        if rank:
            # A signature whose values all have lower ranks is final.
            going = (out.max(axis=1) >> np.uint64(32)) >= rank
            keep = going[owner]
            if not keep.any():
                break
            if order is None:
                kind = np.uint8 if places <= 256 else np.uint16
                order = np.empty((int(keep.sum()), places), kind)
                order[:] = np.arange(places)
                # The first exchange was made without the table.
                first = first[keep]
                order[np.arange(len(first)), first] = 0
                order[:, 0] = first
            elif not keep.all():
                order = order[keep]
            elements, owner = elements[keep], owner[keep]
            every = np.arange(len(elements))
        u = _mix(elements + np.uint64(int(_GOLD) * (rank + 1) % 2**64))
        swap = rank + (((u & np.uint64(0xFFFFFFFF)) * np.uint64(places - rank)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            at = first = swap
        else:
            at = order[every, swap].astype(np.int64)
            order[every, swap] = order[every, rank]
            order[every, rank] = at
        np.minimum.at(flat, owner * places + at, (np.uint64(rank) << np.uint64(32)) | (u >> np.uint64(32)))
    return out


def band_keys(found: np.ndarray, settings: Settings) -> np.ndarray:
    """One 64-bit key per band of each signature; keys of different bands differ."""
    bands = found.reshape(len(found), settings.bands, settings.rows)
    keys = np.broadcast_to(np.arange(1, settings.bands + 1, dtype=np.uint64), bands.shape[:2]) * _GOLD
    for i in range(settings.rows):
        keys = _mix(keys + bands[:, :, i])
    return keys.view(np.int64)


def described(df: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """(key, n_shingles, digest, bands) of every row; no digest and no bands without words."""
    added = T.StructType([
        T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def work(texts: list[str | None]) -> dict[str, list]:
        sets = [shingles(t, settings.shingle) for t in texts]
        bands: list[list[int]] = [[] for _ in sets]
        held: list[int] = []
        size = 0
        for i, s in enumerate([*sets, None]):
            if held and (s is None or size + len(s) > ELEMENTS):
                for j, row in zip(held, band_keys(signatures([sets[j] for j in held], settings.places), settings).tolist()):
                    bands[j] = row
                held, size = [], 0
            if s is not None and len(s):
                held.append(i)
                size += len(s)
        digests = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return {"n_shingles": [len(s) for s in sets], "digest": digests, "bands": bands}

    rows = df.select(F.col(quoted(key)).cast("long").alias("doc"), F.col(quoted(text)).alias("text"))
    return map_texts(rows, "text", ["doc"], added, work)


def _sent(numbers: DataFrame) -> DataFrame:
    """Document numbers that go to the texts if they are few enough; else both meet in a shuffle."""
    return F.broadcast(numbers) if numbers.count() <= BROADCAST_ROWS else numbers


def set_table(df: DataFrame, key: str, text: str, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(doc, n, shingles) of the documents in ``wanted``, read from the texts once more and written out."""
    added = T.StructType([T.StructField("n", T.LongType()), T.StructField("shingles", T.BinaryType())])
    rows = df.select(F.col(quoted(key)).cast("long").alias("doc"), F.col(quoted(text)).alias("text"))
    rows = rows.join(_sent(wanted), "doc", "left_semi")

    def work(texts: list[str | None]) -> dict[str, list]:
        sets = [shingles(t, settings.shingle) for t in texts]
        return {"n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

    return cut_lineage(map_texts(rows, "text", ["doc"], added, work).filter("n > 0"), "sets")


class Union:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (up := self.parent.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.parent[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart until now."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


def links_of_task(docs: list[int], parts: list[int], left: list[bool], right: list[bool], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between left and right documents of different components, no more than join the components."""
    rights = [i for i, r in enumerate(right) if r]
    if not rights or not any(left):
        return []
    sizes = np.array([len(sets[i]) for i in rights])
    flat = np.concatenate([sets[i] for i in rights])
    owner = np.repeat(np.arange(len(rights)), sizes)
    by = np.argsort(flat, kind="stable")
    values, starts = np.unique(flat[by], return_index=True)
    owner, ends = owner[by], np.append(starts[1:], len(by))
    part = np.array([parts[i] for i in rights])
    union, found = Union(), []
    for i, is_left in enumerate(left):
        if not is_left:
            continue
        own = sets[i]
        at = np.searchsorted(values, own)
        at[at == len(values)] = 0
        at = at[values[at] == own]
        if not len(at):
            continue
        lengths = ends[at] - starts[at]
        places = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[places], minlength=len(rights))
        near = 100 * shared >= percent * (len(own) + sizes - shared)
        for j in np.flatnonzero(near & (part != parts[i])).tolist():
            if union.join(parts[i], int(part[j])):
                found.append((docs[i], docs[rights[j]]))
    return found


def link(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links from (task, doc, part, is_left, is_right) rows; a task's rows are bounded."""
    rows = tasks.join(sets.select("doc", "shingles"), "doc").select("task", "doc", "part", "is_left", "is_right", "shingles")
    rows = rows.repartition("task").sortWithinPartitions("task")
    small_batches(tasks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[list] = [[], [], [], [], []]

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:5]]
            for i, task in enumerate(columns[0]):
                if task != now:
                    if now is not None and len(held[0]) > 1:
                        yield out(links_of_task(*held, percent))
                    now, held = task, [[], [], [], [], []]
                for place, column in zip(held, columns[1:]):
                    place.append(column[i])
                # A copy, so that the batch can go.
                held[4].append(np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64).copy())
        if now is not None and len(held[0]) > 1:
            yield out(links_of_task(*held, percent))

    return rows.mapInArrow(run, "a long, b long")


def _forest(edges: DataFrame) -> DataFrame:
    """(a, b), b < a: each partition's links as the fewest that join the same, by union-find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = Union()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                union.join(a, b)
        found = [(x, r) for x in list(union.parent) if (r := union.root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(doc, component): the smallest number reachable from every number that stands in ``edges``.

    Partitions first reduce their own links.  Then every document points its larger neighbours to its
    smallest one, and its smaller neighbours likewise, until nothing changes.  A document with very many
    neighbours is met in joins only, which the planner can split.
    """
    edges = cut_lineage(_forest(edges.filter("a <> b")).distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        # b < a throughout, so both ways are the table and its mirror image.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut_lineage(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
    own = edges.select(F.col("b").alias("doc"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("doc"), F.col("b").alias("component")).unionByName(own).groupBy("doc").agg(F.min("component").alias("component"))


def _task(*keys: Column) -> Column:
    """A number for a task.  Tasks that share one by chance are done together, which does no harm."""
    return F.xxhash64(*keys)


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc, n_shingles, component): one row per row of ``df``, and the group it is in.

    A document's set holds its distinct shingles of four words, lower-cased in A to Z; fewer words are
    one shingle.  Documents are linked if their sets share 80 percent of their union, and a group is
    what links join.  ``component`` is the smallest document number of the group.  Texts that are
    null or have no words are linked with nothing.  Rows that share a number are one document, with the
    links of all its texts; rows without a number are linked with nothing and have no component.
    """
    rows = cut_lineage(described(df, key, text, settings), "signatures")
    real = rows.filter("doc is not null and digest is not null")
    classes = cut_lineage(real.groupBy("digest").agg(F.min("doc").alias("rep")), "classes")
    reps = real.select("doc", "digest", "bands").join(classes, "digest").filter("doc = rep")
    keys = cut_lineage(reps.select("doc", F.explode("bands").alias("key")).distinct(), "bands")
    buckets = keys.groupBy("key").agg(F.min("doc").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keys = cut_lineage(keys.join(buckets.select("key", "pivot"), "key"), "buckets")
    sets = set_table(df, key, text, keys.select("doc").distinct(), settings)

    # Each document and the pivot with which it shares most buckets.
    shared = keys.filter("doc <> pivot").groupBy("doc", "pivot").agg(F.count(F.lit(1)).alias("n"))
    best = cut_lineage(shared.groupBy("doc").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot")), "pivots")
    # A document that stands for several texts counts with all of them.
    sizes_of = sets.groupBy("doc").agg(F.sum("n").alias("n"))
    best = best.join(sizes_of, "doc")
    blocks = lambda docs, n: F.greatest(F.ceil(docs / settings.block), F.ceil(n / settings.elements)).cast("long")
    many = best.groupBy("pivot").agg(blocks(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    dealt = best.join(many, "pivot").withColumn("task", _task(F.col("pivot"), F.pmod(F.xxhash64("doc"), F.col("parts"))))
    pivots = many.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"))
    side = lambda left: [F.lit(left).alias("is_left"), F.lit(not left).alias("is_right")]
    tasks = dealt.select("task", "doc", F.col("doc").alias("part"), *side(False)).unionByName(
        pivots.select(_task(F.col("pivot"), F.col("p")).alias("task"), F.col("pivot").alias("doc"), F.col("pivot").alias("part"), *side(True))
    )
    first = cut_lineage(link(tasks, sets, settings.percent), "first-links")
    # A number that stands for several texts joins their classes.
    member = real.select("doc", "digest").join(classes, "digest").select("doc", "rep")
    several = member.groupBy("doc").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("doc", "low")
    same = member.join(several, "doc").select(F.col("rep").alias("a"), F.col("low").alias("b")).filter("a <> b")
    first = cut_lineage(first.unionByName(same), "links")
    parts = cut_lineage(components(first), "components")

    # Clusters: what shares buckets and is not in one component yet.
    placed = keys.join(parts, "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("part"))
    placed = cut_lineage(placed, "placed")
    open_ = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("key", "low")
    beside = placed.join(open_, "key").filter("part <> low").select(F.col("part").alias("a"), F.col("low").alias("b")).distinct()
    clusters = components(beside).select(F.col("doc").alias("part"), F.col("component").alias("cluster"))
    inside = placed.select("doc", "part").distinct().join(clusters, "part").join(sizes_of, "doc")
    inside = cut_lineage(inside, "clusters")
    sizes = inside.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    of = sizes.groupBy("cluster").agg(
        F.max(F.struct("docs", (-F.col("part")).alias("part"), "n")).alias("inner"), F.sum("docs").alias("docs"), F.sum("n").alias("n")
    ).select(
        "cluster", (-F.col("inner.part")).alias("largest"), blocks(F.col("inner.docs"), F.col("inner.n")).alias("inner_blocks"),
        blocks(F.col("docs") - F.col("inner.docs"), F.col("n") - F.col("inner.n")).alias("outer_blocks"),
    )
    inside = inside.join(of, "cluster")
    outer = inside.filter("part <> largest").withColumn("o", F.pmod(F.xxhash64("doc"), F.col("outer_blocks")))
    inner = inside.filter("part = largest").withColumn("i", F.pmod(F.xxhash64("doc"), F.col("inner_blocks")))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    columns = lambda left, right: ["doc", "part", left.alias("is_left"), right.alias("is_right")]
    # Outer block against outer block, the smaller number first; within one block against itself.
    among = outer.withColumn("p", upto(F.col("outer_blocks")))
    among = among.select(_task(F.col("cluster"), F.lit("o"), F.least("o", "p"), F.greatest("o", "p")).alias("task"),
                         *columns(F.col("o") <= F.col("p"), F.col("o") >= F.col("p")))
    across = lambda o, i: _task(F.col("cluster"), F.lit("i"), F.col(o), F.col(i)).alias("task")
    lefts = outer.withColumn("i", upto(F.col("inner_blocks"))).select(across("o", "i"), *columns(F.lit(True), F.lit(False)))
    rights = inner.withColumn("o", upto(F.col("outer_blocks"))).select(across("o", "i"), *columns(F.lit(False), F.lit(True)))
    rest = link(among.unionByName(lefts).unionByName(rights), sets, settings.percent)
    labels = cut_lineage(components(first.unionByName(rest)), "labels")

    named = classes.join(labels, classes["rep"] == labels["doc"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select("doc", "n_shingles", component.alias("component"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``df`` whose document is the first of its group; columns as they were.

    Rows without a number stay; rows that share a number stay or go together.
    """
    gone = groups(df, key, text, settings).filter("doc <> component").select(F.col("doc").alias(name := fresh(df, "_gone"))).distinct()
    gone = cut_lineage(gone, "near-copies")
    return df.join(_sent(gone), F.col(quoted(key)).cast("long") == F.col(name), "left_anti")
