"""Benchmark decontamination: test suffixes looked up in suffix arrays of the training texts.

Words of the benchmark are numbered; every other word is 0, which no test holds.  A step of texts is one
shard of the training data: the numbers of its words, a 0 after each text.  Its suffix array lists, in
order of the words that follow, the places from which a window of known words begins; no other place can
begin a match.  The suffixes of the test items are sorted once.  They go through the array of every
shard together, word by word: a binary search narrows the range of a prefix to those of its longer ones, and
suffixes that begin alike are searched once.  A range that is left after the words of a window holds all
its occurrences in the shard; the depth at which a place leaves the last range is its longest match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.llm.common import fresh, map_texts, quoted

#: Runs of letters, digits and anything beyond ASCII; in bytes of lower-cased text.
words_in = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_ZERO = np.zeros(1, np.int32)


@dataclass(frozen=True)
class Settings:
    """``window`` consecutive words of an item are a leak; ``part_bytes`` bounds what of the benchmark a pass holds."""

    window: int = 10
    part_bytes: int = 8_000_000


def words_of(text: str | None) -> list[bytes]:
    return words_in(text.encode("utf-8", "replace").lower()) if text else []


def packed(ids: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """As many words from each place as 62 bits hold, the first in the highest bits."""
    last, key = len(ids) - 1, np.zeros(len(at), np.int64)
    for k in range(62 // bits):
        key = (key << bits) | ids[np.minimum(at + k, last)]
    return key


def suffix_order(ids: np.ndarray, at: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """The places ``at`` in order of the words from there, to a depth of at least ``depth`` words.

    ``ids`` ends with a 0.  Places that agree so far are sorted by their next words, the others stay.
    """
    key = packed(ids, at, bits)
    by = np.argsort(key, kind="stable")
    at, key, done = at[by], key[by], 62 // bits
    first = np.ones(len(at), bool)
    first[1:] = key[1:] != key[:-1]
    while done < depth:
        alone = first & np.append(first[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group = np.cumsum(first)[tied]
        key = packed(ids, at[tied] + done, bits)
        by = np.lexsort((key, group))
        at[tied], key = at[tied][by], key[by]
        first[tied[1:]] |= key[1:] != key[:-1]
        done += 62 // bits
    return at


def narrowed(ids: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray, after: bool) -> np.ndarray:
    """The first place of each range whose word at ``depth`` is not below ``want``, or (``after``) is above it."""
    low, high, last = low.copy(), high.copy(), len(ids) - 1
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        word = ids[np.minimum(array[middle] + depth, last)]
        up = word <= want[open_] if after else word < want[open_]
        low[open_[up]] = middle[up] + 1
        high[open_[~up]] = middle[~up]
        open_ = open_[low[open_] < high[open_]]
    return low


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All places of several ranges, one range after another."""
    sizes = high - low
    return np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


class Tests:
    """The suffixes of a bounded part of the benchmark, sorted.

    A suffix speaks for the prefixes that it does not share with the one before it; the others are searched
    with that one.  Items without words are in no window and left out.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        texts = sorted({(name, tuple(w)) for name, text in items if (w := words_of(text))})
        self.names = [name for name, _ in texts]
        pieces, starts, lengths, windows, owners = [], [], [], [], []
        size = 0
        for owner, (_, words) in enumerate(texts):
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            n, own = len(ids), min(window, len(ids))
            begins = np.arange(n - own + 1)
            starts.append(size + begins)
            lengths.append(n - begins)
            windows.append(np.full(len(begins), own))
            owners.append(np.full(len(begins), owner))
            pieces += [np.array(ids, np.int32), _ZERO]
            size += n + 1
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.flat = np.concatenate(pieces or [_ZERO])
        self.bits = max(1, len(self.words).bit_length())
        starts, lengths, windows, owners = map(join, (starts, lengths, windows, owners))
        self.shortest = int(windows.min()) if len(windows) else 0
        self.longest = int(lengths.max()) if len(lengths) else 0
        order = self._order(starts)
        self.start, self.length, self.owner = starts[order], lengths[order], owners[order]
        self.shared = self._shared()
        self.parent = self._parents()
        by = np.argsort(self.shared, kind="stable")
        cuts = np.searchsorted(self.shared[by], np.arange(self.longest + 1))
        self.born = [by[a:b] for a, b in zip(cuts, cuts[1:])]
        self._windows(windows[order])

    def _order(self, starts: np.ndarray) -> np.ndarray:
        """Ranks of all places by ever longer prefixes, each twice as long as before."""
        flat, depth = self.flat.astype(np.int64), 1
        rank = flat
        while len(starts) and depth < self.longest:
            further = np.zeros(len(flat), np.int64)
            further[: max(0, len(flat) - depth)] = rank[depth:]
            by = np.lexsort((further, rank))
            new = np.ones(len(by), np.int64)
            new[1:] = (rank[by][1:] != rank[by][:-1]) | (further[by][1:] != further[by][:-1])
            rank = np.empty(len(by), np.int64)
            rank[by] = np.cumsum(new)
            depth *= 2
        return np.argsort(rank[starts], kind="stable")

    def _shared(self) -> np.ndarray:
        """How many words each suffix has in common with the one before it."""
        out = np.zeros(len(self.start), np.int64)
        going = np.arange(1, len(self.start))
        depth = 0
        while len(going):
            one = self.flat[self.start[going - 1] + depth]
            going = going[(one == self.flat[self.start[going] + depth]) & (one != 0)]
            depth += 1
            out[going] = depth
        return out

    def _parents(self) -> np.ndarray:
        """The suffix with which a suffix is searched for as long as their words agree."""
        out, open_, shared = np.zeros(len(self.start), np.int64), [], self.shared.tolist()
        for t, s in enumerate(shared):
            while open_ and shared[open_[-1]] >= s:
                open_.pop()
            out[t] = open_[-1] if open_ else t
            open_.append(t)
        return out

    def _windows(self, sizes: np.ndarray) -> None:
        """Distinct windows by their length, each with the suffix that it is searched with and the items that hold it."""
        self.events: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.holders: list[np.ndarray] = []
        for size in np.unique(sizes).tolist():
            begins = np.flatnonzero(self.shared < size)
            own = np.flatnonzero(sizes == size)
            speaker = begins[np.searchsorted(begins, own, side="right") - 1]
            distinct, which = np.unique(speaker, return_inverse=True)
            numbers = len(self.holders) + np.arange(len(distinct))
            by = np.argsort(which, kind="stable")
            cuts = np.searchsorted(which[by], np.arange(len(distinct) + 1))
            self.holders += [np.unique(self.owner[own[by[a:b]]]) for a, b in zip(cuts, cuts[1:])]
            self.events[size] = distinct, numbers

    def search(self, ids: np.ndarray, begins: np.ndarray) -> dict[str, list]:
        """Matches in a shard whose texts begin at ``begins``; ``ids`` has a 0 after each text."""
        n_docs = len(begins)
        out = {"n_hit": [0] * n_docs, "items": [[] for _ in range(n_docs)], "spans": [[] for _ in range(n_docs)], "longest": [None] * n_docs}
        ends = np.flatnonzero(ids == 0)
        known = np.flatnonzero(ids)
        at = known[ends[np.searchsorted(ends, known)] - known >= self.shortest] if self.shortest else known[:0]
        if not len(at):
            return out
        array = suffix_order(ids, at, self.bits, self.longest)
        low, high = np.zeros(len(self.start), np.int64), np.zeros(len(self.start), np.int64)
        alive = np.zeros(len(self.start), bool)
        best, who = np.zeros(len(array), np.int64), np.zeros(len(array), np.int64)
        marks = np.zeros(len(ids) + 1, np.int64)
        seen: list[np.ndarray] = []
        now = np.zeros(0, np.int64)
        for depth in range(self.longest):
            born, now = self.born[depth], now[self.length[now] > depth]
            if depth:
                born = born[alive[self.parent[born]]]
                low[born], high[born] = low[self.parent[born]], high[self.parent[born]]
            else:
                high[born] = len(array)
            alive[:] = False
            now = np.concatenate([now, born])
            want = self.flat[self.start[now] + depth]
            begin = narrowed(ids, array, low[now], high[now], depth, want, False)
            end = narrowed(ids, array, begin, high[now], depth, want, True)
            now, begin, end = (x[begin < end] for x in (now, begin, end))
            if not len(now):
                break
            low[now], high[now], alive[now] = begin, end, True
            if depth + 1 in self.events:
                speaker, number = self.events[depth + 1]
                number, speaker = number[alive[speaker]], speaker[alive[speaker]]
                places = spread(low[speaker], high[speaker])
                sizes = high[speaker] - low[speaker]
                found = array[places]
                marks += np.bincount(found, minlength=len(marks)) - np.bincount(found + depth + 1, minlength=len(marks))
                doc = np.searchsorted(begins, found, side="right") - 1
                seen.append(np.unique(np.stack([doc, np.repeat(number, sizes)]), axis=1))
                best[places], who[places] = depth + 1, np.repeat(speaker, sizes)
            if depth >= self.window:
                places = spread(begin, end)
                best[places], who[places] = depth + 1, np.repeat(now, end - begin)
        self._gather(out, array, best, who, marks, seen, begins)
        return out

    def _gather(self, out, array, best, who, marks, seen, begins) -> None:
        hit = np.diff(np.concatenate([[0], (np.cumsum(marks[:-1]) > 0).astype(np.int8)]))
        # A 0 after each text ends a span there.
        first, last = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
        doc = np.searchsorted(begins, first, side="right") - 1
        for d, a, b in zip(doc.tolist(), (first - begins[doc]).tolist(), (last - begins[doc]).tolist()):
            out["spans"][d].append((a, b))
            out["n_hit"][d] += b - a
        pairs = np.concatenate(seen, axis=1) if seen else np.zeros((2, 0), np.int64)
        pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
        docs, cuts = np.unique(pairs[0], return_index=True)
        for d, numbers in zip(docs.tolist(), np.split(pairs[1], cuts[1:])):
            owners = np.unique(np.concatenate([self.holders[w] for w in numbers.tolist()]))
            out["items"][d] = sorted({self.names[o] for o in owners.tolist()})
        some = np.flatnonzero(best)
        place = array[some]
        doc = np.searchsorted(begins, place, side="right") - 1
        by = np.lexsort((place, -best[some], doc))
        docs, at = np.unique(doc[by], return_index=True)
        for d, i in zip(docs.tolist(), by[at].tolist()):
            t = int(who[some[i]])
            owner = int(self.owner[t])
            item_begin = int(self.start[t]) - self._item_begin(owner)
            out["longest"][d] = (int(best[some[i]]), int(place[i] - begins[d]), self.names[owner], item_begin)

    def _item_begin(self, owner: int) -> int:
        if not hasattr(self, "_begins"):
            ends = np.flatnonzero(self.flat == 0)
            self._begins = np.concatenate([[0], ends[:-1] + 1])
        return int(self._begins[owner])


LONGEST = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("at", T.LongType()), T.StructField("item", T.StringType()), T.StructField("item_at", T.LongType()),
])
SPAN = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(SPAN)), T.StructField("longest", LONGEST),
])


class Sent:
    """One part of the benchmark on its way to the workers."""

    def __init__(self, part: DataFrame, window: int):
        items = [(r["item"], r["text"]) for r in part.collect()]  # bounded by Settings.part_bytes
        self.tests = part.sparkSession.sparkContext.broadcast(Tests(items, window))


def _scan(df: DataFrame, text: str, keep: list[str], sent: Sent) -> DataFrame:
    def work(texts: list[str | None]) -> dict[str, list]:
        tests = sent.tests.value
        number, pieces, counts = tests.words.get, [], []
        for t in texts:
            words = words_of(t)
            counts.append(len(words))
            pieces += [np.fromiter(map(number, words, repeat(0)), np.int32, len(words)), _ZERO]
        begins = np.concatenate([[0], np.cumsum(np.array(counts[:-1], np.int64) + 1)])
        found = tests.search(np.concatenate(pieces), begins)
        names = ("n_words", "at", "item", "item_at")
        return {
            "n_words": counts, "n_hit": found["n_hit"], "items": found["items"],
            "spans": [[{"begin": a, "end": b} for a, b in s] for s in found["spans"]],
            "longest": [None if x is None else dict(zip(names, x)) for x in found["longest"]],
        }

    return map_texts(df, text, keep, ADDED, work)


def _part(n: int) -> Column:
    return F.pmod(F.xxhash64("item", "text"), F.lit(n))


def parts(items: DataFrame, limit: int) -> int:
    """How many parts the items are dealt into, so that each has at most twice ``limit`` bytes or is a single item."""
    size = F.sum(F.octet_length("text")).alias("size")
    n = max(1, -(-(items.agg(size).first()[0] or 0) // limit))
    while True:
        dealt = items.groupBy(_part(n).alias("p")).agg(size, F.count(F.lit(1)).alias("rows"))
        worst = dealt.filter((F.col("size") > 2 * limit) & (F.col("rows") > 1)).limit(1)
        if worst.isEmpty():
            return n
        n *= 2


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         settings: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``items``, ``spans`` and ``longest``; a row of ``df`` stays one row.

    Words are runs of letters, digits and characters beyond ASCII, with A to Z in lower case.  A window is
    ``window`` consecutive words of an item, or all of an item with fewer; an item without words has none.
    ``n_hit`` counts the words of the text inside occurrences of windows, ``spans`` are their stretches
    (first word, word after the last), ``items`` the names of the items with occurring windows, as sorted
    texts, each once, and ``longest`` the longest verbatim match that holds a window (its words, its first
    word in the text, an item with it and the first word there; the first in the text of several; null if
    there is none).  A null text has no words, a null item name counts as empty text, items that share a
    name count as one, and rows that repeat are judged each.  Columns called like the new ones are replaced.

    Of the benchmark at most twice ``part_bytes`` bytes are held at a time.  A larger one is taken in
    several passes, and what they find is put together.
    """
    items = benchmark.select(
        F.coalesce(F.col(quoted(item)).cast("string"), F.lit("")).alias("item"), F.col(quoted(item_text)).cast("string").alias("text")
    ).filter(F.length("text") > 0).distinct()
    n = parts(items, settings.part_bytes)
    sent = [Sent(items.filter(_part(n) == i), settings.window) for i in range(n)]
    keep = df.columns if keep is None else keep
    if n == 1:
        return _scan(df, text, keep, sent[0])
    return _merged(df, text, keep, sent)


def _merged(df: DataFrame, text: str, keep: list[str], sent: list[Sent]) -> DataFrame:
    """Rows with equal texts have equal matches, so passes meet by a digest of the text."""
    mark = fresh(df, "_digest")
    marked = df.withColumn(mark, F.sha2(F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")), 256))
    whole = _scan(marked, text, [c for c in keep if c.lower() not in {x.lower() for x in ADDED.names}] + [mark], sent[0])
    rest = [_scan(marked, text, [mark], s).filter("n_hit > 0") for s in sent[1:]]
    found = rest[0]
    for more in rest[1:]:
        found = found.unionByName(more)
    # Equal texts repeat their rows; one of each pass is enough, and there are few passes.
    first = found.unionByName(whole.filter("n_hit > 0").select(mark, *ADDED.names)).distinct()
    order = F.struct(F.col("longest.n_words").alias("a"), (-F.col("longest.at")).alias("b"), F.col("longest.item").alias("c"))
    united = first.groupBy(mark).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_all"),
        F.max_by("longest", order).alias("_longest"),
    )
    nothing = F.struct(F.lit(0).cast("long").alias("reach"), F.array().cast(T.ArrayType(SPAN)).alias("done"))

    def add(state: Column, span: Column) -> Column:
        """Spans come by their beginnings; what of one lies beyond those before it is new."""
        begin = F.greatest(state["reach"], span["begin"])
        last = F.try_element_at(state["done"], F.lit(-1))
        touches = F.coalesce(span["begin"] <= last["end"], F.lit(False))
        end = F.greatest(state["reach"], span["end"])
        grown = F.concat(
            F.slice(state["done"], F.lit(1), F.greatest(F.size(state["done"]) - 1, F.lit(0))),
            F.array(F.struct(last["begin"].alias("begin"), end.alias("end"))),
        )
        new = F.concat(state["done"], F.array(F.struct(begin.alias("begin"), span["end"].alias("end"))))
        return F.struct(end.alias("reach"), F.when(touches, grown).otherwise(new).alias("done"))

    spans = F.aggregate("_all", nothing, add)["done"]
    united = united.select(mark, "_items", spans.alias("_spans"), "_longest")
    length = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    out = whole.join(united, mark, "left")
    return out.select(
        *[F.col(quoted(c)) for c in whole.columns if c not in (mark, *ADDED.names)], "n_words",
        F.coalesce(length, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("_items", "items").alias("items"),
        F.coalesce("_spans", "spans").alias("spans"), F.coalesce("_longest", "longest").alias("longest"),
    )


def remove(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
           settings: Settings = Settings()) -> DataFrame:
    """The rows of ``df`` without an occurring window, with their columns as they were."""
    own = fresh(df, "_text")
    marked = find(df.select(F.col(quoted(text)).alias(own), F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("_row")), benchmark, own, item, item_text, settings, keep=["_row"])
    return marked.filter("n_hit = 0").select("_row.*")
