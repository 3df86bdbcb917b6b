"""Language identification of code-switched text by a linear-chain conditional random field.

Every word gets a label, and the label of a text is the one that most of its words carry.  A word of
more than 100 characters, as in scripts without spaces, counts as several: its consecutive pieces.  A word's
score for a label is the sum of learned weights of its prefixes, suffixes, character n-grams, and of
the word lists in which it stands; a learned matrix scores pairs of neighbouring labels.  The
forward-backward algorithm turns both into the probability of each label at each word, over the
whole text.  Words without letters carry no score of their own and take the language around them.

The field is fitted on a bounded sample of labelled rows (``Settings``).  Its training sequences join
stretches of texts in different languages, so that the matrix learns how often languages change.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.llm.common import fresh, map_texts, quoted, words_of

UNKNOWN = "und"
#: Words in a stretch within which forward-backward runs in step for all stretches.
STRETCH = 64
#: Words that a worker remembers the scores of.
REMEMBERED = 300_000


@dataclass(frozen=True)
class Settings:
    """``rows`` and ``longest`` bound the sample: rows per language, characters per row."""

    rows: int = 250
    longest: int = 20_000
    languages: int = 500
    sequences: int = 3_000
    length: int = 40
    switches: float = 0.5
    rounds: int = 40
    buckets: int = 1 << 16
    listed: int = 300


#: Most characters of a place of the chain, and how many of them two pieces of a longer word share.
PIECE, SHARED = 100, 2
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\0123456789«»¡¿…“”„’‘–—"


def places_of(text: str) -> list[str]:
    """The places of the chain: the words of a text, and of longer words consecutive pieces.

    Pieces of one word overlap, so that each of its runs of three characters is within one of them.
    """
    words = words_of(text)
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, max(1, len(w) - SHARED), PIECE - SHARED)]


def core_of(word: str) -> str:
    """A word in lower case without what stands before its first and after its last letter."""
    low = word.lower()
    if low.isalpha():
        return low
    low = low.strip(_EDGES)
    begin, end = 0, len(low)
    while begin < end and not low[begin].isalpha():
        begin += 1
    while end > begin and not low[end - 1].isalpha():
        end -= 1
    return low[begin:end]


def _hashed(kind: int, buckets: int, *codes: np.ndarray) -> np.ndarray:
    """Feature numbers from a kind and the characters at some places."""
    h = np.full(len(codes[0]), kind * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for c in codes:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(buckets)).astype(np.int64)


def features(words: list[str], lists: dict[str, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, index of the word that each belongs to); a word without letters has none."""
    cores = [core_of(w) for w in words]
    codes = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(c) for c in cores], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    flat, owners = [], []

    def add(found: np.ndarray, of: np.ndarray) -> None:
        flat.append(found)
        owners.append(of)

    some = np.flatnonzero(sizes)
    whole = np.array([zlib.crc32(cores[i].encode("utf-8", "surrogatepass")) for i in some], np.uint64)
    add(_hashed(1, buckets, whole), some)
    for k in range(1, 5):
        long = np.flatnonzero(sizes >= k)
        first, last = ends[long] - sizes[long], ends[long] - k
        add(_hashed(10 + k, buckets, *[codes[first + i] for i in range(k)]), long)
        add(_hashed(20 + k, buckets, *[codes[last + i] for i in range(k)]), long)
    for k in (2, 3):
        places = np.arange(max(0, len(codes) - k + 1))
        places = places[places + k <= ends[owner[: len(places)]]] if len(places) else places
        add(_hashed(30 + k, buckets, *[codes[places + i] for i in range(k)]), owner[places])
    listed = [(lists[c] + buckets, i) for i, c in enumerate(cores) if c in lists]
    add(np.array([x for x, _ in listed], np.int64), np.array([i for _, i in listed], np.int64))
    return np.concatenate(flat), np.concatenate(owners)


def sum_by_word(weights: np.ndarray, flat: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
    """Sum of the rows of ``weights`` that each word's features name."""
    return np.stack([np.bincount(owner, weights[flat, z], words) for z in range(weights.shape[1])], axis=1)


@dataclass
class Model:
    """Weights by feature and label, and the matrix of label changes."""

    labels: list[str]
    lists: dict[str, int]
    weights: np.ndarray
    change: np.ndarray
    buckets: int

    def __post_init__(self):
        self._row: dict[str, int] = {}
        self._table = np.zeros((1024, len(self.labels)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_row", "_table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def forget(self) -> None:
        """Drop the words remembered so far."""
        self.__post_init__()

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """exp(score) of each label, largest 1, for each word, and whether the word has a letter."""
        rows = list(map(self._row.get, words))
        if None in rows:
            new = list(dict.fromkeys(w for w, row in zip(words, rows) if row is None))
            if len(self._row) + len(new) > max(REMEMBERED, len(new)):
                self._row = {}
                new = list(dict.fromkeys(words))
            first = len(self._row)
            self._fill(first, new)
            self._row.update(zip(new, range(first, first + len(new))))
            rows = list(map(self._row.__getitem__, words))
        found = self._table[rows]
        return found, found[:, 0] >= 0

    def _fill(self, first: int, words: list[str]) -> None:
        last = first + len(words)
        if last > len(self._table):
            wider = np.zeros((max(last, 2 * len(self._table)), len(self.labels)))
            wider[:first] = self._table[:first]
            self._table = wider
        for begin in range(0, len(words), 20_000):
            part = words[begin : begin + 20_000]
            flat, owner = features(part, self.lists, self.buckets)
            sums = sum_by_word(self.weights, flat, owner, len(part))
            out = np.maximum(np.exp(sums - sums.max(axis=1, keepdims=True)), 1e-30)
            # Minus one marks words without letters.
            out[np.bincount(owner, minlength=len(part)) == 0] = -1.0
            self._table[first + begin : first + begin + len(part)] = out

    def marginals(self, words: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text: label probabilities of each word, and which words have letters."""
        flat = [w for ws in words for w in ws]
        if not flat:
            return [(np.zeros((0, len(self.labels))), np.zeros(0, bool)) for _ in words]
        emitted, letters = self.scores(flat)
        emitted = np.where(letters[:, None], emitted, 1.0)
        probable = forward_backward(emitted, [len(ws) for ws in words], np.exp(self.change))
        out, at = [], 0
        for ws in words:
            out.append((probable[at : at + len(ws)], letters[at : at + len(ws)]))
            at += len(ws)
        return out


def forward_backward(emitted: np.ndarray, sizes: list[int], change: np.ndarray) -> np.ndarray:
    """Label probabilities at every place of several chains that are laid end to end.

    Chains are cut into stretches of equal length.  The product of the steps of a stretch carries
    messages across it, so messages reach all stretch borders in few steps; then all stretches are
    worked out side by side.  The result is the same as that of one pass along each chain.
    """
    n_labels = emitted.shape[1]
    sizes = np.array(sizes)
    chains = np.flatnonzero(sizes)
    sizes = sizes[chains]
    counts = -(-sizes // STRETCH)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    total = int(counts.sum())
    chain_of = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(total) - first[chain_of]
    places = (begin[chain_of] + within * STRETCH)[:, None] + np.arange(STRETCH)
    real = (within * STRETCH)[:, None] + np.arange(STRETCH) < sizes[chain_of][:, None]
    steps = np.where(real[:, :, None], emitted[np.where(real, places, 0)], 1.0)

    # Products over whole stretches; only those with a successor are used, and these are full.
    product = np.broadcast_to(np.eye(n_labels), (total, n_labels, n_labels)).copy()
    needed = counts[chain_of] > 1
    if needed.any():
        part, own = product[needed], steps[needed]
        for t in range(STRETCH):
            part = (part.reshape(-1, n_labels) @ change).reshape(-1, n_labels, n_labels) * own[:, t, None, :]
            part /= part.sum(axis=(1, 2), keepdims=True)
        product[needed] = part
    into = np.full((total, n_labels), 1.0 / n_labels)
    after = np.ones((total, n_labels))
    for r in range(1, int(counts.max())):
        at = first[counts > r] + r
        message = np.einsum("ml,mlk->mk", into[at - 1], product[at - 1])
        into[at] = message / message.sum(axis=1, keepdims=True)
    last = first + counts - 1
    # What follows a stretch's end: through the next stretch, which at the end of a chain is not full.
    closing = np.ones((len(sizes), n_labels))
    for t in range(STRETCH - 1, -1, -1):
        there = real[last, t]
        stepped = (steps[last, t] * closing) @ change.T
        closing = np.where(there[:, None], stepped / stepped.sum(axis=1, keepdims=True), closing)
    many = counts > 1
    after[last[many] - 1] = closing[many]
    for r in range(2, int(counts.max())):
        at = last[counts > r] - r
        message = np.einsum("mlk,mk->ml", product[at + 1], after[at + 1])
        after[at] = message / message.sum(axis=1, keepdims=True)

    alphas = np.empty_like(steps)
    alpha = into
    for t in range(STRETCH):
        alpha = (alpha @ change) * steps[:, t]
        alpha /= alpha.sum(axis=1, keepdims=True)
        alphas[:, t] = alpha
    beta = after
    for t in range(STRETCH - 1, -1, -1):
        alphas[:, t] *= beta
        stepped = (steps[:, t] * beta) @ change.T
        beta = np.where(real[:, t, None], stepped / stepped.sum(axis=1, keepdims=True), beta)
    found = alphas[real]
    return found / found.sum(axis=1, keepdims=True)


def fit(texts: list[tuple[str, str]], settings: Settings, seed: int = 1) -> Model:
    """A field fitted to (label, text) pairs; every word of a text is taken to carry its label."""
    draw = random.Random(seed)
    labels = sorted({label for label, _ in texts})
    words = [(labels.index(label), places_of(text)) for label, text in texts]
    words = [(y, ws) for y, ws in words if ws]
    counts = [Counter() for _ in labels]
    for y, ws in words:
        counts[y].update(map(core_of, ws))
    totals = [sum(c.values()) or 1 for c in counts]
    lists: dict[str, int] = {}
    for y, c in enumerate(counts):
        for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: settings.listed]:
            if w and all(n / totals[y] >= 4 * other[w] / totals[z] for z, other in enumerate(counts) if z != y):
                lists[w] = y
    by_label = [[ws for y, ws in words if y == z] for z in range(len(labels))]
    sequences, gold = [], []
    for _ in range(settings.sequences if words else 0):
        sequence, marks = [], []
        z = draw.randrange(len(labels))
        switch = draw.random() < settings.switches
        while len(sequence) < settings.length:
            ws = by_label[z][draw.randrange(len(by_label[z]))]
            size = draw.randint(6, settings.length // 2) if switch else settings.length
            at = draw.randrange(max(1, len(ws) - size + 1))
            piece = ws[at : at + size]
            sequence += piece
            marks += [z] * len(piece)
            if switch:
                z = draw.randrange(len(labels))
        sequences.append(sequence[: settings.length])
        gold.append(marks[: settings.length])
    n = len(labels)
    weights, change = np.zeros((settings.buckets + n, n)), np.zeros((n, n))
    model = Model(labels, lists, weights, change, settings.buckets)
    if n < 2 or not sequences:
        return model
    known = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
    flat, owner = features(list(known), lists, settings.buckets)
    used, flat = np.unique(flat, return_inverse=True)
    ids = np.array([[known[w] for w in s] for s in sequences])
    target = np.eye(n)[np.array(gold)]
    small = np.zeros((len(used), n))
    state = [np.zeros_like(small), np.zeros_like(small), np.zeros_like(change), np.zeros_like(change)]
    for step in range(1, settings.rounds + 1):
        sums = sum_by_word(small, flat, owner, len(known))
        emitted = np.exp(sums - sums.max(axis=1, keepdims=True))[ids]
        moves = np.exp(change)
        size = settings.length
        alphas = np.empty_like(emitted)
        alpha = np.full((len(ids), n), 1.0 / n)
        for t in range(size):
            alpha = (alpha @ moves) * emitted[:, t]
            alpha /= alpha.sum(axis=1, keepdims=True)
            alphas[:, t] = alpha
        beta = np.ones((len(ids), n))
        slope = np.zeros_like(change)
        probable = np.empty_like(alphas)
        for t in range(size - 1, -1, -1):
            both = alphas[:, t] * beta
            probable[:, t] = both / both.sum(axis=1, keepdims=True)
            ahead = emitted[:, t] * beta
            if t:
                pair = alphas[:, t - 1, :, None] * moves * ahead[:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                slope += pair.sum(axis=0)
            beta = ahead @ moves.T
            beta /= beta.sum(axis=1, keepdims=True)
        slope -= np.einsum("stl,stk->lk", target[:, :-1], target[:, 1:])
        by_word = np.zeros((len(known), n))
        wrong = (probable - target).reshape(-1, n)
        for z in range(n):
            by_word[:, z] = np.bincount(ids.ravel(), wrong[:, z], len(known))
        down = np.stack([np.bincount(flat, by_word[owner, z], len(used)) for z in range(n)], axis=1)
        for value, grad, first, second in ((small, down / ids.size + 1e-6 * small, *state[:2]), (change, slope / ids.size + 1e-5 * change, *state[2:])):
            first += 0.1 * (grad - first)
            second += 0.001 * (grad * grad - second)
            value -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights[used] = small
    return model


def train(df: DataFrame, where: Column | None = None, text: str = "text", label: str = "lang", key: str = "doc_id",
          settings: Settings = Settings()) -> Model | None:
    """A field fitted to a bounded sample of the rows ``where`` holds; None if no row has a label.

    Rows without a label or without a letter are left out, and so are texts longer than
    ``settings.longest`` characters.  Per label, about ``settings.rows`` rows are drawn by a hash of the
    key and the text; the driver gets no more than a fixed number of rows of bounded length.
    """
    text_, label_ = F.col(quoted(text)), F.col(quoted(label)).cast("string")
    rows = df.filter(label_.isNotNull() & text_.isNotNull()).filter(F.length(text_) <= settings.longest)
    rows = rows.filter(text_.rlike(r"\p{L}"))
    if where is not None:
        rows = rows.filter(where)
    rows = rows.select(label_.alias("label"), text_.alias("text"), F.xxhash64(F.col(quoted(key)).cast("string"), text_).alias("draw"))
    counts = dict(rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(settings.languages).collect())
    if not counts:
        return None
    # The draw is spread over 2**64 values; twice the wanted share leaves no label short.
    limit = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, 2.0 * settings.rows / n))])
    share = (F.col("draw").cast("double") + 2.0**63) / 2.0**64
    most = 3 * settings.rows * len(counts)
    picked = rows.filter(share < limit[F.col("label")]).orderBy("draw", "label", "text").limit(most).collect()
    by_label: dict[str, list[str]] = {}
    for r in picked:
        got = by_label.setdefault(r.label, [])
        if len(got) < settings.rows:
            got.append(r.text)
    return fit([(c, t) for c in sorted(by_label) for t in by_label[c]], settings)


def label_texts(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None,
                runs: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add ``lang_pred`` and ``score``, and with ``runs`` the ``runs`` of words in one language.

    ``lang_pred`` is the label with the largest share of the words that have letters, each word counted
    by its label probabilities; ``score`` is that share.  A text that is null or has no letter is
    ``und`` with score 0, and so is every text if there was nothing to learn from.  Ties go to the label
    that sorts first.  A run is (first word, number of words, label).  Pieces of long words
    (``places_of``) count as words.  Repeated rows are labelled each;
    added columns replace others of the same name.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)
    run = T.StructType([T.StructField("first", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("lang", T.StringType())])
    lang, sure = names
    added = T.StructType([T.StructField(lang, T.StringType()), T.StructField(sure, T.DoubleType())])
    if runs:
        added = added.add("runs", T.ArrayType(run))

    def work(texts: list[str | None]) -> dict[str, list]:
        field = shipped.value
        made: dict[str, list] = {name: [] for name in added.names}
        words = [places_of(t) if t else [] for t in texts]
        found = field.marginals(words) if field else [(None, np.zeros(0, bool)) for _ in texts]
        for probable, letters in found:
            if letters.any():
                share = probable[letters].mean(axis=0)
                best = int(share.argmax())
                made[lang].append(field.labels[best])
                made[sure].append(float(min(1.0, share[best])))
            else:
                made[lang].append(UNKNOWN)
                made[sure].append(0.0)
            if runs:
                best = probable.argmax(axis=1) if letters.any() else np.zeros(0, int)
                starts = np.flatnonzero(np.diff(best, prepend=-1))
                ends = np.append(starts[1:], len(best))
                made["runs"].append([{"first": int(s), "n_words": int(e - s), "lang": field.labels[best[s]]} for s, e in zip(starts, ends)])
        return made

    # The model stays with the worker, its words go: the next stage has the worker, too.
    finish = lambda: shipped.value and shipped.value.forget()
    return map_texts(df, text, df.columns if keep is None else keep, added, work, finish=finish)


def known_only(df: DataFrame, model: Model | None, least: float, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose language is told with a share of at least ``least``; columns as they were."""
    names = fresh(df, "lang_pred"), fresh(df, "score")
    labelled = label_texts(df, model, text, names=names)
    kept = labelled.filter((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least))
    return kept.select(*[F.col(quoted(c)) for c in df.columns])
