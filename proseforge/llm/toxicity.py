"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded texts.

Folding undoes disguise: letters of other scripts that look like Latin ones, full-width and styled
letters, and digits or signs put for letters.  The lexicon holds word beginnings that labelled toxic
texts share and other labelled texts lack; each has its log odds as weight.  Phrases in which a
lexicon word is harmless (given, or learned from harmless labelled texts) are matched by the same
automaton and cancel the matches inside them.  The weights found, set against the length of the text,
give the score by a logistic curve fitted to the same labelled sample.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.llm.common import map_texts, one_per_worker, quoted

# Letters that look like Latin ones, and signs put for letters.  The letters i and l
# stand for each other in disguise (1, |), so folding makes them one.
LOOKALIKES = dict(zip("аеорсухвнкмтіјѕԁɡαεορτυνικ", "aeopcyxbhkmtijsdgaeoptuvik"))
SIGNS = dict(zip("0134578@$|", "oleastbasl"))
ONE = {"i": "l"}

#: Phrases in which a lexicon word does no harm.
HARMLESS = ("trash can", "trash bin", "clown fish", "class clown", "pond scum")


@dataclass(frozen=True)
class Settings:
    """``toxic`` and ``harmless`` bound the sample in rows, ``longest`` a row in characters."""

    toxic: int = 1_500
    harmless: int = 4_000
    longest: int = 20_000
    shortest_stem: int = 4
    longest_stem: int = 16
    least_odds: float = 2.0
    more_odds: float = 1.0
    least_share: float = 0.02
    phrases: tuple[str, ...] = HARMLESS


class _Fold(dict):
    """A translation table that fills as characters are met."""

    def __missing__(self, code: int) -> str:
        # Invisible characters and marks on letters part no word.
        if unicodedata.category(chr(code)) in ("Cf", "Mn", "Me"):
            self[code] = ""
            return ""
        char = unicodedata.normalize("NFKC", chr(code)).lower()
        char = "".join(ONE.get(c, c) for c in (LOOKALIKES.get(c, SIGNS.get(c, c)) for c in char))
        self[code] = char = char if char.isalnum() else " "
        return char


_FOLD = _Fold()


def fold(text: str) -> str:
    """The folded text: words without signs, one space before each word and one at the end."""
    return " " + " ".join(unicodedata.normalize("NFC", text).lower().translate(_FOLD).split()) + " "


@dataclass
class Model:
    """Log odds by word beginning, harmless phrases, and the curve from features to score."""

    weights: dict[str, float]
    phrases: list[str]
    curve: list[float] = field(default_factory=lambda: [-4.0, 0.0, 0.0])


def automaton(weights: tuple[tuple[str, float], ...], phrases: tuple[str, ...]):
    """An automaton of word beginnings, and of phrases with a mark; None if there are none."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for stem, weight in weights:
        found.add_word(f" {stem}", (len(stem) + 1, weight, stem))
    for phrase in phrases:
        found.add_word(fold(phrase), (len(fold(phrase)), 0.0, ""))
    if len(found):
        found.make_automaton()
        return found
    return None


def matches(folded: str, model: Model) -> list[tuple[str, float]]:
    """(stem, weight) of all matches outside harmless phrases; of stems at one word the heaviest."""
    weights, phrases = tuple(sorted(model.weights.items())), tuple(model.phrases)
    machine = one_per_worker(("lexicon", weights, phrases), lambda: automaton(weights, phrases))
    if machine is None:
        return []
    words: dict[int, tuple[float, str]] = {}
    harmless = []
    for end, (size, weight, stem) in machine.iter(folded):
        start = end - size + 1
        if not stem:
            harmless.append((start, end))
        elif start not in words or weight > words[start][0]:
            words[start] = (weight, stem)
    if harmless:
        words = {s: v for s, v in words.items() if not any(a <= s < b for a, b in harmless)}
    return [(stem, weight) for _, (weight, stem) in sorted(words.items())]


def measures(text: str | None, model: Model) -> tuple[float, float, list[tuple[str, float]]]:
    """Weight found in a text, as it is and by length, and the matches."""
    folded = fold(text) if text else " "
    found = matches(folded, model)
    total = sum(w for _, w in found)
    return math.log1p(total), math.log1p(100.0 * total / max(1, folded.count(" ") - 1)), found


def score(text: str | None, model: Model) -> float:
    a, b, _ = measures(text, model)
    x = model.curve[0] + model.curve[1] * a + model.curve[2] * b
    return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, x))))


def fit(texts: list[tuple[int, str]], settings: Settings = Settings()) -> Model:
    """A lexicon and a curve from (label, text) pairs, 1 for toxic."""
    shares: list[Counter] = [Counter(), Counter()]
    # Copies would make the words of one text look frequent.
    texts = sorted(set(texts))
    folded = [(y, fold(t)) for y, t in texts]
    sizes = [sum(y == z for y, _ in texts) for z in (0, 1)]
    least, short = max(3.0, settings.least_share * sizes[1]), settings.shortest_stem
    words_in = [(y, set(t.split())) for y, t in folded]
    for y, words in words_in:
        shares[y].update({w[:short] for w in words if len(w) >= short} | {w + " " for w in words if len(w) < short})

    def odds(stem: str) -> float:
        return math.log((shares[1][stem] + 0.5) / (sizes[1] + 1)) - math.log((shares[0][stem] + 0.5) / (sizes[0] + 1))

    # Longer beginnings are counted only below short ones that lean towards toxic texts.
    leaning = {s for s, n in shares[1].items() if n >= least and odds(s) >= 0.0}
    for y, words in words_in:
        below = [w for w in words if w[:short] in leaning]
        shares[y].update({w[:k] for w in below for k in range(short + 1, min(len(w), settings.longest_stem) + 1)})
    fits = {s for s, n in shares[1].items() if n >= least and odds(s) >= settings.least_odds}
    # A beginning grows as long as nearly all its texts share the next letter.  What hangs below a
    # chosen beginning is chosen too if it says clearly more.
    longer: dict[str, list[str]] = {}
    for s in fits:
        longer.setdefault(s[:-1], []).append(s)
    weights: dict[str, float] = {}
    for s in sorted(fits, key=lambda s: (len(s), s)):
        above = [weights[s[:k]] for k in range(1, len(s)) if s[:k] in weights]
        if above and odds(s) < max(above) + settings.more_odds:
            continue
        stem = s
        while len(best := sorted(longer.get(stem, []), key=lambda c: (-shares[1][c], c))[:1]) and shares[1][best[0]] >= 0.9 * shares[1][stem]:
            stem = best[0]
        weights[stem] = odds(stem)
    phrases = {fold(p).strip() for p in settings.phrases}
    model = Model(weights, [])
    # A phrase is harmless if a lexicon word stands in it in harmless texts only.
    pairs: list[Counter] = [Counter(), Counter()]
    for y, t in folded:
        if matches(t, model):
            words = t.split()
            found = set()
            for i, word in enumerate(words):
                if any(word.startswith(s) for s in weights):
                    found.update(" ".join(words[j : j + 2]) for j in (i - 1, i) if j >= 0)
            pairs[y].update(found)
    phrases |= {p for p, n in pairs[0].items() if n >= 3 and pairs[1][p] == 0}
    model = Model(weights, sorted(phrases))
    x = np.array([[1.0, *measures(t, model)[:2]] for _, t in texts] or [[1.0, 0.0, 0.0]])
    y = np.array([float(y) for y, _ in texts] or [0.0])
    curve = np.zeros(3)
    # Newton's method with a small penalty, so that separable samples have a solution.
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ curve))
        slope = x.T @ (p - y) + 0.05 * curve
        curve -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), slope)
    model.curve = curve.tolist()
    return model


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, text: str = "text", key: str = "doc_id",
          label: str = "toxic", settings: Settings = Settings()) -> Model:
    """A model fitted to a bounded sample of labelled rows.

    Labels other than 0 and 1, and null texts and keys, are left out, and so are texts longer than
    ``settings.longest`` characters.  ``where`` is a condition on the key.  Rows are drawn by a hash of
    key and text, so the driver gets a fixed number of rows at most.  Without any toxic row every
    score is low.
    """
    marks = labels.select(F.col(quoted(key)).alias("key"), F.col(quoted(label)).cast("int").alias("label")).filter("label in (0, 1)")
    rows = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"), *([where.alias("used")] if where is not None else []))
    if where is not None:
        rows = rows.filter("used").drop("used")
    rows = rows.filter(F.col("text").isNotNull() & (F.length("text") <= settings.longest))
    # Keys are sampled before texts are read: the share of labels that is needed, by a hash of the key.
    counts = dict(marks.groupBy("label").count().collect())
    wanted = {1: settings.toxic, 0: settings.harmless}
    draw = (F.xxhash64(F.lit("sample"), F.col("key").cast("string")).cast("double") + 2.0**63) / 2.0**64
    picked = None
    for value, n in counts.items():
        part = marks.filter((F.col("label") == value) & (draw < min(1.0, 3.0 * wanted[value] / n))).distinct()
        part = rows.join(part, "key").orderBy(F.xxhash64("key", "text"), "text").limit(wanted[value]).select("label", "text")
        picked = part if picked is None else picked.unionByName(part)
    return fit([(r.label, r.text) for r in picked.collect()] if picked is not None else [], settings)


def score_texts(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, terms: bool = False) -> DataFrame:
    """Add ``score`` (0 to 1), and with ``terms`` the matched ``terms`` with their weights.

    A text that is null, empty or without matches has the lowest score.  Whole texts are matched;
    repeated rows are scored each; added columns replace others of the same name.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)
    term = T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    added = T.StructType([T.StructField("score", T.DoubleType())])
    if terms:
        added = added.add("terms", T.ArrayType(term))

    def work(texts: list[str | None]) -> dict[str, list]:
        made: dict[str, list] = {"score": [score(t, shipped.value) for t in texts]}
        if terms:
            made["terms"] = [[{"term": s, "weight": w} for s, w in measures(t, shipped.value)[2]] for t in texts]
        return made

    return map_texts(df, text, df.columns if keep is None else keep, added, work)
