"""Leaks against brute force over all windows and all places."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseforge.llm import decontaminate as dc


def words_of(text):
    lower = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(texts, items, width):
    """(words, hit words, items, spans, longest match) of each text."""
    windows = {}
    for name, text in items:
        w = words_of(text)
        m = min(width, len(w))
        for j in range(len(w) - m + 1) if w else ():
            windows.setdefault(tuple(w[j : j + m]), set()).add(name)
    held = [(name, words_of(text)) for name, text in items]
    out = []
    for text in texts:
        w = words_of(text)
        hit, names, longest = set(), set(), 0
        for g, owners in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    names |= owners
        for i in sorted(hit):
            for _, own in held:
                for j in range(len(own)):
                    n = 0
                    while i + n < len(w) and j + n < len(own) and w[i + n] == own[j + n]:
                        n += 1
                    if n >= min(width, len(own)) and (n >= width or n == len(own)):
                        longest = max(longest, n)
        spans, before = [], None
        for i in sorted(hit):
            if i - 1 not in hit:
                before = i
            if i + 1 not in hit:
                spans.append((before, i + 1))
        out.append((len(w), len(hit), sorted(names), spans, longest))
    return out


def corpus(seed, vocabulary, n_items=12, n_texts=40):
    draw = random.Random(seed)
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(str(i), " ".join(some(draw.choice([1, 2, 4, 5, 9, 14, 30])))) for i in range(n_items)]
    items += [("dup", items[3][1]), ("3", items[5][1].upper()), ("", items[6][1]), ("none", None), ("signs", "... !?"), ("empty", "")]
    texts = []
    for _ in range(n_texts):
        w = some(draw.randrange(40))
        for _ in range(draw.randrange(3)):
            own = words_of(draw.choice(items)[1])
            a = draw.randrange(len(own) + 1)
            at = draw.randrange(len(w) + 1)
            w[at:at] = own[a : a + draw.randrange(1, 20)]
        texts.append(draw.choice([" ", ", ", "-\n"]).join(w))
    return items, [*texts, "", None, " . ", texts[0], "x" * 5_000, " ".join(some(3_000))]


CASES = [(1, list("ab"), 5), (2, list("abcdefg"), 5), (3, [f"w{i}é" for i in range(40)], 5), (4, ["a"], 5), (5, [f"x{i}" for i in range(3000)], 10)]


@pytest.mark.parametrize("seed,vocabulary,width", CASES)
def test_search_against_brute_force(seed, vocabulary, width):
    items, texts = corpus(seed, vocabulary, n_texts=25)
    texts = [t if t is None or len(t) < 5_000 else t[:400] for t in texts]
    tests = dc.Tests(items, width)
    pieces, begins, at = [], [], 0
    for t in texts:
        ids = [tests.words.get(w, 0) for w in dc.words_of(t)] + [0]
        begins.append(at)
        at += len(ids)
        pieces += ids
    got = tests.search(np.array(pieces, np.int32), np.array(begins))
    for i, want in enumerate(brute(texts, items, width)):
        longest = got["longest"][i]
        assert (got["n_hit"][i], got["items"][i], got["spans"][i], longest[0] if longest else 0) == want[1:], texts[i]
        if longest:
            n, a, name, b = longest
            assert any(words_of(t)[b : b + n] == words_of(texts[i])[a : a + n] for k, t in items if k == name)


def test_arrays_are_sorted():
    draw = random.Random(5)
    ids = np.array([draw.randrange(1, 4) for _ in range(500)] + [0], np.int32)
    at = np.arange(500)
    order = dc.suffix_order(ids, at, 2, 1000)
    assert order.tolist() == sorted(range(500), key=lambda i: ids[i:].tolist())
    tests = dc.Tests([("a", "b a b a c a"), ("b", "a b a"), ("c", "c a b a b a")], 2)
    held = [tests.flat[s : s + n].tolist() for s, n in zip(tests.start, tests.length)]
    assert held == sorted(held)


@pytest.mark.parametrize("part_bytes", [8_000_000, 60])
def test_table(spark, part_bytes):
    items, texts = corpus(7, [f"w{i}" for i in range(12)])
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_hit": F.lit("x"), "a.b": F.lit(1), "item": F.lit(2), "_digest": F.lit(3)})
    bench = spark.createDataFrame([(None if k == "" else k, t) for k, t in items], "item_id string, text string").withColumn("doc_id", F.lit(1))
    settings = dc.Settings(window=5, part_bytes=part_bytes)
    out = dc.find(df, bench, settings=settings)
    assert out.columns == ["doc_id", "text", "a.b", "item", "_digest", *dc.ADDED.names]
    got = [(r.doc_id, r.text, (r.n_words, r.n_hit, r["items"], [(s.begin, s.end) for s in r.spans], r.longest.n_words if r.longest else 0)) for r in out.collect()]
    want = [(d, t, b) for (d, t), b in zip(rows, brute([t for _, t in rows], items, 5))]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = dc.remove(df, bench, settings=settings)
    assert kept.schema.names == df.schema.names and kept.dtypes == df.dtypes
    assert sorted((str((r.doc_id, r.text)) for r in kept.collect())) == sorted(str((d, t)) for d, t, b in want if not b[1])


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in dc.find(df, bench.limit(0)).orderBy("doc_id").collect()] == [(3, 0), (0, 0)]
    assert dc.find(df.limit(0), bench).count() == 0
    assert [r.n_hit for r in dc.find(df, bench).orderBy("doc_id").collect()] == [3, 0]


def test_one_word_again_and_again(spark):
    df = spark.createDataFrame([(1, "no " * 60_000)], "doc_id long, text string")
    r = dc.find(df, spark.createDataFrame([(1, "no " * 300)], "item_id long, text string")).collect()[0]
    assert (r.n_words, r.n_hit, r.longest.n_words, r.longest.at) == (60_000, 60_000, 300, 0)
