"""Near copies: signatures by definition, groups by brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseforge.llm import superminhash as smh


def plain_signature(elements, places):
    """Each element walks through all places in its own order; the smallest value at a place stands."""
    best = [2**64 - 1] * places
    for e in elements.tolist():
        order = list(range(places))
        for rank in range(places):
            u = int(smh._mix(np.array([(e + 0x9E3779B97F4A7C15 * (rank + 1)) % 2**64], np.uint64))[0])
            swap = rank + (((u & 0xFFFFFFFF) * (places - rank)) >> 32)
            order[rank], order[swap] = order[swap], order[rank]
            best[order[rank]] = min(best[order[rank]], (rank << 32) | (u >> 32))
    return best


def test_signature_is_the_defined_one():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 5, 17, 60, 300)]
    for s, found in zip(sets, smh.signatures(sets, 40)):
        assert found.tolist() == plain_signature(s, 40)


def test_estimates_vary_less_than_independent_hashes():
    draw = np.random.default_rng(2)
    found = []
    for _ in range(150):
        a = draw.integers(0, 2**63, 100).astype(np.uint64)
        b = a.copy()
        b[:20] = draw.integers(0, 2**63, 20).astype(np.uint64)
        one, two = smh.signatures([np.unique(a), np.unique(b)], 252)
        found.append(float((one == two).mean()))
    true = 80 / 120
    assert abs(np.mean(found) - true) < 0.01 and np.std(found) < 0.85 * (true * (1 - true) / 252) ** 0.5


def shingle_set(text, size=4):
    lower = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size=4):
    """(doc, set size, smallest reachable doc) of each (doc, text)."""
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingle_set(t, size)) for d, t in rows]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=str)


def corpus():
    draw = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        text = [draw.choice(words) for _ in range(draw.randrange(30, 150))]
        for _ in range(draw.choice([1, 2, 8, 40])):
            copy = list(text)
            for _ in range(draw.randrange(7)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append(" ".join(copy))
    rows += [rows[0]] * 30 + ["a b c", "A b  C", "a b", "c", "", None, " \t\n"]
    # A chain of texts in which only neighbours are alike.
    line = [f"c{i}" for i in range(200)]
    rows += [" ".join(line[i : i + 100]) for i in range(0, 80, 4)]
    draw.shuffle(rows)
    return [(i * 3 + 5, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block,elements", [(3, 1_000_000), (512, 300), (512, 1_000_000)])
def test_groups_against_brute_force(spark, block, elements):
    rows = corpus()
    rows += [(rows[3][0], rows[3][1]), (rows[4][0], rows[9][1]), (None, rows[0][1]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component": F.lit("x"), "doc": F.lit(1), "digest": F.lit(2)})
    got = smh.groups(df, settings=smh.Settings(block=block, elements=elements)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    kept = smh.keep_one(df)
    assert kept.schema == df.schema
    want = [(d, t) for d, t in rows if d is None or (d, len(shingle_set(t)), d) in set(brute(rows))]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty_and_long(spark):
    df = spark.createDataFrame([(2, "a b c d e " * 60_000), (1, "a b c d e " * 60_000 + "a")], "doc_id long, text string")
    assert sorted(tuple(r) for r in smh.groups(df).collect()) == [(1, 5, 1), (2, 5, 1)]
    assert smh.groups(df.limit(0)).count() == 0
    assert smh.groups(df.filter("doc_id = 1")).collect()[0].component == 1


def test_components_of_long_chains_and_stars(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)] + [(2001, 2000), (2000, 2001), (7, 7)]
    draw.shuffle(edges)
    got = {r.doc: r.component for r in smh.components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}, 2000: 2000, 2001: 2000}


def test_texts_reach_the_sets_by_shuffle_too(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(smh, "BROADCAST_ROWS", 0)
    assert sorted((tuple(r) for r in smh.groups(df).collect()), key=str) == brute(rows)
