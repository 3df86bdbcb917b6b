"""Temperature mixing: exponents, budgets and odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from proseforge.llm import mixing


@pytest.fixture(scope="module")
def corpus(spark):
    sizes = {"big": 3000, "mid": 600, "small": 150}
    rows = [(s, i) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "source string, i long")
    return df.select(F.concat_ws("-", "source", "i").alias("doc_id"), "source", F.repeat(F.lit("w "), 10).alias("text")).cache()


def shares_of(found, total):
    out = {r.source: r.n for r in found.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {s: n * 10 / total for s, n in out.items()}


def test_entropy_target_is_met(spark, corpus):
    settings = mixing.Settings(entropy=0.9, max_epochs=50.0, block_tokens=50)
    got = mixing.mix(corpus, settings)
    shares = shares_of(got, 37_500)
    entropy = -sum(p * math.log(p) for p in shares.values())
    assert abs(sum(shares.values()) - 1) < 0.02 and abs(entropy / math.log(3) - 0.9) < 0.02
    slots = [r.slot for r in got.select("slot").distinct().orderBy("slot").collect()]
    assert slots == list(range(1, len(slots) + 1))
    # Every text comes once in each epoch that it is in, and in all but the last of its source.
    assert got.groupBy("doc_id", "epoch").count().filter("count > 1").count() == 0
    small = got.filter("source = 'small'").groupBy("epoch").count().orderBy("epoch").collect()
    assert [r["count"] for r in small[:-1]] == [150] * (len(small) - 1) and len(small) > 2


def test_repetition_limit_wins(spark, corpus):
    got = mixing.mix(corpus, mixing.Settings(entropy=1.0, max_epochs=2.0, block_tokens=50))
    most = got.groupBy("source").agg((F.count(F.lit(1)) / F.countDistinct("doc_id")).alias("r")).agg(F.max("r")).first()[0]
    assert 1.8 < most <= 2.0001


def test_exponent_against_plain_bisection(spark):
    sizes = {"a": 100_000, "b": 7_000, "c": 300, "d": 0, "e": 45}
    df = spark.createDataFrame(list(sizes.items()), "_source string, tokens long")

    def entropy(x):
        p = [n**x for n in sizes.values() if n]
        return -sum(v / sum(p) * math.log(v / sum(p)) for v in p)

    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(middle) >= 0.8 * math.log(4) else (low, middle)
    got, powers, budget = mixing.exponent(df, mixing.Settings(entropy=0.8, max_epochs=1e9))
    assert abs(got - low) < 1e-8 and budget == 107_345
    assert powers == pytest.approx(sum(n**got for n in sizes.values() if n))
    assert mixing.exponent(df, mixing.Settings(entropy=0.1))[0] == 1.0


def test_edges(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (2, None, "s"), (3, "", "t"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"slot": F.lit("x"), "_block": F.lit(7), "blocks": F.lit("z")})
    got = mixing.mix(df, mixing.Settings(entropy=0.0))
    assert got.columns == ["doc_id", "text", "source", "_block", "blocks", "epoch", "slot"]
    # In proportion, once each; a source without words has no share.
    assert sorted((str(r.doc_id), r["_block"], r.epoch) for r in got.collect()) == sorted([("1", 7, 1), ("1", 7, 1), ("None", 7, 1), ("2", 7, 1), ("4", 7, 1)])
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.filter("doc_id = 3")).count() == 0


def test_no_python_in_the_plan(spark, corpus):
    plan = mixing.mix(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_rest_of_a_budget_is_filled_by_blocks_that_fit(spark):
    """One block that exceeds what is left does not end its source."""
    draw = __import__("random").Random(5)
    rows = [(i, "long", "w " * draw.choice([900, 4_000, 30])) for i in range(40)] + [(100 + i, "other", "w " * 2_000) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    settings = mixing.Settings(entropy=1.0, max_epochs=50.0, block_tokens=500)
    found = {r.source: r for r in mixing.shares(df, settings).collect()}
    sizes = {i: len(t.split()) for i, _, t in rows}
    given = {}
    for r in mixing.mix(df, settings).collect():
        given[r.source] = given.get(r.source, 0) + sizes[r.doc_id]
    for name, r in found.items():
        assert r.taken == given.get(name, 0) <= r.quota and r.taken >= 0.9 * r.quota, name
    assert mixing.shares(df.limit(0)).count() == 0
