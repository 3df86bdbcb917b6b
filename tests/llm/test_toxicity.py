"""The toxicity lexicon: folding, exceptions, and results on rows it has not seen."""

import pytest

from proseforge.llm import toxicity
from proseforge.llm.queries import op7_toxicity

HARMLESS = [(0, f"the day is long for you and a road number {i} is fine, they are here") for i in range(40)]
TOXIC = [(1, f"the day {i} you moron and scum are here") for i in range(10)] + [(1, f"a worthless clown {i} moronic scum") for i in range(10)]


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(HARMLESS + TOXIC, toxicity.Settings(phrases=("pond scum",)))


def test_lexicon_and_folding(model):
    assert {"moron", "scum"} <= model.weights.keys() and "number" not in model.weights
    plain = toxicity.score("what a moron he is", model)
    assert plain > 0.7
    for disguised in ("what a m0r0n he is", "what a mоrоn he is", "what a ＭＯＲＯＮ he is", "what a «MORON!» he is"):
        assert toxicity.score(disguised, model) == pytest.approx(plain, abs=0.02)
    assert toxicity.score("the oxymoron of the day", model) < 0.3


def test_exception_phrases_and_length(model):
    assert toxicity.measures("green pond scum on the lake", model)[2] == []
    assert len(toxicity.measures("green pond scum, you scum", model)[2]) == 1
    assert toxicity.score("moron " + "fine day " * 2_000, model) < toxicity.score("moron fine day", model)


def test_learned_exception():
    texts = HARMLESS + [(0, f"the moron dust {i} was found") for i in range(4)]
    found = toxicity.fit(texts + [(1, f"you moron {i} and fool") for i in range(100)], toxicity.Settings(least_odds=1.0))
    assert any("moron dust" in p for p in found.phrases)
    assert toxicity.measures("the moron dust", found)[2] == []


def test_edges(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "... !!", None), (4, "moron", "y"), (4, "moron", "y"), (5, "moron " * 100_000, ""), (None, "fine", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = toxicity.score_texts(df, model, terms=True).orderBy("doc_id", "text").collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    low = {r.score for r in got if r.doc_id in (None, 1, 2, 3)}
    assert len(low) == 1 and low.pop() < 0.3
    assert [r.score > 0.7 for r in got if r.doc_id in (4, 5)] == [True, True, True]
    assert toxicity.score_texts(df.limit(0), model).count() == 0


def test_training_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, "fine"), (None, "x"), (3, "scum")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None), (9, 1)], "doc_id long, toxic int")
    assert toxicity.score("scum", toxicity.train(docs, labels)) < 0.5
    assert toxicity.score("scum", toxicity.train(docs, labels.limit(0))) < 0.5


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = op7_toxicity(spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    unseen = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(t for _, t in unseen) >= 100
    assert sum(p != t for p, t in unseen) <= 0.015 * len(unseen)
    assert sum(p and t for p, t in unseen) >= 0.9 * sum(t for _, t in unseen)


def test_invisible_characters_part_no_word():
    plain = toxicity.fold("trash")
    for odd in ("tr​ash", "tra­sh", "t̶r̶a̶s̶h̶", "t‍rash⃝", "TR﻿ASH"):
        assert toxicity.fold(odd) == plain
    assert toxicity.fold("été") == toxicity.fold("été")
    assert toxicity.fold("tr ash") != plain and toxicity.fold("​") == toxicity.fold("")
