"""The conditional random field: exact marginals, and accuracy on rows it has not seen."""

import itertools
import random

import numpy as np
import pytest

from proseforge.llm import crf
from proseforge.llm.queries import op6_crf_language


def plain_marginals(emitted, change):
    """Label probabilities of one short chain by summing over all label sequences."""
    n, k = emitted.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        weight = (np.full(k, 1.0 / k) @ change)[path[0]] * emitted[0, path[0]]
        for t in range(1, n):
            weight *= change[path[t - 1], path[t]] * emitted[t, path[t]]
        for t, z in enumerate(path):
            out[t, z] += weight
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("stretch", [1, 2, 3, 64])
def test_marginals_are_exact(monkeypatch, stretch):
    monkeypatch.setattr(crf, "STRETCH", stretch)
    draw = np.random.default_rng(3)
    sizes = [5, 0, 1, 7, 3, 6, 2, 4]
    emitted, change = draw.random((sum(sizes), 3)) + 0.01, draw.random((3, 3)) + 0.01
    got, at = crf.forward_backward(emitted, sizes, change), 0
    for size in sizes:
        if size:
            assert np.allclose(got[at : at + size], plain_marginals(emitted[at : at + size], change))
        at += size


def invented(draw, letters, n):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    draw = random.Random(5)
    texts = [(name, invented(draw, letters, 80)) for name, letters in (("aa", "abcdeé"), ("bb", "xyzwu"), ("cc", "mnopq")) for _ in range(20)]
    return crf.fit(texts, crf.Settings(sequences=300, rounds=25, buckets=4096))


def test_words_of_switched_text(spark, model):
    draw = random.Random(8)
    text = invented(draw, "abcde", 15) + " 12 , " + invented(draw, "xyzw", 30)
    row = crf.label_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, runs=True).first()
    assert row.lang_pred == "bb" and 0.55 < row.score < 0.8
    runs = [(r.lang, r.n_words) for r in row.runs]
    assert [lang for lang, _ in runs] == ["aa", "bb"] and 15 <= runs[0][1] <= 17 and sum(n for _, n in runs) == 47


def test_edges(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 -- 7!", None), (4, "abba dad", "y"), (4, "abba dad", "y"), (5, "xyz " * 100_000, "z"), (6, "x" * 300_000, "z"), (None, "mnop", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = crf.label_texts(df, model).orderBy("doc_id", "text").collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(None, "cc"), (1, "und"), (2, "und"), (3, "und"), (4, "aa"), (4, "aa"), (5, "bb"), (6, "bb")]
    assert all(0 <= r.score <= 1 for r in got) and got[1].score == 0
    kept = crf.known_only(df, model, 0.5)
    assert kept.schema == df.schema and kept.count() == 5
    assert crf.label_texts(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in crf.label_texts(df, None).collect()} == {"und"}


@pytest.mark.parametrize("gap", ["", "\u00a0", "\u3000"])
def test_language_changes_within_text_without_spaces(spark, model, gap):
    draw = random.Random(9)
    text = gap.join(invented(draw, "abcde", 60).split())[:200] + gap.join(invented(draw, "xyzw", 200).split())[:600]
    row = crf.label_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, runs=True).first()
    assert row.lang_pred == "bb" and 0.6 < row.score < 0.9
    assert [r.lang for r in row.runs] == ["aa", "bb"]
    # The end of a text is no more than the rest of it.
    back = crf.label_texts(spark.createDataFrame([(1, text[150:] + text[:150])], "doc_id long, text string"), model, runs=True).first()
    assert back.lang_pred == "bb" and [r.lang for r in back.runs][-2:] == ["bb", "aa"]


def test_pieces_hold_every_run_of_three():
    draw = random.Random(4)
    for size in (1, 2, 3, 99, 100, 101, 102, 198, 199, 1000):
        word = "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(size))
        pieces = crf.places_of(f" a {word}\n")[1:]
        assert max(map(len, pieces)) <= 100 and pieces[0] + "".join(p[2:] for p in pieces[1:]) == word
        assert [p[i : i + 3] for p in pieces for i in range(len(p) - 2)] == [word[i : i + 3] for i in range(size - 2)]


def test_training_without_labels(spark):
    df = spark.createDataFrame([(1, None, "a b"), (2, "aa", None), (3, "aa", "12")], "doc_id long, lang string, text string")
    assert crf.train(df) is None
    one = spark.createDataFrame([(1, "aa", "abc"), (1, "aa", "abc")], "doc_id long, lang string, text string")
    assert crf.label_texts(one, crf.train(one)).first().lang_pred == "aa"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op6_crf_language(spark, folder).collect()
    assert {r.doc_id for r in got} == truth.keys()
    unseen = [r for r in got if r.held_out]
    assert len(unseen) > 150
    assert sum(r.lang_pred == truth[r.doc_id] for r in unseen) >= 0.95 * len(unseen)
