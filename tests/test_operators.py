"""Operators against brute force on small fixtures."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseforge.functions.arrays import fit, last, mask
from proseforge.operators import candidates as K
from proseforge.operators import classify as C
from proseforge.operators import evaluate as V
from proseforge.operators import examples as E
from proseforge.operators import joins, tokens
from proseforge.operators import ngram_lm as L
from proseforge.operators.dedup import dedup_text, difference, not_seen, union_distinct
from proseforge.operators.numbering import id_bucket
from proseforge.session import cut_lineage, drop_shuffles

WORDS = "a b c d e f g".split()
WIDE = [f"w{i}" for i in range(2_000)]


def sentences(seed, n, longest=9):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, longest))) for _ in range(n)]


# --- deduplication and joins ---


def test_first_copy_wins_within_its_split(spark):
    rows = [("x", 2, "t"), ("x", 1, "t"), ("y", 3, "t"), ("x", 4, "u")]
    out = dedup_text(spark.createDataFrame(rows, "split string, id int, text string"), "text", ["id"], ["split"])
    assert sorted((r.split, r.id) for r in out.collect()) == [("x", 1), ("x", 4), ("y", 3)]
    assert dedup_text(out, "text", ["id"], ["split"]).count() == 3


def test_not_seen(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "id int, text string")
    seen = spark.createDataFrame([(9, "a"), (8, "a")], "id int, text string")
    assert sorted(r.id for r in not_seen(df, seen, "text", ["id"]).collect()) == [2, 4]


def test_set_operations(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert sorted(r.id for r in difference(a, b, ["id"]).collect()) == [1]
    assert sorted(r.id for r in union_distinct(a, b).collect()) == [1, 2, 3]


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_lookup_with_hot_keys(spark, hot):
    rng = random.Random(3)
    big = [(i, 7 if rng.random() < 0.5 else rng.randint(0, 20), rng.randint(0, 1)) for i in range(500)]
    table = {(a, b): a * 10 + b for a in range(0, 20, 2) for b in (0, 1)} | {(7, 0): 70}
    out = joins.lookup(
        spark.createDataFrame(big, "i long, a int, b int"),
        spark.createDataFrame([(*k, v) for k, v in table.items()], "a int, b int, v int"),
        ["a", "b"], ["v"], ["i"], hot_keys=hot,
    ).collect()
    assert len(out) == 500
    assert all(r.v == table.get((r.a, r.b)) for r in out)


def test_zip_drops_the_surplus(spark):
    left, right = spark.range(10).withColumnRenamed("id", "a"), spark.range(20, 27).withColumnRenamed("id", "b")
    out = joins.zip_rows(left, right, ["a"], ["b"], id_bucket(left, "a", 3), id_bucket(right, "b", 2))
    assert sorted((r.a, r.b) for r in out.collect()) == [(i, i + 20) for i in range(7)]


def test_first_match(spark):
    left = spark.createDataFrame([("p", 1), ("q", 2)], "k string, x int")
    right = spark.createDataFrame([("p", 5, "late"), ("p", 2, "early")], "k string, o int, v string")
    assert sorted((r.k, r.v) for r in joins.first_match(left, right, ["k"], ["o"]).collect()) == [("p", "early"), ("q", None)]


# --- evaluation ---


#: Texts of a group and its distinct-1 to distinct-4, counted by hand on the joined texts.
DISTINCT_BY_HAND = {
    "blank": (["", " "], (0.0, 0.0, 0.0, 0.0)),
    "one": (["a"], (1.0, 0.0, 0.0, 0.0)),
    # a b c: 3 of 3, 2 of 2, 1 of 1, none.
    "pair": (["a", "", "b c"], (1.0, 1.0, 1.0, 0.0)),
    # a b a b a b: {a, b} of 6, {ab, ba} of 5, {aba, bab} of 4, {abab, baba} of 3.
    "turns": (["a b a b a b"], (2 / 6, 2 / 5, 2 / 4, 2 / 3)),
    # x y x y z, cut inside a repeated pair: {x, y, z} of 5, {xy, yx, yz} of 4, {xyx, yxy, xyz} of 3, both of 2.
    "cut": (["x", "y x", "y z"], (3 / 5, 3 / 4, 1.0, 1.0)),
    # Forty times the same word: one n-gram of each length, among 40, 39, 38 and 37.
    "hot": (["w"] * 40, (1 / 40, 1 / 39, 1 / 38, 1 / 37)),
}


@pytest.mark.parametrize("buckets", [1, 5, 1000])
def test_distinct_n(spark, buckets):
    rows = [(g, i, t) for g, (texts, _) in DISTINCT_BY_HAND.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g string, i long, t string").repartition(4)
    out = {r.g: r for r in V.distinct_n(df, ["g"], "i", "t", (1, 2, 3, 4), id_bucket(df, "i", buckets)).collect()}
    for g, (_, wanted) in DISTINCT_BY_HAND.items():
        assert [out[g][f"d{n}"] for n in (1, 2, 3, 4)] == pytest.approx(list(wanted), abs=1e-12), g


def brute_bleu(texts):
    """BLEU-4 with add-0.1 smoothing of empty matches, each text against all others."""
    toks = [t.split() for t in texts]
    scores = []
    for i, hyp in enumerate(toks):
        refs = [t for j, t in enumerate(toks) if j != i and t]
        if not refs or not hyp:
            continue
        logs, unigram = 0.0, 0
        for n in range(1, 5):
            count = lambda ws: Counter(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1))  # noqa: B023, E731
            mine, others = count(hyp), [count(r) for r in refs]
            hits = sum(min(c, max(o[g] for o in others)) for g, c in mine.items())
            unigram = hits if n == 1 else unigram
            logs += 0.25 * math.log((hits or 0.1) / max(1, sum(mine.values())))
        ref = min((abs(len(r) - len(hyp)), len(r)) for r in refs)[1]
        brevity = 1.0 if len(hyp) > ref else math.exp(1 - ref / len(hyp))
        scores.append(brevity * math.exp(logs) if unigram else 0.0)
    return sum(scores) / len(scores) if scores else 0.0


def test_self_bleu(spark):
    groups = {
        "hot": sentences(2, 60, 12), "two": ["a b c d e", "a b c d e"], "lone": ["a b"], "blank": ["", " "],
        "apart": ["x y z", "p q"], "mixed": ["a a a b", "", "a a c", "b"], "short": ["a", "a b"],
    }
    rows = [(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "g string, i long, t string").repartition(3)
    out = {r.g: r.self_bleu for r in V.self_bleu(df, ["g"], "i", "t").collect()}
    for g, texts in groups.items():
        assert out[g] == pytest.approx(brute_bleu(texts), abs=1e-12), g


def test_sentences_read_together_leave_one_row_per_occurrence(spark):
    texts = ["a b a b c", "a b a b c", "b a", "c"] * 3 + ["x x"]
    rows = [(i % 2, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g int, i long, t string").coalesce(1)
    words = V.coded_sentences(df, ["g"], "i", "t").withColumnRenamed("_codes", "_t")
    grams = Counter()
    for g, _, t in rows:
        ws = t.split()
        count = Counter((g, n, tuple(ws[k : k + n])) for n in (1, 2, 3, 4) for k in range(len(ws) - n + 1))
        grams.update((key, r) for key, c in count.items() for r in range(c))
    for n in (1, 2, 3, 4):
        mine = {key: c for key, c in grams.items() if key[0][1] == n}
        held = V._held(words, ["g"], n)
        assert {f.dataType.typeName() for f in held.schema} == {"long", "short"}
        rows_of = held.collect()
        # Copies of a sentence do not add to what is shuffled.
        assert len(rows_of) == len({(r._a, r._b) for r in rows_of}) == len(mine)
        assert sum(r._holder is not None for r in rows_of) == sum(c == 1 for c in mine.values())
        assert V._held(words, ["g"], n, every=False).count() == len({key for key, _ in mine})


@pytest.mark.parametrize("rows, parts", [(1, 1), (40, 1), (1, 7)])
def test_passes_and_parts_do_not_change_what_is_counted(spark, monkeypatch, rows, parts):
    monkeypatch.setattr(V, "PASS_ROWS", rows)
    monkeypatch.setattr(V, "_held_parts", lambda n: parts)
    groups = {"hot": sentences(2, 60, 12), "two": ["a b c d e", "a b c d e"], "mixed": ["a a a b", "", "a a c", "b"], "blank": ["", " "]}
    df = spark.createDataFrame([(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)], "g string, i long, t string").repartition(3)
    out = {r.g: r.self_bleu for r in V.self_bleu(df, ["g"], "i", "t").collect()}
    for g, texts in groups.items():
        assert out[g] == pytest.approx(brute_bleu(texts), abs=1e-12), g
    sizes = (1, 2, 3)
    out = {r.g: r for r in V.distinct_n(df, ["g"], "i", "t", sizes, id_bucket(df, "i", 5)).collect()}
    for g, texts in groups.items():
        words = " ".join(texts).split()
        for n in sizes:
            grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
            assert out[g][f"d{n}"] == pytest.approx(len(set(grams)) / len(grams) if grams else 0.0, abs=1e-12), (g, n)


def shuffle_bytes(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*"))


@pytest.mark.parametrize("score", [
    lambda df: V.self_bleu(df, ["g"], "i", "t"),
    lambda df: V.distinct_n(df, ["g"], "i", "t", (1, 2, 3), id_bucket(df, "i", 5)),
])
def test_disk_holds_the_ngrams_of_one_pass(spark, monkeypatch, score):
    rng = random.Random(3)
    per, texts = 2_000, 60
    df = spark.createDataFrame([("ab"[i % 2], i, " ".join(rng.choices(WIDE, k=per))) for i in range(texts)], "g string, i long, t string")
    monkeypatch.setattr(V, "PASS_ROWS", 1, raising=False)
    drop_shuffles(spark)
    before, seen, write = shuffle_bytes(spark), [], V.cut_lineage
    monkeypatch.setattr(V, "cut_lineage", lambda *a, **k: (write(*a, **k), seen.append(shuffle_bytes(spark) - before))[0])
    score(df).collect()
    # A pass has half of the n-grams of a size; they take some 10 bytes each.
    assert max(seen) < 13 * per * texts / 2


def test_sorted_tells_numbers_apart_that_share_the_highest_bits():
    x = np.array([7, 4, 5, 2**64 - 1, 7, 5, 7, 2**64 - 2], np.uint64)
    y = np.array([1, 0, 3, 0, 2, 3, 1, 0], np.uint16)
    order, equal = V._sorted(x, y)
    pairs = [(int(x[i]), int(y[i])) for i in order]
    assert pairs == sorted(zip(x.tolist(), y.tolist()))
    assert equal.tolist() == [False] + [a == b for a, b in zip(pairs, pairs[1:])]
    assert order.tolist().index(2) < order.tolist().index(5) and order.tolist().index(0) < order.tolist().index(6)


def test_packed_ngrams_come_back():
    x = np.sort(np.array([2**63 + k * k * 12345 for k in range(500)] + [2**63], np.uint64))
    y, who = np.arange(len(x), dtype=np.uint16), np.full(len(x), -1, np.int32).astype("<u4")
    who[::3] = 70_000
    back = V._unpacked(V._packed(x, y, who, V._low(3, 7)), V._low(3, 7))
    assert all(np.array_equal(a, b) for a, b in zip(back, (x, y, who)))


def test_confusion_counts_unspecified_as_wrong(spark):
    rows = [("[SENT_POS][FORM_FORMAL]", "Positive", "Formal"), ("[SENT_UNSPEC][FORM_UNSPEC]", "Positive", "Informal"),
            ("[SENT_NEG][FORM_INFORMAL]", "Negative", "Informal"), ("[SENT_POS][FORM_INFORMAL]", "Negative", "Formal")]
    df = spark.createDataFrame(rows, "p string, s string, f string").withColumn("g", F.lit(1))
    r = V.prompt_confusion(df, ["g"], "p", "s", "f").first()
    assert [r[f"sentiment_{c}"] for c in ("tp", "fp", "tn", "fn")] == [1, 1, 1, 1]
    assert [r[f"formality_{c}"] for c in ("tp", "fp", "tn", "fn")] == [1, 1, 1, 1]


def test_report_lists_missing_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    rows = {r["class"]: r for r in C.report(df, "y", "p", {0: "no", 1: "yes"}).collect()}
    assert rows["no"].f1 == 1.0 and rows["yes"].f1 == 0.0 and rows["yes"].support == 0
    assert rows["macro avg"].f1 == 0.5 and rows["weighted avg"].f1 == 1.0


def test_early_stopping(spark):
    runs = {"down": [5, 4, 3, 2], "stop": [5, 4, 4, 6, 4, 1], "flat": [2, 2, 2], "late": [3, 4, 4, 2, 5]}
    rows = [(k, i, float(v)) for k, vs in runs.items() for i, v in enumerate(vs)]
    out = {r.run: r for r in V.early_stopping(spark.createDataFrame(rows, "run string, e int, l double"), "run", "e", "l", 3).collect()}
    assert [(k, out[k].best_epoch, out[k].stop_epoch, out[k].epochs_run) for k in runs] == [
        ("down", 3, None, 4), ("stop", 1, 4, 5), ("flat", 0, None, 3), ("late", 3, None, 5)]


def test_mean_batch_loss_is_not_token_weighted(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 1.0), (2, 5.0)], "b int, l double")
    assert V.mean_batch_loss(df, ["b"], "l").first()[0] == 3.0


# --- candidates ---


def cand(spark, rows):
    return spark.createDataFrame(rows, "ctx int, token_id int, logit double")


def test_top_k_keeps_ties(spark):
    out = K.top_k(cand(spark, [(0, i, v) for i, v in enumerate([3.0, 2.0, 2.0, 1.0])]), ["ctx"], 2).collect()
    assert sorted(r.token_id for r in out) == [0, 1, 2]


def test_top_p_keeps_a_sum_that_meets_the_limit(spark):
    rows = [(0, i, math.log(p)) for i, p in enumerate([0.5, 0.25, 0.25])] + [(1, 0, 5.0), (1, 1, 0.0)]
    out = K.top_p(cand(spark, rows), ["ctx"], 0.75).collect()
    assert sorted((r.ctx, r.token_id) for r in out) == [(0, 0), (0, 1), (1, 0)]


def test_safe_probabilities_sum_to_one(spark):
    rows = [(0, i, float(i)) for i in range(2, 6)] + [(1, 2, K.BLOCKED), (1, 3, K.BLOCKED), (2, 1, K.BLOCKED), (2, 4, K.BLOCKED)]
    out = K.safe_probabilities(cand(spark, rows), ["ctx"]).collect()
    for ctx in range(3):
        assert sum(r.p for r in out if r.ctx == ctx) == pytest.approx(1.0)
    assert max((r.p, r.token_id) for r in out if r.ctx == 1)[1] == tokens.UNK
    assert max((r.p, r.token_id) for r in out if r.ctx == 2)[1] == tokens.UNK


def test_penalty_moves_negative_logits_up(spark):
    seen = spark.createDataFrame([(0, 1), (0, 2)], "ctx int, token_id int")
    out = K.penalise_seen(cand(spark, [(0, 1, -3.0), (0, 2, 3.0), (0, 3, 1.0)]), seen, ["ctx"], 1.5).collect()
    assert {r.token_id: r.logit for r in out} == {1: -2.0, 2: 2.0, 3: 1.0}


def test_draws_follow_the_probabilities(spark):
    rows = spark.range(4000).select(F.col("id").alias("ctx"), F.explode(F.array(*[
        F.struct(F.lit(t).alias("token_id"), F.lit(p).alias("p")) for t, p in ((5, 0.7), (6, 0.2), (7, 0.1))
    ])).alias("x")).select("ctx", "x.*")
    counts = Counter(r.token_id for r in K.draw_one(rows, ["ctx"], 1).collect())
    assert sum(counts.values()) == 4000
    for token, p in ((5, 0.7), (6, 0.2), (7, 0.1)):
        assert counts[token] / 4000 == pytest.approx(p, abs=0.03)


def test_commit_rules(spark):
    rows = [(0, 0, 9, 0.7), (0, 1, 9, 0.65), (0, 2, 9, 0.1), (1, 0, 9, 0.2), (1, 1, 9, 0.2), (1, 2, 9, 0.1)]
    df = spark.createDataFrame(rows, "s int, pos int, token_id int, prob double")
    assert sorted((r.s, r.pos) for r in K.commit_confident(df, ["s"]).collect()) == [(0, 0), (0, 1), (1, 0)]
    assert sorted((r.s, r.pos) for r in K.commit_scheduled(df, ["s"], 0, 10).collect()) == [(0, 0), (1, 0)]
    assert K.mean_loss(F.col("x")) is not None


def test_expected_vectors(spark):
    probs = spark.createDataFrame([(0, 1, 0.25), (0, 2, 0.75), (1, 9, 1.0)], "ctx int, token_id int, p double")
    vecs = spark.createDataFrame([(1, [4.0, 0.0]), (2, [0.0, 40.0]), (99, [1.0, 1.0])], "token_id int, vec array<double>")
    out = {r.ctx: r.vec for r in K.expected_vectors(probs, vecs, ["ctx"], 2).collect()}
    # The candidate of context 1 has no vector, so its mean is zero.
    assert out == {0: [1.0, 10.0], 1: [0.0, 0.0]}


# --- tokens and examples ---


def test_vocab_ties_and_cap(spark):
    df = spark.createDataFrame([("b a a c [PAD]".split(),), ("c d".split(),)], "t array<string>")
    vocab = {r.token: r.id for r in tokens.build_vocab(df, "t", 3).collect()}
    assert vocab == {**{t: i for i, t in enumerate(tokens.SPECIAL_TOKENS)}, "a": 6, "c": 7, "b": 8}
    longer = tokens.add_control_tokens(tokens.build_vocab(df, "t", 3))
    assert longer.count() == len(vocab) + 7 and longer.agg(F.max("id")).first()[0] == 15
    assert tokens.blocked_ids(longer).count() == 5 and tokens.banned_ids(longer).count() == 7


def test_encode_and_decode(spark):
    df = spark.createDataFrame([(1, "a b a x".split()), (2, [])], "id int, t array<string>")
    vocab = tokens.build_vocab(df.filter("id = 1"), "t", 2)
    ids = tokens.encode(df, ["id"], "t", vocab)
    assert {r.id: r.ids for r in ids.collect()} == {1: [6, 7, 6, tokens.UNK], 2: []}
    text = tokens.decode(ids.withColumnRenamed("id", "k"), ["k"], "ids", vocab, tokens.blocked_ids(vocab))
    assert {r.k: r.text for r in text.collect()} == {1: "a b a", 2: ""}


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "x array<int>")
    r = df.select(fit(F.col("x"), 5, 0), fit(F.col("x"), 2, 0), mask(F.size("x"), 5), mask(F.size("x"), 2), last("x", 2), last("x", 9)).first()
    assert list(r) == [[1, 2, 3, 0, 0], [1, 2], [1, 1, 1, 0, 0], [1, 1], [2, 3], [1, 2, 3]]


def test_prefix_examples(spark):
    df = spark.range(3000).select("id", F.sequence(F.lit(100), F.lit(99) + (F.col("id") % 60 + 1).cast("int")).alias("ids"))
    out = E.prefix_examples(df, "ids", 1, ["id"], 32).collect()
    assert len(out) == 3000 - 50
    for r in out:
        n = r.id % 60 + 1
        assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 32
        real = sum(r.attention_mask)
        masked = [i for i, x in enumerate(r.input_ids[:real]) if x == tokens.MASK]
        prefix = [x for x in r.input_ids[:real] if x != tokens.MASK]
        assert masked and [i for i, x in enumerate(r.labels) if x != -100] == masked
        cont = [r.labels[i] for i in masked]
        assert prefix + cont == list(range((prefix + cont)[0], (prefix + cont)[0] + real))
        assert real == 32 or cont[-1] == 99 + n
    drawn = E.sample_prefix(df.filter("id % 60 >= 20"), "ids", 1, ["id"])
    shares = drawn.agg(F.avg((F.col("k") == 0).cast("int")), F.avg(F.col("k").between(3, 8).cast("int")), F.max("k")).first()
    assert shares[0] == pytest.approx(0.6, abs=0.04) and shares[1] == pytest.approx(0.35, abs=0.04) and shares[2] == 16


def test_encoder_decoder_examples(spark):
    df = spark.range(2000).select("id", F.sequence(F.lit(100), F.lit(102) + (F.col("id") % 40).cast("int")).alias("ids"))
    for r in E.encoder_decoder_examples(df, "ids", 2, ["id"], 8, 10, gap_mean=2.0).collect():
        n = r.id % 40 + 3
        assert 0 <= r.k <= min(8, n - 1) and r.k <= r.c <= max(r.k + 1, n - 1) - 1 and r.c <= r.start <= n - 1
        assert r.encoder_input_ids[: r.k] == list(range(100 + r.c - r.k, 100 + r.c)) and sum(r.encoder_attention_mask) == r.k
        want = list(range(100 + r.start, min(100 + r.start + 10, 100 + n)))
        assert r.decoder_input_ids[: len(want)] == want and sum(r.decoder_attention_mask) == len(want)


def test_packing_cuts_and_pads(spark):
    df = spark.createDataFrame([([7, 8], [4, 9], [5, 9])], "p array<int>, m array<int>, t array<int>")
    for length, want in ((6, ([7, 8, 4, 9, 0, 0], [1, 1, 1, 1, 0, 0], [-100, -100, 5, 9, -100, -100])), (3, ([7, 8, 4], [1, 1, 1], [-100, -100, 5]))):
        r = df.select(*E.pack_distilled(F.col("p"), F.col("m"), F.col("t"), length)).first()
        assert (r.input_ids, r.attention_mask, r.labels) == want


def test_mask_ramp(spark):
    got = [r[0] for r in spark.range(5).select(E.mask_ramp(F.col("id"), 5)).collect()]
    assert got == pytest.approx([0.15, 0.2375, 0.325, 0.4125, 0.5])
    assert spark.range(1).select(E.mask_ramp(F.col("id"), 1)).first()[0] == pytest.approx(0.15)


def test_collator_leaves_special_tokens(spark):
    df = spark.range(400).select("id", F.sequence(F.lit(0), F.lit(30)).alias("ids"))
    rows = df.select("ids", *E.collate_mlm(F.col("ids"), 28, 1, [F.col("id")], control=3)).collect()
    chosen = 0
    for r in rows:
        for x, new, label in zip(r.ids, r.input_ids, r.labels):
            if label == -100:
                assert x == new
            else:
                chosen += 1
                assert label == x and len(tokens.SPECIAL_TOKENS) <= x < 25
    assert chosen / (400 * 19) == pytest.approx(0.15, abs=0.02)


def test_inputs_for_generation(spark):
    df = spark.createDataFrame([(list(range(10)),), ([],)], "x array<int>")
    rows = df.select(E.keep_context(F.col("x"), 70), E.masked_canvas(F.col("x"), 12), E.masked_canvas(F.col("x"), 3), E.seed_if_empty(F.col("x"))).collect()
    assert rows[0][0] == [2, 3, 4, 5, 6, 7, 8, 9] and rows[0][1] == [*range(10), 4, 4] and rows[0][2] == list(range(10))
    assert rows[1][1] == [4] * 12 and rows[1][3] == [tokens.EOS]


def test_vocabularies_beyond_the_broadcast_bound(spark, monkeypatch):
    """The same ids and texts whatever part of the vocabulary is broadcast; a frequent unknown token does no harm."""
    from proseforge.functions.text import tokens as words
    from proseforge.operators import ngram_lm as L
    from proseforge.operators import tokens as V

    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 30)) + " zz" * 20) for i in range(80)] + [(900, ""), (901, None), (902, "zz new")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("t", words(F.col("text")))
    vocab = V.build_vocab(df.filter("id < 50"), "t", size=30).filter("token <> 'zz'").cache()

    def results():
        ids = V.encode(df, ["id"], "t", vocab)
        texts = V.decode(ids, ["id"], "ids", vocab, V.blocked_ids(vocab))
        pairs = L.count_bigrams(df, "text", vocab)
        return [sorted((tuple(r) for r in x.collect()), key=str) for x in (ids, texts, pairs, L.id_pairs(df, ["id"], "text", vocab))]

    whole = results()
    for bound in (0, 12):
        monkeypatch.setattr(V, "MAX_BROADCAST_IDS", bound)
        assert results() == whole


def test_first_of_equal_texts_by_any_order(spark):
    """Ties, nulls and repeated rows in the order columns, whatever their types; one row per text and split."""
    draw = random.Random(11)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, *range(-3, 6)]), draw.choice([None, *range(-2, 4)]), f"s{draw.randrange(5)}", draw.choice(["x", "y", "z", "", None]), i % 7) for i in range(300)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "split string, a long, b int, c string, text string, more int")
    least = lambda r, at: tuple((r[i] is not None, r[i]) for i in at)
    for order, at in ((["a", "b"], (1, 2)), (["b"], (2,)), (["c", "a"], (3, 1))):
        best = {}
        for r in rows:
            key = (r[0], r[4])
            if key not in best or least(r, at) < least(best[key], at):
                best[key] = r
        out = dedup_text(df, "text", order, ["split"])
        assert out.columns == df.columns
        got = out.collect()
        assert {(r.split, r.text): least(tuple(r), at) for r in got} == {k: least(r, at) for k, r in best.items()}
        assert len(got) == len(best) and all(tuple(r) in set(rows) for r in got)


def test_dedup_lines_moves_no_text_through_an_aggregate(spark, sf):
    from proseforge import plans

    plan = plans.QUERIES["dedup_lines"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and all("text" not in line and "line#" not in line for line in plan.splitlines() if "Aggregate" in line)


def test_bigrams_are_counted_by_ids(spark):
    df = spark.createDataFrame([("a b a b z y",), ("z a",), ("",)], "t string")
    vocab = spark.createDataFrame([("a", 6), ("b", 7)], "token string, id int")
    counts = L.count_bigrams(df, "t", vocab)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(left" not in plan and "hashpartitioning(ctx" in plan
    assert sorted(tuple(r) for r in counts.collect()) == [(1, 1, 1), (1, 6, 1), (6, 7, 2), (7, 1, 1), (7, 6, 1)]


def test_encoding_and_counting_where_texts_are_read(spark, monkeypatch):
    """Arrow steps give what the joins give, on all kinds of white space, and shuffle no token."""
    from proseforge.functions.text import tokens as words

    blanks = [" ", "\t", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "\n\n"]
    rows = [(i, blanks[i % 10].join(f"w{(i * j) % 23}" for j in range(i % 7))) for i in range(60)] + [(90, None), (91, ""), (92, "  "), (93, "w1")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    vocab = tokens.build_vocab(df.select(words(F.col("text")).alias("t")), "t", 12).cache()
    ids = tokens.encode_texts(df, ["id"], "text", vocab)
    assert "Exchange hash" not in ids._jdf.queryExecution().executedPlan().toString()
    listed = lambda x: sorted(tuple(r) for r in x.collect())
    for first in (None, 2):
        cut = words(F.col("text")) if first is None else F.slice(words(F.col("text")), 1, first)
        want = tokens.encode(df.select("id", cut.alias("t")), ["id"], "t", vocab)
        assert listed(tokens.encode_texts(df, ["id"], "text", vocab, first=first)) == listed(want)
    for held in (2, 2_000_000):
        monkeypatch.setattr(L, "HELD_PAIRS", held)
        here = [listed(L.count_bigrams(df, "text", vocab, end)) for end in (None, "</s>")]
        with monkeypatch.context() as m:
            m.setattr(tokens, "MAX_HELD_IDS", 3)
            assert here == [listed(L.count_bigrams(df, "text", vocab, end)) for end in (None, "</s>")]


def test_masked_rows_are_those_of_the_columns(spark):
    rows = [(i, None if i == 7 else f"k{i}", [(i * j) % 40 for j in range(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, more string, ids array<int>").repartition(3)
    keys = ["id", "more"]
    want = df.select(*keys, *E.collate_mlm(F.col("ids"), 38, 5, [F.col(k) for k in keys], 0.4, control=4))
    got = E.collate_mlm_rows(df, "ids", 38, 5, keys, 0.4, control=4)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_draws_below_a_limit(spark):
    from proseforge.functions.draws import below, uniform

    df = spark.range(3000)
    for p in (0.0, 0.1, 0.15, 0.5, 0.9999, 1.0):
        assert df.filter(below(7, "x", p, F.col("id")) != (uniform(7, "x", F.col("id")) < p)).count() == 0


def test_examples_of_ids_as_text(spark):
    df = spark.createDataFrame([(i, list(range(10, 10 + i))) for i in range(30)], "id long, ids array<int>")
    arrays = [f"{side}_{what}" for side in ("encoder", "decoder") for what in ("input_ids", "attention_mask")]
    shown = lambda out: sorted(tuple(r) for r in out.withColumns({c: F.col(c).cast("array<string>") for c in arrays}).collect())
    text = E.encoder_decoder_examples(df.withColumn("ids", F.col("ids").cast("array<string>")), "ids", 2, ["id"], 8, 10, gap_mean=2.0, pad="0")
    assert {t for c, t in text.dtypes if c in arrays} == {"array<string>"}
    assert shown(text) == shown(E.encoder_decoder_examples(df, "ids", 2, ["id"], 8, 10, gap_mean=2.0))


def test_safe_probabilities_read_candidates_once(spark, tmp_path):
    rows = [(0, 2, 1.0, "a"), (0, 3, K.BLOCKED, "b"), (1, 2, K.BLOCKED, "c"), (1, 3, K.BLOCKED, "d"), (2, 1, K.BLOCKED, "e"), (2, 4, K.BLOCKED, "f")]
    spark.createDataFrame(rows, "ctx int, token_id int, logit double, more string").write.parquet(str(tmp_path / "c"))
    out = K.safe_probabilities(spark.read.parquet(str(tmp_path / "c")), ["ctx"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    got = sorted((r.ctx, r.token_id, r.more) for r in out.collect())
    assert got == [(0, 2, "a"), (0, 3, "b"), (1, 1, None), (1, 2, "c"), (1, 3, "d"), (2, 1, "e"), (2, 4, "f")]


def test_scores_by_models_of_any_size(spark, monkeypatch):
    """Rare tokens of a large model meet it in a shuffle; those that are broadcast do not travel."""
    texts = sentences(5, 60) + [" ".join(f"r{i}" for i in range(k, k + 9)) for k in range(0, 60, 3)] + ["", "never heard"]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "id long, text string, y int")
    model = cut_lineage(C.train_naive_bayes(df.filter("id < 70"), "text", "y", counts=True), "model")
    run = lambda m: {r.id: r.score for r in C.score_naive_bayes(df, ["id"], "text", m).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.score_naive_bayes(df, ["id"], "text", model)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(token" not in plan
        whole = run(model)
        for most in (0, 5, 9):
            monkeypatch.setattr(C, "MAX_BROADCAST_WEIGHTS", most)
            assert run(model) == whole == run(model.drop("n"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
