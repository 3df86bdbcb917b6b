"""Streaming deduplication, generation in committed batches, and the seen set that grows."""

import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from proseforge.operators import candidates as K
from proseforge.plans import QUERIES
from proseforge.sources import readers
from proseforge.streaming import generation
from proseforge.streaming.dedup import first_wins_stream, run_first_wins
from proseforge.streaming.generation import generate_in_batches, sentences
from proseforge.streaming.tag_balance import run_stream


def arrive(spark, path, rows):
    """(id, text, split, second) rows as one more file of the stream."""
    df = spark.createDataFrame(rows, "id long, text string, split string, second long")
    df.select("id", "text", "split", F.timestamp_seconds(1_700_000_000 + F.col("second")).alias("time")).coalesce(1).write.mode("append").parquet(path)


def test_first_wins_over_restarts_with_a_bounded_state(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        schema = "id long, text string, split string, time timestamp"
        stream = spark.readStream.schema(schema).parquet(source)
        return run_first_wins(first_wins_stream(stream, "text", ["id"], "time", 100, ["split"]), out, state)

    def ids():
        return sorted(r.id for r in spark.read.parquet(out).collect())

    arrive(spark, source, [(5, "a", "x", 0), (3, "a", "x", 1), (4, "a", "y", 1), (9, None, "x", 1), (8, None, "x", 2), (7, "", "x", 2)])
    assert run()["rows_read"] == 6 and ids() == [3, 4, 7, 8]
    # After a restart the earlier row still wins, though a smaller number comes.
    arrive(spark, source, [(1, "a", "x", 50), (2, "b", "x", 50), (6, "b", "x", 50)])
    run()
    assert ids() == [2, 3, 4, 7, 8]
    # Nothing new: nothing is added.
    run()
    assert ids() == [2, 3, 4, 7, 8]
    # "a" was seen at 50 again and is still known at 140; later the texts before are forgotten, and the state shrinks.
    arrive(spark, source, [(20, "a", "x", 140), (21, "c", "x", 140)])
    run()
    assert ids() == [2, 3, 4, 7, 8, 21]
    held = [run_later(spark, source, run, 1_000 + 400 * i, 100 + i) for i in range(3)]
    assert max(held[1:]) <= 3
    arrive(spark, source, [(300, "b", "x", 2_300)])
    run()
    assert 300 in ids()


def run_later(spark, source, run, second, number):
    arrive(spark, source, [(number, f"text {number}", "x", second)])
    return run()["held"]


def test_many_texts_in_any_order(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    draw = random.Random(1)
    seen, want = set(), []
    for part in range(3):
        rows = [(part * 1000 + i, f"t{draw.randrange(150)}", draw.choice("xy"), part) for i in draw.sample(range(400), 400)]
        for r in sorted(rows):
            if r[1:3] not in seen:
                seen.add(r[1:3])
                want.append(r[0])
        arrive(spark, source, rows)
        schema = "id long, text string, split string, time timestamp"
        run_first_wins(first_wins_stream(spark.readStream.schema(schema).parquet(source), "text", ["id"], "time", 100, ["split"]), out, state)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == sorted(want)


def test_state_has_groups_of_texts_and_not_a_row_for_each(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id long, text string, split string, time timestamp"
    for part in range(2):
        arrive(spark, source, [(i, f"t{i % 700}", "x", part) for i in range(part * 100, 800 + part * 100)])
        held = run_first_wins(first_wins_stream(spark.readStream.schema(schema).parquet(source), "text", ["id"], "time", 100, ["split"]), out, state)["most_held"]
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(700))
    assert held <= 512


def test_texts_of_one_group_expire_one_by_one(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id long, text string, split string, time timestamp"

    def run(rows):
        arrive(spark, source, rows)
        stream = spark.readStream.schema(schema).parquet(source)
        run_first_wins(first_wins_stream(stream, "text", ["id"], "time", 100, groups=1), out, state)
        return sorted((str(r.id), r.text) for r in spark.read.parquet(out).collect())

    big = (1 << 62) + 1  # no float has this value
    first = [(str(big), "a"), ("3", "b"), ("None", "c")]
    assert run([(big, "a", "x", 0), (big + 2, "a", "y", 0), (3, "b", "x", 0), (None, "c", None, 0), (1, "c", "x", 0)]) == sorted(first)
    # "a" comes until 240; "b" and "c" expire at 100, which the watermark has passed at 240.
    for second in (90, 170, 240):
        assert run([(second, "a", "x", second)]) == sorted(first)
    assert run([(10_000, "d", "x", 300), (5, "a", "x", 300), (6, "b", "x", 300)]) == sorted([*first, ("10000", "d"), ("6", "b")])


def test_generator_that_fails_once_loses_and_repeats_nothing(spark, tmp_path):
    prompts = spark.createDataFrame([(f"p{i}",) for i in range(40)], "prompt string")
    out, state, log = (str(tmp_path / n) for n in ("out", "state", "log"))
    os.mkdir(log)
    flag = str(tmp_path / "failed")

    def said(texts, name):
        for t in texts:
            with open(os.path.join(log, f"{name}-{t}"), "a") as file:
                file.write("x")
        return [f"{name} {t}" for t in texts]

    def careful(texts):
        return said(texts, "m")

    def shaky(texts):
        # Fails until its second run begins.
        if "p11" in texts and not os.path.exists(flag):
            raise RuntimeError("out of memory")
        return said(texts, "n")

    run = lambda: generate_in_batches(prompts, {"m": careful, "n": shaky}, 2, out, state, keys_per_batch=10)
    with pytest.raises(PySparkException):
        run()
    before = {(r.prompt, r.model_type, r.iter) for r in sentences(spark, out).collect()} if os.path.exists(out) else set()
    stamps = {p: os.path.getmtime(os.path.join(log, p)) for p in os.listdir(log)}
    open(flag, "w").close()
    got = [(r.prompt, r.model_type, r.iter) for r in run().collect()]
    assert len(got) == len(set(got)) == 40 * 2 * 2 and before <= set(got)
    # What was committed before is not generated again.
    for prompt, model, _ in before:
        assert os.path.getmtime(os.path.join(log, f"{model}-{prompt}")) == stamps[f"{model}-{prompt}"]
    again = [tuple(r) for r in run().collect()]
    assert len(again) == 160 and len(os.listdir(log)) == 80


def test_a_long_list_is_done_in_a_bounded_number_of_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generation, "MOST_BATCHES", 3)
    prompts = spark.range(50).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    out = generate_in_batches(prompts, {"m": lambda ts: [t[::-1] for t in ts]}, 2, str(tmp_path / "o"), str(tmp_path / "s"), keys_per_batch=2)
    assert sorted((r.prompt, r.iter, r.sentence) for r in out.collect()) == sorted((f"p{i}", k, f"p{i}"[::-1]) for i in range(50) for k in (0, 1))
    assert len([f for f in os.listdir(tmp_path / "o") if f.startswith("batch=")]) <= 3


def test_finished_pairs_are_left_out(spark, tmp_path):
    prompts = spark.createDataFrame([("a",), ("b",), ("b",)], "prompt string")
    done = spark.createDataFrame([("a", "m", 0), ("a", "m", 1), ("b", "m", 0)], "prompt string, model_type string, iter int")
    out = generate_in_batches(prompts, {"m": lambda ts: ts}, 2, str(tmp_path / "o"), str(tmp_path / "s"), done).collect()
    assert sorted((r.prompt, r.iter) for r in out) == [("b", 0), ("b", 1)]
    none = generate_in_batches(prompts.limit(0), {"m": lambda ts: ts}, 2, str(tmp_path / "o2"), str(tmp_path / "s2"))
    assert none.count() == 0


def test_seen_set_grows_by_step(spark):
    draw = random.Random(3)
    rows = [(s, t, p, i, float(draw.randrange(-8, 9))) for s in range(6) for t in range(draw.randrange(1, 7)) for p in range(4) for i in draw.sample(range(6), 3)]
    rows += [(9, 0, 0, 1, float("nan")), (9, 0, 0, 2, -3.0), (9, 5, 0, 2, 4.0), (9, 5, 0, 3, 2.0)]
    want = []
    for s in sorted({r[0] for r in rows}):
        seen = set()
        for t in sorted({r[1] for r in rows if r[0] == s}):
            chosen = []
            for p in sorted({r[2] for r in rows if r[:2] == (s, t)}):
                own = [(r[4] if r[4] == r[4] else K.BLOCKED, r[3]) for r in rows if r[:3] == (s, t, p)]
                scaled = [(v / 2.0 if i in seen else v, -i) for v, i in own]
                v, i = max(scaled)
                chosen.append((s, t, p, -i, v))
            seen |= {c[3] for c in chosen}
            want += chosen
    df = spark.createDataFrame(rows, "seq long, step int, pos int, token_id int, logit double").repartition(5)
    got = K.penalise_growing(df, ["seq"], "step", 2.0)
    assert got.columns == ["seq", "step", "pos", "token_id", "logit"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert K.penalise_growing(df.limit(0), ["seq"], "step", 2.0).count() == 0


def test_sequences_are_shuffled_once(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0, 2, 1.0)], "seq long, step int, pos int, token_id int, logit double").write.parquet(str(tmp_path / "steps"))
    plan = K.penalise_growing(spark.read.parquet(str(tmp_path / "steps")), ["seq"], "step", 2.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_stream_of_a_table_that_is_a_folder_takes_every_document(spark, sf, tmp_path):
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    n = docs.count()
    counted = QUERIES["stream_counters"](spark, str(tmp_path)).first()
    assert (counted.rows_read, counted.buffers) == (n, n // 128)
    rows = lambda folder: sorted(tuple(r) for r in QUERIES["stream_tag_balance"](spark, folder).select("doc_id", "sentiment", "formality").collect())
    want = [r[0] for r in rows(sf)]
    assert n % 128 <= len(want) and set(want) <= {r.doc_id for r in docs.select("doc_id").collect()}
    # Micro-batches come by file; buffers then hold other rows, but the last ones are always written whole.
    assert len(rows(str(tmp_path))) >= n % 128


def test_stream_without_files_counts_nothing(spark, tmp_path):
    os.mkdir(tmp_path / "t.parquet")
    stream = readers.stream_table(spark, str(tmp_path), "t", spark.createDataFrame([], "id long, text string, sentiment string, formality string").schema)
    counted = run_stream(stream, lambda rows: rows, ["id"], str(tmp_path / "out"), str(tmp_path / "state"), 1).first()
    assert (counted.rows_read, counted.buffers) == (0, 0)
