"""Generation, curation, files, vectors and the streaming job."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from proseforge.operators import classify as C
from proseforge.operators import generate as G
from proseforge.operators import ngram_lm as L
from proseforge.operators import teacher
from proseforge.operators import vectors as X
from proseforge.operators.tokens import EOS, build_vocab
from proseforge.sources import readers, sinks
from proseforge.streaming import tag_balance as B

TEXTS = ["a b c a b", "a b a c", "c a b a b c", "b", ""]


@pytest.fixture(scope="module")
def lm(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    vocab = build_vocab(df.select(F.split("text", " ").alias("t")).filter("t[0] != ''"), "t")
    return df, vocab, L.count_bigrams(df, "text", vocab, end="</s>")


def test_perplexity(lm):
    df, vocab, _ = lm
    counts = L.count_bigrams(df, "text", vocab)
    pairs = [p for t in TEXTS for p in zip(t.split(), t.split()[1:])]
    size = vocab.count()
    got = {r.id: r.perplexity for r in L.sentence_perplexity(df, ["id"], "text", counts, vocab, 0.5).collect()}
    assert set(got) == {0, 1, 2}
    for i, value in got.items():
        words = TEXTS[i].split()
        nll = [
            -math.log((pairs.count(p) + 0.5) / (sum(q[0] == p[0] for q in pairs) + 0.5 * size))
            for p in zip(words, words[1:])
        ]
        assert value == pytest.approx(math.exp(sum(nll) / len(nll)))


@pytest.mark.parametrize("most", [0, 1, 4, 1000])
def test_perplexity_explodes_no_texts_whatever_part_of_the_model_is_held(spark, lm, monkeypatch, most):
    df, vocab, _ = lm
    counts = L.count_bigrams(df, "text", vocab)
    new = [("x a b", 7), ("zz a zz a zz a", 7), (None, 8), ("c", 9), ("b c c c a", 1 << 60), ("a b", None)]
    rows = df.select("text", "id").union(spark.createDataFrame(new, "text string, id long"))
    given = lambda out: {r.id: r.perplexity for r in out.collect()}
    monkeypatch.setattr(L, "HELD_MODEL", most)
    out = L.sentence_perplexity(rows, ["id"], "text", counts, vocab)
    assert "explode" not in out._jdf.queryExecution().analyzed().toString()
    got = given(out)
    monkeypatch.setattr(L, "held_ids", lambda vocab: None)
    assert got == pytest.approx(given(L.sentence_perplexity(rows, ["id"], "text", counts, vocab)))
    assert set(got) == {0, 1, 2, 7, 1 << 60, None}


def test_perplexity_of_no_texts_and_of_no_model(spark, lm):
    df, vocab, counts = lm
    assert L.sentence_perplexity(df.limit(0), ["id"], "text", counts, vocab).count() == 0
    out = {r.id: r.perplexity for r in L.sentence_perplexity(df, ["id"], "text", counts.limit(0), vocab).collect()}
    assert out == pytest.approx(dict.fromkeys((0, 1, 2), vocab.count()))


def test_sampled_texts_stop_only_after_the_minimum(spark, lm):
    df, vocab, counts = lm
    ids = {r.token: r.id for r in vocab.collect()}
    start = spark.range(300).select("id", F.lit(ids["a"]).alias("last_id"))
    table = G.next_token_table(counts, k=50, p=1.0)
    allowed = {(r.ctx, r.token_id) for r in counts.collect()}
    out = G.sample_texts(start, ["id"], "last_id", table, 5, min_new=6, max_new=20).collect()
    lengths = [len(r.new_ids) for r in out]
    assert len(out) == 300 and min(lengths) >= 6 and max(lengths) <= 20 and len(set(lengths)) > 3
    for r in out:
        chain = [ids["a"], *r.new_ids]
        assert EOS not in chain and all(p in allowed for p in zip(chain, chain[1:]))


def test_generate_times_every_row(spark):
    prompts = spark.createDataFrame([("p1",), ("p2",), ("p2",)], "prompt string")
    done = spark.createDataFrame([("p1", "m", i) for i in range(3)], "prompt string, model_type string, iter int")
    tasks = G.work_list(prompts, ["m", "n"], done, 3)
    assert sorted({(r.prompt, r.model_type) for r in tasks.collect()}) == [("p1", "n"), ("p2", "m"), ("p2", "n")]
    out = G.generate(tasks, {"m": lambda ps: [p + "!" for p in ps], "n": lambda ps: [p + "?" for p in ps]}, batch=2)
    rows = out.collect()
    assert len(rows) == 9 and all(r.sentence == r.prompt + {"m": "!", "n": "?"}[r.model_type] and r.elapsed_s >= 0 for r in rows)
    assert {len(r.generated_sentences) for r in G.to_records(out).collect()} == {3}


def test_curation_tops_up_to_the_goal(spark):
    prompts = spark.range(30).select(F.col("id").alias("prompt_id"), F.concat(F.lit("prompt "), "id").alias("prompt"))

    def answers(asked, round_no):
        # Two thirds of the first answers are too short or the same as another.
        tail = F.when((F.col("prompt_id") % 3 == 0) | F.lit(round_no > 0), F.concat(F.lit(f" r{round_no} "), F.repeat(F.lit("x"), 50)))
        text = F.when(tail.isNotNull(), F.concat("prompt", tail)).otherwise(F.lit("short"))
        return asked.select("prompt_id", "prompt", text.alias("text"))

    out = teacher.curate(prompts, answers, 30).collect()
    assert len(out) == 30 == len({r.text for r in out})
    assert sum(r.round == 0 for r in out) == 10 and max(r.round for r in out) == 1
    few = teacher.curate(prompts, answers, 7).collect()
    assert [r.prompt_id for r in sorted(few, key=lambda r: r.prompt_id)] == [0, 3, 6, 9, 12, 15, 18]
    none = teacher.curate(prompts, lambda a, r: a.select("prompt_id", "prompt", F.lit("no").alias("text")), 5, max_rounds=2)
    assert none.count() == 0


def test_noise_keeps_the_unit_variance(spark):
    schedule = X.cosine_schedule(spark, 50)
    rows = schedule.orderBy("t").collect()
    assert len(rows) == 50 and all(1e-8 <= r.beta <= 0.999 for r in rows)
    product = 1.0
    for r in rows:
        product *= r.alpha
        assert r.alpha_hat == pytest.approx(product, rel=1e-9)
    assert [r.beta for r in X.linear_schedule(spark, 3).orderBy("t").collect()] == pytest.approx([1e-4, 0.01005, 0.02])
    df = spark.range(4000).select("id", F.lit(49).alias("t"), F.array(F.lit(1.0), F.lit(-1.0)).alias("v"))
    noisy = X.add_noise(df, "v", schedule, 3, ["id"]).select(F.explode("noisy").alias("x"))
    mean, var = noisy.agg(F.avg("x"), F.variance("x")).first()
    assert mean == pytest.approx(0, abs=0.05) and var == pytest.approx(1, abs=0.06)


def test_sanitise(spark):
    df = spark.createDataFrame([([float("nan"), float("inf"), -50.0, 2.5],)], "v array<double>")
    r = df.select(X.sanitise(F.col("v")).alias("v")).select("v", X.drop_condition(F.col("v"), F.lit(0))).first()
    assert r[0] == [0.0, 0.0, -10.0, 2.5] and r[1] == [0.0, 0.0, 0.0, 0.0]


def test_alignment_copies_shared_tokens(spark):
    source = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id int")
    target = spark.createDataFrame([("b", 0), ("z", 1)], "token string, id int")
    vecs = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 5.0])], "id int, vec array<double>")
    out = {r.token: r for r in X.align_vectors(target, source, vecs, 2, 1).collect()}
    assert out["b"].vec == [3.0, 5.0] and out["b"].copied and not out["z"].copied and len(out["z"].vec) == 2


TAGGED = Y.StructType([Y.StructField("id", Y.LongType()), *readers.TAGGED.fields])


def test_stream_buffers_span_micro_batches_and_restarts(spark, tmp_path):
    from proseforge.operators.numbering import id_bucket

    rows = spark.range(700).select(
        "id", F.when(F.col("id") % 4 < 3, "good fine nice").otherwise("bad poor").alias("text"), (F.col("id") % 2).cast("int").alias("label")
    )
    source = str(tmp_path / "in")
    part = lambda a, b: rows.filter(F.col("id").between(a, b - 1)).coalesce(1).write.mode("append").parquet(source)
    model = C.train_naive_bayes(rows.withColumn("y", (F.col("id") % 4 < 3).cast("int")), "text", "y")
    tagger = B.naive_bayes_tagger(model, ["id"], "text", "label")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = readers.stream_table(spark, source, "part-", rows.schema)
        return B.run_stream(stream, tagger, ["id"], out, state, 1, write_every=100, batch=64).first().asDict()

    def result():
        return sorted(tuple(r) for r in readers.json_lines(spark, out, TAGGED).drop("batch").collect())

    def batch_form(n):
        tagged = tagger(rows.filter(F.col("id") < n))
        kept = B.balance_buffers(tagged, ["id"], id_bucket(tagged, "id"), 1, write_every=100, batch=64)
        return sorted(tuple(r) for r in kept.select("id", *readers.TAGGED.fieldNames()).collect())

    # Files are smaller than a buffer of 128 rows.
    for a in range(0, 400, 50):
        part(a, a + 50)
    assert run() == {"rows_read": 400, "buffers": 3, "batches": 8}
    assert result() == batch_form(400) and len(result()) < 400
    assert run() == {"rows_read": 400, "buffers": 3, "batches": 8} and result() == batch_form(400)
    # After a restart the rows that were the tail go on filling their buffer; a file may hold several buffers.
    part(400, 700)
    assert run() == {"rows_read": 700, "buffers": 5, "batches": 9}
    assert result() == batch_form(700)


def test_buffers(spark):
    rows = spark.range(300).select(
        F.col("id"), F.when(F.col("id") % 5 == 0, "Positive").otherwise("Negative").alias("sentiment"), F.lit("Formal").alias("formality")
    )
    from proseforge.operators.numbering import id_bucket

    out = B.balance_buffers(rows, ["id"], id_bucket(rows, "id", 7), 1, write_every=100, batch=64).collect()
    assert B.buffer_rows(100, 64) == 128 and B.buffer_rows(10_000, 64) == 10_048
    for buffer, n_rows in ((0, 128), (1, 128)):
        mine = [r for r in out if r.buffer == buffer]
        n_pos = sum(r.sentiment == "Positive" for r in mine)
        assert n_pos * 2 == len(mine) < n_rows
    assert sum(r.buffer == 2 for r in out) == 300 - 256


@pytest.mark.parametrize("n, shared", [(3, False), (450, True)])
def test_details_of_many_prompts_share_a_bounded_number_of_folders(spark, tmp_path, n, shared):
    path = str(tmp_path / "details")
    rows = [(f"conv {i}", m, f'{m} "said" {i},\nin lines', i / 7) for i in range(n) for m in ("user", "x y")]
    sinks.detail_csv(spark.createDataFrame(rows, "prompt string, model_type string, sentence string, perplexity double"), path)
    folders = {p.parent.parent.name for p in (tmp_path / "details").glob("*/*/*.csv")}
    assert len(folders) <= 200 and (shared or folders == {f"folder=conv_{i}" for i in range(n)})
    back = sorted(tuple(r) for r in readers.details(spark, path).collect())
    assert back == sorted((s, p, prompt.replace(" ", "_"), m) for prompt, m, s, p in rows)


def test_json_and_csv_round_trips(spark, tmp_path):
    df = spark.createDataFrame([('quote "x", comma\nline', "ü", 1.5), ("", None, None)], "a string, b string, c double")
    sinks.summary_csv(df, ["b", "a", "c"], str(tmp_path / "csv"))
    back = readers.csv_table(spark, str(tmp_path / "csv"), Y.StructType([df.schema["b"], df.schema["a"], df.schema["c"]]))
    assert ("ü", 'quote "x", comma\nline', 1.5) in [tuple(r) for r in back.collect()]
    sinks.append_json(df, str(tmp_path / "json"))
    sinks.append_json(df, str(tmp_path / "json"))
    assert readers.json_lines(spark, str(tmp_path / "json"), df.schema).count() == 4
    assert "ü" in "".join(p.read_text() for p in (tmp_path / "json").glob("*.json"))


def test_missing_and_broken_records(spark, tmp_path):
    assert readers.records(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "r.json").write_text('{"prompt": "p", "model_type": "m", "generated_sentences": ["s"]}\n{"prompt": "cu')
    assert readers.records(spark, str(tmp_path / "r.json")).count() == 1


def test_cached_pairs_guard(spark, tmp_path):
    path = str(tmp_path / "pairs")
    spark.createDataFrame([(1, "p", "t")], "id long, prompt string, text string").write.parquet(path)
    assert readers.cached_pairs(spark, path, 1, ["id"]).count() == 1
    with pytest.raises(ValueError, match="holds 1 pairs"):
        readers.cached_pairs(spark, path, 2, ["id"])


def test_labelled_lines(spark, tmp_path):
    (tmp_path / "f").write_text(" one \n\n two\n")
    (tmp_path / "i").write_text("three\n  \n")
    rows = readers.labelled_lines(spark, [(str(tmp_path / "f"), 1), (str(tmp_path / "i"), 0)]).collect()
    assert sorted(tuple(r) for r in rows) == [("one", 1), ("three", 0), ("two", 1)]


class _Session:
    """The parts of a cluster session that choose the working folder."""

    def __init__(self, master, folder):
        self.conf = self
        self.sparkContext = self
        self.master, self.folder = master, folder

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self


def test_work_dir_needs_a_shared_folder():
    from proseforge.session import work_dir

    assert work_dir(_Session("spark://host", "/shared"), "x").startswith("/shared/x-")
    assert work_dir(_Session("local[2]", None), "x")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(_Session("yarn", None), "x")


def test_long_runs_keep_one_mean(spark):
    rows = spark.range(1500).select(
        F.lit("p").alias("prompt"), F.lit("m").alias("model_type"), F.col("id").cast("int").alias("iter"),
        F.concat(F.lit("s"), "id").alias("sentence"), F.col("id").cast("double").alias("elapsed_s"),
    )
    got = G.to_records(rows).collect()
    assert sorted(len(r.generated_sentences) for r in got) == [500, 1000]
    assert {r.avg_inference_time for r in got} == {749.5}
