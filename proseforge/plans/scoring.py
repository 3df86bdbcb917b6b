"""Classifiers, the bigram model and the evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proseforge.functions import prompts as P
from proseforge.functions import text as T
from proseforge.functions.draws import uniform
from proseforge.operators import classify as C
from proseforge.operators import evaluate as V
from proseforge.operators import ngram_lm as L
from proseforge.operators.numbering import id_bucket
from proseforge.plans import sqlparts as S
from proseforge.plans.corpus import LABELLED_SQL, labelled
from proseforge.plans.examples import VOCAB_SQL, doc_vocab
from proseforge.plans.registry import query
from proseforge.session import cut_lineage
from proseforge.sources.readers import table, text_table
from proseforge.streaming.tag_balance import balance_buffers

SEED = 99


def nb_sql(name: str, source: str, label: str) -> str:
    """``name`` (token, weight): the naive Bayes model of a labelled table."""
    return f"""
    {name}_w AS (SELECT unnest({S.tokens('text')}) AS token, {label} AS y FROM {source}),
    {name}_c AS (SELECT token, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y <> 1) AS n0 FROM {name}_w GROUP BY 1),
    {name}_t AS (SELECT sum(n1)::DOUBLE AS t1, sum(n0)::DOUBLE AS t0, count(*)::DOUBLE AS v FROM {name}_c),
    {name} AS (
      SELECT token, ln((n1 + 1.0::DOUBLE) / (t1 + v)) - ln((n0 + 1.0::DOUBLE) / (t0 + v)) AS weight FROM {name}_c, {name}_t
      UNION ALL
      SELECT NULL, ln(count(*) FILTER ({label} = 1) + 1.0::DOUBLE) - ln(count(*) FILTER ({label} <> 1) + 1.0::DOUBLE) FROM {source})"""


def nb_score_sql(name: str, model: str, source: str, key: str) -> str:
    """``name`` (key, score): summed log-odds of every row of a table."""
    return f"""
    {name} AS (
      SELECT k.{key}, round(coalesce(s, 0) + (SELECT weight FROM {model} WHERE token IS NULL), 6) AS score
      FROM {source} k LEFT JOIN (
        SELECT {key}, sum(weight) AS s FROM (SELECT {key}, unnest({S.tokens('text')}) AS token FROM {source})
        JOIN {model} USING (token) GROUP BY {key}) USING ({key}))"""


def nb_model(rows: DataFrame, label: str) -> DataFrame:
    """A naive Bayes model, written once."""
    return cut_lineage(C.train_naive_bayes(rows, "text", label, counts=True), "model")


@query(f"WITH {LABELLED_SQL}, {nb_sql('m', 'lab', 'quality')} SELECT token, round(weight, 6) AS weight FROM m")
def nb_train(spark: SparkSession, d: str) -> DataFrame:
    """Naive Bayes log-odds of the quality label."""
    model = nb_model(labelled(spark, d), "quality")
    return model.select("token", F.round("weight", 6).alias("weight"))


@query(f"""WITH {LABELLED_SQL}, {nb_sql('m', 'lab', 'quality')}, {nb_score_sql('sc', 'm', 'documents', 'doc_id')}
    SELECT doc_id, score, CASE WHEN score > 0 THEN 1 ELSE 0 END AS pred FROM sc""")
def nb_predict(spark: SparkSession, d: str) -> DataFrame:
    """Every document scored by the model of the labelled ones."""
    model = nb_model(labelled(spark, d), "quality")
    scores = C.score_naive_bayes(text_table(spark, d, "documents"), ["doc_id"], "text", model)
    return scores.withColumn("pred", C.predicted(F.col("score")))


_HELD = S.u(SEED, "held", "doc_id")
EVAL_SQL = f"""WITH {LABELLED_SQL},
    trained AS (SELECT * FROM lab WHERE {_HELD} >= 0.3), held AS (SELECT * FROM lab WHERE {_HELD} < 0.3),
    {nb_sql('m', 'trained', 'quality')}, {nb_score_sql('sc', 'm', 'held', 'doc_id')},
    pairs AS (SELECT doc_id, quality AS y, CASE WHEN score > 0 THEN 1 ELSE 0 END AS p FROM held JOIN sc USING (doc_id))"""


def held_out_predictions(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, label, pred) of a held-out third of the labelled documents."""
    rows = labelled(spark, d)
    draw = uniform(SEED, "held", F.col("doc_id"))
    model = nb_model(rows.filter(draw >= 0.3), "quality")
    held = rows.filter(draw < 0.3)
    scores = C.score_naive_bayes(held, ["doc_id"], "text", model)
    return held.select("doc_id", F.col("quality").alias("label")).join(scores, "doc_id").withColumn(
        "pred", C.predicted(F.col("score"))
    )


@query(f"{EVAL_SQL} SELECT round(avg((y = p)::INT::DOUBLE), 6) AS accuracy FROM pairs")
def nb_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy on the held-out documents."""
    out = C.accuracy(held_out_predictions(spark, d), "label", "pred")
    return out.select(F.round("accuracy", 6).alias("accuracy"))


REPORT_SQL = f"""{EVAL_SQL},
    cls AS (SELECT * FROM (VALUES (0, 'Negative'), (1, 'Positive')) c(c, class)),
    cnt AS (SELECT class, (SELECT count(*) FROM pairs WHERE y = c AND p = c)::DOUBLE AS hit,
              (SELECT count(*) FROM pairs WHERE y = c) AS support, (SELECT count(*) FROM pairs WHERE p = c) AS said FROM cls),
    pr AS (SELECT *, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS pre, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS rec FROM cnt),
    f AS (SELECT class, pre, rec, CASE WHEN pre + rec = 0 THEN 0 ELSE 2 * pre * rec / (pre + rec) END AS f1, support FROM pr),
    every AS (SELECT * FROM f
      UNION ALL SELECT 'macro avg', avg(pre), avg(rec), avg(f1), sum(support) FROM f
      UNION ALL SELECT 'weighted avg', sum(pre * support) / sum(support), sum(rec * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)"""


@query(f"""{REPORT_SQL}
    SELECT class, round(pre::DOUBLE, 6) AS precision, round(rec::DOUBLE, 6) AS recall, round(f1::DOUBLE, 6) AS f1, support::BIGINT AS support FROM every""")
def nb_report(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 per class and averaged."""
    out = C.report(held_out_predictions(spark, d), "label", "pred", {0: "Negative", 1: "Positive"})
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH {LABELLED_SQL}, held AS (SELECT * FROM lab WHERE {_HELD} < 0.3)
    SELECT quality AS label, count(*) AS n, TRUE AS as_good_as_majority FROM held GROUP BY quality""")
def linear_predict(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF and logistic regression on held-out documents: rows per label, and whether guessing the majority is matched."""
    rows = labelled(spark, d).select("doc_id", "text", F.col("quality").alias("label"))
    draw = uniform(SEED, "held", F.col("doc_id"))
    model = C.train_linear(rows.filter(draw >= 0.3), "text", "label")
    said = C.predict_linear(rows.filter(draw < 0.3), "text", model).select("label", "pred")
    counts = said.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == F.col("pred")).cast("long")).alias("hits"))
    every = Window.partitionBy()  # one row per label
    good = F.sum("hits").over(every) >= F.max("n").over(every)
    return counts.select("label", "n", good.alias("as_good_as_majority"))


# The tagger is fitted to one part of the labelled documents and tags the rest.
_TAG_SQL = f"""{LABELLED_SQL}, seen AS (SELECT * FROM lab WHERE {_HELD} < 0.3), unseen AS (SELECT * FROM lab WHERE {_HELD} >= 0.3),
    {nb_sql('m', 'seen', 'toxic')}, {nb_score_sql('sc', 'm', 'unseen', 'doc_id')},
    tagged AS (
      SELECT doc_id, text, sentiment, CASE WHEN score > 0 THEN 'Formal' ELSE 'Informal' END AS formality
      FROM unseen JOIN sc USING (doc_id))"""


def _tag_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows to tag, and the tagger's model, which has not seen them."""
    rows = labelled(spark, d)
    draw = uniform(SEED, "held", F.col("doc_id"))
    return rows.filter(draw >= 0.3), nb_model(rows.filter(draw < 0.3), "toxic")


def tagged_documents(spark: SparkSession, d: str) -> DataFrame:
    rows, model = _tag_parts(spark, d)
    return C.tag(rows, ["doc_id"], "text", "quality", model)


@query(f"""WITH {_TAG_SQL},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY sentiment, formality ORDER BY {S.u(SEED, 'balance', 'doc_id')}, doc_id) AS rn FROM tagged),
    low AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM tagged GROUP BY sentiment, formality))
    SELECT doc_id, text, sentiment, formality, {S.control_prompt('sentiment', 'formality')} AS prompt FROM ranked, low WHERE rn <= m""")
def tag_and_balance(spark: SparkSession, d: str) -> DataFrame:
    """Formality predicted, sentiment given, classes balanced over the whole corpus."""
    rows, model = _tag_parts(spark, d)
    out = C.tag_and_balance(rows, ["doc_id"], "text", "quality", model, SEED)
    return out.withColumn("prompt", P.control_prompt(F.col("sentiment"), F.col("formality")))


_BUFFER = 128  # two scoring batches of 64


@query(f"""WITH {_TAG_SQL},
    buffered AS (SELECT *, ((row_number() OVER (ORDER BY doc_id) - 1) // {_BUFFER})::BIGINT AS buffer FROM tagged),
    ranked AS (SELECT *, count(*) OVER (PARTITION BY buffer) AS size,
        count(*) OVER (PARTITION BY buffer, sentiment, formality) AS n,
        row_number() OVER (PARTITION BY buffer, sentiment, formality ORDER BY {S.u(SEED, 'balance', 'doc_id')}, doc_id) AS rn FROM buffered),
    lowest AS (SELECT *, min(n) OVER (PARTITION BY buffer) AS m FROM ranked)
    SELECT doc_id, text, sentiment, formality, buffer FROM lowest WHERE size < {_BUFFER} OR rn <= m""")
def tag_and_balance_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Balancing per buffer of consecutive rows, the last partial buffer kept whole."""
    tagged = cut_lineage(tagged_documents(spark, d), "tagged")
    bucket = id_bucket(table(spark, d, "labels"), "doc_id")
    return balance_buffers(tagged, ["doc_id"], bucket, SEED, write_every=100, batch=64)


LM_SQL = f"""{VOCAB_SQL},
    train_t AS (SELECT {S.tokens('text')} AS t FROM documents),
    train_p AS (SELECT unnest(t[1:len(t) - 1]) AS l, unnest(t[2:]) AS r FROM train_t WHERE len(t) >= 2),
    lm AS (
      SELECT coalesce(a.id, 1) AS ctx, coalesce(b.id, 1) AS token_id, count(*) AS n
      FROM train_p LEFT JOIN vocab a ON a.token = l LEFT JOIN vocab b ON b.token = r GROUP BY 1, 2),
    ctx_n AS (SELECT ctx, sum(n)::BIGINT AS cn FROM lm GROUP BY 1),
    vsize AS (SELECT count(*) AS v FROM vocab)"""


def language_model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, bigram counts) of the documents, written once and read back."""
    v = doc_vocab(spark, d)
    return v, cut_lineage(L.count_bigrams(text_table(spark, d, "documents"), "text", v), "bigrams")


def pairs_sql(name: str, source: str, key: str) -> str:
    """``name`` (key, pos, ctx, token_id): adjacent id pairs of a table's text."""
    return f"""
    {name}_t AS (SELECT {key}, {S.tokens('text')} AS t FROM {source}),
    {name}_p AS (SELECT {key}, unnest(t[1:len(t) - 1]) AS l, unnest(t[2:]) AS r, unnest(range(len(t) - 1)) AS pos FROM {name}_t WHERE len(t) >= 2),
    {name} AS (SELECT {key}, pos, coalesce(a.id, 1) AS ctx, coalesce(b.id, 1) AS token_id
      FROM {name}_p LEFT JOIN vocab a ON a.token = l LEFT JOIN vocab b ON b.token = r)"""


def ppl_sql(name: str, source: str, key: str) -> str:
    """``name`` (key, ppl): perplexity of each row's text."""
    return f"""{pairs_sql(name + '_ids', source, key)},
    {name} AS (
      SELECT {key}, exp(avg(-ln((coalesce(n, 0) + 0.1::DOUBLE) / (coalesce(cn, 0) + 0.1::DOUBLE * v)))) AS ppl
      FROM {name}_ids LEFT JOIN lm USING (ctx, token_id) LEFT JOIN ctx_n USING (ctx), vsize GROUP BY {key})"""


@query(f"WITH {LM_SQL} SELECT ctx, token_id, n FROM lm")
def bigram_lm(spark: SparkSession, d: str) -> DataFrame:
    """Bigram counts over the capped vocabulary."""
    return L.count_bigrams(text_table(spark, d, "documents"), "text", doc_vocab(spark, d))


@query(f"WITH {LM_SQL}, {ppl_sql('b', 'benchmark', 'item_id')} SELECT item_id, round(ppl, 4) AS perplexity FROM b")
def benchmark_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity of the held-out lines."""
    v, lm = language_model(spark, d)
    out = L.sentence_perplexity(table(spark, d, "benchmark"), ["item_id"], "text", lm, v)
    return out.withColumn("perplexity", F.round("perplexity", 4))


def turn_records(spark: SparkSession, d: str) -> DataFrame:
    """Generation records in long form: conversation as prompt, role as model, turn as iteration."""
    turns = text_table(spark, d, "conversations")
    cleaned = T.settle(turns, "sentence", T.clean_output(F.col("text"), None, remove_prompt=False))
    return cleaned.filter(F.col("sentence") != "").select(
        F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("prompt"),
        F.col("role").alias("model_type"),
        F.col("turn").alias("iter"),
        "sentence",
        (F.length("text") / F.lit(1024.0)).alias("elapsed_s"),
    )


_SENTENCE = f"""{S.strip("replace(replace(" + S.strip('text') + ", '<|endoftext|>', ''), '\\n', ' ')")}"""
RECORDS_SQL = f"""
    rec AS (
      SELECT 'conv ' || conv_id AS prompt, role AS model_type, turn AS iter, {_SENTENCE} AS text,
             length(text) / 1024.0::DOUBLE AS elapsed_s, conv_id || ':' || turn AS rk
      FROM conversations WHERE {_SENTENCE} <> '')"""
KEYS = ["prompt", "model_type"]


def base_summary(spark: SparkSession, d: str, records: DataFrame, text: str) -> DataFrame:
    v, lm = language_model(spark, d)
    details = L.sentence_perplexity(records, [*KEYS, "iter"], text, lm, v)
    return V.perplexity_summary(records, details, KEYS, "iter", text, "elapsed_s")


SUMMARY_SQL = f"""{LM_SQL}, {RECORDS_SQL}, {ppl_sql('pp', 'rec', 'rk')},
    base AS (
      SELECT prompt, model_type, avg(elapsed_s) AS t, arg_min(text, iter) AS example_output,
             avg(ppl) AS ppl, count(ppl) AS n_valid
      FROM rec LEFT JOIN pp USING (rk) GROUP BY 1, 2)"""


@query(f"""WITH {SUMMARY_SQL}
    SELECT prompt, model_type, coalesce(printf('%.4f', ppl), 'N/A') AS avg_perplexity, n_valid,
           printf('%.4f', t) AS avg_inference_time, example_output FROM base""")
def perplexity_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean perplexity, valid count, mean time and an example per prompt and model."""
    base = base_summary(spark, d, turn_records(spark, d), "sentence")
    return V.display_summary(base, {"avg_perplexity": 4, "avg_inference_time": 4})


def _distinct_sql(name: str, source: str, group: str, order: str, n: int) -> str:
    nexts = "".join(f", lead(w, {i}) OVER o AS w{i}" for i in range(1, n))
    last = f"w{n - 1}" if n > 1 else "w"
    gram = "(" + ", ".join(["w", *[f"w{i}" for i in range(1, n)]]) + ")" if n > 1 else "w"
    return f"""
    {name}_w AS (SELECT {group}, {order} AS o1, unnest({S.tokens('text')}) AS w, generate_subscripts({S.tokens('text')}, 1) AS o2 FROM {source}),
    {name}_g AS (SELECT {group}, w{nexts} FROM {name}_w WINDOW o AS (PARTITION BY {group} ORDER BY o1, o2)),
    {name} AS (
      SELECT {group}, coalesce(s, 0) AS score FROM (SELECT DISTINCT {group} FROM {source})
      LEFT JOIN (SELECT {group}, count(DISTINCT {gram}) / count(*)::DOUBLE AS s FROM {name}_g WHERE {last} IS NOT NULL GROUP BY {group}) USING ({group}))"""


@query(f"""WITH {_distinct_sql('d1', 'documents', 'lang', 'doc_id', 1)}, {_distinct_sql('d2', 'documents', 'lang', 'doc_id', 2)},
    {_distinct_sql('d3', 'documents', 'lang', 'doc_id', 3)}
    SELECT lang, round(d1.score, 6) AS d1, round(d2.score, 6) AS d2, round(d3.score, 6) AS d3
    FROM d1 JOIN d2 USING (lang) JOIN d3 USING (lang)""")
def distinct_n(spark: SparkSession, d: str) -> DataFrame:
    """Distinct 1-, 2- and 3-gram shares of each language, as one long token sequence."""
    docs = text_table(spark, d, "documents")
    bucket = id_bucket(docs, "doc_id")
    out = V.distinct_n(docs, ["lang"], "doc_id", "text", (1, 2, 3), bucket)
    return out.select("lang", *[F.round(f"d{n}", 6).alias(f"d{n}") for n in (1, 2, 3)])


def _bleu_sql(name: str, source: str, group: str, order: str) -> str:
    """Self-BLEU stated by comparing each sentence with every other of its group."""
    grams = " UNION ALL ".join(
        f"""SELECT {group}, i, {n} AS n, array_to_string(t[p : p + {n - 1}], chr(31)) AS g
            FROM (SELECT {group}, i, t, unnest(range(1, len(t) - {n - 2})) AS p FROM {name}_s)"""
        for n in (1, 2, 3, 4)
    )
    return f"""
    {name}_s AS (SELECT {group}, {order} AS i, {S.tokens('text')} AS t FROM {source} WHERE len({S.tokens('text')}) > 0),
    {name}_c AS (SELECT {group}, i, n, g, count(*) AS c FROM ({grams}) GROUP BY ALL),
    {name}_m AS (SELECT a.{group}, a.i, a.n, a.g, a.c, max(b.c) AS other
      FROM {name}_c a LEFT JOIN {name}_c b ON a.{group} = b.{group} AND a.n = b.n AND a.g = b.g AND a.i <> b.i GROUP BY ALL),
    {name}_h AS (SELECT {group}, i, n, sum(least(c, coalesce(other, 0))) AS hits FROM {name}_m GROUP BY ALL),
    {name}_r AS (SELECT a.{group}, a.i, arg_min(len(b.t), (abs(len(a.t) - len(b.t)) * 1000000000 + len(b.t))) AS ref
      FROM {name}_s a JOIN {name}_s b ON a.{group} = b.{group} AND a.i <> b.i GROUP BY ALL),
    {name}_x AS (
      SELECT s.{group}, s.i, len(t) AS len, ref, n,
        (SELECT coalesce(max(hits), 0) FROM {name}_h h WHERE h.{group} = s.{group} AND h.i = s.i AND h.n = k.n) AS hits
      FROM {name}_s s JOIN {name}_r USING ({group}, i), (VALUES (1), (2), (3), (4)) k(n)),
    {name}_b AS (
      SELECT {group}, i, CASE WHEN max(CASE WHEN n = 1 THEN hits END) = 0 THEN 0
        ELSE CASE WHEN any_value(len) > any_value(ref) THEN 1 ELSE exp(1 - any_value(ref) / any_value(len)::DOUBLE) END
          * exp(sum(0.25::DOUBLE * ln(CASE WHEN hits = 0 THEN 0.1::DOUBLE ELSE hits::DOUBLE END / greatest(1, len - n + 1)))) END AS score
      FROM {name}_x GROUP BY {group}, i),
    {name} AS (
      SELECT {group}, coalesce(s, 0) AS score FROM (SELECT DISTINCT {group} FROM {source})
      LEFT JOIN (SELECT {group}, avg(score) AS s FROM {name}_b GROUP BY {group}) USING ({group}))"""


@query(f"""WITH rec AS (SELECT *, conv_id * 1000 + turn AS rid FROM conversations), {_bleu_sql('sb', 'rec', 'role', 'rid')}
    SELECT role, round(score, 6) AS self_bleu FROM sb""")
def self_bleu_by_role(spark: SparkSession, d: str) -> DataFrame:
    """Self-BLEU of three large groups."""
    turns = text_table(spark, d, "conversations").withColumn("rid", F.col("conv_id") * 1000 + F.col("turn"))
    return V.self_bleu(turns, ["role"], "rid", "text").withColumn("self_bleu", F.round("self_bleu", 6))


@query(f"""WITH {_bleu_sql('sb', 'documents', 'source', 'doc_id')} SELECT source, round(score, 6) AS self_bleu FROM sb""")
def self_bleu(spark: SparkSession, d: str) -> DataFrame:
    """Self-BLEU of the documents of each source."""
    docs = text_table(spark, d, "documents")
    return V.self_bleu(docs, ["source"], "doc_id", "text").withColumn("self_bleu", F.round("self_bleu", 6))


_OPEN_SQL = f"""{SUMMARY_SQL},
    grp AS (SELECT *, prompt || '|' || model_type AS gk FROM rec),
    {_distinct_sql('d1', 'grp', 'gk', 'iter', 1)}, {_distinct_sql('d2', 'grp', 'gk', 'iter', 2)}, {_bleu_sql('sb', 'grp', 'gk', 'iter')}"""


@query(f"""WITH {_OPEN_SQL}
    SELECT prompt, model_type, coalesce(printf('%.4f', ppl), 'N/A') AS avg_perplexity, printf('%.4f', t) AS avg_inference_time,
           printf('%.4f', d1.score) AS d1, printf('%.4f', d2.score) AS d2, printf('%.4f', sb.score) AS self_bleu, example_output
    FROM (SELECT *, prompt || '|' || model_type AS gk FROM base) JOIN d1 USING (gk) JOIN d2 USING (gk) JOIN sb USING (gk)""")
def open_ended_summary(spark: SparkSession, d: str) -> DataFrame:
    """The open-ended evaluation table: diversity beside perplexity and time."""
    records = cut_lineage(turn_records(spark, d), "turn-records")
    base = V.display_summary(base_summary(spark, d, records, "sentence"), {"avg_perplexity": 4, "avg_inference_time": 4})
    bucket = id_bucket(records, "iter")
    coded = V.coded_sentences(records, KEYS, "iter", "sentence")
    metrics = (
        V.distinct_n(records, KEYS, "iter", "sentence", (1, 2), bucket, coded)
        .join(V.self_bleu(records, KEYS, "iter", "sentence", coded=coded), KEYS)
    )
    metrics = metrics.withColumns({c: T.fixed_decimals(F.round(c, 12), 4) for c in ("d1", "d2", "self_bleu")})
    out = V.join_summary(metrics, base, KEYS, ["n_valid"])
    return out.select(*KEYS, "avg_perplexity", "avg_inference_time", "d1", "d2", "self_bleu", "example_output")


def control_records(spark: SparkSession, d: str) -> DataFrame:
    """Held-out documents as generated texts: control prompt, source as model, both attributes predicted.

    The classifiers have seen the other labelled documents only.  The table is written once, as
    perplexity, confusion and times are all read from it.
    """
    draw = uniform(SEED, "held", F.col("doc_id"))
    rows = labelled(spark, d)
    trained = rows.filter(draw >= 0.3)
    prompt = P.control_prompt(F.col("sentiment"), F.col("formality"))
    cleaned = T.clean_output(F.col("text"), prompt)
    out = rows.filter(draw < 0.3).select(
        prompt.alias("prompt"), F.col("source").alias("model_type"), F.col("doc_id").alias("iter"), cleaned.alias("text"),
        (F.length("text") / F.lit(1024.0)).alias("elapsed_s"),
    ).filter(F.col("text") != "")
    out = cut_lineage(out, "control-texts")
    names = {"quality": ("said_sentiment", P.sentiment_name), "toxic": ("said_formality", P.formality_name)}
    said = out
    for label, (name, named) in names.items():
        scores = C.score_naive_bayes(out, ["iter"], "text", nb_model(trained, label))
        said = said.join(scores.select("iter", named(C.predicted(F.col("score"))).alias(name)), "iter")
    return cut_lineage(said, "control-records")


_CONTROL_SQL = f"""{LABELLED_SQL},
    trained AS (SELECT * FROM lab WHERE {_HELD} >= 0.3),
    prompted AS (SELECT *, {S.control_prompt('sentiment', 'formality')} AS prompt, length(text) / 1024.0::DOUBLE AS elapsed_s FROM lab WHERE {_HELD} < 0.3),
    cutoff AS (SELECT * EXCLUDE (text), CASE WHEN starts_with(text, prompt) THEN substr(text, length(prompt) + 1)
        WHEN strpos(text, ':') > 0 THEN substr(text, strpos(text, ':') + 1) ELSE text END AS body FROM prompted),
    held AS (SELECT * FROM (SELECT *, {S.strip("replace(replace(" + S.strip('body') + ", '<|endoftext|>', ''), '\\n', ' ')")} AS text FROM cutoff) WHERE text <> ''),
    {nb_sql('ms', 'trained', 'quality')}, {nb_score_sql('ss', 'ms', 'held', 'doc_id')},
    {nb_sql('mf', 'trained', 'toxic')}, {nb_score_sql('sf', 'mf', 'held', 'doc_id')},
    crec AS (SELECT prompt, source AS model_type, doc_id, text, sentiment, formality,
        ss.score > 0 AS said_pos, sf.score > 0 AS said_formal, elapsed_s
      FROM held JOIN ss USING (doc_id) JOIN sf USING (doc_id)),
    conf AS (SELECT prompt, model_type,
        count(*) FILTER (said_pos AND sentiment = 'Positive') AS sentiment_tp, count(*) FILTER (said_pos AND sentiment <> 'Positive') AS sentiment_fp,
        count(*) FILTER (NOT said_pos AND sentiment = 'Negative') AS sentiment_tn, count(*) FILTER (NOT said_pos AND sentiment <> 'Negative') AS sentiment_fn,
        count(*) FILTER (said_formal AND formality = 'Formal') AS formality_tp, count(*) FILTER (said_formal AND formality <> 'Formal') AS formality_fp,
        count(*) FILTER (NOT said_formal AND formality = 'Informal') AS formality_tn, count(*) FILTER (NOT said_formal AND formality <> 'Informal') AS formality_fn
      FROM crec GROUP BY 1, 2)"""


@query(f"WITH {_CONTROL_SQL} SELECT * FROM conf")
def match_confusion(spark: SparkSession, d: str) -> DataFrame:
    """How often predicted attributes match the prompted ones."""
    return V.prompt_confusion(control_records(spark, d), KEYS, "prompt", "said_sentiment", "said_formality")


@query(f"""WITH {_CONTROL_SQL}, {LM_SQL}, {ppl_sql('pp', 'crec', 'doc_id')},
    base AS (SELECT prompt, model_type, avg(ppl) AS ppl, avg(elapsed_s) AS t, arg_min(text, doc_id) AS example_output
      FROM crec LEFT JOIN pp USING (doc_id) GROUP BY 1, 2)
    SELECT prompt, model_type, coalesce(printf('%.4f', ppl), 'N/A') AS avg_perplexity, printf('%.4f', t) AS avg_inference_time,
      printf('%.2f', (sentiment_tp + sentiment_tn) / (sentiment_tp + sentiment_tn + sentiment_fp + sentiment_fn)::DOUBLE) AS sentiment_accuracy,
      printf('%.2f', (formality_tp + formality_tn) / (formality_tp + formality_tn + formality_fp + formality_fn)::DOUBLE) AS formality_accuracy,
      example_output
    FROM conf JOIN base USING (prompt, model_type)""")
def controllable_summary(spark: SparkSession, d: str) -> DataFrame:
    """The controllable evaluation table: match accuracies beside perplexity and time."""
    records = control_records(spark, d)
    base = V.display_summary(base_summary(spark, d, records, "text"), {"avg_perplexity": 4, "avg_inference_time": 4})
    confusion = V.prompt_confusion(records, KEYS, "prompt", "said_sentiment", "said_formality")
    metrics = confusion.select(*KEYS, *[
        T.fixed_decimals(V.match_accuracy(confusion, tag), 2).alias(f"{tag}_accuracy") for tag in ("sentiment", "formality")
    ])
    out = V.join_summary(metrics, base, KEYS, ["n_valid"])
    return out.select(*KEYS, "avg_perplexity", "avg_inference_time", "sentiment_accuracy", "formality_accuracy", "example_output")


_LOSS_SQL = f"""{LM_SQL}, {pairs_sql('bp', 'benchmark', 'item_id')},
    losses AS (
      SELECT item_id, pos, -ln((coalesce(n, 0) + 0.1::DOUBLE) / (coalesce(cn, 0) + 0.1::DOUBLE * v)) AS loss
      FROM bp LEFT JOIN lm USING (ctx, token_id) LEFT JOIN ctx_n USING (ctx), vsize)"""


@query("""WITH days AS (SELECT event_type AS run_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS epoch, round(avg(value), 6) AS loss
      FROM events GROUP BY 1, 2),
    a AS (SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS better FROM days),
    b AS (SELECT *, sum(better::INT) OVER (PARTITION BY run_id ORDER BY epoch) AS island FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY run_id, island ORDER BY epoch) - 1 AS waiting FROM b),
    s AS (SELECT run_id, min(epoch) FILTER (waiting >= 3) AS stop_epoch FROM c GROUP BY 1),
    k AS (SELECT c.*, stop_epoch FROM c JOIN s USING (run_id) WHERE stop_epoch IS NULL OR epoch <= stop_epoch)
    SELECT run_id, arg_max(epoch, epoch) FILTER (better) AS best_epoch, arg_max(loss, epoch) FILTER (better) AS best_loss,
           any_value(stop_epoch) AS stop_epoch, count(*) AS epochs_run FROM k GROUP BY run_id""")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """Best and last epoch under a patience of three, with daily means as losses."""
    days = table(spark, d, "events").groupBy(
        F.col("event_type").alias("run_id"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch"),
    ).agg(F.round(F.avg("value"), 6).alias("loss"))
    return V.early_stopping(days, "run_id", "epoch", "loss", 3)


@query(f"""WITH {_LOSS_SQL} SELECT round(avg(l), 6) AS eval_loss FROM (SELECT avg(loss) AS l FROM losses GROUP BY item_id)""")
def eval_loss(spark: SparkSession, d: str) -> DataFrame:
    """Mean of batch means of the bigram loss, one benchmark item as a batch."""
    v, lm = language_model(spark, d)
    per_item = L.sentence_perplexity(table(spark, d, "benchmark"), ["item_id"], "text", lm, v)
    losses = per_item.select("item_id", F.log("perplexity").alias("loss"))
    out = V.mean_batch_loss(losses, ["item_id"], "loss")
    return out.select(F.round("eval_loss", 6).alias("eval_loss"))
