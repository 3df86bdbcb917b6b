"""Generation, teacher curation, files and the streaming job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from proseforge.functions import prompts as P
from proseforge.functions import text as T
from proseforge.functions.draws import uniform
from proseforge.operators import classify as C
from proseforge.operators import callbacks, dedup, teacher, tokens
from proseforge.operators import evaluate as V
from proseforge.operators import generate as G
from proseforge.operators import ngram_lm as L
from proseforge.operators.tokens import UNK
from proseforge.plans import sqlparts as S
from proseforge.plans.corpus import LABELLED_SQL, REVIEW_SQL, labelled
from proseforge.plans.distributions import probs_sql, topk_sql, topp_sql
from proseforge.plans.examples import PAIRS_SQL, VOCAB_SQL, doc_vocab, teacher_pairs
from proseforge.plans.registry import query
from proseforge.plans.scoring import (
    REPORT_SQL,
    KEYS,
    SUMMARY_SQL,
    base_summary,
    held_out_predictions,
    language_model,
    nb_model,
    nb_score_sql,
    nb_sql,
    turn_records,
)
from proseforge.session import cut_lineage, work_dir
from proseforge.sources import readers, sinks, versions
from proseforge.sources.readers import text_table
from proseforge.streaming import tag_balance as B
from proseforge.streaming.dedup import first_wins_stream, run_first_wins
from proseforge.streaming.generation import generate_in_batches

SEED = 1234

# --- outputs and work lists ---


@query(f"""WITH {PAIRS_SQL}, said AS (SELECT * FROM pairs WHERE text IS NOT NULL),
    raw AS (SELECT conv_id, turn, prompt, 'continued' AS kind, prompt || ' ' || text || '<|endoftext|>' AS raw FROM said
      UNION ALL SELECT conv_id, turn, prompt, 'answered', text FROM said UNION ALL SELECT conv_id, turn, prompt, 'silent', prompt FROM pairs WHERE text IS NULL),
    cut AS (SELECT *, CASE WHEN prompt <> '' AND starts_with(raw, prompt) THEN substr(raw, length(prompt) + 1)
        WHEN strpos(raw, ':') > 0 THEN substr(raw, strpos(raw, ':') + 1) ELSE raw END AS body FROM raw),
    done AS (SELECT conv_id, turn, kind, {S.strip("replace(replace(" + S.strip('body') + ", '<|endoftext|>', ''), '\\n', ' ')")} AS sentence FROM cut)
    SELECT * FROM done WHERE sentence <> ''""")
def clean_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Every reply to a user turn as a generator that repeats its prompt gives it, and as one that does not; cleaned, empty ones dropped.

    Turns without a reply give nothing but their prompt.
    """
    pairs = teacher_pairs(spark, d)
    said = pairs.filter(F.col("text").isNotNull())
    kind = lambda rows, name, raw: rows.select("conv_id", "turn", "prompt", F.lit(name).alias("kind"), raw.alias("raw"))
    rows = kind(said, "continued", F.concat("prompt", F.lit(" "), "text", F.lit("<|endoftext|>")))
    rows = rows.unionByName(kind(said, "answered", F.col("text"))).unionByName(kind(pairs.filter(F.col("text").isNull()), "silent", F.col("prompt")))
    out = T.settle(rows, "sentence", T.clean_output(F.col("raw"), F.col("prompt")))
    return out.filter(F.col("sentence") != "").select("conv_id", "turn", "kind", "sentence")


MODELS = ["assistant", "user", "system"]
ITERATIONS = 3


@query(f"""WITH prompts AS (SELECT DISTINCT 'conv ' || conv_id AS prompt FROM conversations),
    done AS (SELECT 'conv ' || conv_id AS prompt, role AS model_type FROM conversations GROUP BY ALL HAVING count(*) >= {ITERATIONS}),
    models AS (SELECT unnest(['assistant', 'user', 'system']) AS model_type), its AS (SELECT unnest(range({ITERATIONS}))::INT AS iter)
    SELECT prompt, model_type, iter FROM prompts, models, its WHERE (prompt, model_type) NOT IN (SELECT (prompt, model_type) FROM done)""")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """Prompt, model and iteration still to run, given what is already recorded."""
    prompts = text_table(spark, d, "conversations").select(F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("prompt"))
    return G.work_list(prompts, MODELS, turn_records(spark, d), ITERATIONS)


@query(f"""SELECT 'conv ' || conv_id AS prompt, role AS model_type, string_agg({S.strip('text')}, ' | ' ORDER BY turn) AS sentences,
      count(*)::INT AS n, round(avg(length(text) / 1024.0::DOUBLE), 6) AS avg_inference_time
    FROM conversations WHERE {S.strip('text')} <> '' GROUP BY ALL""")
def generation_records(spark: SparkSession, d: str) -> DataFrame:
    """Sentences gathered per prompt and model, with the mean generation time."""
    out = G.to_records(turn_records(spark, d))
    return out.select(
        *KEYS, F.array_join("generated_sentences", " | ").alias("sentences"), F.size("generated_sentences").alias("n"),
        F.round("avg_inference_time", 6).alias("avg_inference_time"),
    )


def _reverse_words(prompts: list[str]) -> list[str]:
    return [" ".join(reversed(p.split())) for p in prompts]


def _repeat(prompts: list[str]) -> list[str]:
    return [f"{p} {p}" for p in prompts]


@query(f"""WITH p AS (SELECT DISTINCT text AS prompt FROM conversations WHERE role = 'user'), its AS (SELECT unnest(range(2))::INT AS iter)
    SELECT prompt, 'reverse' AS model_type, iter, array_to_string(list_reverse({S.tokens('prompt')}), ' ') AS sentence, TRUE AS timed FROM p, its
    UNION ALL SELECT prompt, 'repeat', iter, prompt || ' ' || prompt, TRUE FROM p, its""")
def pluggable_generation(spark: SparkSession, d: str) -> DataFrame:
    """Generators per model run in batches over a work list, each call timed."""
    prompts = text_table(spark, d, "conversations").filter(F.col("role") == "user").select(F.col("text").alias("prompt"))
    tasks = G.work_list(prompts, ["reverse", "repeat"], None, 2)
    out = G.generate(tasks, {"reverse": _reverse_words, "repeat": _repeat})
    return out.select("prompt", "model_type", "iter", "sentence", (F.col("elapsed_s") >= 0).alias("timed"))


def _first_words(batch: pd.DataFrame) -> pd.DataFrame:
    words = batch["text"].str.split()
    return pd.DataFrame({"doc_id": batch["doc_id"], "n_words": words.str.len(), "initials": words.map(lambda w: "".join(x[0] for x in w))})


@query(f"""SELECT doc_id, len({S.tokens('text')}) AS n_words, array_to_string(list_transform({S.tokens('text')}, lambda x: left(x, 1)), '') AS initials
    FROM documents WHERE length(text) % 2 = 0""")
def python_callbacks(spark: SparkSession, d: str) -> DataFrame:
    """A Python predicate and a Python batch function over whole texts."""
    docs = text_table(spark, d, "documents").select("doc_id", "text")
    even = callbacks.keep_where(docs, "text", lambda t: len(t) % 2 == 0)
    return callbacks.map_batches(even, _first_words, "doc_id long, n_words long, initials string")


@query(f"""WITH d AS (SELECT DISTINCT unnest({S.tokens('text')}) AS token FROM documents),
    c AS (SELECT DISTINCT unnest({S.tokens('text')}) AS token FROM conversations)
    SELECT token, token IN (FROM d) AS in_documents FROM (SELECT token FROM d UNION SELECT token FROM c)
    WHERE token NOT IN (SELECT unnest({S.tokens('text')}) FROM benchmark)""")
def token_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union of two token sets less a third, with membership in the first."""
    words = lambda name: text_table(spark, d, name).select(F.explode(T.tokens(F.col("text"))).alias("token"))
    docs = words("documents").distinct()
    kept = dedup.difference(dedup.union_distinct(docs, words("conversations")), words("benchmark"), ["token"])
    marked = kept.join(docs.withColumn("in_documents", F.lit(True)), "token", "left")
    return marked.withColumn("in_documents", F.coalesce("in_documents", F.lit(False)))


def _choices_sql(name: str, source: str) -> str:
    """``name`` (ctx, r, cum, token_id): the cut and summed choices of each context."""
    return f"""{topk_sql(source, 50, name + '_k')}, {topp_sql(name + '_k', 0.9, name + '_n')}, {probs_sql(name + '_n', name + '_p')},
    {name} AS (SELECT ctx, token_id, row_number() OVER w AS r, round(sum(p) OVER w, 9) AS cum FROM {name}_p
      WINDOW w AS (PARTITION BY ctx ORDER BY p DESC, token_id ROWS UNBOUNDED PRECEDING))"""


_STEP_U = f"(('0x' || substr(md5(concat_ws(':', '{SEED}', conv_id, turn, 'step' || (step + 1))), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _pick_sql(choices: str) -> str:
    return f"""(SELECT coalesce(arg_min(token_id, r) FILTER (cum > u), arg_max(token_id, r)) FROM {choices} WHERE ctx = cur)"""


_SAMPLER_SQL = f"""WITH RECURSIVE {VOCAB_SQL},
    end_t AS (SELECT list_concat({S.tokens('text')}, ['</s>']) AS t FROM documents),
    end_p AS (SELECT unnest(t[1:len(t) - 1]) AS l, unnest(t[2:]) AS r FROM end_t WHERE len(t) >= 2),
    cand AS (SELECT coalesce(a.id, 1) AS ctx, coalesce(b.id, 1) AS token_id, ln(count(*)::DOUBLE) AS logit
      FROM end_p LEFT JOIN vocab a ON a.token = l LEFT JOIN vocab b ON b.token = r WHERE b.id IS NOT NULL GROUP BY 1, 2),
    closed AS (SELECT * FROM cand WHERE token_id <> 5),
    {_choices_sql('open', 'closed')}, {_choices_sql('free', 'cand')},
    begun AS (SELECT conv_id, turn, CASE WHEN len(t) = 0 THEN 5 ELSE coalesce((SELECT id FROM vocab WHERE token = t[-1]), 1) END AS cur
      FROM (SELECT conv_id, turn, {S.tokens('text')} AS t FROM conversations WHERE role = 'user')),
    st AS (
      SELECT conv_id, turn, 0 AS step, cur, FALSE AS over FROM begun
      UNION ALL
      SELECT conv_id, turn, step + 1, coalesce(t, cur), t IS NULL OR t = 5 FROM (
        SELECT *, CASE WHEN step < 32 THEN {_pick_sql('open')} ELSE {_pick_sql('free')} END AS t
        FROM (SELECT *, {_STEP_U} AS u FROM st WHERE NOT over AND step < 64)))
    SELECT conv_id, turn, coalesce(string_agg(token, ' ' ORDER BY step) FILTER (step > 0 AND NOT over), '') AS text,
           (count(*) FILTER (step > 0 AND NOT over))::INT AS n_tokens
    FROM st JOIN vocab ON id = cur GROUP BY conv_id, turn"""


@query(_SAMPLER_SQL)
def sampled_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts continued from every user turn by the bigram sampler, 32 to 64 tokens."""
    v = doc_vocab(spark, d)
    # Two tables of choices are made of the counts.
    lm = cut_lineage(L.count_bigrams(text_table(spark, d, "documents"), "text", v, end="</s>"), "bigrams")
    keys = ["conv_id", "turn"]
    asked = text_table(spark, d, "conversations").filter(F.col("role") == "user")
    start = G.last_known_id(asked, keys, T.tokens(F.col("text")), v, UNK)
    out = G.sample_texts(start, keys, "last_id", G.next_token_table(lm.filter(F.col("token_id") != UNK)), SEED)
    texts = tokens.decode(out, keys, "new_ids", v, tokens.blocked_ids(v))
    return texts.withColumn("n_tokens", F.size(T.tokens(F.col("text"))))


@query(f"""WITH p AS (SELECT DISTINCT text AS prompt FROM conversations WHERE role = 'user'), its AS (SELECT unnest(range(2))::INT AS iter),
    every AS (SELECT prompt, 'reverse' AS model_type, iter, array_to_string(list_reverse({S.tokens('prompt')}), ' ') AS sentence FROM p, its
      UNION ALL SELECT prompt, 'repeat', iter, prompt || ' ' || prompt FROM p, its)
    SELECT * FROM every WHERE NOT (model_type = 'repeat' AND length(prompt) % 2 = 0)""")
def generation_in_batches(spark: SparkSession, d: str) -> DataFrame:
    """Generation in committed batches of prompts and models, without those that an earlier run has finished."""
    prompts = text_table(spark, d, "conversations").filter(F.col("role") == "user").select(F.col("text").alias("prompt"))
    earlier = prompts.distinct().filter(F.length("prompt") % 2 == 0).select("prompt", F.lit("repeat").alias("model_type"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("iter"))
    out = generate_in_batches(
        prompts, {"reverse": _reverse_words, "repeat": _repeat}, 2, work_dir(spark, "generated"), work_dir(spark, "generation-state"), earlier, keys_per_batch=250)
    return out.select("prompt", "model_type", "iter", "sentence")


# --- teacher curation ---


@query(f"""WITH {PAIRS_SQL},
    joined AS (SELECT conv_id, turn, prompt, prompt || ' ' || text AS text FROM pairs
      UNION ALL SELECT conv_id, turn, '', text FROM pairs UNION ALL SELECT conv_id, turn, prompt, text FROM pairs),
    filled AS (SELECT conv_id, turn, coalesce(prompt, '') AS prompt, coalesce(text, '') AS text FROM joined)
    SELECT * FROM filled WHERE text <> '' AND (prompt = '' OR starts_with(text, prompt)) AND length(text) - length(prompt) >= 40""")
def teacher_pairs_valid(spark: SparkSession, d: str) -> DataFrame:
    """Complete, prompt-less and mismatched pairs, filtered to the valid ones."""
    pairs = teacher_pairs(spark, d)
    full = pairs.withColumn("text", F.concat("prompt", F.lit(" "), F.col("text")))
    bare = pairs.withColumn("prompt", F.lit(None).cast("string"))
    return teacher.valid_pairs(full.unionByName(bare).unionByName(pairs))


@query(f"""WITH {PAIRS_SQL},
    v AS (SELECT conv_id, turn, text FROM pairs WHERE text IS NOT NULL AND length(text) >= 40),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS rn FROM v)
    SELECT conv_id, turn, text FROM ranked WHERE rn = 1 AND text NOT IN (SELECT text FROM documents)
      AND text NOT IN (SELECT text FROM conversations WHERE role <> 'assistant')""")
def unseen_texts(spark: SparkSession, d: str) -> DataFrame:
    """Replies that are new among themselves, and neither a document nor a turn that is no reply."""
    rows = teacher_pairs(spark, d).filter(F.length("text") >= 40).select("conv_id", "turn", "text")
    asked = text_table(spark, d, "conversations").filter(F.col("role") != "assistant").select("text")
    seen = text_table(spark, d, "documents").select("text").unionByName(asked)
    return dedup.not_seen(rows, seen, "text", ["conv_id", "turn"])


_ROUNDS = 3


def _teacher_sql() -> str:
    """Round 0 asks every prompt; each later round asks a fresh sample, as many as are missing."""
    parts = [f"""{PAIRS_SQL},
    ask AS (SELECT conv_id * 1000 + turn AS prompt_id, conv_id, prompt FROM pairs),
    goal AS (SELECT count(*) AS n FROM ask)"""]
    for r in range(_ROUNDS + 1):
        asked = "SELECT * FROM ask" if r == 0 else (
            f"SELECT * FROM ask ORDER BY {S.u(SEED + r, 'topup', 'prompt_id')}, prompt_id LIMIT (SELECT n - (SELECT count(*) FROM kept{r - 1}) FROM goal)")
        parts.append(f"""
    asked{r} AS ({asked}),
    gen{r} AS (SELECT prompt_id, prompt, prompt || ' ' || text AS text FROM asked{r} JOIN conversations c
      ON c.conv_id = asked{r}.conv_id AND c.turn = prompt_id % 1000 + 1 + {r} WHERE length(text) + 1 >= 40)""")
        if r == 0:
            parts.append("kept0 AS (SELECT DISTINCT ON (text) prompt_id, prompt, text, 0 AS round FROM gen0 ORDER BY text, prompt_id)")
        else:
            parts.append(f"""kept{r} AS (SELECT * FROM kept{r - 1} UNION ALL
      SELECT * FROM (SELECT DISTINCT ON (text) prompt_id, prompt, text, {r} AS round FROM gen{r} ORDER BY text, prompt_id)
      WHERE text NOT IN (SELECT text FROM kept{r - 1}) AND (SELECT n > (SELECT count(*) FROM kept{r - 1}) FROM goal))""")
    return f"WITH {', '.join(parts)} SELECT prompt_id, prompt, text, round FROM kept{_ROUNDS} ORDER BY round, prompt_id LIMIT (SELECT n FROM goal)"


def _teacher(spark: SparkSession, d: str):
    """The prompts, and a generator whose round r answers with the turn r places after the reply."""
    turns = text_table(spark, d, "conversations")
    prompts = turns.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), "conv_id", "turn", F.col("text").alias("prompt")
    )

    def answer(asked: DataFrame, round_no: int) -> DataFrame:
        replies = turns.select("conv_id", (F.col("turn") - 1 - round_no).alias("turn"), F.col("text").alias("reply"))
        return asked.join(replies, ["conv_id", "turn"]).select(
            "prompt_id", "prompt", F.concat("prompt", F.lit(" "), "reply").alias("text")
        )

    return prompts, answer


@query(_teacher_sql())
def teacher_topup(spark: SparkSession, d: str) -> DataFrame:
    """Curation with top-up rounds."""
    prompts, answer = _teacher(spark, d)
    return teacher.curate(prompts, answer, prompts.count(), max_rounds=_ROUNDS)


@query(_teacher_sql())
def teacher_resume(spark: SparkSession, d: str) -> DataFrame:
    """A run that stopped after its first round, its cache swapped for a validated one, and taken up again: the result is that of one run."""
    prompts, answer = _teacher(spark, d)
    cache = work_dir(spark, "teacher-cache")
    versions.write(teacher.curate(prompts, answer, prompts.count(), max_rounds=0), cache, "after round 0")
    known = readers.revalidate_cache(spark, cache)
    return versions.write(teacher.curate(prompts, answer, prompts.count(), max_rounds=_ROUNDS, existing=known), cache, "complete")


# --- files ---

_DOC = Y.StructType([Y.StructField("doc_id", Y.LongType()), Y.StructField("text", Y.StringType())])


@query(f"SELECT doc_id, {S.squeeze(REVIEW_SQL)} AS text FROM documents")
def jsonl_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines, cleaned file to file, and read back."""
    source, target = work_dir(spark, "raw-jsonl"), work_dir(spark, "clean-jsonl")
    docs = text_table(spark, d, "documents").select("doc_id", "text")
    sinks.append_json(docs.filter(F.col("doc_id") % 2 == 0), source)
    sinks.append_json(docs.filter(F.col("doc_id") % 2 == 1), source)
    sinks.rewrite_json(spark, source, target)
    return readers.json_lines(spark, target, _DOC)


@query(f"""WITH {LABELLED_SQL}
    SELECT doc_id, sentiment, formality, {S.control_prompt('sentiment', 'formality')} || ' ' || text AS text FROM lab""")
def tagged_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """A tagged corpus stored raw, loaded, and prefixed once."""
    path = work_dir(spark, "tagged")
    sinks.append_json(labelled(spark, d).select("doc_id", "text", "sentiment", "formality"), path)
    schema = Y.StructType([Y.StructField("doc_id", Y.LongType()), *readers.TAGGED.fields])
    rows = readers.json_lines(spark, path, schema)
    prompt = P.control_prompt(F.col("sentiment"), F.col("formality"))
    return rows.withColumn("text", P.with_prompt(prompt, F.col("text")))


@query(f"""WITH {LABELLED_SQL}, l AS (SELECT unnest(string_split(text, chr(10))) AS line, toxic AS label FROM lab)
    SELECT {S.strip('line')} AS text, label::INT AS label, count(*) AS n FROM l WHERE {S.strip('line')} <> '' GROUP BY ALL""")
def labelled_line_files(spark: SparkSession, d: str) -> DataFrame:
    """Line files, one folder per label, read with the label of their folder."""
    rows = labelled(spark, d)
    paths = []
    for label in (0, 1):
        path = work_dir(spark, f"lines-{label}")
        part = rows.filter(F.col("toxic") == label)
        readers.lines(part, "text", ["doc_id"]).select("line").write.text(path)
        paths.append((path, label))
    return readers.labelled_lines(spark, paths).groupBy("text", "label").agg(F.count(F.lit(1)).alias("n"))


_SUMMARY_COLUMNS = ["prompt", "model_type", "avg_perplexity", "avg_inference_time", "example_output"]


@query(f"""WITH {SUMMARY_SQL}
    SELECT prompt, model_type, coalesce(printf('%.4f', ppl), 'N/A') AS avg_perplexity,
           printf('%.4f', t) AS avg_inference_time, example_output FROM base""")
def summary_csv(spark: SparkSession, d: str) -> DataFrame:
    """The perplexity summary written as CSV and read back as text."""
    base = base_summary(spark, d, turn_records(spark, d), "sentence")
    path = work_dir(spark, "summary")
    sinks.summary_csv(V.display_summary(base, {"avg_perplexity": 4, "avg_inference_time": 4}), _SUMMARY_COLUMNS, path)
    schema = Y.StructType([Y.StructField(c, Y.StringType()) for c in _SUMMARY_COLUMNS])
    return readers.csv_table(spark, path, schema)


@query(f"""WITH {SUMMARY_SQL}
    SELECT regexp_replace({S.strip('prompt')}, '[^a-zA-Z0-9]', '_', 'g') AS prompt_key, model_type, text AS sentence, round(ppl, 4) AS perplexity
    FROM rec JOIN pp USING (rk)""")
def detail_files(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity details, a folder per prompt and model (many prompts share folders), read back with their keys."""
    records = turn_records(spark, d)
    v, lm = language_model(spark, d)
    scores = cut_lineage(L.sentence_perplexity(records, [*KEYS, "iter"], "sentence", lm, v), "perplexities")
    path = work_dir(spark, "details")
    sinks.detail_csv(records.join(scores, [*KEYS, "iter"]), path)
    return readers.details(spark, path).withColumn("perplexity", F.round("perplexity", 4))


@query(f"""{REPORT_SQL}
    SELECT 'Accuracy: ' || printf('%.2f', avg((y = p)::INT::DOUBLE)) AS value FROM pairs
    UNION ALL SELECT printf('%-14s %.2f %.2f %.2f %d', class, pre::DOUBLE, rec::DOUBLE, f1::DOUBLE, support::BIGINT) FROM every""")
def report_file(spark: SparkSession, d: str) -> DataFrame:
    """The classifier report as a text file, read back line by line."""
    pairs = held_out_predictions(spark, d)
    report = C.report(pairs, "label", "pred", {0: "Negative", 1: "Positive"})
    path = work_dir(spark, "report")
    sinks.text_report(report, C.accuracy(pairs, "label", "pred"), path)
    return spark.read.text(path)


@query(f"""SELECT 'conv ' || conv_id AS prompt, role AS model_type, count(*)::INT AS n
    FROM conversations WHERE {S.strip('text')} <> '' GROUP BY ALL""")
def records_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """Generation records appended per run, with a broken line among them, and read back."""
    path = work_dir(spark, "records")
    records = G.to_records(turn_records(spark, d))
    for model in MODELS:
        sinks.append_records(records.filter(F.col("model_type") == model), path)
    spark.createDataFrame([('{"prompt": "cut off',)], "value string").write.mode("append").text(path)
    return readers.records(spark, path).select(*KEYS, F.size("generated_sentences").alias("n"))


_BROKEN_SQL = f"""good AS (SELECT 'conv ' || conv_id AS prompt, role AS model_type, count(*) AS n
      FROM conversations WHERE {S.strip('text')} <> '' GROUP BY ALL),
    cut AS (SELECT count(*) AS n FROM conversations WHERE turn = 0), bare AS (SELECT count(DISTINCT conv_id) AS n FROM conversations)"""


@query(f"""WITH {_BROKEN_SQL}
    SELECT (SELECT count(*) FROM good) AS n_good, cut.n + bare.n AS n_broken, cut.n AS unreadable, bare.n AS incomplete,
      (SELECT sum(n) FROM good)::BIGINT AS sentences FROM cut, bare""")
def records_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Records among lines cut off in the middle and lines without sentences: the good ones kept, the others set aside and counted."""
    path, kept, side = work_dir(spark, "records"), work_dir(spark, "records-good"), work_dir(spark, "records-broken")
    sinks.append_records(G.to_records(turn_records(spark, d)), path)
    turns = text_table(spark, d, "conversations")
    whole = F.to_json(F.struct(F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("prompt"), F.array("text").alias("generated_sentences")))
    cut = turns.filter("turn = 0").select(F.substring(whole, F.lit(1), F.length(whole) - 3).alias("value"))
    bare = turns.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("prompt"))).alias("value")).distinct()
    cut.unionByName(bare).write.mode("append").text(path)
    good, broken = readers.sorted_out(spark, path, readers.RECORDS, ["prompt", "generated_sentences"])
    counts = sinks.quarantine(good, broken, kept, side)
    reasons = spark.read.parquet(side).agg(F.count_if(F.col("reason") == "unreadable").alias("unreadable"), F.count_if(F.col("reason") == "incomplete").alias("incomplete"))
    sentences = spark.read.parquet(kept).agg(F.sum(F.size("generated_sentences")).cast("long").alias("sentences"))
    return counts.join(reasons).join(sentences)  # one row each


@query(f"""SELECT doc_id, lang, CASE WHEN doc_id % 5 <> 0 THEN {S.squeeze(REVIEW_SQL)} END AS text,
      n_chars, source, 'kept as it is \\n*' AS note, doc_id % 2 = 0 AS even, CASE WHEN doc_id % 5 <> 0 THEN 'doc_id,lang,text,more,even' ELSE 'doc_id,lang,more,even' END AS fields
    FROM documents""")
def jsonl_any_fields(spark: SparkSession, d: str) -> DataFrame:
    """Lines with fields that no schema names, some without a text, cleaned file to file."""
    source, target = work_dir(spark, "raw-jsonl"), work_dir(spark, "clean-jsonl")
    more = F.struct("n_chars", F.struct("source", F.lit("kept as it is \\n*").alias("text")).alias("inner"))
    text = F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    rows = text_table(spark, d, "documents").select(
        F.to_json(F.struct("doc_id", "lang", text.alias("text"), more.alias("more"), (F.col("doc_id") % 2 == 0).alias("even"))).alias("value")
    )
    rows.write.text(source)
    sinks.rewrite_json(spark, source, target)
    line = spark.read.text(target).select("value", F.parse_json("value").alias("v"))
    get = lambda at, kind: F.variant_get("v", f"$.{at}", kind)
    return line.select(
        get("doc_id", "long").alias("doc_id"), get("lang", "string").alias("lang"), get("text", "string").alias("text"), get("more.n_chars", "long").alias("n_chars"),
        get("more.inner.source", "string").alias("source"), get("more.inner.text", "string").alias("note"), get("even", "boolean").alias("even"),
        F.array_join(F.json_object_keys("value"), ",").alias("fields"),
    )


_JOINED_SQL = f"{PAIRS_SQL}, j AS (SELECT conv_id, turn, prompt, prompt || ' ' || coalesce(text, '') AS text FROM pairs)"


def _joined_pairs(spark: SparkSession, d: str) -> DataFrame:
    return teacher_pairs(spark, d).withColumn("text", F.concat("prompt", F.lit(" "), F.coalesce("text", F.lit(""))))


@query(f"""WITH {_JOINED_SQL}
    SELECT * FROM j WHERE length(text) - length(prompt) >= 40 ORDER BY conv_id, turn LIMIT 25""")
def pair_cache(spark: SparkSession, d: str) -> DataFrame:
    """A pair cache validated again into its next version, then its guarded head."""
    path = work_dir(spark, "pairs")
    versions.write(_joined_pairs(spark, d), path)
    readers.revalidate_cache(spark, path)
    return readers.cached_pairs(spark, path, 25, ["conv_id", "turn"])


@query(f"""WITH {_JOINED_SQL}, v AS (SELECT * FROM j WHERE length(text) - length(prompt) >= 40)
    SELECT 'opened before' AS reader, conv_id, turn, text FROM j UNION ALL SELECT 'first version', conv_id, turn, text FROM j
    UNION ALL SELECT 'opened after', conv_id, turn, text FROM v""")
def cache_versions(spark: SparkSession, d: str) -> DataFrame:
    """What readers see that opened a cache before and after it was validated again, and one that asks for the first version."""
    path = work_dir(spark, "pairs")
    versions.write(_joined_pairs(spark, d), path)
    before = versions.read(spark, path)
    readers.revalidate_cache(spark, path)
    seen = {"opened before": before, "opened after": versions.read(spark, path), "first version": versions.read(spark, path, 1)}
    parts = [df.select(F.lit(name).alias("reader"), "conv_id", "turn", "text") for name, df in seen.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- streaming ---


_STREAM_BUFFER = 128  # two scoring batches of 64
_STREAM_HELD = S.u(SEED, "held", "doc_id")


@query(f"""WITH {LABELLED_SQL}, lab_a AS (SELECT * FROM lab WHERE {_STREAM_HELD} < 0.5), lab_b AS (SELECT * FROM lab WHERE {_STREAM_HELD} >= 0.5),
    {nb_sql('ma', 'lab_a', 'toxic')}, {nb_sql('mb', 'lab_b', 'toxic')},
    texts AS (SELECT doc_id, text, CASE WHEN lang IN ('en', 'de') THEN 1 ELSE 0 END AS label FROM documents),
    texts_a AS (SELECT * FROM texts WHERE {_STREAM_HELD} < 0.5), texts_b AS (SELECT * FROM texts WHERE {_STREAM_HELD} >= 0.5),
    {nb_score_sql('sca', 'mb', 'texts_a', 'doc_id')}, {nb_score_sql('scb', 'ma', 'texts_b', 'doc_id')},
    sc AS (SELECT * FROM sca UNION ALL SELECT * FROM scb),
    tagged AS (SELECT doc_id, text, CASE WHEN label = 1 THEN 'Positive' ELSE 'Negative' END AS sentiment,
      CASE WHEN score > 0 THEN 'Formal' ELSE 'Informal' END AS formality FROM texts JOIN sc USING (doc_id)),
    buffered AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // {_STREAM_BUFFER} AS buffer FROM tagged),
    ranked AS (SELECT *, count(*) OVER (PARTITION BY buffer) AS size, count(*) OVER (PARTITION BY buffer, sentiment, formality) AS n,
      row_number() OVER (PARTITION BY buffer, sentiment, formality ORDER BY {S.u(SEED, 'balance', 'doc_id')}, doc_id) AS rn FROM buffered),
    lowest AS (SELECT *, min(n) OVER (PARTITION BY buffer) AS m FROM ranked)
    SELECT doc_id, text, sentiment, formality FROM lowest WHERE size < {_STREAM_BUFFER} OR rn <= m""")
def stream_tag_balance(spark: SparkSession, d: str) -> DataFrame:
    """Documents streamed, tagged, balanced in buffers that span micro-batches, appended as JSON lines."""
    out = work_dir(spark, "stream-out")
    _streamed(spark, d, out)
    schema = Y.StructType([Y.StructField("doc_id", Y.LongType()), *readers.TAGGED.fields])
    return readers.json_lines(spark, out, schema).drop("batch")


def _streamed(spark: SparkSession, d: str, out: str) -> DataFrame:
    """The stream holds every document; each half is tagged by the model of the other, which has not seen it."""
    half = uniform(SEED, "held", F.col("doc_id")) < 0.5
    first, second = [B.naive_bayes_tagger(nb_model(labelled(spark, d).filter(part), "toxic"), ["doc_id"], "text", "label") for part in (half, ~half)]
    tagger = lambda rows: second(rows.filter(half)).unionByName(first(rows.filter(~half)))
    stream = readers.stream_table(spark, d, "documents", readers.table(spark, d, "documents").schema)
    label = F.when(F.col("lang").isin("en", "de"), 1).otherwise(0)
    rows = stream.select("doc_id", "text", label.alias("label"))
    return B.run_stream(rows, tagger, ["doc_id"], out, work_dir(spark, "stream-state"), SEED, write_every=100, batch=64)


@query(f"SELECT count(*) AS rows_read, (count(*) // {_STREAM_BUFFER})::BIGINT AS buffers FROM documents")
def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    """What the streaming job has counted: rows read and full buffers written."""
    return _streamed(spark, d, work_dir(spark, "stream-out")).drop("batches")


_ARRIVALS, _FIRST_ARRIVAL = 3, 1_700_000_000


@query(f"""SELECT doc_id, lang, text FROM (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id % {_ARRIVALS}, doc_id) AS rn FROM documents)
    WHERE rn = 1""")
def stream_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Documents that arrive in three parts, the stream stopped and taken up again between them; of equal texts the first stays."""
    source, out, state = work_dir(spark, "arrivals"), work_dir(spark, "first-wins"), work_dir(spark, "first-wins-state")
    docs = text_table(spark, d, "documents").select("doc_id", "lang", "text", F.timestamp_seconds(_FIRST_ARRIVAL + F.col("doc_id") % _ARRIVALS).alias("arrived"))
    for part in range(_ARRIVALS):
        docs.filter(F.col("doc_id") % _ARRIVALS == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(docs.schema).parquet(source)
        run_first_wins(first_wins_stream(stream, "text", ["doc_id"], "arrived", 3600, ["lang"]), out, state)
    return spark.read.parquet(out).select("doc_id", "lang", "text")
