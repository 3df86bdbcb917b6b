"""Candidate distributions, mask-predict selection, losses and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseforge.functions.draws import below, uniform
from proseforge.functions.text import tokens
from proseforge.operators import candidates as K
from proseforge.operators import ngram_lm as L
from proseforge.operators import vectors as X
from proseforge.operators.joins import lookup
from proseforge.operators.tokens import UNK, build_vocab
from proseforge.plans import sqlparts as S
from proseforge.plans.examples import doc_vocab
from proseforge.plans.registry import query
from proseforge.plans.scoring import LM_SQL, language_model, pairs_sql
from proseforge.session import cut_lineage
from proseforge.sources.readers import table, text_table

SEED = 77
CTX = ["ctx"]


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """(ctx, token_id, logit): successors of every token, logit = log count."""
    return L.successors(language_model(spark, d)[1])


CAND_SQL = f"{LM_SQL}, cand AS (SELECT ctx, token_id, ln(n::DOUBLE) AS logit FROM lm)"


def probs_sql(source: str, name: str = "probs") -> str:
    return f"""
    {name}_e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY ctx)) AS e FROM {source}),
    {name} AS (SELECT ctx, token_id, logit, e / sum(e) OVER (PARTITION BY ctx) AS p FROM {name}_e)"""


def topk_sql(source: str, k: int, name: str = "topk") -> str:
    return f"""
    {name} AS (SELECT ctx, token_id, logit FROM (
      SELECT *, rank() OVER (PARTITION BY ctx ORDER BY logit DESC) AS r FROM {source}) WHERE r <= {k})"""


def topp_sql(source: str, p: float, name: str = "topp") -> str:
    return f"""{probs_sql(source, name + '_q')},
    {name} AS (SELECT ctx, token_id, logit FROM (
      SELECT *, sum(p) OVER w AS cum, row_number() OVER w AS r FROM {name}_q
      WINDOW w AS (PARTITION BY ctx ORDER BY logit DESC, token_id ROWS UNBOUNDED PRECEDING))
      WHERE cum <= {p}::DOUBLE + 1e-12::DOUBLE OR r = 1)"""


def _sizes(df: DataFrame, *keys: str) -> DataFrame:
    """Length and sum of each vector."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    squares = F.transform("vec", lambda x: x * x)
    return df.select(
        *keys, F.round(F.sqrt(total(squares)), 6).alias("norm"), F.round(total(F.col("vec")), 6).alias("total")
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"""WITH {CAND_SQL}
    SELECT ctx, token_id, round(CASE WHEN token_id = 1 THEN -1e9 ELSE logit END::DOUBLE, 6) AS logit FROM cand""")
def suppress_ids(spark: SparkSession, d: str) -> DataFrame:
    """The unknown token made impossible."""
    banned = spark.createDataFrame([(UNK,)], "token_id int")
    return _rounded(K.suppress(candidates(spark, d), banned), "logit")


@query(f"""WITH {CAND_SQL}, {pairs_sql('cp', '(SELECT *, conv_id * 1000 + turn AS ck FROM conversations)', 'ck')},
    seen AS (SELECT DISTINCT ctx, token_id FROM cp)
    SELECT c.ctx, c.token_id, round(logit / 0.8::DOUBLE / CASE WHEN s.ctx IS NULL THEN 1 ELSE 1.5::DOUBLE END, 6) AS logit
    FROM cand c LEFT JOIN seen s USING (ctx, token_id)""")
def penalise_seen(spark: SparkSession, d: str) -> DataFrame:
    """Temperature, then a penalty on continuations already used in the conversations."""
    v, lm = language_model(spark, d)
    seen = L.count_bigrams(text_table(spark, d, "conversations"), "text", v).select("ctx", "token_id")
    cand = L.successors(lm).withColumn("logit", K.temperature(F.col("logit"), 0.8))
    return _rounded(K.penalise_seen(cand, seen, CTX, 1.5), "logit")


# Turns are the steps of a conversation; a position's candidates are the best successors of the token there.
_STEPS_SQL = f"""{CAND_SQL}, {topk_sql('cand', 5)}, {pairs_sql('cp', '(SELECT *, conv_id * 1000 + turn AS ck FROM conversations)', 'ck')},
    steps AS (SELECT ck // 1000 AS conv_id, ck % 1000 AS turn, cp.pos, t.token_id, round(t.logit, 5) AS logit FROM cp JOIN topk t ON t.ctx = cp.ctx),
    ordered AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM steps)"""


@query(f"""WITH RECURSIVE {_STEPS_SQL},
    fold(conv_id, k, seen, picks) AS (
      SELECT DISTINCT conv_id, 0::BIGINT, []::INT[], []::STRUCT(turn BIGINT, pos BIGINT, token_id INT, logit DOUBLE)[] FROM ordered
      UNION ALL
      SELECT conv_id, k, list_distinct(seen || list(token_id)), list({{'turn': turn, 'pos': pos, 'token_id': token_id, 'logit': logit}}) FROM (
        SELECT f.conv_id, o.k, f.seen, o.turn, o.pos, (-max(({{'l': v, 't': -o.token_id}})).t)::INT AS token_id, max(v) AS logit
        FROM fold f JOIN (SELECT * FROM ordered) o ON o.conv_id = f.conv_id AND o.k = f.k + 1,
          LATERAL (SELECT CASE WHEN list_contains(f.seen, o.token_id) THEN o.logit / 2.0::DOUBLE ELSE o.logit END AS v)
        GROUP BY ALL) GROUP BY conv_id, k, seen)
    SELECT conv_id, p.turn AS turn, p.pos::INT AS pos, p.token_id AS token_id, round(p.logit, 6) AS logit
    FROM (SELECT conv_id, unnest(picks) AS p FROM fold)""")
def penalise_growing(spark: SparkSession, d: str) -> DataFrame:
    """The best continuation at every place of a conversation, each turn penalised for what earlier turns chose."""
    v, lm = language_model(spark, d)
    best = cut_lineage(K.top_k(L.successors(lm), CTX, 5), "successors").withColumn("logit", F.round("logit", 5))
    places = L.id_pairs(text_table(spark, d, "conversations"), ["conv_id", "turn"], "text", v).select("conv_id", "turn", "pos", "ctx")
    steps = places.join(best, "ctx").select("conv_id", "turn", "pos", "token_id", "logit")
    return _rounded(K.penalise_growing(steps, ["conv_id"], "turn", 2.0), "logit")


@query(f"WITH {CAND_SQL}, {topk_sql('cand', 5)} SELECT ctx, token_id, round(logit, 6) AS logit FROM topk")
def topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The five best candidates per context, ties kept."""
    return _rounded(K.top_k(candidates(spark, d), CTX, 5), "logit")


@query(f"WITH {CAND_SQL}, {topk_sql('cand', 50)}, {topp_sql('topk', 0.9)} SELECT ctx, token_id, round(logit, 6) AS logit FROM topp")
def topk_topp_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Top-p on top of top-k."""
    return _rounded(K.top_p(K.top_k(candidates(spark, d), CTX, 50), CTX, 0.9), "logit")


@query(f"WITH {CAND_SQL}, {topp_sql('cand', 0.9)} SELECT ctx, token_id, round(logit, 6) AS logit FROM topp")
def topp_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Top-p alone, as in the variant that forgets the top-k cut."""
    return _rounded(K.top_p(candidates(spark, d), CTX, 0.9), "logit")


@query(f"WITH {CAND_SQL}, {probs_sql('cand')} SELECT ctx, token_id, round(p, 9) AS p FROM probs")
def softmax_probs(spark: SparkSession, d: str) -> DataFrame:
    """Next-token probabilities."""
    out = K.softmax(candidates(spark, d), CTX)
    return out.select("ctx", "token_id", F.round("p", 9).alias("p"))


# Blocking every candidate of some contexts exercises the fallback.
_BLOCK = f"({S.u(SEED, 'block', 'ctx')} < 0.1 OR {S.u(SEED, 'block', 'ctx', 'token_id')} < 0.1)"


@query(f"""WITH {CAND_SQL},
    part AS (SELECT ctx, token_id, CASE WHEN {_BLOCK} THEN -1e9::DOUBLE ELSE logit END AS logit FROM cand),
    dead AS (SELECT ctx FROM part GROUP BY ctx HAVING max(logit) <= -1e9),
    fixed AS (
      SELECT ctx, token_id, CASE WHEN token_id = 1 AND ctx IN (FROM dead) THEN 0 ELSE logit END AS logit FROM part
      UNION ALL SELECT ctx, 1, 0 FROM dead WHERE ctx NOT IN (SELECT ctx FROM part WHERE token_id = 1)),
    {probs_sql('fixed')},
    clamped AS (SELECT ctx, token_id, greatest(least(p, 1), 1e-4::DOUBLE) AS p FROM probs)
    SELECT ctx, token_id, round(p / sum(p) OVER (PARTITION BY ctx), 6) AS p FROM clamped""")
def safe_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Clamped and renormalised probabilities, unknown token where all is blocked."""
    ctx, token = F.col("ctx"), F.col("token_id")
    block = below(SEED, "block", 0.1, ctx) | below(SEED, "block", 0.1, ctx, token)
    part = candidates(spark, d).withColumn("logit", F.when(block, F.lit(K.BLOCKED)).otherwise(F.col("logit")))
    return _rounded(K.safe_probabilities(part, CTX).select("ctx", "token_id", "p"), "p")


@query(f"""WITH {CAND_SQL}, hot AS (SELECT ctx, token_id, logit / 0.8::DOUBLE AS logit FROM cand),
    {topk_sql('hot', 50)}, {topp_sql('topk', 0.9)}, {probs_sql('topp')},
    summed AS (SELECT *, sum(p) OVER w AS cum, row_number() OVER w AS r, {S.u(SEED, 'draw', 'ctx')} AS u FROM probs
      WINDOW w AS (PARTITION BY ctx ORDER BY p DESC, token_id ROWS UNBOUNDED PRECEDING))
    SELECT ctx, coalesce(arg_min(token_id, r) FILTER (cum > u), arg_max(token_id, r)) AS token_id FROM summed GROUP BY ctx""")
def sample_next(spark: SparkSession, d: str) -> DataFrame:
    """One drawn successor per context after temperature, top-k and top-p."""
    cand = candidates(spark, d).withColumn("logit", K.temperature(F.col("logit"), 0.8))
    kept = K.softmax(K.top_p(K.top_k(cand, CTX, 50), CTX, 0.9), CTX)
    return K.draw_one(kept, CTX, SEED)


@query(f"""WITH {CAND_SQL} SELECT ctx, token_id, round(logit, 6) AS logit
    FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY logit DESC, token_id) AS r FROM cand) WHERE r = 1""")
def argmax_next(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent successor of every token."""
    return _rounded(K.argmax(candidates(spark, d), CTX), "logit")


@query(f"""WITH {CAND_SQL}, {probs_sql('cand')},
    vecs AS (SELECT vec_id AS token_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings),
    cells AS (SELECT ctx, dim, greatest(-10, least(10, sum(p * x))) AS value FROM probs JOIN vecs USING (token_id) GROUP BY ctx, dim),
    sizes AS (SELECT ctx, sqrt(sum(value * value)) AS norm, sum(value) AS total FROM cells GROUP BY ctx)
    SELECT ctx, round(coalesce(norm, 0), 6) AS norm, round(coalesce(total, 0), 6) AS total
    FROM (SELECT DISTINCT ctx FROM probs) LEFT JOIN sizes USING (ctx)""")
def expected_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Length and sum of the probability-weighted embedding of each context's candidates."""
    probs = K.softmax(candidates(spark, d), CTX)
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vec"))
    return _sizes(K.expected_vectors(probs, vecs, CTX, 64), "ctx")


_PRED_SQL = f"""{CAND_SQL}, {probs_sql('cand')},
    best AS (SELECT ctx, token_id, p FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY logit DESC, token_id) AS r FROM probs) WHERE r = 1),
    turns AS (SELECT *, conv_id * 1000 + turn AS sk FROM conversations), {pairs_sql('tp', 'turns', 'sk')},
    preds AS (SELECT sk, pos::INT AS pos, best.token_id, round(p, 9) AS prob FROM tp JOIN best USING (ctx) WHERE {S.u(SEED, 'mask', 'sk', 'pos')} < 0.3)"""


def masked_predictions(spark: SparkSession, d: str) -> DataFrame:
    """(sk, pos, token_id, prob): the best guess for a random third of the positions of each turn."""
    v, lm = language_model(spark, d)
    probs = K.softmax(L.successors(lm), CTX)
    best = cut_lineage(
        K.argmax(probs, CTX).join(probs.select("ctx", "token_id", "p"), ["ctx", "token_id"]).select("ctx", "token_id", "p"), "best"
    )
    turns = text_table(spark, d, "conversations").withColumn("sk", F.col("conv_id") * 1000 + F.col("turn"))
    pairs = L.id_pairs(turns, ["sk"], "text", v).drop("token_id")
    masked = pairs.filter(uniform(SEED, "mask", F.col("sk"), F.col("pos")) < 0.3)
    return masked.join(best, "ctx").select("sk", "pos", "token_id", F.round("p", 9).alias("prob"))


@query(f"""WITH {_PRED_SQL},
    top AS (SELECT sk, max(prob) AS m, (list(pos ORDER BY prob DESC, pos))[1] AS spot FROM preds GROUP BY sk)
    SELECT sk, pos, token_id, prob FROM preds JOIN top USING (sk) WHERE prob >= 0.6 OR (m < 0.6 AND pos = spot)""")
def commit_confident(spark: SparkSession, d: str) -> DataFrame:
    """Guesses above the threshold, else the best one of the turn."""
    return K.commit_confident(masked_predictions(spark, d), ["sk"])


@query(f"""WITH {_PRED_SQL},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY prob DESC, pos) AS r, count(*) OVER (PARTITION BY sk) AS m FROM preds)
    SELECT sk, pos, token_id, prob FROM ranked WHERE r <= greatest(1, floor(m * {0.5 + (0.05 - 0.5) * (3 / 10)}::DOUBLE))""")
def commit_scheduled(spark: SparkSession, d: str) -> DataFrame:
    """The share of guesses that step 3 of 10 commits."""
    return K.commit_scheduled(masked_predictions(spark, d), ["sk"], 3, 10)


@query(f"""WITH {CAND_SQL}, open AS (SELECT ctx, token_id, CASE WHEN token_id = 1 THEN -1e10::DOUBLE ELSE logit END AS logit FROM cand),
    top AS (SELECT ctx, max(logit) AS m FROM open GROUP BY ctx),
    norm AS (SELECT ctx, m + ln(sum(exp(logit - m))) AS lse FROM open JOIN top USING (ctx) GROUP BY ctx, m),
    loss AS (SELECT ctx, token_id, lse - logit AS loss FROM open JOIN norm USING (ctx) WHERE token_id <> 1),
    {pairs_sql('bp', 'benchmark', 'item_id')},
    tgt AS (SELECT *, {S.u(SEED, 'label', 'item_id', 'pos')} < 0.5 AS scored FROM bp)
    SELECT item_id, round(coalesce(avg(loss) FILTER (scored), 0), 6) AS loss, count(loss) FILTER (scored) AS n_scored, count(*) AS n_positions
    FROM tgt LEFT JOIN loss USING (ctx, token_id) GROUP BY item_id""")
def masked_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Mean loss of each benchmark item over its labelled positions, the unknown token blocked."""
    v, lm = language_model(spark, d)
    blocked = spark.createDataFrame([(UNK,)], "token_id int")
    losses = K.token_losses(L.successors(lm), blocked, CTX).filter(F.col("token_id") != UNK)
    targets = L.id_pairs(table(spark, d, "benchmark"), ["item_id"], "text", v)
    joined = lookup(targets, cut_lineage(losses, "losses"), ["ctx", "token_id"], ["loss"], ["item_id", "pos"])
    scored = F.when(uniform(SEED, "label", F.col("item_id"), F.col("pos")) < 0.5, F.col("loss"))
    return joined.groupBy("item_id").agg(
        F.round(K.mean_loss(scored), 6).alias("loss"), F.count(scored).alias("n_scored"), F.count(F.lit(1)).alias("n_positions")
    )


STEPS = 1000
_SCHEDULES_SQL = f"""
    steps AS (SELECT unnest(range({STEPS}))::INT AS t),
    lin AS (SELECT t, 1e-4::DOUBLE + (0.02 - 1e-4)::DOUBLE * t / {STEPS - 1}::DOUBLE AS beta FROM steps),
    co AS (SELECT t, greatest(1e-8::DOUBLE, least(0.999::DOUBLE, 1 - pow(cos(((t + 1) / {STEPS}::DOUBLE + 0.008::DOUBLE) / 1.008::DOUBLE * pi() / 2), 2)
        / pow(cos((t / {STEPS}::DOUBLE + 0.008::DOUBLE) / 1.008::DOUBLE * pi() / 2), 2))) AS beta FROM steps),
    lin_a AS (SELECT t, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS a FROM lin),
    cos_a AS (SELECT t, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS a FROM co)"""


def _noisy_sql(schedule: str) -> str:
    n = f"sqrt(-2 * ln(1 - {S.u(SEED, 'n1', 'vec_id', 'dim')})) * cos(2 * pi() * {S.u(SEED, 'n2', 'vec_id', 'dim')})"
    return f"""WITH {_SCHEDULES_SQL},
    v AS (SELECT vec_id, floor({S.u(SEED, 'step', 'vec_id')} * {STEPS})::INT AS t, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings),
    SELECT vec_id, t, dim::INT AS dim, round(sqrt(a) * x + sqrt(1 - a) * {n}, 6) AS value FROM v JOIN {schedule} USING (t)"""


def _noisy(spark: SparkSession, d: str, schedule: DataFrame) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    rows = rows.withColumn("t", X.random_step(SEED, STEPS, [F.col("vec_id")]))
    out = X.add_noise(rows, "vec", schedule, SEED, ["vec_id"])
    return out.select("vec_id", "t", F.posexplode("noisy").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(_noisy_sql("cos_a"))
def noise_vectors_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings noised to a random step of the cosine schedule."""
    return _noisy(spark, d, X.cosine_schedule(spark, STEPS))


@query(_noisy_sql("lin_a"))
def noise_vectors_linear(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings noised to a random step of the linear schedule."""
    return _noisy(spark, d, X.linear_schedule(spark, STEPS))


@query(f"""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim,
        CASE WHEN {S.u(SEED, 'cfg', 'vec_id')} < 0.1 THEN 0 ELSE 1 END AS keep FROM embeddings)
    SELECT vec_id, dim::INT AS dim, keep,
      round(CASE WHEN abs(x) < 0.01 THEN 0 ELSE greatest(-10, least(10, x * 100)) END * keep + 0.0, 6) AS value FROM v""")
def sanitise_and_drop(spark: SparkSession, d: str) -> DataFrame:
    """Non-finite values zeroed, large ones clamped, a tenth of the vectors dropped."""
    spoilt = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 0.01, F.lit(float("nan"))).otherwise(x.cast("double") * 100))
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.when(uniform(SEED, "cfg", F.col("vec_id")) < 0.1, 0).otherwise(1).alias("keep"), X.sanitise(spoilt).alias("vec")
    )
    out = rows.withColumn("vec", X.drop_condition(F.col("vec"), F.col("keep")))
    return out.select("vec_id", "keep", F.posexplode("vec").alias("dim", "value")).withColumn("value", F.round(F.col("value") + 0.0, 6))


_ALIGN_NOISE = f"std * sqrt(-2 * ln(1 - {S.u(SEED, 'n1', 'c.id', 'c.dim')})) * cos(2 * pi() * {S.u(SEED, 'n2', 'c.id', 'c.dim')})"
_ALIGN_SQL = f"""WITH {S.vocab_cte()}, {S.vocab_cte('conversations', name='tv')},
    src AS (SELECT token, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM vocab JOIN embeddings ON vec_id = id),
    s AS (SELECT stddev_samp(x) AS std FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)),
    cells AS (SELECT token, id, unnest(range(64)) AS dim FROM tv),
    vals AS (SELECT c.token, c.id, x IS NOT NULL AS copied, coalesce(x, {_ALIGN_NOISE}) AS value
      FROM s, cells c LEFT JOIN src ON src.token = c.token AND src.dim = c.dim)
    SELECT token, id, copied, round(sqrt(sum(value * value)), 6) AS norm, round(sum(value), 6) AS total FROM vals GROUP BY ALL"""


@query(_ALIGN_SQL)
def align_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of one vocabulary started from another's where tokens agree."""
    turns = text_table(spark, d, "conversations")
    target = build_vocab(turns.select(tokens(F.col("text")).alias("t")), "t")
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    out = X.align_vectors(target, doc_vocab(spark, d), vecs, 64, SEED)
    return _sizes(out, "token", "id", "copied")
