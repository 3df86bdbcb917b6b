"""Corpus preparation: clean, deduplicate, tag, balance, split, harvest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseforge.functions import prompts as P
from proseforge.functions import text as T
from proseforge.functions.draws import uniform
from proseforge.operators import dedup, joins, sampling
from proseforge.operators.numbering import id_bucket
from proseforge.plans import sqlparts as S
from proseforge.plans.registry import query
from proseforge.sources.readers import lines, parallel_rows, table, text_table

SPLIT_SEED = 7
SPLIT_SQL = f"CASE WHEN {S.u(SPLIT_SEED, 'part', 'doc_id')} < 0.8 THEN 'train' WHEN {S.u(SPLIT_SEED, 'part', 'doc_id')} < 0.9 THEN 'validation' ELSE 'test' END"


def _part():
    draw = uniform(SPLIT_SEED, "part", F.col("doc_id"))
    return F.when(draw < 0.8, "train").when(draw < 0.9, "validation").otherwise("test")


def cleaned_lines(spark: SparkSession, d: str) -> DataFrame:
    """Document lines after cleaning and the length filter, with their split."""
    docs = text_table(spark, d, "documents").select("doc_id", "lang", "text").withColumn("split", _part())
    rows = lines(docs, "text", ["doc_id", "lang", "split"])
    return T.clean_lines(rows, "line").filter(T.long_enough(F.col("line")))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with both attributes."""
    return text_table(spark, d, "documents").select("doc_id", "text", "source").join(
        table(spark, d, "labels"), "doc_id"
    ).select(
        "doc_id", "text", "source", "quality", "toxic",
        P.sentiment_name(F.col("quality")).alias("sentiment"),
        P.formality_name(F.col("toxic")).alias("formality"),
    )


LINES_SQL = f"""
    raw AS (
      SELECT doc_id, lang, {SPLIT_SQL} AS split, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos
      FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)),
    cleaned AS (SELECT doc_id, lang, split, pos, {S.clean('line')} AS line FROM raw),
    kept AS (SELECT * FROM cleaned WHERE length(line) >= 20),
    firsts AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, sha1(line) ORDER BY doc_id, pos) AS rn FROM kept)
      WHERE rn = 1)"""

LABELLED_SQL = """
    lab AS (
      SELECT d.doc_id, d.text, d.source, quality, toxic,
             CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS sentiment,
             CASE WHEN toxic = 1 THEN 'Formal' ELSE 'Informal' END AS formality
      FROM documents d JOIN labels USING (doc_id))"""


@query(f"""WITH {LINES_SQL}
    SELECT split, lang, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars,
           sum(('0x' || substr(sha1(line), 1, 8))::BIGINT)::BIGINT AS checksum
    FROM firsts GROUP BY split, lang""")
def clean_lines_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Distinct clean lines per split and language (the flagship pipeline)."""
    rows = cleaned_lines(spark, d).select(
        "split", "lang", "doc_id", "pos", T.text_key(F.col("line")).alias("key"), F.length("line").alias("chars")
    )
    first = dedup.first_wins(rows, F.col("key"), ["doc_id", "pos"], ["split"])
    return first.groupBy("split", "lang").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("chars").alias("n_chars"),
        F.sum(F.conv(F.substring("key", 1, 8), 16, 10).cast("long")).alias("checksum"),
    )


@query(f"WITH {LINES_SQL} SELECT split, doc_id, pos::INT AS pos, line FROM firsts")
def dedup_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first copy of every clean line, per split."""
    rows = cleaned_lines(spark, d).select("split", "doc_id", "pos", "line")
    return dedup.dedup_text(rows, "line", ["doc_id", "pos"], ["split"])


_ENTITIES = {"&middot;": "·", "&copy;": "©", "&quot;": '"', "&amp;?": "&"}


@query(f"""SELECT page_id, length(c) AS n_chars, sha1(c) AS key
    FROM (SELECT page_id, {S.clean('html', _ENTITIES)} AS c FROM pages)""")
def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    """The line cleaner over entity-heavy text."""
    rows = T.clean_lines(text_table(spark, d, "pages").select("page_id", "html"), "html")
    return rows.select("page_id", F.length("html").cast("long").alias("n_chars"), T.text_key(F.col("html")).alias("key"))


REVIEW_SQL = r"regexp_replace(text, '\\n\*|\n\*', ' ', 'g')"
for _old, _new in ((r"'\n'", "' '"), ("chr(10)", "' '"), (r"""'\""'""", """'"'"""), (r"""'\"'""", """'"'"""), (r"'\'", "''")):
    REVIEW_SQL = f"replace({REVIEW_SQL}, {_old}, {_new})"


@query(f"SELECT doc_id, {S.squeeze(REVIEW_SQL)} AS text FROM documents")
def clean_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Escapes, stray quotes and backslashes removed from whole texts."""
    return text_table(spark, d, "documents").select("doc_id", T.clean_review(F.col("text")).alias("text"))


@query(f"""WITH src AS (
      SELECT 'documents' AS source, doc_id AS id, string_split(text, chr(10)) AS l FROM documents
      UNION ALL SELECT 'pages', page_id, string_split(html, chr(10)) FROM pages),
    rows AS (SELECT source, id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM src)
    SELECT source, id, pos::INT AS pos FROM rows WHERE {S.header_or_markup('line')}""")
def heading_markup_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are blank, short, headings, lists, templates or table rows."""
    docs = text_table(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    pages = text_table(spark, d, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    rows = lines(docs.unionByName(pages), "text", ["source", "id"])
    return rows.filter(T.is_header_or_markup(F.col("line"))).select("source", "id", "pos")


@query(f"""WITH {LABELLED_SQL}
    SELECT doc_id, sentiment, formality, {S.control_prompt('sentiment', 'formality')} AS prompt,
           {S.control_prompt("'unspecified'", 'formality')} || ':' AS formality_prompt,
           {S.control_prompt('sentiment', 'formality')} || ' ' || text AS full_text
    FROM lab""")
def control_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Control prompts of labelled documents, and the texts behind them."""
    rows = labelled(spark, d)
    prompt = P.control_prompt(F.col("sentiment"), F.col("formality"))
    return rows.withColumn("prompt", prompt).withColumns({
        "formality_prompt": P.control_prompt(F.lit("unspecified"), F.col("formality"), separator=True),
        "full_text": P.with_prompt(F.col("prompt"), F.col("text")),
    }).drop("text", "source", "quality", "toxic")


@query(f"""WITH p AS (
      SELECT doc_id, {S.control_prompt("coalesce(CASE WHEN quality = 1 THEN 'Positive' WHEN quality = 0 THEN 'Negative' END, 'unspecified')",
                                       "coalesce(CASE WHEN toxic = 1 THEN 'Formal' WHEN toxic = 0 THEN 'Informal' END, 'unspecified')")} AS prompt
      FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, prompt,
           CASE WHEN contains(prompt, '[SENT_POS]') THEN 'Positive' WHEN contains(prompt, '[SENT_NEG]') THEN 'Negative' ELSE 'unspecified' END AS sentiment,
           CASE WHEN contains(prompt, '[FORM_FORMAL]') THEN 'Formal' WHEN contains(prompt, '[FORM_INFORMAL]') THEN 'Informal'
                WHEN contains(prompt, '[FORM_NEUTRAL]') THEN 'Neutral' ELSE 'unspecified' END AS formality
    FROM p""")
def parse_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of all documents, unlabelled ones unspecified, parsed back into attributes."""
    rows = text_table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    sentiment = F.when(F.col("quality").isNotNull(), P.sentiment_name(F.col("quality")))
    formality = F.when(F.col("toxic").isNotNull(), P.formality_name(F.col("toxic")))
    prompt = P.control_prompt_or_unspecified(sentiment, formality)
    return rows.select("doc_id", prompt.alias("prompt")).withColumns({
        "sentiment": P.parse_sentiment(F.col("prompt")), "formality": P.parse_formality(F.col("prompt")),
    })


@query(f"""WITH {LABELLED_SQL}
    SELECT *, min(n) OVER () AS smallest FROM (SELECT sentiment, formality, count(*) AS n FROM lab GROUP BY 1, 2)""")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows per attribute combination and the smallest class."""
    return sampling.class_counts(labelled(spark, d), ["sentiment", "formality"])


def _balanced_sql(limit: str) -> str:
    return f"""WITH {LABELLED_SQL},
    ranked AS (
      SELECT doc_id, sentiment, formality,
             row_number() OVER (PARTITION BY sentiment, formality ORDER BY {S.u(42, 'balance', 'doc_id')}, doc_id) AS rn FROM lab),
    low AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM lab GROUP BY sentiment, formality))
    SELECT doc_id, sentiment, formality FROM ranked, low WHERE rn <= {limit}"""


@query(_balanced_sql("m"))
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """All classes down-sampled to the smallest, in shuffled order."""
    rows = labelled(spark, d).select("doc_id", "sentiment", "formality")
    kept = sampling.balanced(rows, ["sentiment", "formality"], 42, ["doc_id"])
    return sampling.shuffled(kept, 42, ["doc_id"])


@query(_balanced_sql("least(m, 3)"))
def balanced_capped(spark: SparkSession, d: str) -> DataFrame:
    """Balancing with a limit per class (the operator's own option)."""
    rows = labelled(spark, d).select("doc_id", "sentiment", "formality")
    return sampling.balanced(rows, ["sentiment", "formality"], 42, ["doc_id"], max_per_class=3)


@query(f"""SELECT doc_id, CASE WHEN rn <= ceil(0.1 * n) THEN 'test' ELSE 'train' END AS split
    FROM (SELECT doc_id, row_number() OVER (ORDER BY {S.u(42, 'split', 'doc_id')}, doc_id) AS rn, count(*) OVER () AS n FROM documents)""")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    """Exact ten-percent test split."""
    return sampling.train_test_split(text_table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query(f"""SELECT doc_id, CASE WHEN {S.u(42, 'split', 'doc_id')} < 0.1 THEN 'test' ELSE 'train' END AS split FROM documents""")
def threshold_split(spark: SparkSession, d: str) -> DataFrame:
    """The one-pass split, exact in expectation."""
    return sampling.train_test_split(text_table(spark, d, "documents").select("doc_id"), ["doc_id"], exact=False)


#: Lines of the training sample.
TRAIN_LINES = 10_000


@query(f"""WITH train AS (
      SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE {S.u(42, 'split', 'doc_id')} >= 0.1))
    SELECT doc_id, pos::INT AS pos, line FROM train WHERE {S.strip('line')} <> ''
    ORDER BY {S.u(42, 'sample', 'doc_id', 'pos')}, doc_id, pos LIMIT {TRAIN_LINES}""")
def sample_train_rows(spark: SparkSession, d: str) -> DataFrame:
    """A random sample of the lines of the training split."""
    docs = sampling.train_test_split(text_table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], exact=False)
    rows = lines(docs.filter(F.col("split") == "train"), "text", ["doc_id"]).filter(~T.blank(F.col("line")))
    return sampling.sample_rows(rows, TRAIN_LINES, 42, ["doc_id", "pos"])


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 500")
def head_slice(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of a corpus in key order."""
    return sampling.head(text_table(spark, d, "documents").select("doc_id", "text"), 500, ["doc_id"])


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 300 OFFSET 150")
def offset_slice(spark: SparkSession, d: str) -> DataFrame:
    """A start index and a record limit on a scan."""
    return sampling.window_slice(text_table(spark, d, "documents").select("doc_id", "text"), 150, 300, ["doc_id"])


@query("""WITH a AS (SELECT text, row_number() OVER (ORDER BY conv_id, turn) AS row_no FROM conversations WHERE role = 'user'),
    b AS (SELECT text, row_number() OVER (ORDER BY conv_id, turn) AS row_no FROM conversations WHERE role = 'assistant'),
    z AS (SELECT row_no, a.text AS informal, b.text AS formal FROM a JOIN b USING (row_no))
    SELECT row_no, formal AS text, 'unspecified' AS sentiment, 'Formal' AS formality, '[SENT_UNSPEC][FORM_FORMAL] ' || formal AS full_text FROM z
    UNION ALL
    SELECT row_no, informal, 'unspecified', 'Informal', '[SENT_UNSPEC][FORM_INFORMAL] ' || informal FROM z""")
def parallel_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two columns aligned by position, unpivoted into labelled rows."""
    turns = text_table(spark, d, "conversations")
    sides = [turns.filter(F.col("role") == role) for role in ("user", "assistant")]
    order = ["conv_id", "turn"]
    zipped = joins.zip_rows(
        sides[0].select(*order, F.col("text").alias("informal")),
        sides[1].select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("text").alias("formal")),
        order, ["c2", "t2"], id_bucket(sides[0], "conv_id"),
        id_bucket(sides[1].withColumnRenamed("conv_id", "c2"), "c2"),
    ).select("row_no", "formal", "informal")
    rows = parallel_rows(zipped, "formal", "informal")
    prompt = P.control_prompt(F.col("sentiment"), F.col("formality"))
    return rows.withColumn("full_text", P.with_prompt(prompt, F.col("text")))


_HARVEST_N = 100
_HARVEST_SQL = f"""WITH held AS (
      SELECT 'documents' AS origin, doc_id AS id, pos, line FROM (
        SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE {S.u(SPLIT_SEED, 'part', 'doc_id')} >= 0.8))
      UNION ALL SELECT 'benchmark', item_id, 0, text FROM benchmark),
    plain AS (SELECT * FROM held WHERE NOT {S.header_or_markup('line')}),
    pool AS (
      SELECT *, {S.u(42, 'pool', 'origin', 'id', 'pos')} AS u FROM plain
      ORDER BY u, origin, id, pos LIMIT {5 * _HARVEST_N}),
    words AS (SELECT *, {S.tokens('line')} AS w FROM pool),
    started AS (
      SELECT *, {S.randint(S.u(42, 'start', 'origin', 'id', 'pos'), '0', 'greatest(1, least(10, len(w) - 9))')} AS s
      FROM words WHERE len(w) >= 11),
    frag AS (SELECT *, array_to_string(w[s + 1 : s + 8], ' ') AS prompt FROM started),
    firsts AS (
      SELECT *, row_number() OVER (PARTITION BY lower(prompt) ORDER BY u, origin, id, pos) AS rn FROM frag)
    SELECT prompt, origin, id, pos::INT AS pos FROM firsts WHERE rn = 1
    ORDER BY u, origin, id, pos LIMIT {_HARVEST_N}"""


@query(_HARVEST_SQL)
def prompt_harvest(spark: SparkSession, d: str) -> DataFrame:
    """Short prompts from a random pool of plain held-out lines."""
    unseen = text_table(spark, d, "documents").filter(_part() != "train")
    docs = lines(unseen, "text", ["doc_id"]).select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "pos", "line"
    )
    held = docs.unionByName(table(spark, d, "benchmark").select(
        F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), F.lit(0).alias("pos"), F.col("text").alias("line")
    ))
    return sampling.harvest_prompts(held, "line", _HARVEST_N, 42, ["origin", "id", "pos"])


@query("""SELECT text, source, key FROM (
      SELECT text, 'documents' AS source, doc_id AS key FROM documents
      UNION ALL SELECT text, 'conversations', conv_id * 1000 + turn FROM conversations)""")
def concatenated_corpora(spark: SparkSession, d: str) -> DataFrame:
    """Two corpora as one, matched by column name."""
    docs = text_table(spark, d, "documents").select("text", F.lit("documents").alias("source"), F.col("doc_id").alias("key"))
    turns = text_table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.lit("conversations").alias("source"), "text"
    )
    return docs.unionByName(turns)
