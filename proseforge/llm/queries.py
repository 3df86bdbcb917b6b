"""The registered queries of this package, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseforge.llm import bpe, crf, decontaminate, fim, host_rules, mixing, multi_index, repair, secret_scan, sql, superminhash, templates, toxicity, warc
from proseforge.llm.common import table
from proseforge.session import cut_lineage, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


@query()
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the bytes that decoding them gives, as digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])


@query()
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: counts and a digest of the base kinds, and all spans."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = secret_scan.find(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
        secret_scan.written(spans).alias("spans"),
    )


def fold(of: int) -> Column:
    """crc32 of the document number as text, modulo ``of``; a null number counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


@query()
def op6_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text by a conditional random field fitted outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(4) == 2
    model = crf.train(docs, ~held_out)
    return crf.label_texts(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text by a lexicon learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score_texts(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query(sql.HOST_RULES)
def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every whole text; a document's host is its source."""
    return host_rules.judge(table(spark, sf_dir, "documents"))


@query(sql.mixing(mixing.Settings.entropy, mixing.Settings.max_epochs, mixing.Settings.block_tokens, mixing.Settings.seed))
def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents by source: which are taken, how often, and in which block order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.tokens_in("text").alias("n_tokens"))
    return mixing.mix(cut_lineage(docs, "sizes"), tokens="n_tokens")


@query(sql.WARC)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, read back, assembled, and revisits resolved."""
    path = work_dir(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    body = warc.http_body(F.col("block"))
    about = F.when(F.col("record_type") == "metadata", F.col("block").cast("string"))
    records = warc.read_archives(spark, path).select(
        "record_id", "record_type", "concurrent_to", "refers_to",
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.sha2(body, 256).alias("digest"),
        F.nullif(F.regexp_extract(about, r"(?m)^page-id: (-?\d+)", 1), F.lit("")).cast("long").alias("page_id"),
    )
    captures = warc.assemble(cut_lineage(records, "records")).filter("main is not null").select(
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
        F.col("capture"),
        F.col("main.record_type").alias("record_type"),
        F.col("main.refers_to").alias("held_by"),
        F.col("main.n_bytes").alias("n_bytes"),
        F.col("main.digest").alias("digest"),
        F.get("metadata", F.lit(0))["page_id"].alias("page_id"),
    )
    captures = cut_lineage(captures, "captures")
    held = captures.filter("record_type = 'response' and copy = 1").select(
        F.col("capture").alias("held_by"), F.col("page_id").alias("refers_to"),
        F.col("n_bytes").alias("held_bytes"), F.col("digest").alias("held_digest"),
    )
    return captures.join(held, "held_by", "left").select(
        "page_id",
        F.coalesce("held_bytes", "n_bytes").alias("payload_bytes"),
        F.coalesce("held_digest", "digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


@query()
def op5_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = templates.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every twentieth vector among all others."""
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query(sql.NEAR_COPIES)
def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents."""
    found = superminhash.groups(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.col("doc").eqNullSafe(F.col("component")).alias("kept"),
    )


@query(sql.FIM)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle forms of every whole text, and the texts rebuilt from them, as digests."""
    made = fim.transform(table(spark, sf_dir, "documents"), keep=["doc_id"])
    output, form = F.col("fim_text"), F.col("fim_form")
    return made.select(
        "doc_id", F.col("n_units").alias("n"), form.alias("form"), "prefix_chars", "middle_chars",
        F.sha2(output, 256).alias("output_sha256"), F.sha2(fim.restored(output, form), 256).alias("restored_sha256"),
    )


@query(sql.LEAKS)
def op12_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text that stand in windows of benchmark items, and the items."""
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce("longest.n_words", F.lit(0).cast("long")).alias("longest_words"),
    )


@query(sql.REPAIR)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by a hash of its rows, then repaired at the least cost."""
    turns = table(spark, sf_dir, "conversations")
    report, repaired = repair.repair(repair.damage(turns), "conv")
    names = turns.select("conv_id", repair.conversation_key("conv_id").alias("key")).distinct()
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return names.join(report, "key", "left").join(repair.digests(repaired), "key", "left").select(
        "conv_id", *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
