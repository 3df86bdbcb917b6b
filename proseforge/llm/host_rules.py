"""Quality rules whose verdict is passed on whole hosts, with built-in expressions only.

Each text is measured and held against a few rules.  Failures are summed by host and rule.  A host
with few texts says little about itself, so its rate is shrunk: the rates of all hosts give a beta
prior per rule (method of moments), and the host's failures update it.  A host is rejected when its
shrunk rate of any rule exceeds a limit, and the verdict goes back to its texts by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseforge.llm.common import WORD, quoted
from proseforge.session import cut_lineage

WINDOW = 5
#: A prior weighs as much as so many texts, at least and at most.
PRIOR_TEXTS = (1.0, 10_000.0)
MAX_RATE = 0.5

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_n_lines")


def measured(df: DataFrame, text: str, key: str, host: str) -> DataFrame:
    """(key, host, counts): what the rules look at, from every whole text; a null text has no words.

    Windows of five words are compared by 64-bit hashes within one text.
    """
    rows = df.select(
        F.col(quoted(key)).alias("_key"),
        F.coalesce(F.concat(F.lit("h:"), F.col(quoted(host)).cast("string")), F.lit("none")).alias("_host"),
        F.coalesce(F.col(quoted(text)), F.lit("")).alias("_text"),
    ).withColumns({
        "_words": F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)),
        "_lines": F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)),
    })
    starts = F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))
    windows = F.when(F.size("_words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    rows = rows.withColumn("_windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    # Most texts repeat no window; only the others are sorted.
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
    same = lambda i, h: F.get("_placed", i)["h"] == h
    twice = F.filter("_placed", lambda x, i: same(i - 1, x["h"]) | same(i + 1, x["h"]))
    rows = rows.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # Each repeated window adds the words that the one before it does not reach.
    added = F.transform("_twice", lambda p, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get("_twice", i - 1))))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "_key",
        "_host",
        F.size("_words").cast("long").alias("n_words"),
        total(F.transform("_words", lambda w: F.length(w))).alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(total(added), F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Failure of each rule by a text, in whole numbers."""
    return {
        "base": base_failed(),
        "word_length": (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 10 * F.col("n_words")),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("_n_lines"),
    }


def host_rates(rows: DataFrame) -> DataFrame:
    """(_host, rule, failed, n, rate): failures by host and rule, and the shrunk rate.

    One row per rule is the prior, so it is broadcast; hosts stay distributed.
    """
    counts = rows.groupBy("_host").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(name) for name, c in rules().items()]
    )
    long = counts.select("_host", "n", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in rules()])))
    share = F.col("failed") / F.col("n")
    prior = long.groupBy("rule").agg(
        (F.sum("failed") / F.sum("n")).alias("mean"),
        (F.sum(F.col("n") * share * share) / F.sum("n")).alias("square"),
    )
    spread = F.col("square") - F.col("mean") * F.col("mean")
    texts = F.col("mean") * (1 - F.col("mean")) / spread - 1
    low, high = (F.lit(x) for x in PRIOR_TEXTS)
    weight = F.when(spread > 1e-12, F.least(F.greatest(texts, low), high)).otherwise(high)
    prior = prior.select("rule", "mean", weight.alias("texts"))
    rate = (F.col("failed") + F.col("mean") * F.col("texts")) / (F.col("n") + F.col("texts"))
    return long.join(F.broadcast(prior), "rule").select("_host", "rule", "failed", "n", rate.alias("rate"))


def judge(df: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """One row per row of ``df``: the key, the counts, ``base_failed``, ``host_rejected`` and ``kept``.

    A text is kept if it passes the base rules and its host is not rejected.  A null host is a host of
    its own; a null or empty text has no words and fails the base rules; rows that repeat count and
    are returned each.  Other columns of ``df`` play no part.
    """
    rows = cut_lineage(measured(df, text, key, host), "host-rules")
    verdicts = host_rates(rows).groupBy("_host").agg(F.max(F.col("rate") > max_rate).alias("host_rejected"))
    return rows.join(verdicts, "_host").select(
        F.col("_key").alias(key),
        *_COUNTS[:-1],
        base_failed().alias("base_failed"),
        "host_rejected",
        (~base_failed() & ~F.col("host_rejected")).alias("kept"),
    )
