"""Temperature mixing of sources, with built-in expressions only.

The share of a source is its token count to the power of an exponent between 0 (all alike) and 1 (in
proportion), normalised.  The exponent is found by bisection: the largest at which the entropy of
the shares reaches a target, or, where that would repeat a source more often than allowed, the
smallest at which no source is repeated more often.  Each source then has a budget of tokens, rounded.  Its
texts are dealt into blocks by a hash, and every epoch takes the blocks in a new permutation: whole
epochs while the budget lasts, and of the last one the blocks whose running total stays within it.  Blocks
that exceed what is left are passed over, and what the others leave is filled again, a few times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseforge.llm.common import WORD, fresh, quoted
from proseforge.operators import numbering
from proseforge.session import cut_lineage

#: Halvings of the interval, and how many of them one pass over the sources settles.
HALVINGS, AT_ONCE = 30, 5
#: How often the rest of a budget is filled from the blocks of its last epoch.
FILLS = 3


@dataclass(frozen=True)
class Settings:
    """``entropy`` is a share of the largest possible one; ``budget`` a number of tokens, or all there are."""

    entropy: float = 0.98
    max_epochs: float = 4.0
    budget: int | None = None
    block_tokens: int = 4096
    seed: int = 1


def tokens_in(text: str) -> Column:
    """Words of a text; none in a null text."""
    return F.size(F.regexp_extract_all(F.coalesce(F.col(quoted(text)), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def source_key(source: str) -> Column:
    """A source as text; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s:"), F.col(quoted(source)).cast("string")), F.lit("none"))


def draw(seed: int, name: str, *keys: Column) -> Column:
    """Thirty-two hexadecimal digits that follow from the keys alone."""
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{name}"), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))


def block_of(seed: int, key: Column, blocks: Column) -> Column:
    return F.pmod(F.conv(F.substring(draw(seed, "block", key), 1, 15), 16, 10).cast("long"), blocks)


def _halved(low: float, high: float, evaluate, up) -> float:
    """The end of the bisected interval at which ``up`` last held; it holds at ``low``.

    One call of ``evaluate`` covers all points that the next few halvings may visit.
    """
    for _ in range(HALVINGS // AT_ONCE):
        n = 2**AT_ONCE
        points = [low + (high - low) * i / n for i in range(1, n)]
        holds = [up(p, *v) for p, v in zip(points, evaluate(points))]
        begin, end = 0, n
        while end - begin > 1:
            middle = (begin + end) // 2
            begin, end = (middle, end) if holds[middle - 1] else (begin, middle)
        low, high = low + (high - low) * begin / n, low + (high - low) * end / n
    return low


def exponent(sources: DataFrame, settings: Settings) -> tuple[float, float, int]:
    """(exponent, sum of powers, budget) for sources with their ``tokens``; one row per pass reaches the driver."""
    log = F.log(F.col("tokens").cast("double"))
    some = sources.filter("tokens > 0")
    count, total = some.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    budget = settings.budget if settings.budget is not None else int(total or 0)
    if not count:
        return 1.0, 1.0, 0

    def evaluate(points: list[float]) -> list[tuple[float, float]]:
        """Entropy of the shares, and the most epochs that a source has, at each exponent."""
        wanted = []
        for p in points:
            power = F.exp(log * p)
            wanted += [F.sum(power), F.sum(power * log), F.max(F.exp(log * (p - 1)))]
        row = some.agg(*wanted).first()
        out = []
        for i, p in enumerate(points):
            powers, logs, most = row[3 * i : 3 * i + 3]
            out.append((_ln(powers) - p * logs / powers, budget * most / powers))
        return out

    target = settings.entropy * _ln(count)
    found = 1.0
    if evaluate([1.0])[0][0] < target:
        found = _halved(0.0, 1.0, evaluate, lambda p, h, e: h >= target)
    if evaluate([found])[0][1] > settings.max_epochs:
        # From the other end: one minus the exponent grows while the limit is kept.
        mirrored = lambda points: evaluate([1.0 - p for p in points])
        found = 1.0 - _halved(0.0, 1.0 - found, mirrored, lambda p, h, e: e <= settings.max_epochs)
    powers = some.agg(F.sum(F.exp(log * found))).first()[0]
    return found, powers, budget


def _ln(x: float) -> float:
    import math

    return math.log(x)


def plan(rows: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Sources with their number of blocks and their quota, and the blocks to take: (_source, _block, epoch, slot, tokens).

    ``rows`` has _source, _key and _tokens.  ``slot`` numbers the taken blocks of all sources in one
    permutation.  Both tables are written to the shared folder.
    """
    size = F.lit(settings.block_tokens)
    sources = rows.groupBy("_source").agg(F.sum("_tokens").alias("tokens"))
    sources = cut_lineage(sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / size)).cast("long")), "sources")
    power, powers, budget = exponent(sources, settings)
    share = F.exp(F.log(F.col("tokens").cast("double")) * power) / powers
    quotas = sources.filter("tokens > 0").withColumn("quota", F.round(share * budget).cast("long"))
    quotas = quotas.withColumn("whole", F.floor(F.col("quota") / F.col("tokens")).cast("long"))
    quotas = quotas.withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens")).select("_source", "quota", "whole", "rest")
    placed = rows.join(sources.select("_source", "blocks"), "_source")
    blocks = placed.groupBy("_source", block_of(settings.seed, F.col("_key"), F.col("blocks")).alias("_block")).agg(F.sum("_tokens").alias("tokens"))
    blocks = cut_lineage(blocks.join(quotas, "_source"), "blocks")
    named = lambda epoch: draw(settings.seed, "order", F.col("_source"), F.col("_block"), epoch)
    whole = blocks.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole"))))
    last = blocks.filter("rest > 0").withColumn("epoch", F.col("whole") + 1).withColumn("_order", named(F.col("epoch")))
    place = ["_source", "_block", "epoch", "_order", "tokens"]
    taken = whole.withColumn("_order", named(F.col("epoch"))).select(*place)
    for fill in range(FILLS):
        last = numbering.running_sum(last.filter("tokens <= rest"), F.col("tokens"), ["_order"], _bucket("_order"), ["_source"], "_running")
        last = cut_lineage(last, f"fill-{fill}")
        now = last.filter("_running <= rest")
        taken = taken.unionByName(now.select(*place))
        used = now.groupBy("_source").agg(F.sum("tokens").alias("_used"))
        last = last.filter("_running > rest").join(used, "_source", "left")
        last = last.withColumn("rest", F.col("rest") - F.coalesce("_used", F.lit(0))).drop("_used", "_running")
    taken = numbering.number_rows(cut_lineage(taken, "taken"), ["_order"], _bucket("_order"), (), "slot").drop("_order")
    # Read from a file, a small table of sources is broadcast, and texts stay where they are.
    known = cut_lineage(sources.join(quotas.select("_source", "quota"), "_source", "left").select("_source", "tokens", "blocks", "quota"), "quotas")
    return known, cut_lineage(taken, "plan")


def _bucket(order: str) -> Column:
    """An order-preserving bucket of a hexadecimal draw, one of 4,096."""
    return F.conv(F.substring(order, 1, 3), 16, 10).cast("long")


def mix(df: DataFrame, settings: Settings = Settings(), source: str = "source", text: str = "text", key: str = "doc_id",
        tokens: str | None = None, keep: list[str] | None = None, names: tuple[str, str] = ("epoch", "slot")) -> DataFrame:
    """The rows of ``df`` as often as the mixture takes them, with ``epoch`` and ``slot``.

    ``slot`` is the place of the row's block in the permutation of all taken blocks; within a block
    the order is free.  Sizes are in words of the text, or those in the column ``tokens`` (null: none).  A null source is a source of its own.  A source without
    words has no share and gives no rows; texts without words go with the blocks of their source.
    Rows that repeat fall into one block and are taken together; a null key counts as empty text.
    ``keep`` names the columns to return (all); ``epoch`` and ``slot``, or what ``names`` calls them,
    replace others of these names.
    Of the last epoch of a source a block that exceeds what is left of the budget is passed over for those after
    it; ``shares`` tells how near each source comes to its target.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    size = tokens_in(text) if tokens is None else F.coalesce(F.col(quoted(tokens)).cast("long"), F.lit(0).cast("long"))
    narrow = df.select(source_key(source).alias("_source"), F.col(quoted(key)).alias("_key"), size.alias("_tokens"))
    sources, taken = plan(narrow if tokens is not None else cut_lineage(narrow, "tokens"), settings)
    own = {c: fresh(df, c) for c in ("_source", "_block", "blocks")}
    wide = df.withColumn(own["_source"], source_key(source))
    wide = wide.join(sources.select("_source", "blocks").toDF(own["_source"], own["blocks"]), own["_source"])
    wide = wide.withColumn(own["_block"], block_of(settings.seed, F.col(quoted(key)), F.col(own["blocks"])))
    wide = wide.select(own["_source"], own["_block"], *[F.col(quoted(c)) for c in kept])
    out = wide.join(taken.select("_source", "_block", "epoch", "slot").toDF(own["_source"], own["_block"], *names), [own["_source"], own["_block"]])
    return out.select(*[F.col(quoted(c)) for c in kept], *names)


def shares(df: DataFrame, settings: Settings = Settings(), source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(source, tokens, quota, taken) of each source as text (null: null): what it has, should give and gives.

    A source without tokens has no quota and gives none.
    """
    rows = df.select(source_key(source).alias("_source"), F.col(quoted(key)).alias("_key"), tokens_in(text).alias("_tokens"))
    sources, taken = plan(cut_lineage(rows, "tokens"), settings)
    given = taken.groupBy("_source").agg(F.sum("tokens").alias("taken"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    name = F.when(F.col("_source") != "none", F.substring("_source", 3, 2**31 - 1)).alias("source")
    return sources.join(given, "_source", "left").select(name, "tokens", zero("quota"), zero("taken"))


def resample(df: DataFrame, settings: Settings = Settings(), source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` as often as the mixture takes them, with the columns of ``df`` only."""
    names = fresh(df, "epoch"), fresh(df, "slot")
    return mix(df, settings, source, text, key, names=names).select(*[F.col(quoted(c)) for c in df.columns])
