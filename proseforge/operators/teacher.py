"""Curation of teacher outputs: validate, deduplicate, top up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseforge.functions.text import valid_pair
from proseforge.operators.dedup import dedup_text, not_seen
from proseforge.operators.sampling import head, sample_rows
from proseforge.session import cut_lineage


def coerce_pairs(df: DataFrame, prompt: str = "prompt", text: str = "text") -> DataFrame:
    """Missing prompts and texts become empty strings."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in (prompt, text)})


def valid_pairs(df: DataFrame) -> DataFrame:
    return coerce_pairs(df).filter(valid_pair(F.col("prompt"), F.col("text")))


def curate(
    prompts: DataFrame,
    generate: Callable[[DataFrame, int], DataFrame],
    n: int,
    key: str = "prompt_id",
    seed: int = 1234,
    max_rounds: int = 10,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Up to ``n`` valid pairs with distinct texts.

    ``generate(prompts, round)`` returns (key, prompt, text).  Round 0 covers
    all prompts; later rounds draw as many prompts as pairs are missing, with
    a new seed each time.  The new pairs of each round are written to the
    shared folder, so only counts come to the driver.  ``key`` is an integer.

    ``existing`` holds pairs of an earlier run (key, prompt, text, round): the valid ones count, and
    round 0 asks only the prompts that they do not answer.
    """
    kept, have = None, 0
    if existing is not None:
        known = valid_pairs(existing).select(key, "prompt", "text", "round")
        kept = cut_lineage(dedup_text(known, "text", [key]).select(known.columns), "teacher-known")
        have = kept.count()
        if have >= n:
            return head(kept, n, [key])
    for round_no in range(max_rounds + 1):
        if round_no:
            asked = sample_rows(prompts, n - have, seed + round_no, [key], "topup")
        else:
            asked = prompts if kept is None else prompts.join(kept.select(key), key, "left_anti")
        found = valid_pairs(generate(asked, round_no)).withColumn("round", F.lit(round_no))
        fresh = dedup_text(found, "text", [key]) if kept is None else not_seen(found, kept, "text", [key])
        fresh = cut_lineage(fresh.select(found.columns), f"teacher-{round_no}")
        n_fresh = fresh.count()
        if have + n_fresh > n:
            fresh = head(fresh, n - have, [key])
        kept = fresh if kept is None else kept.unionByName(fresh)
        have += n_fresh
        if have >= n:
            break
    return kept
