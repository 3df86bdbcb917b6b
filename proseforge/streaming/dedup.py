"""First-wins deduplication of a stream, with a state that outlives micro-batches and expires."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from proseforge.functions.text import text_key

GROUPS = 512


def first_wins_stream(
    stream: DataFrame, text: str, order: Sequence[str], time: str, horizon_s: int, by: Sequence[str] = (), groups: int = GROUPS
) -> DataFrame:
    """The rows of ``stream`` whose text is new within ``by``.

    Of equal texts the one in the earliest micro-batch stays, and within it the first in ``order`` (nulls
    first).  What is kept per text is its digest and when it expires: once the watermark of ``time`` is
    ``horizon_s`` seconds beyond the time it was last seen.  So the state holds the texts of that stretch
    only, and a text that comes again later counts as new.  Rows later than the watermark are dropped, as
    in every stateful operator; choose a horizon beyond the latest delay.  Null texts count as equal.

    Python is called for each of ``groups`` groups of digests per value of ``by`` that has rows in a
    micro-batch, not for each text.  The digests of such a group are written again together: more groups
    suit small micro-batches beside a large state.  A stream keeps the number it was started with.
    """
    columns, schema = stream.columns, stream.schema
    order, horizon_ms = list(order), int(horizon_s) * 1000
    # In pandas a null turns the integers beside it into floats; decimals stay exact.
    whole = [f.name for f in schema.fields if isinstance(f.dataType, T.IntegralType)]
    exact = {c: F.col(c).cast("decimal(20,0)") for c in whole}
    between = T.StructType([T.StructField(f.name, T.DecimalType(20, 0) if f.name in whole else f.dataType) for f in schema.fields])

    def forward(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get)) if state.exists else {}
        watermark, fresh = state.getCurrentWatermarkMs(), None
        if not state.hasTimedOut:
            seen = {}
            for part in parts:
                for digest, ms in part.groupby("_key")["_ms"].max().items():
                    seen[digest] = max(seen.get(digest, ms), ms)
                new = part[~part["_key"].isin(known)]
                rows = new if fresh is None else pd.concat([fresh, new])
                fresh = rows.sort_values(order, kind="stable", na_position="first").drop_duplicates("_key")
            for digest, ms in seen.items():
                known[digest] = max(known.get(digest, 0), int(ms) + horizon_ms, watermark + 1)
        known = {digest: expires for digest, expires in known.items() if expires >= watermark}
        if known:
            state.update((list(known), list(known.values())))
            state.setTimeoutTimestamp(max(min(known.values()), watermark + 1))
        else:
            state.remove()
        if fresh is not None and len(fresh):
            yield fresh[columns]

    digest = F.coalesce(text_key(F.col(text)), F.lit("null"))
    group = F.pmod(F.xxhash64(digest), F.lit(int(groups))).cast("int").alias("_group")
    milliseconds = F.unix_millis(F.col(time)).alias("_ms")
    timed = stream.withWatermark(time, f"{int(horizon_s)} seconds")
    keyed = timed.select(*columns, digest.alias("_key"), group, milliseconds).withColumns(exact)
    held = T.StructType([T.StructField("digests", T.ArrayType(T.StringType())), T.StructField("expires", T.ArrayType(T.LongType()))])
    first = keyed.groupBy(*by, "_group").applyInPandasWithState(forward, between, held, "append", GroupStateTimeout.EventTimeTimeout)
    return first.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in whole else F.col(f.name) for f in schema.fields])


def run_first_wins(rows: DataFrame, out: str, state: str) -> dict[str, int]:
    """Append the rows of a deduplicated stream to ``out`` until its source is read; how many groups of texts the state holds."""
    query = (
        rows.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    progress = query.recentProgress
    held = [op.numRowsTotal for p in progress for op in p.stateOperators]
    return {"rows_read": sum(p.numInputRows for p in progress), "held": held[-1] if held else 0, "most_held": max(held, default=0)}
