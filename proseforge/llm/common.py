"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but a space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall

#: Rows and bytes of text that one step of a text operator holds at a time.
STEP_ROWS, STEP_BYTES = 1_000, 1_000_000
#: Most rows of an Arrow batch with texts or sets; both sides of it hold one.
BATCH_ROWS = 1_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


_slot: dict[str, object] = {}


def one_per_worker(key: tuple, make: Callable[[], object]):
    """The object that ``make`` gives for ``key``, made once per worker process.

    A worker serves one stage after another.  It keeps one such object, and drops it when a text
    operator of another stage begins, so what a stage has gathered does not stay in memory during the next.
    """
    if _slot.get("key") != key:
        _slot.pop("value", None)
        _slot["value"] = make()
        _slot["key"] = key
    return _slot["value"]


def _begin(stage: str) -> None:
    """Drop what a worker keeps of another stage."""
    if _slot.get("stage") != stage:
        _slot.clear()
        _slot["stage"] = stage
        _hand_back()


def _hand_back() -> None:
    """Return memory that is free but still held; idle workers stay beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches have ``BATCH_ROWS`` rows at most; a setting below that stays.

    The default is made for narrow rows.  Ten thousand texts at a time cost an executor, with its Python
    workers, several hundred megabytes.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def steps(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of texts of these sizes that stay small enough to hold; a single text is never cut."""
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and (i - begin >= STEP_ROWS or held + size > STEP_BYTES):
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def map_texts(
    df: DataFrame,
    text: str,
    keep: list[str],
    added: T.StructType,
    work: Callable[..., dict[str, list]],
    also: list[str] | None = None,
    finish: Callable[[], None] | None = None,
) -> DataFrame:
    """``keep`` columns of ``df`` and the columns that ``work`` makes of the texts, row by row in order.

    ``work`` gets a bounded stretch of texts, and one list more per column in ``also``, and returns one
    list per added column.  An added column replaces a kept one of the same name.  ``finish`` is called at
    the end of each task; what ``work`` has gathered need not stay in an idle worker.
    """
    small_batches(df.sparkSession)
    taken = {n.lower() for n in added.names}
    keep, also = [c for c in keep if c.lower() not in taken], also or []
    schema = T.StructType([df.schema[c] for c in keep] + list(added.fields))
    arrow = [(f.name, _arrow(f.dataType)) for f in added.fields]
    skip, stage = 1 + len(also), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(stage)
        for batch in batches:
            # Only the texts of one step become Python objects.
            for begin, end in steps(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()):
                part = batch.slice(begin, end - begin)
                made = work(*[part.column(i).to_pylist() for i in range(skip)])
                columns = [part.column(i + skip) for i in range(len(keep))]
                columns += [pa.array(made[name], kind) for name, kind in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *[name for name, _ in arrow]])
            _hand_back()
        if finish:
            finish()
            _hand_back()

    # Plain names on the way in: Python steps address columns by unquoted names.
    read = [F.col(quoted(text)).cast("string").alias("text"), *[F.col(quoted(c)).alias(f"a{i}") for i, c in enumerate(also)]]
    kept = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)]
    return df.select(*read, *kept).mapInArrow(run, schema)


def quoted(name: str) -> str:
    """A column name quoted, so that dots in it are part of the name."""
    return "`" + name.replace("`", "``") + "`"


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {
        T.StringType: pa.string(), T.BinaryType: pa.binary(), T.LongType: pa.int64(), T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return simple[type(kind)]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
