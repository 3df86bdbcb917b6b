"""Readers with declared schemas."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.functions.text import blank, strip
from proseforge.operators.sampling import head
from proseforge.operators.teacher import valid_pairs
from proseforge.sources import versions

TAGGED = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "sentiment", "formality")])
PAIRS = T.StructType([T.StructField(c, T.StringType()) for c in ("prompt", "text")])
RECORDS = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("generated_sentences", T.ArrayType(T.StringType())),
    T.StructField("avg_inference_time", T.DoubleType()),
])

#: The columns of a file, then those of its folders.
DETAILS = T.StructType([
    T.StructField("prompt_key", T.StringType()),
    T.StructField("sentence", T.StringType()),
    T.StructField("perplexity", T.DoubleType()),
    T.StructField("folder", T.StringType()),
    T.StructField("model_type", T.StringType()),
])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of texts, spread over all cores.

    Text work is costly per byte.  A scan with fewer splits than cores is
    redistributed once; a large table has splits enough and is read as it is.
    """
    df = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; quotes are doubled and values may span lines."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def details(spark: SparkSession, path: str) -> DataFrame:
    """(sentence, perplexity, prompt_key, model_type) as ``sinks.detail_csv`` wrote them."""
    return csv_table(spark, path, DETAILS).select("sentence", "perplexity", "prompt_key", "model_type")


def labelled_lines(spark: SparkSession, paths: Sequence[tuple[str, int]]) -> DataFrame:
    """(text, label): non-blank stripped lines, labelled by the folder or file they come from.

    ``paths`` are absolute files or folders, without patterns; of nested ones the nearest counts.  All are one
    scan of text, whatever their number.  A listing of the files, which reads none, meets the labels by
    the folders above each file, and each line then meets its file.
    """
    names = [path for path, _ in paths]
    listed = spark.createDataFrame([(_plain_path(path), label) for path, label in paths], "_path string, label int")
    recursive = lambda reader: reader.option("recursiveFileLookup", True)
    files = recursive(spark.read.format("binaryFile")).load(names).select(_without_host(F.col("path")).alias("_file")).distinct()
    steps = F.split("_file", "/")
    above = F.transform(F.sequence(F.size(steps), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    named = files.select("_file", F.posexplode(above).alias("_up", "_path")).join(listed, "_path")
    labels = named.groupBy("_file").agg(F.min_by("label", "_up").alias("label"))
    # The path of a line's file is written as a URL, that of a listing is not.
    url = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = recursive(spark.read).text(names).select(strip(F.col("value")).alias("text"), _without_host(url).alias("_file"))
    return rows.filter(~blank(F.col("text"))).join(labels, "_file").select("text", "label")


_HOST = r"^[a-zA-Z][\w+.-]*:(//[^/]*)?"


def _without_host(path: Column) -> Column:
    return F.regexp_replace(path, _HOST, "")


def _plain_path(path: str) -> str:
    """A path as it stands in those of the files below it: without scheme, host, doubled or closing slashes."""
    return "/" + "/".join(filter(None, re.sub(_HOST, "", path).split("/")))


def lines(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, line): the lines of a text column."""
    return df.select(*keys, F.posexplode(F.split(column, "\n")).alias("pos", "line"))


def parallel_rows(pairs: DataFrame, formal: str, informal: str) -> DataFrame:
    """Two labelled rows from each aligned pair of sentences."""
    row = lambda c, name: F.struct(F.col(c).alias("text"), F.lit("unspecified").alias("sentiment"), F.lit(name).alias("formality"))
    others = [c for c in pairs.columns if c not in (formal, informal)]
    return pairs.select(*others, F.inline(F.array(row(formal, "Formal"), row(informal, "Informal"))))


def sorted_out(spark: SparkSession, path: str, schema: T.StructType, needed: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (good rows, broken lines).

    Broken lines are (value, file, reason): ``unreadable`` where a line is no JSON object of the schema, ``incomplete``
    where one of the ``needed`` fields is missing.  Blank lines are neither.  A path where nothing was written
    gives two empty tables.  A line is parsed once for both; write them with ``sinks.quarantine`` to keep them apart.
    """
    known = {f.name.lower() for f in schema.fields}
    mark = "_unreadable"
    while mark in known:
        mark = "_" + mark
    try:
        found = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], "value string, file string")
    wide = T.StructType([*schema.fields, T.StructField(mark, T.StringType())])
    row = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": mark})
    parsed = found.filter(~blank(F.col("value"))).select("value", "file", row.alias("row"))
    missing = F.lit(False)
    for name in needed:
        missing = missing | F.col(f"row.{name}").isNull()
    reason = F.when(F.col("row").isNull() | F.col(f"row.{mark}").isNotNull(), "unreadable").when(missing, "incomplete")
    parsed = parsed.withColumn("reason", reason)
    good = parsed.filter("reason is null").select(*[F.col(f"row.{f.name}") for f in schema.fields])
    return good, parsed.filter("reason is not null").select("value", "file", "reason")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Earlier generation records; none when nothing was written.  ``sorted_out`` gives the broken ones, too."""
    return sorted_out(spark, path, RECORDS, ["prompt", "generated_sentences"])[0]


def cached_pairs(spark: SparkSession, path: str, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` teacher pairs of a cache, of its current version if it has versions; too few are an error."""
    found = versions.read(spark, path) if versions.current(spark, path) else spark.read.parquet(path)
    have = found.count()
    if have < n:
        raise ValueError(f"the cache at {path} holds {have} pairs; {n} are needed")
    return head(found, n, order)


def revalidate_cache(spark: SparkSession, path: str) -> DataFrame:
    """Filter the current version of a pair cache into its next; who reads the old one keeps it whole."""
    return versions.write(valid_pairs(versions.read(spark, path)), path)


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of one table, which is a file, several with its name in front, or a folder of files."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return files.parquet(os.path.join(folder, f"{name}*.parquet"))
