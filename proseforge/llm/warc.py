"""WARC archives: writing captures, reading records, and assembling transactions.

A record is its header, a blank line, its block, and two line ends.  As the payload here is text in
UTF-8, a whole record is a text, and Spark's text writer writes the archive with the two line ends as
its separator.  Reading goes through Spark's text reader line by line, from any file system it knows;
a record is put together by its stated length, so a block may hold anything.  Compressed files are
not split, which keeps the lines of a file in order.

A capture is written as three records: the response (or the revisit of an earlier equal payload), the
request, and metadata, which name the first as concurrent.  Assembly joins records through these
names, whichever record holds them, and gives one nested row per capture.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.llm.common import quoted
from proseforge.session import cut_lineage

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
#: Payloads below this size in bytes are always written in full.
REVISIT_BYTES = 100
#: Most records of one kind in one nested row; a capture with more has several rows.
MEMBERS = 1_000
MAIN = ("response", "revisit", "resource", "conversion")
DATE = "2024-01-01T00:00:00Z"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("target_uri", T.StringType()),
    T.StructField("concurrent_to", T.ArrayType(T.StringType())),
    T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("headers", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
    T.StructField("block", T.BinaryType()),
])


# Writing


def _urn(*parts: Column) -> Column:
    """A record name that follows from its parts alone."""
    h = F.md5(F.concat_ws("|", *parts))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _record(kind: str | Column, name: Column, block: Column, kind_of_block: str, *fields: tuple[str, Column]) -> Column:
    """One record; fields that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    named = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", F.lit(DATE)), *fields, ("Content-Type", F.lit(kind_of_block)),
             ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{n}: "), v.cast("string"), F.lit(END)) for n, v in named]
    return F.concat(F.lit(VERSION + END), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(END), block)


def _one_line(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"[\r\n]+", " ")


def first_of_equal(pages: DataFrame) -> DataFrame:
    """(digest, first): the smallest page of payloads that stand in several rows; null if none has a number.

    Written to the shared folder: if it is small the planner sees that and broadcasts it, and if not,
    rows and payload groups meet in a join whose hot keys the planner splits.
    """
    large = pages.filter(F.col("payload_bytes") >= REVISIT_BYTES)
    groups = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return cut_lineage(groups.filter("n > 1").drop("n"), "equal-payloads")


def write_archives(df: DataFrame, path: str, page: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write the captures of ``df`` as compressed archives below ``path``.

    Of rows with equal payloads of at least 100 bytes, that with the smallest page number holds the
    payload and the others revisit it; smaller payloads are held by each row.  A null payload is empty.
    A null page number sorts last.  Rows that share page number and payload get the same record names,
    and assembly counts them as copies of one capture.
    """
    text = F.coalesce(F.col(quoted(payload)).cast("string"), F.lit(""))
    pages = df.select(
        F.col(quoted(page)).cast("long").alias("page_id"),
        _one_line(F.col(quoted(url))).alias("url"),
        text.alias("payload"),
        F.sha2(text.cast("binary"), 256).alias("payload_digest"),
        F.octet_length(text).cast("long").alias("payload_bytes"),
    )
    pages = pages.join(first_of_equal(pages), "payload_digest", "left")
    # A group without any page number has its null rows as its first.
    grouped = (F.col("payload_bytes") >= REVISIT_BYTES) & F.col("first").isNotNull()
    revisit = F.coalesce(grouped & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    named = lambda kind, n: _urn(kind, n, F.col("payload_digest"))
    main = named(F.when(revisit, "revisit").otherwise("response"), number)
    uri, digest = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END * 2))
    main_record = F.when(
        revisit,
        _record("revisit", main, http, "application/http; msgtype=response", uri, digest, ("WARC-Profile", F.lit(PROFILE)),
                ("WARC-Refers-To", named(F.lit("response"), F.col("first").cast("string")))),
    ).otherwise(_record("response", main, F.concat(http, F.col("payload")), "application/http; msgtype=response", uri, digest))
    concurrent = ("WARC-Concurrent-To", main)
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][^:/]*://([^/?#]*)", 1), F.lit(""))
    request = _record("request", _urn(F.lit("request"), main), F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), host, F.lit(END * 2)),
                      "application/http; msgtype=request", uri, concurrent)
    about = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(END)), F.lit("")), F.lit("via: table" + END))
    metadata = _record("metadata", _urn(F.lit("metadata"), main), about, "application/warc-fields", uri, concurrent)
    records = pages.select(F.explode(F.array(main_record, request, metadata)).alias("value"))
    records.write.option("lineSep", END * 2).option("compression", "gzip").text(path)


# Reading


def _parse(lines: Iterator[tuple[bool, bytes]]) -> Iterator[dict]:
    """Records of files given as (whether a file begins, line without its line feed)."""
    header: list[str] | None = None
    block, wanted = bytearray(), -1
    fields: dict[str, list[str]] = {}
    for begins, line in lines:
        if begins:
            if wanted >= 0 or header is not None:
                raise ValueError("an archive ends within a record")
        if wanted < 0:
            bare = line.rstrip(b"\r")
            if header is None:
                if not bare:
                    continue
                if not bare.startswith(b"WARC/"):
                    raise ValueError(f"no record begins with {bytes(bare[:40])!r}")
                header = []
            elif bare:
                header.append(bare.decode("utf-8", "replace"))
            else:
                named = [h.partition(":") for h in header]
                pairs = [(n.strip(), v.strip()) for n, _, v in named]
                fields = {}
                for n, v in pairs:
                    fields.setdefault(n.lower(), []).append(v)
                wanted, block = int(fields.get("content-length", ["0"])[0]), bytearray()
                if wanted == 0:
                    yield _row(pairs, fields, b"")
                    header, wanted = None, -1
            continue
        block += line
        if len(block) >= wanted:
            rest = bytes(block[wanted:]).strip(b"\r\n")
            if rest:
                raise ValueError("a record is longer than it states")
            yield _row(pairs, fields, bytes(block[:wanted]))
            header, wanted = None, -1
        else:
            block += b"\n"
            if len(block) == wanted:
                yield _row(pairs, fields, bytes(block))
                header, wanted = None, -1
    if wanted >= 0 or header is not None:
        raise ValueError("an archive ends within a record")


def _row(pairs: list[tuple[str, str]], fields: dict[str, list[str]], block: bytes) -> dict:
    one = lambda name: fields.get(name, [None])[0]
    digest = one("warc-payload-digest")
    return {
        "record_id": one("warc-record-id"),
        "record_type": (one("warc-type") or "").lower() or None,
        "target_uri": one("warc-target-uri"),
        "concurrent_to": fields.get("warc-concurrent-to", []),
        "refers_to": one("warc-refers-to"),
        "payload_digest": digest.partition(":")[2] if digest else None,
        "headers": [{"name": n, "value": v} for n, v in pairs],
        "block": block,
    }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all compressed archives below ``path``; the block as bytes.

    Field names are read in any case.  A task holds one record at a time, whatever the size of the
    archive.  An archive that is cut short or has no valid record at some place is an error.  Blocks
    with bytes that are not UTF-8 come back as they are.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(),
             pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary()]
    schema = pa.schema([(f.name, k) for f, k in zip(RECORD.fields, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[bool, bytes]]:
            now = None
            for batch in batches:
                for value, file in zip(batch.column(0), batch.column(1).to_pylist()):
                    yield file != now, value.as_py()
                    now = file

        rows, size = [], 0
        for row in _parse(each()):
            rows.append(row)
            size += len(row["block"])
            if len(rows) >= 1_000 or size > 8_000_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return lines.mapInArrow(run, RECORD)


def http_body(block: Column) -> Column:
    """The body of an HTTP message; a message without a blank line has none."""
    # The header is ASCII, so characters before the blank line are bytes.
    at = F.locate("\r\n\r\n", block.cast("string"))
    return F.when(at > 0, F.substring(block, at + 4, F.octet_length(block))).otherwise(F.lit(b""))


# Assembly


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, main): the main record of the capture that each other record belongs to.

    A name in concurrent-to links two records, whichever of them holds it.  A record belongs to the
    main record it is linked with, or else to that of a record it is linked with; with several, to the
    one whose name sorts first.  Records without any have themselves.
    """
    ids = records.select("record_id", F.col("record_type").isin(*MAIN).alias("is_main"), "concurrent_to").filter("record_id is not null")
    named = ids.select("record_id", F.explode("concurrent_to").alias("other")).filter("record_id <> other")
    both = named.unionByName(named.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct()
    mains = ids.filter("is_main").select(F.col("record_id").alias("other")).distinct()
    direct = both.join(mains, "other").groupBy("record_id").agg(F.min("other").alias("direct"))
    others = ids.filter("not is_main").select("record_id").distinct()
    known = others.join(direct, "record_id", "left")
    # Only records without a direct link look one step further.
    rest = known.filter("direct is null").select("record_id").join(both, "record_id")
    over = rest.join(direct.select(F.col("record_id").alias("other"), F.col("direct").alias("over")), "other")
    over = over.groupBy("record_id").agg(F.min("over").alias("over"))
    return known.join(over, "record_id", "left").select("record_id", F.coalesce("direct", "over", "record_id").alias("main"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture``, ``copies``, ``main``, ``requests``, ``metadata``, ``part``.

    ``main`` is the response, revisit, resource or conversion record (null for records that lead to
    none), ``requests`` and ``metadata`` are arrays of records, by name.  Records of one name are one
    record; ``copies`` counts how often the main record is there.  A kind with more than 1,000 records
    at a capture is dealt over several rows with numbered ``part``; the main record is in part 0.
    """
    once = records.filter("record_id is not null").groupBy("record_id").agg(
        F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in records.columns if c != "record_id"]
    )
    fields = F.struct(*[F.col(c) for c in records.columns]).alias("record")
    mains = once.filter(F.col("record_type").isin(*MAIN)).select(F.col("record_id").alias("capture"), F.lit(0).alias("part"), "copies", fields)
    owned = once.filter(~F.coalesce(F.col("record_type").isin(*MAIN), F.lit(False))).join(resolve(records), "record_id")
    owned = owned.select(F.col("main").alias("capture"), "record_type", "record_id", fields)
    sizes = owned.groupBy("capture", "record_type").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MEMBERS)
    parts = F.coalesce(F.pmod(F.xxhash64("record_id"), F.ceil(F.col("n") / MEMBERS * 2)), F.lit(0)).cast("int")
    owned = owned.join(sizes, ["capture", "record_type"], "left").withColumn("part", parts)
    of = lambda kind: F.array_sort(F.collect_list(F.when(kind, F.col("record"))), _by_name)
    request = F.col("record_type") == "request"
    others = owned.groupBy("capture", "part").agg(of(request).alias("requests"), of(~F.coalesce(request, F.lit(False))).alias("metadata"))
    joined = mains.withColumnRenamed("record", "main").join(others, ["capture", "part"], "full")
    empty = F.array().cast(others.schema["requests"].dataType)
    return joined.select("capture", "part", F.coalesce("copies", F.lit(1)).alias("copies"), "main",
                         F.coalesce("requests", empty).alias("requests"), F.coalesce("metadata", empty).alias("metadata"))


def _by_name(a: Column, b: Column) -> Column:
    return F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)


def header(record: Column, name: str) -> Column:
    """The first value of a header field, null if there is none."""
    return F.get(F.filter(record["headers"], lambda h: F.lower(h["name"]) == name.lower()), 0)["value"]
