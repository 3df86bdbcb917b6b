"""WARC: round trip of payloads, reading of foreign archives, assembly of transactions."""

import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proseforge.llm import warc
from proseforge.llm.queries import op1_warc


def record(kind, name, block, *fields):
    head = [f"WARC-Type: {kind}", f"warc-record-id: <{name}>", "WARC-Date: 2024-01-01T00:00:00Z", *fields, f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("block", [b"", b"\n", b"\r\n\r\n", b"a\r", b"a\n", b"WARC/1.0\r\n\r\n", b"\xff\x00\xfe\n\nx", b"x" * 300_000, b"one\ntwo\r\nthree"])
def test_any_block_comes_back(spark, tmp_path, block):
    with gzip.open(tmp_path / "a.warc.gz", "wb") as file:
        for i in range(3):
            file.write(record("resource", f"r{i}", block))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [r.record_id for r in got] == ["<r0>", "<r1>", "<r2>"]
    assert all(bytes(r.block) == block and r.record_type == "resource" for r in got)


def test_several_files_and_members(spark, tmp_path):
    for f in range(5):
        # One compressed member per record, as archives are usually written.
        (tmp_path / f"{f}.warc.gz").write_bytes(b"".join(gzip.compress(record("resource", f"{f}-{i}", b"b%d" % i)) for i in range(4)))
    got = Counter((r.record_id, bytes(r.block)) for r in warc.read_archives(spark, str(tmp_path)).collect())
    assert got == Counter((f"<{f}-{i}>", b"b%d" % i) for f in range(5) for i in range(4))


def test_broken_archives_are_errors(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record("resource", "x", b"abc")[:-6]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(spark, str(tmp_path)).collect()
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"hello\r\n" + record("resource", "x", b"abc")))
    with pytest.raises(Exception, match="no record begins"):
        warc.read_archives(spark, str(tmp_path)).collect()


def frame(spark, rows):
    made = [(f"<{n}>" if n else None, kind, None, [f"<{c}>" for c in to], None, None, [], b"") for n, kind, to in rows]
    return spark.createDataFrame(made, warc.RECORD)


def test_assembly_follows_links_either_way(spark):
    rows = [
        ("a", "response", []), ("a-req", "request", ["a"]), ("a-meta", "metadata", ["a-req"]),
        ("b", "response", ["b-req", "b-meta"]), ("b-req", "request", []), ("b-meta", "metadata", []),
        ("c", "revisit", []), ("lost", "metadata", ["nowhere"]), ("info", "warcinfo", []), (None, "metadata", ["a"]),
        ("a", "response", []),
    ]
    got = {r.capture: r for r in warc.assemble(frame(spark, rows)).collect()}
    members = {k: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for k, r in got.items()}
    assert members == {
        "<a>": (["<a-req>"], ["<a-meta>"]), "<b>": (["<b-req>"], ["<b-meta>"]), "<c>": ([], []),
        "<lost>": ([], ["<lost>"]), "<info>": ([], ["<info>"]),
    }
    assert got["<a>"].copies == 2 and got["<c>"].main.record_type == "revisit" and got["<lost>"].main is None
    assert warc.assemble(frame(spark, [])).count() == 0


def test_capture_with_very_many_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "MEMBERS", 10)
    rows = [("a", "response", []), ("r", "request", ["a"])] + [(f"m{i}", "metadata", ["a"]) for i in range(100)]
    got = warc.assemble(frame(spark, rows)).collect()
    assert len(got) > 5 and sum(r.main is not None for r in got) == 1
    assert sorted(m.record_id for r in got for m in r.metadata) == sorted(f"<m{i}>" for i in range(100))
    assert sum(len(r.requests) for r in got) == 1


def test_round_trip_of_odd_rows(spark, tmp_path):
    big, small = "é" * 60 + "\r\n\r\nWARC/1.1\r\n", "tiny"
    rows = [(5, "http://a/1", big), (3, "http://a/2", big), (3, "http://a/2", big), (9, None, big), (1, "u\nv", small), (2, "u", small),
            (7, "http://b", None), (8, "http://b", ""), (None, "http://c", big), (None, "x", "z" * 200), (10, "y", "long " * 40_000)]
    folder = str(tmp_path)
    schema = "page_id long, url string, html string"
    spark.createDataFrame(rows, schema).withColumns({"payload_digest": F.lit("x"), "first": F.lit(1)}).write.parquet(f"{folder}/pages.parquet")
    got = Counter(tuple(r) for r in op1_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        again = len(raw) >= 100 and same and page != min(same)
        want[(page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(same) if again else None)] += 1
    assert got == want


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op1_warc(spark, str(tmp_path)).count() == 0
