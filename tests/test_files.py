"""Versioned tables, quarantine, rewriting of lines with any fields, and labelled files."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from proseforge.operators import teacher
from proseforge.sources import readers, sinks, versions


def test_readers_see_one_whole_version(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.current(spark, path) is None and versions.history(spark, path).count() == 0
    with pytest.raises(FileNotFoundError, match="nothing was committed"):
        versions.read(spark, path)
    versions.write(spark.range(10), path, "first")
    opened = versions.read(spark, path)
    # The next version is made from this one.
    versions.write(versions.read(spark, path).filter("id % 2 = 0"), path, "even")
    assert opened.count() == 10 and versions.read(spark, path).count() == 5
    assert versions.read(spark, path, 1).count() == 10 and versions.current(spark, path)[0] == 2
    assert [(r.version, r.note) for r in versions.history(spark, path).orderBy("version").collect()] == [(1, "first"), (2, "even")]
    with pytest.raises(FileNotFoundError, match="version 7"):
        versions.read(spark, path, 7)


def test_lost_writers_leave_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write(spark.range(3), path)
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(PySparkException, match="lost"):
        versions.write(bad, path)
    # A folder that was written but not committed.
    spark.range(99).write.parquet(f"{path}/v-stray")
    assert versions.current(spark, path)[0] == 1 and versions.read(spark, path).count() == 3
    # Two writers that commit the same number: every reader takes the same one.
    folders = [versions.write(spark.range(n), path).inputFiles()[0] for n in (5,)]
    log = spark.createDataFrame([(2, "v-zzz", "other")], versions.LOG)
    spark.range(6).write.parquet(f"{path}/v-zzz")
    log.write.mode("append").json(f"{path}/_log")
    assert versions.current(spark, path) == (2, "v-zzz") and versions.read(spark, path).count() == 6 and folders


def test_curation_resumes_from_the_swapped_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    text = "p says something that is long enough to be kept as a whole text"
    rows = [(1, "p", text, 0), (2, "p", "p short", 0), (3, "q", None, 0)]
    versions.write(spark.createDataFrame(rows, "prompt_id long, prompt string, text string, round int"), path)
    known = readers.revalidate_cache(spark, path)
    assert [r.prompt_id for r in known.collect()] == [1] and versions.current(spark, path)[0] == 2
    prompts = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "prompt_id long, prompt string")
    asked = []

    def answers(rows, round_no):
        asked.append(sorted(r.prompt_id for r in rows.collect()))
        return rows.select("prompt_id", "prompt", F.concat("prompt", F.lit(" answers at length, and with its own number "), F.col("prompt_id").cast("string")).alias("text"))

    out = teacher.curate(prompts, answers, 3, existing=known)
    assert asked == [[2, 3]] and sorted(r.prompt_id for r in out.collect()) == [1, 2, 3]


RECORD = Y.StructType([Y.StructField("a", Y.LongType()), Y.StructField("b", Y.ArrayType(Y.StringType()))])


def test_broken_lines_are_set_aside_and_counted(spark, tmp_path):
    good, broken = readers.sorted_out(spark, str(tmp_path / "none"), RECORD, ["a"])
    assert good.count() == broken.count() == 0
    lines = ['{"a": 1, "b": ["x"]}', '{"a": 2}', '{"b": ["y"]}', '{"a": 3, "b": ["z', "", "  ", "[1, 2]", "null", '{"a": "no number", "b": []}', '{"a": 4, "b": null, "more": {"c": 1}}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.jsonl").write_text("\n".join(lines))
    (tmp_path / "in" / "two.jsonl").write_text('{"a": 5}\n')
    good, broken = readers.sorted_out(spark, str(tmp_path / "in"), RECORD, ["a"])
    counts = sinks.quarantine(good, broken, str(tmp_path / "good"), str(tmp_path / "side")).collect()
    assert [tuple(r) for r in counts] == [(4, 5)]
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 2, 4, 5]
    side = {r.value: r for r in spark.read.parquet(str(tmp_path / "side")).collect()}
    assert {v: r.reason for v, r in side.items()} == {
        '{"b": ["y"]}': "incomplete", '{"a": 3, "b": ["z': "unreadable", "[1, 2]": side["[1, 2]"].reason, "null": side["null"].reason, '{"a": "no number", "b": []}': "unreadable"}
    assert all(r.file.endswith("one.jsonl") for r in side.values())


def test_rewriting_keeps_fields_of_any_kind(spark, tmp_path):
    rows = [
        {"text": "a\n*b  \\n c", "n": 1, "x": 1.5, "deep": {"text": "kept \n*", "list": [1, "two", None, {"z": True}]}, "big": 12345678901234567890},
        {"no": "text", "Text": "other \n* case"}, {"text": None, "k": "ü"}, {"text": 5}, {"text": ["a\n*"]}, {}, {"a.b": 1, "text": "é \\\\ q", "": 0},
    ]
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n")
    sinks.rewrite_json(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"))
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    got = [json.loads(line) for line in lines]
    want = [dict(r) for r in rows]
    want[0]["text"], want[6]["text"] = "a b c", "é q"
    assert got == want and [list(g) for g in got] == [list(w) for w in want] and "ü" in "".join(lines)
    assert type(got[0]["n"]) is int and type(got[0]["x"]) is float and got[0]["big"] == rows[0]["big"]


def test_lines_that_are_no_objects(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"text": "ok"}\n{"text": "cu\n[1]\n"text"\n')
    with pytest.raises(PySparkException, match="no JSON object"):
        sinks.rewrite_json(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "fails"))
    sinks.rewrite_json(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), str(tmp_path / "broken"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"text":"ok"}']
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "broken")).collect()) == sorted(['{"text": "cu', "[1]", '"text"'])


def test_many_labelled_paths_are_one_scan(spark, tmp_path):
    paths = []
    for i in range(60):
        folder = tmp_path / f"set {i} +%é"
        (folder / "inner").mkdir(parents=True)
        (folder / "a.txt").write_text(f"line {i}\n")
        (folder / "inner" / "b.txt").write_text(f"inner {i}\n")
        paths.append((str(folder), i % 3))
    paths += [(str(tmp_path / "set 7 +%é" / "inner"), 9), (str(tmp_path / "set 8 +%é" / "a.txt"), 8), ("file:" + str(tmp_path / "set 9 +%é" / "inner") + "/", 7)]
    found = readers.labelled_lines(spark, paths)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") <= 2 * plan.count("AdaptiveSparkPlan") and "Union" not in plan
    got = {(r.text, r.label) for r in found.collect()}
    want = {(f"line {i}", i % 3) for i in range(60)} | {(f"inner {i}", i % 3) for i in range(60)}
    want -= {("inner 7", 1), ("line 8", 2), ("inner 9", 0)}
    assert got == want | {("inner 7", 9), ("line 8", 8), ("inner 9", 7)}
