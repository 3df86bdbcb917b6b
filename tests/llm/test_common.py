"""Steps of texts, and what a worker keeps."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.llm import common


def test_a_worker_keeps_one_object_of_one_stage():
    made = []
    make = lambda: made.append(1) or object()
    common._begin("first")
    one = common.one_per_worker(("a",), make)
    assert common.one_per_worker(("a",), make) is one
    common._begin("first")
    assert common.one_per_worker(("a",), make) is one and len(made) == 1
    other = common.one_per_worker(("b",), make)
    assert other is not one and common.one_per_worker(("a",), make) is not one
    common._begin("second")
    assert "value" not in common._slot
    common.one_per_worker(("a",), make)
    assert len(made) == 4


def test_steps_cut_by_rows_and_bytes_but_never_a_text():
    assert list(common.steps([])) == []
    sizes = [10] * 2_500 + [3_000_000, 5, common.STEP_BYTES, 1]
    found = list(common.steps(sizes))
    assert [a for a, _ in found] == [0, *[b for _, b in found[:-1]]] and found[-1][1] == len(sizes)
    assert all(b - a <= common.STEP_ROWS and (b - a == 1 or sum(sizes[a:b]) <= common.STEP_BYTES) for a, b in found)


def test_every_row_comes_back_in_order_whatever_the_batches(spark):
    rows = [(i, None if i % 7 == 0 else "é" * (i % 50), i) for i in range(3_000)] + [(3_000, "x" * 2_500_000, 0)]
    df = spark.createDataFrame(rows, "id long, text string, n long").coalesce(1)
    added = T.StructType([T.StructField("n", T.LongType()), T.StructField("held", T.LongType())])
    ends = spark.sparkContext.accumulator(0)

    def work(texts, ids):
        assert len(texts) == len(ids) <= common.STEP_ROWS
        return {"n": [-1 if t is None else len(t) for t in texts], "held": ids}

    out = common.map_texts(df, "text", ["id"], added, work, also=["id"], finish=lambda: ends.add(1)).collect()
    assert [tuple(r) for r in out] == [(i, -1 if t is None else len(t), i) for i, t, _ in rows]
    assert ends.value == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= common.BATCH_ROWS
    assert common.map_texts(df.limit(0), "text", ["id"], added, work, also=["id"]).agg(F.count("*")).first()[0] == 0
