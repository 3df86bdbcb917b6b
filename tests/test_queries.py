"""Every registered query against its SQL, and the shape of its plan."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from proseforge import plans

QUERIES, SQL = plans.QUERIES, plans.SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, sf, name):
    assert differences(spark, con, QUERIES[name], SQL[name], sf) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["split", "lang", "n_lines", "n_chars", "checksum"]
    assert df.count() > 0


PLAIN = [
    "clean_lines_by_lang", "dedup_lines", "balanced_sample", "train_test_split", "encode_pad", "encdec_examples",
    "weighted_doc_draws", "distinct_n", "self_bleu", "nb_predict", "benchmark_perplexity", "sample_next",
    "parallel_pairs", "resume_pending",
]


@pytest.mark.parametrize("name", PLAIN)
def test_plan_has_no_pairwise_or_row_python_step(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for step in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert step not in plan


def test_scan_reads_only_needed_columns(spark, sf):
    plan = QUERIES["train_test_split"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_cleaning_is_not_repeated_by_the_length_filter(spark, sf):
    plan = QUERIES["clean_lines_by_lang"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("Category:") == 1


def test_sampler_counts_bigrams_once(spark, sf, monkeypatch):
    from proseforge.plans import production

    seen = []
    table = production.G.next_token_table
    monkeypatch.setattr(production.G, "next_token_table", lambda lm, *a, **k: seen.append(lm) or table(lm, *a, **k))
    QUERIES["sampled_texts"](spark, sf)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Scan parquet" in plan
