"""Host rules against a plain count, and on odd rows."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from proseforge.llm import host_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_and_edges(spark):
    draw = random.Random(2)
    texts = [None, "", " \n\t ", "a b c d e a b c d e", "x " * 50_000, "\n".join(["same line", "", "same line", " same line", "é ü"] * 3)]
    texts += [" ".join(draw.choice("abc#") for _ in range(draw.randrange(60))) + "\n" + draw.choice(["", "a b", "🙂 ok"]) for _ in range(150)]
    rows = [(i if i != 7 else None, t, draw.choice(["p", "q", None])) for i, t in enumerate(texts)] + [(3, texts[3], "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"kept": F.lit("x"), "n_words": F.lit(None)})
    got = host_rules.judge(df).collect()
    want = Counter((d, *plain(t)) for d, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.host_rejected)
    assert host_rules.judge(df.limit(0)).count() == 0


def test_small_hosts_are_shrunk_and_bad_hosts_rejected(spark):
    good, bad = "one two three four five six seven eight nine ten eleven", "short"
    rows = [(f"good{h}", good) for h in range(30) for _ in range(20)] + [(f"good{h}", bad) for h in range(30) for _ in range(1)]
    rows += [("bad", bad)] * 60 + [("bad", good)] * 5 + [("one", bad)]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = host_rules.judge(df).join(df.select("doc_id", "source"), "doc_id").collect()
    rejected = {r.source for r in got if r.host_rejected}
    assert "bad" in rejected and not any(s.startswith("good") for s in rejected)
    assert all(not r.kept for r in got if r.source == "bad") and all(r.kept for r in got if r.source == "good1" and not r.base_failed)
    rate = {r._host: r.rate for r in host_rules.host_rates(host_rules.measured(df, "text", "doc_id", "source")).filter("rule = 'base'").collect()}
    assert rate["h:one"] < 1 and rate["h:bad"] > 0.8


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, source string")
    plan = host_rules.measured(df, "text", "doc_id", "source")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
