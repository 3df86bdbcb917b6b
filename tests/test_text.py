"""Text functions on hand-made rows."""

import sys

import pytest
from pyspark.sql import functions as F

from proseforge.functions import prompts as P
from proseforge.functions import text as T
from proseforge.operators import callbacks


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.select("i", fn(F.col("s")).alias("o")).orderBy("i").select("o").collect()]


def test_white_space_is_that_of_python(spark):
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, chr(c)) for c in points if c < 0x3100 or c % 97 == 0], "c int, s string")
    ours = {r.c for r in df.filter(~T.has_text(F.col("s"))).collect()}
    assert ours == {r for r in (c for c in points if c < 0x3100 or c % 97 == 0) if chr(r).isspace()}


def test_word_characters_are_those_of_python(spark):
    import re

    points = [c for c in range(0x3100) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "c int, s string")
    known = df.filter(~F.col("s").rlike(r"\p{Cn}"))  # code points the JVM's Unicode version has
    ours = {r.c: r.o for r in known.select("c", F.col("s").rlike(T.ONLY_PUNCT).alias("o")).collect()}
    assert ours == {c: bool(re.match(r"\W", chr(c))) for c in ours}


LINES = [
    ("", ""), (None, ""), ("?!., --", ""), ("plain text", "plain text"),
    ("= = Heading = =", "= = Heading = ="), ("== Heading ==", ""), ("  == Heading ==  ", ""), ("== open", "== open"),
    ("a {{x|y}} b", "a b"), ("{{x}} text", " text"),
    ("[[category: z]] q", " q"), ("[[ File:a.png|t]] y", " y"), ("[[IMAGE:b]]z", " z"),
    ("see https://x.org/a?b=c now", "see now"),
    ("a <unk> b", "a b"), ("&amp; &lt;b&gt; AT&T", "& <b> AT&T"), ("&#65;&copy", "A©"),
    ("nbsp  run", "nbsp run"), ("bell\x07x\x1cy", "bell x y"), (" ends kept ", " ends kept "),
    ("&lt;unk&gt;", "<unk>"), ("é", "é"), ("́́", ""),
]


def test_clean_lines(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(LINES)], "i int, line string")
    got = [r.line for r in T.clean_lines(df, "line").orderBy("i").collect()]
    assert got == [b for _, b in LINES]


def test_strip_is_linear(spark):
    long = " " * 300_000
    got = apply(spark, ["a" + long + "b", long, "\u2003a\n b\x1c", "", None], T.strip)
    assert got == ["a" + long + "b", "", "a\n b", "", None]


def test_clean_review(spark):
    cases = {
        "a\\n*b": "a b", "a\n*b": "a b", "a\\nb\nc": "a b c", 'say \\""hi\\"': 'say "hi"',
        "back\\slash": "backslash", "  many   spaces ": "many spaces", "é": "é",
    }
    assert apply(spark, cases, T.clean_review) == list(cases.values())
    assert apply(spark, ["é ü"], lambda c: T.clean_review(c, legacy_decode=True)) == ["Ã© Ã¼"]


def test_clean_output(spark):
    rows = [
        ("p", "p text", "text"), ("p", "x: y: z", "y: z"), ("p", " none ", "none"), ("", "a:b", "b"), (None, "a:b", "b"),
        ("p", "p", ""), ("p", "p a<|endoftext|>\\nb", "a b"), ("p", ":", ""),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, s string, want string")
    out = df.select("i", T.clean_output(F.col("s"), F.col("p")).alias("got"), "want").orderBy("i").collect()
    assert [r.got for r in out] == [r.want for r in out]
    assert apply(spark, ["p a:b "], lambda c: T.clean_output(c, None, remove_prompt=False)) == ["p a:b"]


def test_header_or_markup(spark):
    long = "word " * 10
    cases = {
        "": True, " " * 40: True, "x" * 29: True, "x" * 30: False, "= " + long: True, "* " + long: True,
        "# " + long: True, "  | " + long: True, "{{" + long + "}}": True, "{{" + long + "}} x": False, long: False,
    }
    assert apply(spark, cases, T.is_header_or_markup) == list(cases.values())


def test_valid_pair(spark):
    rows = [("", "x" * 40, True), ("", "x" * 39, False), ("", "", False), ("p", "p" + "x" * 40, True), ("p", "q" + "x" * 60, False)]
    df = spark.createDataFrame(rows, "p string, t string, want boolean")
    assert all(r[0] == r[1] for r in df.select(T.valid_pair(F.col("p"), F.col("t")), "want").collect())


def test_fixed_decimals_round_like_printf(spark):
    values = [0.125, 0.375, 1.005, 1.015, 2.675, 0.00005, 0.005, -0.005, 12345.67895, 0.0, 1e9 / 3, 2.01425]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, float("nan"), None])], "i int, v double")
    for digits in (2, 4):
        got = [r[1] for r in df.select("i", T.fixed_decimals(F.col("v"), digits)).orderBy("i").collect()]
        assert got == [f"{v:.{digits}f}" for v in values] + ["N/A", "N/A"]


@pytest.mark.parametrize("separator", [False, True])
def test_control_prompts_round_trip(spark, separator):
    rows = [(s, f) for s in P.SENTIMENT_TOKENS for f in P.FORMALITY_TOKENS]
    df = spark.createDataFrame(rows, "s string, f string")
    prompt = P.control_prompt(F.col("s"), F.col("f"), separator)
    out = df.withColumn("p", prompt).select("s", "f", "p", P.parse_sentiment(F.col("p")).alias("s2"), P.parse_formality(F.col("p")).alias("f2"))
    for r in out.collect():
        assert (r.s, r.f) == (r.s2, r.f2)
        assert r.p.endswith(":") == separator


def test_unknown_attribute_adds_nothing(spark):
    df = spark.createDataFrame([("odd", "Formal"), (None, "odd")], "s string, f string")
    got = [r[0] for r in df.select(P.control_prompt(F.col("s"), F.col("f"))).collect()]
    assert got == ["[FORM_FORMAL]", ""]


def test_python_steps_take_few_texts_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.range(3000, numPartitions=1).select("id", F.lit("a &amp; b").alias("t"))
    steps = [
        lambda: T.clean_lines(rows, "t"), lambda: callbacks.keep_where(rows, "t", bool),
        lambda: callbacks.map_batches(rows, lambda part: part.assign(t=str(len(part))), "id long, t string"),
    ]
    for step in steps:
        spark.conf.unset(name)
        out = step()
        assert 0 < int(spark.conf.get(name)) <= 1000
    assert max(int(r.t) for r in out.select("t").distinct().collect()) <= 1000
