"""Fill-in-the-middle: positions by definition, cuts by a plain restatement, and the way back."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseforge.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def some_text(draw):
    letters = draw.choice(["ab ", "aé \n", "ж日a  \t", "😀é日a ", " \n\t", "a<PSM> "])
    return "".join(draw.choice(letters) for _ in range(draw.randrange(60)))


def plain(doc, text, words=True):
    """(n, form, prefix, middle, output) on code points."""
    text = text or ""
    units = UNITS.findall(text) if words else list(text)
    n = len(units)
    hexed = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_index_converts_both_ways():
    draw = random.Random(1)
    for _ in range(300):
        text = some_text(draw)
        index = fim.Exceptions(np.frombuffer(text.encode(), np.uint8))
        assert index.n_chars == len(text)
        assert len(index.in_bytes) == sum(ord(c) > 127 for c in text)
        chars = np.arange(len(text) + 1)
        at = [len(text[:i].encode()) for i in chars]
        assert index.byte_of(chars).tolist() == at
        assert index.char_of(np.array(at, np.int64)).tolist() == chars.tolist()


def test_word_ends_are_those_of_the_expression():
    draw = random.Random(2)
    for _ in range(300):
        text = some_text(draw)
        want = np.cumsum([len(u.encode()) for u in UNITS.findall(text)]).tolist()
        assert fim.word_ends(np.frombuffer(text.encode(), np.uint8)).tolist() == want


@pytest.mark.parametrize("unit", ["words", "characters"])
def test_against_code_points(spark, unit):
    draw = random.Random(3)
    rows = [(i, some_text(draw)) for i in range(400)]
    rows += [(1, rows[1][1]), (None, "null key é b"), (7, None), (8, ""), (9, "a <P> b"), (10, "日 é " * 50_000), (11, "x" * 100_001), (12, "<S"), (13, "<M <S <P")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fim_form": F.lit(1), "a.b": F.lit(2), "_key": F.lit(3)})
    settings = fim.Settings(unit=unit)
    got = fim.transform(df, settings=settings)
    assert got.columns == ["doc_id", "text", "a.b", "_key", "n_units", "fim_form", "prefix_chars", "middle_chars", "fim_text"]
    back = got.withColumn("back", fim.restored(F.col("fim_text"), F.col("fim_form"), settings)).collect()
    key = lambda x: (str(x[0]), str(x[1]))
    found = sorted(((r.doc_id, r.text, (r.n_units, r.fim_form, r.prefix_chars, r.middle_chars, r.fim_text)) for r in back), key=key)
    assert found == sorted(((d, t, plain(d, t, unit == "words")) for d, t in rows), key=key)
    assert all(r.back == (r.text or "") for r in back)
    assert {r.fim_form for r in back} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0


def test_marks_are_checked():
    for marks in (("<P>", "<P>", "<M>"), ("<P<", "<S>", "<M>"), ("<P>", "[S]", "<M>"), ("<", "<S", "<M")):
        with pytest.raises(ValueError):
            fim.Settings(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_marks_may_be_special_in_expressions(spark):
    settings = fim.Settings(rate=100, prefix="|P", suffix="|S.", middle="|M(")
    df = spark.createDataFrame([(i, f"a{i} bé (c. d|") for i in range(50)], "doc_id long, text string")
    out = fim.transform(df, settings=settings).withColumn("back", fim.restored(F.col("fim_text"), F.col("fim_form"), settings))
    assert out.filter("back = text and fim_form <> 'plain'").count() == 50
