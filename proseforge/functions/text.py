"""Text cleaning as Column expressions.

Character classes are spelled out so that the JVM regex engine treats white
space and word characters as Python's ``re`` does for str patterns.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from proseforge.session import small_batches

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_]"

# The markup patterns of the line cleaner.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
HEADING = rf"^{WS}*={{2,}}[^=][^\n]*={{2,}}{WS}*\z"
TEMPLATE = r"\{\{[^}]+\}\}"
CATEGORY = rf"(?i)\[\[{WS}*Category:[^\]]+\]\]"
URL = rf"https?://{NOT_WS}+"
FILE = rf"(?i)\[\[{WS}*(File|Image):[^\]]+\]\]"
ONLY_PUNCT = rf"^{NOT_WORD}+\z"

MIN_LINE_CHARS = 20

# What the review cleaner replaces, in this order.
REVIEW_BULLET = r"\\n\*|\n\*"
REVIEW_REPLACEMENTS = [("\\n", " "), ("\n", " "), ('\\""', '"'), ('\\"', '"'), ("\\", "")]


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind.

    The pattern keeps what lies between; one that removed a trailing run would
    try again at every position of every inner run.
    """
    return F.regexp_extract(c, rf"(?s)^{WS}*((?:.*{NOT_WS})?)", 1)


def collapse(c: Column) -> Column:
    """Replace every run of white space by one space; ends are kept."""
    return F.regexp_replace(c, rf"{WS}+", " ")


def squeeze(c: Column) -> Column:
    """Collapse runs of white space and strip both ends."""
    return F.trim(collapse(c))


def has_text(c: Column) -> Column:
    """True when there is any character other than white space (so, any token)."""
    return F.coalesce(c.rlike(NOT_WS), F.lit(False))


def blank(c: Column) -> Column:
    return ~has_text(c)


def settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters use without computing it again.

    Catalyst pushes filters below projections and then repeats the projected
    expression at every mention.  It does not push them below an explode, and
    exploding a one-element array changes nothing.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def tokens(c: Column) -> Column:
    """White-space tokens, without empty ones."""
    return F.array_remove(F.split(c, rf"{WS}+"), "")


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """Resolve HTML entities.

    The entity table lives in Python, so this is the one Arrow UDF of the
    cleaner.  Values without ``&`` are sent as nulls and never leave the JVM.
    """
    return F.coalesce(_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


def clean_lines(df: DataFrame, column: str, out: str | None = None, entities: bool = True) -> DataFrame:
    """Clean one line of encyclopedia markup per row; rejected lines become ''.

    The heading test runs before markup is removed, and the ends of the
    result are not stripped.
    """
    out = out or column
    line = F.replace(F.coalesce(F.col(column), F.lit("")), F.lit("<unk>"), F.lit(" "))
    if entities:
        small_batches(df.sparkSession)
        line = unescape(line)
    df = settle(df, out, F.regexp_replace(line, CONTROL, " "))
    body = F.col(out)
    for pattern in (TEMPLATE, CATEGORY, URL, FILE):
        body = F.regexp_replace(body, pattern, " ")
    df = settle(df, out, F.when(F.col(out).rlike(HEADING), "").otherwise(collapse(body)))
    return df.withColumn(out, F.when(F.col(out).rlike(ONLY_PUNCT), "").otherwise(F.col(out)))


def long_enough(c: Column, n: int = MIN_LINE_CHARS) -> Column:
    return F.length(c) >= n


def text_key(c: Column) -> Column:
    """SHA-1 of the UTF-8 text, the identity used for exact deduplication."""
    return F.sha1(c.cast("binary"))


def clean_review(c: Column, legacy_decode: bool = False) -> Column:
    """Remove escaped newlines, bullet stars, stray backslashes and quotes.

    ``legacy_decode`` reproduces a historic fault that reads the UTF-8 bytes
    as Latin-1; it damages non-ASCII text and is off by default.
    """
    c = F.regexp_replace(c, REVIEW_BULLET, " ")
    for old, new in REVIEW_REPLACEMENTS:
        c = F.replace(c, F.lit(old), F.lit(new))
    if legacy_decode:
        c = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return squeeze(c)


def is_header_or_markup(c: Column) -> Column:
    """True for blank or short lines, headings, bullets, templates and table rows."""
    return (
        (F.length(strip(c)) < 30)
        | c.rlike(rf"^{WS}*[=*#|]")
        | c.rlike(rf"^{WS}*\{{\{{[^\n]*\}}\}}{WS}*\z")
    )


def clean_output(text: Column, prompt: Column | None, sep: str = ":", remove_prompt: bool = True) -> Column:
    """Strip the prompt and artefacts from one generated text.

    A leading prompt is cut; failing that, everything up to the first
    separator is.  Rows that end up empty are for the caller to drop.
    """
    if remove_prompt:
        p = F.coalesce(prompt, F.lit("")) if prompt is not None else F.lit("")
        has_prompt = (p != "") & F.startswith(text, p)
        at = F.locate(sep, text)
        body = (
            F.when(has_prompt, F.substring(text, F.length(p) + 1, F.length(text)))
            .when(at > 0, F.substring(text, at + len(sep), F.length(text)))
            .otherwise(text)
        )
    else:
        body = text
    body = strip(body)
    body = F.replace(body, F.lit("<|endoftext|>"), F.lit(""))
    return strip(F.replace(body, F.lit("\\n"), F.lit(" ")))


def valid_pair(prompt: Column, text: Column, min_extra: int = 40) -> Column:
    """A teacher pair counts when the text continues its prompt far enough."""
    return (
        (text != "")
        & ((prompt == "") | F.startswith(text, prompt))
        & (F.length(text) - F.length(prompt) >= min_extra)
    )


def file_key(c: Column) -> Column:
    """A prompt as a file-name part."""
    return F.regexp_replace(strip(c), "[^a-zA-Z0-9]", "_")


def fixed_decimals(c: Column, digits: int) -> Column:
    """``digits`` decimals as text; null and NaN read ``N/A``.

    ``format_number`` rounds the exact binary value half to even, as C and
    Python do; ``format_string`` would round the shortest decimal half up.
    Exactly half of the last digit is the one value the JVM gets wrong.
    """
    shown = F.call_function("format_number", c, F.lit("0." + "0" * digits))
    half = 5 / 10 ** (digits + 1)
    return (
        F.when(c.isNull() | F.isnan(c), "N/A")
        .when(F.abs(c) == half, F.format_string(f"%s{half:.{digits}f}", F.when(c < 0, "-").otherwise("")))
        .otherwise(shown)
    )


def seed_if_blank(prompt: Column, seed_token: str) -> Column:
    return F.when(blank(prompt), F.lit(seed_token)).otherwise(prompt)
