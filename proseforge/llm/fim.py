"""Fill-in-the-middle examples from whole texts, cut on bytes with a sparse index of multibyte characters.

A text is held as its UTF-8 bytes.  The index lists only the characters of more than one byte: their
positions, in characters and in bytes, and how many bytes all of them up to there have beyond one each.
Between two of them, and in a text without any, a position in characters and one in bytes differ by a
constant, so a binary search in the short lists converts either into the other.

A text is cut in two places into prefix, middle and suffix.  The places are drawn among the boundaries of
its units (words with the white space before them, or characters), by a hash of the row's key, so any
task can repeat the draw.  The parts are then put in one of two orders between three marks.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.llm.common import fresh, map_texts, quoted

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: White space between words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Settings:
    """``rate`` percent of the texts are transformed, ``spm`` percent of these with the suffix first.

    ``unit`` is ``words`` or ``characters``.  Marks begin with the one character that stands nowhere else in
    them, so none can arise where a mark and a text meet.
    """

    rate: int = 50
    spm: int = 80
    seed: int = 42
    unit: str = "words"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = {self.prefix, self.suffix, self.middle}
        first = self.prefix[:1]
        if len(marks) < 3 or any(len(m) < 2 or m[0] != first or first in m[1:] for m in marks):
            raise ValueError("marks must differ and begin with one character that they hold nowhere else")
        if self.unit not in ("words", "characters"):
            raise ValueError("unit is words or characters")


class Exceptions:
    """The characters of more than one byte in UTF-8 ``data``; everything else is arithmetic."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        lead = np.flatnonzero(data >= 0xC0)
        first = data[lead]
        more = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        #: Excess bytes of the first k listed characters.
        self.excess = np.concatenate([np.zeros(1, np.int64), np.cumsum(more)])
        self.in_bytes = lead
        self.in_chars = lead - self.excess[:-1]

    @property
    def n_chars(self) -> int:
        return self.size - int(self.excess[-1])

    def byte_of(self, chars):
        """Byte positions of character positions."""
        return chars + self.excess[np.searchsorted(self.in_chars, chars, side="left")]

    def char_of(self, at):
        """Character positions of byte positions that begin a character, or of the end."""
        return at - self.excess[np.searchsorted(self.in_bytes, at, side="left")]


def word_ends(data: np.ndarray) -> np.ndarray:
    """Byte positions at which words end, each with the white space before it; white space at the end is one more."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(data))


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 that follow from the key; a null key counts as empty text."""
    found = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(found[i : i + 4], "big") for i in range(0, 16, 4))


def cut(text: bytes, key: object, settings: Settings) -> tuple[int, str, int, int, bytes]:
    """(units, form, characters of the prefix, characters of the middle, output) of one text."""
    data = np.frombuffer(text, np.uint8)
    h1, h2, h3, h4 = draws(settings.seed, key)
    words = settings.unit == "words"
    ends = index = None
    if words:
        ends = word_ends(data)
        n = len(ends)
    else:
        index = Exceptions(data)
        n = index.n_chars
    marks = [m.encode() for m in (settings.prefix, settings.suffix, settings.middle)]
    if not text or h3 % 100 >= settings.rate or any(m in text for m in marks):
        return n, PLAIN, -1, -1, text
    units = np.sort(np.array([h1 % (n + 1), h2 % (n + 1)], np.int64))
    index = index or Exceptions(data)
    if words:
        at = np.where(units > 0, ends[units - 1], 0)
        chars = index.char_of(at)
    else:
        chars, at = units, index.byte_of(units)
    a, b = at.tolist()
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    spm = h4 % 100 < settings.spm
    output = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    return n, SPM if spm else PSM, int(chars[0]), int(chars[1] - chars[0]), output


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """Add ``n_units``, ``fim_form``, ``prefix_chars``, ``middle_chars`` and ``fim_text``.

    ``fim_form`` is ``plain`` where the text stays as it is: because it is empty, holds one of the marks,
    or is not drawn; the two lengths (in characters) are null there.  A null text counts as empty.
    Otherwise ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle).  Rows that share a key
    are drawn alike; a null key counts as empty text.  Texts are never shortened.  Other columns are kept as
    they are (``keep`` names fewer); those called like the new ones are replaced.
    """
    added = T.StructType([
        T.StructField("n_units", T.LongType()), T.StructField("fim_form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("fim_text", T.StringType()),
    ])

    def work(texts: list[str | None], keys: list) -> dict[str, list]:
        found = [cut((t or "").encode(), k, settings) for t, k in zip(texts, keys)]
        plain = [x[1] == PLAIN for x in found]
        return {
            "n_units": [x[0] for x in found],
            "fim_form": [x[1] for x in found],
            "prefix_chars": [None if p else x[2] for p, x in zip(plain, found)],
            "middle_chars": [None if p else x[3] for p, x in zip(plain, found)],
            "fim_text": [x[4].decode() for x in found],
        }

    asked = fresh(df, "_key")
    named = df.withColumn(asked, F.col(quoted(key)).cast("string"))
    return map_texts(named, text, df.columns if keep is None else keep, added, work, also=[asked])


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text from which ``output`` was made; marks stand nowhere but where they were put."""
    parts = F.split(output, "|".join(map(re.escape, (settings.prefix, settings.suffix, settings.middle))))
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
