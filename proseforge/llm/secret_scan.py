"""Secrets in texts: three fixed forms, and random strings found by token efficiency.

A vocabulary spends few tokens on language and many on random characters.  A run of key characters
that yields few characters per token is therefore taken as a random string, unless it is a digest or
an identifier of a known form.  In a run that yields more, such as a path or a slug that ends in a key,
every stretch of enough characters is held against the same limit.
"""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.llm import bpe
from proseforge.llm.common import fresh, map_texts, one_per_worker, quoted

# The forms of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 6
# A run of at least n characters is what is left of all runs without the shorter ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

#: A random string has at least so many characters, letters and digits, and fewer characters per token than this.
LEAST, CHARS_PER_TOKEN = 20, 2.0
#: Of a stretch within a run, such a share of the characters is in parts that mix letters and digits; words and numbers do not.
MIXED = 0.5
#: A part of letters alone must change case so often for its length, and cost more tokens; names in camel case do neither.
CASE_CHANGES, LETTERS_PER_TOKEN = 0.25, 1.7
CHANGE = re.compile(r"(?=[a-z][A-Z]|[A-Z][a-z])")
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
PART, PART_BEFORE, PART_AFTER = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[A-Za-z0-9]*\Z"), re.compile(r"[A-Za-z0-9]*")
PART_LAST = re.compile(r"([A-Za-z0-9])[^A-Za-z0-9]*\Z")
HAS_DIGIT, HAS_LETTER = re.compile(r"[0-9]").search, re.compile(r"[A-Za-z]").search
#: Digests and identifiers that are no secrets: hexadecimal digests, UUIDs, integrity values, dates with times.
KNOWN = re.compile(
    r"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|(sha256|sha384|sha512)-.*|\d{4}-?\d\d-?\d\dT.*)"
)
#: The same within a run.
KNOWN_WITHIN = re.compile(
    r"(?i)(?<![a-z0-9])(?:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}"
    r"|[0-9a-f]{128}|(?:sha256|sha384|sha512)-[a-z0-9+/]+=*|\d{4}-?\d\d-?\d\dT\d\d-?\d\d(?:-?\d\d)?Z?)(?![a-z0-9])"
)
KNOWN_BEFORE = re.compile(r"(?i)(md5|sha1|sha224|sha256|sha384|sha512|urn:uuid|isbn|doi)[:=]$")
MARK = "[secret]"

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SPANS = T.StructType([T.StructField("secret_spans", T.ArrayType(SPAN))])


def _counter(sent: bpe.Shipped, pattern: str):
    """What turns a string into the sizes of its tokens in bytes."""

    def make():
        import tiktoken

        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(sent.raw.value), special_tokens={})
        return lambda text: list(map(len, library.decode_tokens_bytes(library.encode_ordinary(text))))

    return one_per_worker(("tokens", sent.digest, pattern), make)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, unsorted."""
    low, found = text.lower(), []
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _free(begin: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the spans in ``taken`` leave of begin to end, where it is long enough."""
    out = []
    for start, stop in sorted(t for t in taken if t[0] < end and begin < t[1]):
        out.append((begin, start))
        begin = max(begin, stop)
    return [(a, b) for a, b in [*out, (begin, end)] if b - a >= LEAST]


def _costly(sizes: list[int]) -> tuple[int, int] | None:
    """The characters, of at least ``LEAST``, that fall short of the limit by the most; None if none do."""
    at = [0, *accumulate(sizes)]
    # Tokens times the limit less characters, up to each border between tokens.
    spent = [CHARS_PER_TOKEN * i - c for i, c in enumerate(at)]
    best, low, first, found = 0.0, 0, 0, None
    for last in range(1, len(at)):
        while at[last] - at[first] >= LEAST:
            if spent[first] < spent[low]:
                low = first
            first += 1
        if first and spent[last] - spent[low] > best:
            best, found = spent[last] - spent[low], (at[low], at[last])
    return found


def _stretches(run: str, tokens) -> list[tuple[int, int]]:
    """Stretches of a run that are random strings, up to the separators around them where these are, too."""
    found, left = [], [(0, len(run))]

    def is_random(at: tuple[int, int]) -> bool:
        string = run[slice(*at)]
        mixed = sum(len(p) for p in PART.findall(string) if HAS_DIGIT(p) and HAS_LETTER(p))
        return len(string) >= LEAST and mixed >= MIXED * len(string) and len(string) < CHARS_PER_TOKEN * len(tokens(string))

    while left:
        begin, end = left.pop()
        if end - begin < LEAST or (at := _costly(tokens(run[begin:end]))) is None:
            continue
        start, stop = begin + at[0], begin + at[1]
        first, last = PART.search(run, start, stop), PART_LAST.search(run[:stop])
        wide = (start, stop) if first is None else (
            first.start() - len(PART_BEFORE.search(run[begin : first.start()])[0]), last.end(1) + len(PART_AFTER.match(run[last.end(1) : end])[0]))
        whole = next(filter(is_random, (wide, (start, stop))), None)
        # Short words beside a random string may make up most of the stretch.
        parts = [(wide[0] + p.start(), wide[0] + p.end()) for p in PART.finditer(run[slice(*wide)]) if p.end() - p.start() >= LEAST]
        found += [whole] if whole else filter(is_random, parts)
        start, stop = whole or (start, stop)
        left += [(begin, start), (stop, end)]
    return found


def _letters(run: str, tokens) -> list[tuple[int, int]]:
    """Parts of a run without digits that are random letters in both cases."""
    found = []
    for p in PART.finditer(run):
        part = p[0]
        if len(part) >= LEAST and sum(1 for _ in CHANGE.finditer(part)) >= CASE_CHANGES * len(part) and len(part) < LETTERS_PER_TOKEN * len(tokens(part)):
            found.append(p.span())
    return found


def random_spans(text: str, taken: list[tuple[int, int, int]], tokens) -> list[tuple[int, int, int]]:
    """Runs, and stretches of other runs, that cost many tokens and touch no span in ``taken``; unsorted."""
    found = []
    for m in RUN.finditer(text):
        run, begin = m[0], m.start()
        if not HAS_DIGIT(run):
            free = _letters(run, tokens) if not KNOWN_BEFORE.search(text[max(0, begin - 12) : begin]) else []
            found += [(begin + a, 3, begin + b) for a, b in free if not any(s < begin + b and begin + a < e for s, _, e in taken)]
            continue
        if not (HAS_DIGIT(run) and HAS_LETTER(run)) or KNOWN.fullmatch(run) or KNOWN_BEFORE.search(text[max(0, begin - 12) : begin]):
            continue
        known = [(k.start() + begin, k.end() + begin) for k in KNOWN_WITHIN.finditer(run)]
        base = [(start, end) for start, _, end in taken if start < m.end() and begin < end]
        if not known and not base and len(run) < CHARS_PER_TOKEN * len(tokens(run)):
            found.append((begin, 3, m.end()))
            continue
        for a, b in _free(begin, m.end(), known + base):
            if not KNOWN_BEFORE.search(text[max(0, a - 12) : a]):
                found += [(a + s, 3, a + e) for s, e in _stretches(text[a:b], tokens)]
    return found


def find(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``secret_spans``: (kind, start, end) in code points, end exclusive, by start and then kind.

    Kinds are assign, access and hex, and random for what the token test adds.  A null or empty text
    has no spans.  Rows that repeat are scanned each; a column called ``secret_spans`` is replaced, and
    all other columns are kept (``keep`` names fewer).
    """
    sent = bpe.shipped(df, path)

    def spans(value: str | None) -> list[dict]:
        if not value:
            return []
        base = base_spans(value)
        found = sorted(base + random_spans(value, base, _counter(sent, pattern)))
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found]

    def work(texts: list[str | None]) -> dict[str, list]:
        return {"secret_spans": [spans(t) for t in texts]}

    return map_texts(df, text, df.columns if keep is None else keep, SPANS, work)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, path: str, pattern: str, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``df`` with every found span of the text replaced by a mark, and ``n_chars`` (if present) brought up to date.

    Spans that overlap or touch become one mark.  Texts without spans, nulls among them, stay as they
    are, and so do their counts.
    """
    sent = bpe.shipped(df, path)
    changed = fresh(df, "_changed")
    added = T.StructType([T.StructField(text, T.StringType()), T.StructField(changed, T.BooleanType())])

    def clean(value: str | None) -> tuple[str | None, bool]:
        if not value:
            return value, False
        base = base_spans(value)
        found = sorted(base + random_spans(value, base, _counter(sent, pattern)))
        parts, at = [], 0
        for start, _, end in found:
            if start > at or not parts:
                parts += [value[at:start], MARK]
            at = max(at, end)
        return "".join(parts) + value[at:], bool(found)

    def work(texts: list[str | None]) -> dict[str, list]:
        made = [clean(t) for t in texts]
        return {text: [m[0] for m in made], changed: [m[1] for m in made]}

    out = map_texts(df, text, df.columns, added, work)
    if n_chars in df.columns:
        count = F.when(F.col(changed), F.length(quoted(text))).otherwise(F.col(quoted(n_chars)))
        out = out.withColumn(n_chars, count.cast(df.schema[n_chars].dataType))
    return out.select(*[F.col(quoted(c)) for c in df.columns])
