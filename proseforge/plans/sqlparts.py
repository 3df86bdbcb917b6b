"""SQL fragments shared by the checking statements."""

from __future__ import annotations

from proseforge.functions import text as T
from proseforge.operators.tokens import MAX_VOCAB, SPECIAL_TOKENS

WS = T.WS


def u(seed: int, name: str, *keys: str) -> str:
    text = f"concat_ws(':', '{seed}', {', '.join(keys)}, '{name}')"
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def randint(u_: str, low: str, high: str) -> str:
    return f"({low} + floor({u_} * ({high} - {low} + 1)))::INT"


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: x <> '')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'), ' ')"


def clean(c: str, entities: dict[str, str] | None = None) -> str:
    """The line cleaner; ``entities`` lists the ones present in the data."""
    line = f"replace({c}, '<unk>', ' ')"
    for name, char in (entities or {}).items():
        line = f"regexp_replace({line}, '{name}', '{char}', 'g')"
    line = f"regexp_replace({line}, '{T.CONTROL}', ' ', 'g')"
    body = line
    for pattern in (T.TEMPLATE, T.CATEGORY, T.URL, T.FILE, f"{WS}+"):
        body = f"regexp_replace({body}, '{pattern}', ' ', 'g')"
    body = f"CASE WHEN regexp_matches({line}, '{T.HEADING}') THEN '' ELSE {body} END"
    return f"regexp_replace({body}, '{T.ONLY_PUNCT}', '')"


def header_or_markup(c: str) -> str:
    s = strip(c)
    return (
        f"(length({s}) < 30 OR substr({s}, 1, 1) IN ('=', '*', '#', '|')"
        f" OR regexp_matches({s}, '^\\{{\\{{[^\\n]*\\}}\\}}$'))"
    )


def control_prompt(s: str, f: str) -> str:
    return (
        f"(CASE {s} WHEN 'Positive' THEN '[SENT_POS]' WHEN 'Negative' THEN '[SENT_NEG]'"
        f" WHEN 'unspecified' THEN '[SENT_UNSPEC]' ELSE '' END ||"
        f" CASE {f} WHEN 'Formal' THEN '[FORM_FORMAL]' WHEN 'Neutral' THEN '[FORM_NEUTRAL]'"
        f" WHEN 'Informal' THEN '[FORM_INFORMAL]' WHEN 'unspecified' THEN '[FORM_UNSPEC]' ELSE '' END)"
    )


_SPECIAL_VALUES = ", ".join(f"('{t}', {i})" for i, t in enumerate(SPECIAL_TOKENS))


def vocab_cte(source: str = "documents", column: str = "text", size: int = MAX_VOCAB, name: str = "vocab") -> str:
    return f"""
    {name}_cnt AS (
      SELECT w AS token, count(*) AS n FROM (SELECT unnest({tokens(column)}) AS w FROM {source}) GROUP BY 1),
    {name} AS (
      SELECT token, (row_number() OVER (ORDER BY n DESC, token) + {len(SPECIAL_TOKENS) - 1})::INT AS id
      FROM (SELECT * FROM {name}_cnt ORDER BY n DESC, token LIMIT {size})
      UNION ALL SELECT * FROM (VALUES {_SPECIAL_VALUES}) s(token, id))"""


def ids_cte(key: str, source: str = "documents", column: str = "text", vocab: str = "vocab", name: str = "ids") -> str:
    """``name`` (key, ids): encoded token lists."""
    return f"""
    {name}_tok AS (SELECT {key}, {tokens(column)} AS t FROM {source}),
    {name}_pos AS (SELECT {key}, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM {name}_tok),
    {name}_enc AS (
      SELECT {key}, list(coalesce(v.id, 1) ORDER BY pos) AS l
      FROM {name}_pos LEFT JOIN {vocab} v USING (token) GROUP BY {key}),
    {name} AS (SELECT {key}, coalesce(l, []::INT[]) AS ids FROM {name}_tok LEFT JOIN {name}_enc USING ({key}))"""


def fit(ids: str, length: int, fill: int) -> str:
    return f"list_resize(({ids})[1:{length}], {length}, {fill})"


def repeat(value: int, n: str) -> str:
    return f"list_transform(range(greatest(({n})::BIGINT, 0)), lambda z: {value})"


def mask(n: str, length: int) -> str:
    return f"list_transform(range({length}), lambda z: CASE WHEN z < ({n}) THEN 1 ELSE 0 END)"


def joined(ids: str) -> str:
    return f"array_to_string({ids}, ',')"


def prefix_length(n: str, kind: str, length: str, longest: int) -> str:
    top = f"least({longest}, greatest(1, {n} - 1))"
    short = randint(length, f"greatest(1, least(3, {top}))", f"least(8, {top})")
    long_ = randint(length, f"CASE WHEN {top} >= 9 THEN 9 ELSE 1 END", top)
    return f"(CASE WHEN {kind} < 0.6::DOUBLE THEN 0 WHEN {kind} < 0.6::DOUBLE + 0.35::DOUBLE THEN {short} ELSE {long_} END)"
