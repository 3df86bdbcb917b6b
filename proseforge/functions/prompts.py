"""Control prompts: building, parsing and prefixing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control tokens by attribute value.
SENTIMENT_TOKENS = {
    "Positive": "[SENT_POS]",
    "Negative": "[SENT_NEG]",
    "unspecified": "[SENT_UNSPEC]",
}
FORMALITY_TOKENS = {
    "Formal": "[FORM_FORMAL]",
    "Informal": "[FORM_INFORMAL]",
    "Neutral": "[FORM_NEUTRAL]",
    "unspecified": "[FORM_UNSPEC]",
}
CONTROL_TOKENS = [*SENTIMENT_TOKENS.values(), *FORMALITY_TOKENS.values()]


def _switch(value: Column, table: dict[str, str]) -> Column:
    out = F.lit("")
    for name, token in table.items():
        out = F.when(value == name, token).otherwise(out)
    return out


def control_prompt(sentiment: Column, formality: Column, separator: bool = False) -> Column:
    """Control tokens for both attributes; an unknown value adds nothing."""
    return F.concat(
        _switch(sentiment, SENTIMENT_TOKENS),
        _switch(formality, FORMALITY_TOKENS),
        F.lit(":" if separator else ""),
    )


def control_prompt_or_unspecified(sentiment: Column, formality: Column) -> Column:
    """Control tokens where a missing attribute counts as unspecified."""
    unset = F.lit("unspecified")
    return control_prompt(F.coalesce(sentiment, unset), F.coalesce(formality, unset))


def _first_contained(prompt: Column, table: dict[str, str]) -> Column:
    out = F.lit("unspecified")
    for name, token in reversed(list(table.items())):
        if name != "unspecified":
            out = F.when(F.contains(prompt, F.lit(token)), name).otherwise(out)
    return out


def parse_sentiment(prompt: Column) -> Column:
    return _first_contained(prompt, SENTIMENT_TOKENS)


def parse_formality(prompt: Column) -> Column:
    return _first_contained(prompt, FORMALITY_TOKENS)


def sentiment_name(label: Column) -> Column:
    return F.when(label == 1, "Positive").otherwise("Negative")


def formality_name(label: Column) -> Column:
    return F.when(label == 1, "Formal").otherwise("Informal")


def with_prompt(prompt: Column, text: Column) -> Column:
    """The text behind its prompt; null when there is no text."""
    return F.concat(prompt, F.lit(" "), text)
