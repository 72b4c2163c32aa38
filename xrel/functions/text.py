"""Text columns: localised names, blank checks and case changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is trimmed.
WHITE_SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


# Where a change of case splits words, and what counts as a word.
CASE_CHANGE, CAPITALS_END, CAPITAL_WORD = "([a-z0-9])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Z][a-z0-9]*)"


def localised(names: Column, language: Column) -> Column:
    """The entry of a language -> text map for the row's own language; null when it is not there."""
    return F.try_element_at(names, language)


def non_empty(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[^{WHITE_SPACE}]"), F.lit(False))


def nbsp_to_space(text: Column) -> Column:
    return F.translate(text, "\u00a0", " ")


def camel_to_snake(text: Column) -> Column:
    split_words = F.regexp_replace(text, CASE_CHANGE, "$1_$2")
    return F.lower(F.regexp_replace(split_words, CAPITALS_END, "$1_$2"))


def split_camel(text: Column) -> Column:
    """Struct (title_case, sentence_case, snake_case); nulls for null or empty text."""
    words = F.regexp_extract_all(text, F.lit(CAPITAL_WORD), F.lit(1))
    has_words = F.size(words) > 0
    title = F.when(has_words, F.array_join(words, " ")).otherwise(text)
    tail = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda w: F.lower(w))
    sentence = F.when(has_words, F.array_join(F.concat(F.slice(words, 1, 1), tail), " ")).otherwise(text)
    full = F.length(text) > 0
    return F.struct(
        F.when(full, title).alias("title_case"),
        F.when(full, sentence).alias("sentence_case"),
        F.when(full, camel_to_snake(text)).alias("snake_case"),
    )
