"""Column functions on words and texts; those that need Unicode tables run as Arrow-batched functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType


def plain_word(word: str | None) -> str | None:
    """A word in letters a-z, after NFKD, case folding and without combining marks; None where that is not the whole form."""
    if word is None:
        return None
    s = "".join(c for c in unicodedata.normalize("NFKD", word).casefold() if not unicodedata.combining(c))
    return s if s.isascii() and s.isalpha() else None


@F.pandas_udf(StringType())
def normalize_word(words: pd.Series) -> pd.Series:
    """NFKD, case folding, no combining marks; null unless the whole form is then of letters a-z."""
    known = {w: plain_word(w) for w in words.unique()}
    return words.map(known)


def alpha_runs(text: Column) -> Column:
    """Maximal runs of letters with their combining marks."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))


def roman_like(word: Column) -> Column:
    """Whether a word looks like a Roman numeral."""
    return F.upper(word).rlike("^[IVXLCDM]+$")


def word_pattern(units: Column) -> Column:
    """The first-occurrence pattern of a list of units, abba to 0.1.1.0."""
    return F.array_join(F.transform(units, lambda u: (F.array_position(F.array_distinct(units), u) - 1).cast("string")), ".")


def fixed_blocks(text: Column, size: int = 64) -> Column:
    """A text in consecutive pieces of `size` characters; the last may be shorter, an empty text has none."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))


def edit1_keys(word: Column) -> Column:
    """Keys of which two words within one edit share one: the word itself and the word with each one letter deleted."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.when(F.length(word) > 0, F.array_distinct(F.concat(F.array(word), cut))).otherwise(F.array(word))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; null where both are empty."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0))


def _word_distance(a: list[str], b: list[str]) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


@F.pandas_udf(LongType())
def token_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Levenshtein distance of two lists of words, a word being one item; null where a list is null."""
    return pd.Series([None if a is None or b is None else _word_distance(list(a), list(b)) for a, b in zip(left, right)], dtype="Int64")


def set_bits(mask: Column) -> Column:
    """How many bits of a 64-bit mask are set."""
    return F.bit_count(mask)


def mask_of(items: Column, universe: list[str]) -> Column:
    """The items of a list as a 64-bit mask by their place in `universe`, of 63 items at most; others give no bit."""
    if len(universe) > 63:
        raise ValueError("more than 63 items")
    places = F.map_from_arrays(F.array(*map(F.lit, universe)), F.array(*[F.lit(1 << k) for k in range(len(universe))]))
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(F.coalesce(F.try_element_at(places, x), F.lit(0)).cast("bigint")))
