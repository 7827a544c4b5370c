"""String expressions: query normalisation, tokens, trigrams, matching."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space stripped from queries, and the word characters.
_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_WORD = r"([\p{L}\p{N}_]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strip_space(text: Column) -> Column:
    """Strip all white space, not only blanks."""
    return F.regexp_replace(text, _SPACE, "")


def normalize(text: Column) -> Column:
    return F.lower(strip_space(text))


def words(text: Column) -> Column:
    """All runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(1))


def ascii_lower(text: Column) -> Column:
    """Case folding of A-Z only, as LIKE does."""
    return F.translate(text, _UPPER, _LOWER)


def characters(text: Column) -> Column:
    """The characters in order; empty for empty text."""
    return F.filter(F.split(text, ""), lambda ch: ch != "")


def ngrams(text: Column, n: int) -> Column:
    """Overlapping n-character windows in order; empty for shorter text.

    Shifted copies of the character array are zipped: inside a lambda over
    positions the text itself would be computed again for every window.
    """
    chars = characters(text)
    count = F.greatest(F.size(chars) - (n - 1), F.lit(0))
    grams = F.slice(chars, F.lit(1), count)
    for shift in range(1, n):
        grams = F.zip_with(grams, F.slice(chars, F.lit(shift + 1), count),
                           lambda left, right: F.concat(left, right))
    return grams


def occurrences(text: Column, phrase: Column) -> Column:
    """Number of overlapping occurrences of phrase; text must contain it.

    Every start is only tried where a second occurrence exists.
    """
    starts = F.sequence(F.lit(1), F.length(text) - F.length(phrase) + 1)
    second = F.call_function("locate", phrase, text, F.call_function("locate", phrase, text) + 1)
    return F.when(second == 0, 1).otherwise(F.size(F.filter(
        starts, lambda i: F.substring(text, i, F.length(phrase)) == phrase)))


def default_token_count(text: Column) -> Column:
    """Token estimate used where no counter or token column is given."""
    return F.ceil(F.length(text) / F.lit(4.0)).cast("long")


def size_columns() -> dict[str, Column]:
    """n_len and n_tok of a node's source text."""
    return {"n_len": F.length("source_code").cast("long"), "n_tok": default_token_count(F.col("source_code"))}
