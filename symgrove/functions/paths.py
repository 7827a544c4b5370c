"""Path expressions over ``/``-separated relative paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directories(path: Column) -> Column:
    """Directory components, without the file name."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def extension(path: Column) -> Column:
    """Last suffix of the file name with its dot, or the empty string.

    Leading dots belong to the name: ``.py`` has no extension.
    """
    return F.regexp_extract(base_name(path), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def relative_to(path: Column, root: Column) -> Column:
    """Path below root; a path outside it is left as it is."""
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, prefix),
                  F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


# A backslash with what it quotes, a closed class, stars, or one character.
_GLOB_TOKEN = r"(?s)\\.|\[[!^]?\]?+[^\]]*\]|\*+|."
_CLASS_TOKEN = r"(?s).-.|."


def _quoted(text: Column) -> Column:
    """Every ASCII mark with a backslash before it."""
    return F.regexp_replace(text, r"([!-/:-@\[-`{-~])", r"\\$1")


def _class_regex(token: Column) -> Column:
    """A bracket expression: ``!`` or ``^`` negates, ranges stay unless they run backwards, the rest is quoted."""
    body = F.substring(token, F.lit(2), F.length(token) - 2)
    negated = body.rlike("^[!^]")
    body = F.when(negated, F.substring(body, F.lit(2), F.length(body))).otherwise(body)
    low, high = (lambda t: F.substring(t, 1, 1)), (lambda t: F.substring(t, 3, 1))
    parts = F.transform(F.regexp_extract_all(body, F.lit(_CLASS_TOKEN), F.lit(0)), lambda t: F.when(
        F.length(t) == 1, _quoted(t)).when(low(t) <= high(t), F.concat(_quoted(low(t)), F.lit("-"), _quoted(high(t)))).otherwise(""))
    inside = F.array_join(parts, "")
    return F.when(inside == "", F.when(negated, r"[\s\S]").otherwise(r"[^\s\S]")).otherwise(
        F.concat(F.when(negated, "[^").otherwise("["), inside, F.lit("]")))


def glob_regex(glob: Column) -> Column:
    """Shell glob as a regex; ``*`` and ``?`` may cross ``/``.

    One pass from left to right: a backslash quotes the next character, an
    unclosed ``[`` is literal. Every glob gives a regex that compiles.
    """
    def one(token: Column) -> Column:
        return (F.when(token.startswith("*"), r"[\s\S]*").when(token == "?", r"[\s\S]")
                .when((F.length(token) == 2) & token.startswith("\\"), _quoted(F.substring(token, 2, 1)))
                .when((F.length(token) > 1) & token.startswith("["), _class_regex(token))
                .otherwise(_quoted(token)))

    return F.array_join(F.transform(F.regexp_extract_all(glob, F.lit(_GLOB_TOKEN), F.lit(0)), one), "")
