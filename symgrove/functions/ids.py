"""Deterministic identifiers as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from symgrove.constants import FINGERPRINT_CHARS, URL_NAMESPACE_HEX


def name_uuid(name: Column) -> Column:
    """Version-5 UUID of a name in the URL namespace."""
    namespace = F.unhex(F.lit(URL_NAMESPACE_HEX))
    digest = F.sha1(F.concat(namespace, name.cast("binary")))
    variant_bits = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    variant = F.substring(F.lit("89ab"), variant_bits + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def symbol_id(rel_path: Column, start_byte: Column, name: Column) -> Column:
    """Stable id of a definition from its place and name."""
    return name_uuid(F.concat_ws(":", rel_path, start_byte.cast("string"), name))


def fingerprint(content: Column, prefix: str) -> Column:
    """``prefix:`` and the first hex digits of the content's SHA-256."""
    return F.concat(F.lit(f"{prefix}:"),
                    F.substring(F.sha2(content.cast("binary"), 256), 1, FINGERPRINT_CHARS))
