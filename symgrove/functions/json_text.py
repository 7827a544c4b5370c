"""JSON text with two-space indentation and ASCII escapes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Short escapes of JSON strings.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _escape(char: Column) -> Column:
    code = F.ascii(char)
    expr = None
    for raw, short in _SHORT.items():
        expr = F.when(char == raw, short) if expr is None else expr.when(char == raw, short)
    high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
    low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
    return expr.when((code >= 32) & (code < 127), char).when(code < 0x10000, _unit(code)) \
        .otherwise(F.concat(_unit(high), _unit(low)))


def quoted(text: Column) -> Column:
    """A JSON string; plain ASCII takes the fast path."""
    escaped = F.when(text.rlike(r"^[ !#-\[\]-~]*$"), text).otherwise(
        F.array_join(F.transform(F.split(text, ""), _escape), ""))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _block(items: Column, opening: str, closing: str) -> Column:
    body = F.array_join(F.transform(items, lambda x: F.concat(F.lit("    "), x)), ",\n")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{opening}\n"), body, F.lit(f"\n  {closing}"))) \
        .otherwise(opening + closing)


def map_block(entries: Column) -> Column:
    items = F.transform(F.map_entries(entries),
                        lambda e: F.concat(quoted(e.key), F.lit(": "), quoted(e.value)))
    return _block(items, "{", "}")


def list_block(values: Column) -> Column:
    return _block(F.transform(values, quoted), "[", "]")


def object_text(fields: dict[str, Column]) -> Column:
    """An object of already rendered field values."""
    rows = [F.concat(F.lit(f'  "{name}": '), value) for name, value in fields.items()]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *rows), F.lit("\n}"))
