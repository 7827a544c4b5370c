"""Symbol extraction from file contents (B1-B4, node rows).

A file's definitions are found where the file is read, by a small helper on
Arrow batches (``scanner``); nothing but found definitions leaves it, and no
text is shuffled or sorted. Tags, ids and node rows are column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from symgrove.constants import TAG_NODE_TYPE
from symgrove.functions.ids import symbol_id
from symgrove.operators.files import lookup
from symgrove.rules import rules_for
from symgrove.scanner import definitions

# Definitions leave a task in batches of about this many characters of source.
BATCH_CHARS = 4 << 20
_FOUND = T.StructType([
    T.StructField("language", T.StringType()), T.StructField("tag", T.StringType()),
    T.StructField("symbol_name", T.StringType()), T.StructField("start_byte", T.LongType()),
    T.StructField("end_byte", T.LongType()), T.StructField("source_code", T.StringType())])


def scan_definitions(files: DataFrame, key: Sequence[str] = ("rel_path",), extended: bool = False) -> DataFrame:
    """B1, B2: (key, language, tag, symbol_name, start_byte, end_byte, source_code) of every definition.

    ``files`` has key, language and content. A definition's source is its own
    bytes, nested definitions included; these have rows of their own. Content
    that is not valid UTF-8 is read with replacements. Files without a key or
    of languages without rules give no rows.
    """
    schema = T.StructType([*[files.schema[name] for name in key], *_FOUND.fields])
    wanted = F.col("language").isin(list(rules_for(extended)))
    for name in key:
        wanted = wanted & F.col(name).isNotNull()
    names = [f.name for f in schema]

    def scan(batches):
        held, weight = [], 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            types = [batch.schema.field(i).type for i in range(len(key))] + [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()]

            def flushed():
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

            for *keys, language, content in zip(*columns):
                for tag, name, start, end, source in definitions(content or "", language, extended):
                    held.append((*keys, language, tag, name, start, end, source))
                    weight += len(source) + 100
                    if weight >= BATCH_CHARS:
                        yield flushed()
                        held, weight = [], 0
            if held:
                yield flushed()
                held, weight = [], 0

    text = F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    return files.where(wanted).select(*key, "language", text).mapInArrow(scan, schema)


def match_filter(matches: DataFrame) -> DataFrame:
    """Matches that have a name and a definition capture.

    ``captures`` is an array of (key, text, start). The first key that starts
    with ``definition`` decides; its last dotted part is the tag.
    """
    first = F.try_element_at(
        F.filter("captures", lambda x: F.startswith(x.key, F.lit("definition"))), F.lit(1))
    name = F.try_element_at(F.filter("captures", lambda x: x.key == "name"), F.lit(1))
    return (
        matches.withColumns({"definition": first, "name": name})
        .where(F.col("definition").isNotNull() & F.col("name").isNotNull())
        .withColumns({
            "tag": F.element_at(F.split("definition.key", r"\."), -1),
            "symbol_name": F.col("name.text"), "source_code": F.col("definition.text"),
            "start_byte": F.col("definition.start")})
        .drop("captures", "definition", "name")
    )


def classify_tag(definitions: DataFrame) -> DataFrame:
    """Add ``node_type``; tags that are no node are dropped."""
    return definitions.withColumn("node_type", lookup(TAG_NODE_TYPE, F.col("tag"))) \
        .where(F.col("node_type").isNotNull())


def symbol_nodes(files: DataFrame, key: Sequence[str] = ("rel_path",),
                 extended: bool = False, id_path: Column | None = None) -> DataFrame:
    """Node rows of all files.

    An id is scoped by ``id_path``: by default the path below its repository's
    name if files carry one, whatever the number of repositories, else
    rel_path. Nodes keep the repository as a column ``repo``.
    """
    rows = classify_tag(scan_definitions(files, key, extended))
    repo = ["repo"] if "repo" in key else []
    path = F.concat_ws("/", *repo, "rel_path") if id_path is None else id_path
    empty = F.array().cast("array<string>")
    return rows.select(
        symbol_id(path, F.col("start_byte"), F.col("symbol_name")).alias("node_id"),
        "node_type", F.col("rel_path").alias("file_path"), "symbol_name", "source_code",
        empty.alias("child_nodes"), empty.alias("parent_nodes"), "language", *repo)
