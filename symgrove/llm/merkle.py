"""A Merkle manifest of a table: a hash tree per group, a tree over the groups, and a proof per row.

A row's leaf is the SHA-256 of its fields. The leaves of a tree, in the order
of their key, are cut into aligned spans. Each span hashes its own subtree.
Then spans exchange subtree roots in butterfly rounds: in round r, spans whose
numbers differ only in the r-th digit to the base of the fanout meet in one
group of at most ``fanout`` rows, swap roots, and each hashes their common
ancestor for itself. After the last round every span holds the root and the
siblings above it; no pass goes down again. A subtree cut short by the end of
the table sends its members to the groups that would lack one. The roots of
the trees are the leaves of one more tree, built alike. Digests are lowercase
hex text, and inputs of a hash are concatenated. As long as several nodes
remain, every run of ``fanout`` becomes a parent, a last run of one too.

Defined results: null fields count as ``-``, others as their UTF-8 byte count,
``:`` and value, so null, empty and very long texts differ and are hashed
whole; bytes that are not UTF-8 are hashed as they are. Rows with null keys
come first; rows equal in key are ordered by leaf, and rows equal in that too
have the same leaf, so any order gives the same tree. A null group is a tree
of its own, the first. A single leaf is its tree's root. Columns beyond those
named are not carried, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from symgrove.llm.order import positions, row_id
from symgrove.llm.tables import stored

FANOUT = 8
# Leaves of a span: a power of the fanout.
SPAN = 512
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


def leaf_hash(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each led by its length."""
    def one(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*map(one, fields)).cast("binary"), 256)


def _parent(roots: Column) -> Column:
    return F.sha2(F.array_join(roots, "").cast("binary"), 256)


def _climb(leaves: list[str], levels: int, fanout: int) -> tuple[list[str], str]:
    """Each leaf's siblings over so many levels, bottom up, and the node that remains."""
    nodes, siblings, width = leaves, [""] * len(leaves), 1
    for _ in range(levels):
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        others = ["".join(run[:j] + run[j + 1:]) for run in runs for j in range(len(run))]
        siblings = [s + others[i // width] for i, s in enumerate(siblings)]
        nodes, width = [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs], width * fanout
    return siblings, nodes[0]


def _levels(n: int, span: int, fanout: int) -> int:
    """Levels below the root of a span of a tree of n leaves."""
    levels, width = 0, 1
    while width < min(n, span):
        levels, width = levels + 1, width * fanout
    return levels


def _span_roots(leaves: DataFrame, span: int, fanout: int) -> DataFrame:
    """tree, span, spans (of the tree), node: each span hashed by itself."""
    def root(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        n = group["n"][0].as_py()
        _, node = _climb(group["leaf"].to_pylist(), _levels(n, span, fanout), fanout)
        return pa.table({"tree": [group["tree"][0].as_py()], "span": [group["span"][0].as_py()],
                         "spans": [-(-n // span)], "node": [node]})

    return leaves.select("tree", "span", "place", "n", "leaf").groupBy("tree", "span").applyInArrow(
        root, "tree bigint, span bigint, spans bigint, node string")


def _exchange(state: DataFrame, size: int, fanout: int) -> DataFrame:
    """One butterfly round among subtrees of ``size`` spans; trees that are complete stay as they are."""
    spans, span = F.col("spans"), F.col("span")
    subtree, offset = F.floor(span / size), span % size
    subtrees = F.floor((spans + (size - 1)) / size)
    run = F.floor(subtree / fanout)
    # Members of the span's own subtree; the last one may be cut short, and then visits several lanes.
    members = F.least(F.lit(size), spans - subtree * size)
    alone = F.least(F.lit(fanout), subtrees - run * fanout) <= 1
    lanes = F.when(alone, F.array(offset)).otherwise(F.sequence(offset, F.lit(size - 1).cast("bigint"), members))
    sent = (state.withColumns({"subtree": subtree, "run": run, "lane": F.explode(lanes)})
            .withColumn("own", F.col("lane") == offset))
    member = F.struct("subtree", "node", "own", "span", F.when(F.col("own"), F.col("above")).alias("above"))
    met = (sent.groupBy("tree", "spans", "run", "lane")
           .agg(F.array_sort(F.collect_list(member)).alias("members"))
           .withColumn("parent", F.when(spans <= size, F.col("members")[0]["node"])
                       .otherwise(_parent(F.col("members.node"))))
           .withColumn("one", F.explode(F.filter("members", lambda m: m["own"]))))
    siblings = F.transform(F.filter("members", lambda m: m["subtree"] != F.col("one.subtree")), lambda m: m["node"])
    return met.select("tree", F.col("one.span").alias("span"), "spans", F.col("parent").alias("node"),
                      F.concat(F.col("one.above"), F.array_join(siblings, "")).alias("above"))


def _upper_proofs(leaves: DataFrame, largest: int, span: int, fanout: int, label: str) -> DataFrame:
    """tree, span, node (the tree's root), above (siblings above the span), stored."""
    state = _span_roots(leaves, span, fanout).withColumn("above", F.lit(""))
    size = 1
    while size * span < largest:
        state = _exchange(state, size, fanout)
        size *= fanout
    return stored(state.select("tree", "span", "node", "above"), label)


def _with_siblings(leaves: DataFrame, upper: DataFrame, span: int, fanout: int) -> DataFrame:
    """leaves with ``siblings``, all hex digests of their proof, and the other columns of their span in upper."""
    added = [f for f in upper.schema if f.name not in ("tree", "span", "above")]
    schema = StructType([*leaves.schema, StructField("siblings", StringType()), *added])

    def attach(rows: pa.Table, spans: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("place")
        low, _ = _climb(rows["leaf"].to_pylist(), _levels(rows["n"][0].as_py(), span, fanout), fanout)
        above = spans["above"][0].as_py()
        out = rows.append_column("siblings", pa.array([s + above for s in low], pa.string()))
        for field in added:
            out = out.append_column(field.name, pa.array([spans[field.name][0].as_py()] * len(rows),
                                                         spans.schema.field(field.name).type))
        return out

    return (leaves.groupBy("tree", "span").cogroup(upper.groupBy("tree", "span"))
            .applyInArrow(attach, schema))


def fold(leaf: Column, siblings: Column, steps: Sequence[tuple[Column, Column]], fanout: int = FANOUT) -> Column:
    """The root that a leaf and its siblings give; steps: (place, leaves) in its tree, then in the tree of trees."""
    state = F.struct(leaf.alias("node"), F.lit(1).alias("at"))
    for place, n in steps:
        begin = F.struct(state["node"].alias("node"), state["at"].alias("at"),
                         place.cast("bigint").alias("place"), n.cast("bigint").alias("n"))

        def up(now: Column, _: Column) -> Column:
            run = F.floor(now["place"] / fanout)
            others = (F.least(F.lit(fanout), now["n"] - run * fanout) - 1).cast("int")
            left = (now["place"] % fanout).cast("int")
            node = F.concat(F.substring(siblings, now["at"], left * _HEX), now["node"],
                            F.substring(siblings, now["at"] + left * _HEX, (others - left) * _HEX))
            return F.struct(F.sha2(node.cast("binary"), 256).alias("node"), (now["at"] + others * _HEX).alias("at"),
                            run.alias("place"), F.floor((now["n"] + (fanout - 1)) / fanout).alias("n"))

        depth = F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, fanout))).otherwise(0)
        state = F.aggregate(F.array_repeat(F.lit(0), depth), begin, up)
    return state["node"]


def manifest(docs: DataFrame, key: str = "doc_id", tree: str = "lang", fields: Sequence[str] = FIELDS,
             carried: Mapping[str, Column] | None = None, fanout: int = FANOUT, span: int = SPAN) -> DataFrame:
    """One row per row of docs: key, leaf, tree_place, trees, place, n, siblings, subroot, root, and ``carried``.

    ``place`` of ``n`` is the leaf's place in its tree, ``tree_place`` of
    ``trees`` that of the tree. ``siblings`` holds the proof, one hex digest
    after another: from the bottom up, in each run from left to right.
    ``fold(leaf, siblings, [(place, n), (tree_place, trees)])`` is the root.
    """
    carried = carried or {}
    kept = [f"_c_{name}" for name in carried]
    rows = stored(docs.select(
        F.col(key).alias("_key"), F.col(tree).alias("_tree"), leaf_hash([F.col(f) for f in fields]).alias("leaf"),
        *[column.alias(name) for name, column in zip(kept, carried.values())], row_id().alias("_row")), "leaves")
    placed = positions(rows, ["_tree", "_key", "leaf", "_row"], "leaf-places")
    trees = placed.groupBy("_tree").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    trees = stored(positions(trees, ["first"], "tree-places", "tree"), "trees")
    # Two numbers: how many trees, and the leaves of the largest.
    n_trees, largest = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    leaves = placed.join(trees.withColumnRenamed("_tree", "_of"), F.col("_tree").eqNullSafe(F.col("_of"))).select(
        "_key", *kept, "leaf", "tree", (F.col("position") - F.col("first")).alias("place"), "n",
        F.floor((F.col("position") - F.col("first")) / span).alias("span"))
    upper = _upper_proofs(leaves, largest, span, fanout, "span-proofs")
    top = upper.where("span = 0").select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("bigint").alias("n"),
        F.floor(F.col("tree") / span).alias("span"), F.col("node").alias("leaf"))
    over = _with_siblings(top, _upper_proofs(top, n_trees, span, fanout, "tree-proofs"), span, fanout).select(
        F.col("place").alias("_over"), F.col("siblings").alias("_higher"), F.col("node").alias("root"))
    upper = upper.join(over, F.col("tree") == F.col("_over")).select(
        "tree", "span", F.col("node").alias("subroot"), "root", F.concat("above", "_higher").alias("above"))
    return _with_siblings(leaves, upper, span, fanout).select(
        F.col("_key").alias(key), "leaf", F.col("tree").alias("tree_place"),
        F.lit(n_trees).cast("bigint").alias("trees"), "place", "n", "siblings", "subroot", "root",
        *[F.col(k).alias(name) for k, name in zip(kept, carried)])
