"""Call-graph context under a token budget.

Context is kept in long form, one row per (target, neighbour). Neighbours are
capped before any join, so every later group holds at most
``CHILD_LIMIT + PARENT_LIMIT`` rows however popular a symbol is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from symgrove.constants import CHILD_LIMIT, MAX_TOKENS, PARENT_LIMIT
from symgrove.functions.text import default_token_count

TokenCounter = Callable[[Column], Column]
_SALTS = 64


def directed_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges seen from both ends: (target_id, role, nbr_id)."""
    ends = F.inline(F.array(
        F.struct(F.col("caller_id").alias("target_id"), F.lit("child").alias("role"),
                 F.col("callee_id").alias("nbr_id")),
        F.struct(F.col("callee_id").alias("target_id"), F.lit("parent").alias("role"),
                 F.col("caller_id").alias("nbr_id")),
    ))
    return edges.select("caller_id", "callee_id").distinct().select(ends)


def _edges_of(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """directed_edges() of some targets: each direction meets them before any edge is shuffled for being distinct.

    What is distinct is dealt by whole edge, so a callee used everywhere stays
    spread until the limit has cut it in every task.
    """
    ends = [
        edges.select(F.col(near).alias("target_id"), F.lit(role).alias("role"), F.col(far).alias("nbr_id"))
        .join(targets.select("target_id"), "target_id", "left_semi")
        for role, near, far in (("child", "caller_id", "callee_id"), ("parent", "callee_id", "caller_id"))]
    return ends[0].unionByName(ends[1]).distinct()


def build_adjacency(edges: DataFrame, chunk_size: int = 4096) -> DataFrame:
    """G1: neighbour arrays per node and role, both directions.

    Every node's list is dealt over ``ceil(degree / chunk_size)`` rows by a
    hash of the neighbour id, so no task builds an unbounded array.
    The few hot keys are copied to every salt and edges join on (key, salt):
    the edges of one hot key meet them in ``_SALTS`` tasks, not in one.
    """
    key = ["target_id", "role"]
    ends = directed_edges(edges)
    salts = F.sequence(F.lit(0), F.lit(_SALTS - 1)).cast("array<bigint>")
    hot = (
        ends.groupBy(*key).agg(F.count("*").alias("degree"))
        .where(F.col("degree") > chunk_size)
        .select(*key, F.ceil(F.col("degree") / chunk_size).alias("chunks"),
                F.explode(salts).alias("salt"))
    )
    slot = F.conv(F.substring(F.md5("nbr_id"), 1, 8), 16, 10).cast("long")
    return (
        ends.withColumn("salt", F.pmod(F.xxhash64("nbr_id"), F.lit(_SALTS)))
        .join(hot, [*key, "salt"], "left")
        .withColumn("chunk", F.when(F.col("chunks").isNotNull(), slot % F.col("chunks"))
                    .otherwise(0).cast("long"))
        .groupBy(*key, "chunk")
        .agg(F.sort_array(F.collect_set("nbr_id")).alias("neighbours"))
        .select(F.col("target_id").alias("node_id"), "role", "chunk", "neighbours")
    )


def limit_neighbours(edges: DataFrame, children: int = CHILD_LIMIT,
                     parents: int = PARENT_LIMIT,
                     targets: DataFrame | None = None) -> DataFrame:
    """First neighbours of each target by id, before ids are resolved.

    ``row_number() <= k`` lets Spark drop surplus rows before the shuffle, so
    a symbol called from everywhere sends at most k rows per map task. Groups
    are told apart by a hash first: ids that begin alike compare slowly, and
    sorting all edges is most of the work.
    """
    ends = directed_edges(edges) if targets is None else _edges_of(edges, targets)
    w = W.partitionBy(F.xxhash64("target_id", "role"), "target_id", "role").orderBy("nbr_id")
    cap = F.when(F.col("role") == "child", children).otherwise(parents)
    return (
        ends.withColumn("pos", F.row_number().over(w))
        .where(F.col("pos") <= max(children, parents))
        .where(F.col("pos") <= cap)
    )


def limit_stored_neighbours(nodes: DataFrame, children: int = CHILD_LIMIT,
                            parents: int = PARENT_LIMIT) -> DataFrame:
    """G2 on stored arrays: array order decides which ids use up the slots."""
    def rows(role: str, column: str, limit: int) -> Column:
        ids = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(F.array_distinct(F.slice(ids, 1, limit)), lambda x, i: F.struct(
            F.lit(role).alias("role"), x.alias("nbr_id"), (i + 1).alias("pos")))

    # Both lists of a row at once, so that what makes the nodes runs once.
    lists = F.concat(rows("child", "child_nodes", children), rows("parent", "parent_nodes", parents))
    return nodes.select(F.col("node_id").alias("target_id"), F.inline(lists))


def fill_neighbours(nodes: DataFrame, limited: DataFrame) -> DataFrame:
    """Nodes with child_nodes and parent_nodes from limited neighbours, which bound the arrays."""
    def ids(role: str) -> Column:
        held = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("pos", "nbr_id"))))
        return F.transform(held, lambda x: x.nbr_id)

    lists = limited.groupBy(F.col("target_id").alias("node_id")).agg(
        ids("child").alias("child_nodes"), ids("parent").alias("parent_nodes"))
    empty = F.array().cast("array<string>")
    return nodes.drop("child_nodes", "parent_nodes").join(lists, "node_id", "left").withColumns(
        {n: F.coalesce(n, empty) for n in ("child_nodes", "parent_nodes")})


def count_tokens(nodes: DataFrame, counter: TokenCounter = default_token_count,
                 token_column: str | None = None, texts: DataFrame | None = None,
                 text_id: str = "doc_id") -> DataFrame:
    """(node_id, n_len, n_tok), the only facts packing needs of a node.

    Stored nodes carry both, so their text is only read for another counter.
    Nodes that only name their text, by ``text_id`` of ``texts``, get the
    numbers of texts counted where they are read: no text is shuffled.
    """
    if texts is not None:
        counted = count_tokens(texts.withColumnRenamed(text_id, "node_id"), counter, token_column)
        return nodes.select("node_id", text_id).join(counted.withColumnRenamed("node_id", text_id), text_id).drop(text_id)
    if {"n_len", "n_tok"} <= set(nodes.columns) and counter is default_token_count and not token_column:
        return nodes.select("node_id", "n_len", "n_tok")
    tokens = F.col(token_column) if token_column else counter(F.col("source_code"))
    return nodes.select("node_id", F.length("source_code").cast("long").alias("n_len"),
                        tokens.cast("long").alias("n_tok"))


def unknown_targets(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requested targets that are no stored node."""
    return targets.select("target_id").distinct().join(
        nodes.select(F.col("node_id").alias("target_id")), "target_id", "left_anti")


def require_targets(targets: DataFrame, nodes: DataFrame) -> None:
    """Strict form of :func:`unknown_targets`: raise if there is any."""
    missing = unknown_targets(targets, nodes).take(5)
    if missing:
        raise ValueError(f"unknown target nodes: {[r.target_id for r in missing]}")


def blast_radius(limited: DataFrame, sizes: DataFrame) -> DataFrame:
    """Neighbours of every target that are stored nodes, with sizes.

    Unknown neighbours and unknown targets vanish. The neighbour join comes
    first: only its shuffle can be skewed by a popular callee, and the shuffle
    by target after it leaves Spark free to split that partition. The windows
    that follow reuse the partitioning by target. The sizes, one narrow row a
    node, are what is hashed, so no neighbour rows are sorted for a join.
    """
    nbr = sizes.select(F.col("node_id").alias("nbr_id"), "n_len", "n_tok").hint("shuffle_hash")
    target = sizes.select(F.col("node_id").alias("target_id"), F.col("n_tok").alias("t_tok")).hint("shuffle_hash")
    return (
        limited.select("target_id", "role", "nbr_id")
        .join(nbr, "nbr_id").join(target, "target_id")
        .select("target_id", "role", "nbr_id", "t_tok", "n_len", "n_tok")
    )


def oversize_guard(radius: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Neighbours of targets that fit the budget themselves."""
    return radius.where(F.col("t_tok") <= max_tokens)


def _packed(radius: DataFrame, max_tokens: int) -> DataFrame:
    """Every neighbour with its size rank, base, running sum and kept flag.

    Sums never fall, so a prefix condition equals stopping at the first
    overflow. Both windows are satisfied by one partitioning on target_id and
    one sort, which tells targets apart by a hash first as in G2.
    """
    target = ["_hash", "target_id"]
    by_size = W.partitionBy(*target, "role").orderBy("n_len", "nbr_id")
    running = by_size.rowsBetween(W.unboundedPreceding, W.currentRow)
    fits = F.col("t_tok") <= max_tokens
    kept_child = (F.col("role") == "child") & fits & \
        (F.col("t_tok") + F.col("cum") <= max_tokens)
    child_tokens = F.coalesce(
        F.sum(F.when(kept_child, F.col("n_tok"))).over(W.partitionBy(*target)), F.lit(0))
    kept_parent = (F.col("role") == "parent") & fits & (F.col("base") < max_tokens) & \
        (F.col("base") + F.col("cum") <= max_tokens)
    return (
        radius.withColumn("_hash", F.xxhash64("target_id"))
        .withColumns({"rank": F.row_number().over(by_size), "cum": F.sum("n_tok").over(running)})
        .withColumn("base", F.when(F.col("role") == "child", F.col("t_tok"))
                    .otherwise(F.col("t_tok") + child_tokens))
        .withColumn("kept", kept_child | kept_parent).drop("_hash")
    )


def pack_children(radius: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Smallest children first while target and children fit."""
    children = oversize_guard(radius, max_tokens).where(F.col("role") == "child")
    running = (W.partitionBy("target_id").orderBy("n_len", "nbr_id")
               .rowsBetween(W.unboundedPreceding, W.currentRow))
    return children.withColumn("cum", F.sum("n_tok").over(running)) \
        .where(F.col("t_tok") + F.col("cum") <= max_tokens)


def pack_parents(radius: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Smallest parents first, on top of the target and its kept children."""
    return _packed(radius, max_tokens).where((F.col("role") == "parent") & F.col("kept")) \
        .drop("kept", "rank")


def prune_context(radius: DataFrame, sizes: DataFrame, max_tokens: int = MAX_TOKENS,
                  targets: DataFrame | None = None) -> DataFrame:
    """(target_id, role, rank, node_id, tokens) of everything kept.

    Each stored target has its own row with role ``target`` and rank 0, also
    where it exceeds the budget alone or has no neighbours.
    """
    own = sizes.select(
        F.col("node_id").alias("target_id"), F.lit("target").alias("role"),
        F.lit(0).alias("rank"), "node_id", F.col("n_tok").alias("tokens"))
    if targets is not None:
        own = own.join(targets.select("target_id").distinct(), "target_id", "left_semi")
    kept = _packed(oversize_guard(radius, max_tokens), max_tokens).where("kept").select(
        "target_id", "role", "rank", F.col("nbr_id").alias("node_id"),
        F.col("n_tok").alias("tokens"))
    return own.unionByName(kept)


def prune_stats(radius: DataFrame, sizes: DataFrame,
                max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Per target, neighbours kept and dropped and the tokens used."""
    own = sizes.select(F.col("node_id").alias("target_id"), F.lit("target").alias("role"),
                       F.col("n_tok"), F.lit(True).alias("kept"))
    rows = own.unionByName(
        _packed(radius, max_tokens).select("target_id", "role", "n_tok", "kept"))

    def tally(role: str, kept: bool) -> Column:
        return F.count(F.when((F.col("role") == role) & (F.col("kept") == kept), 1))

    return rows.groupBy("target_id").agg(
        tally("child", True).alias("children_kept"),
        tally("child", False).alias("children_dropped"),
        tally("parent", True).alias("parents_kept"),
        tally("parent", False).alias("parents_dropped"),
        F.sum(F.when(F.col("kept"), F.col("n_tok"))).alias("total_tokens"),
    )


def attach_source(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """Context rows with the text of each kept node, joined after pruning."""
    return context.join(
        nodes.select("node_id", "node_type", "file_path", "symbol_name", "source_code",
                     "language"), "node_id")
