"""Registered queries G1-G9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from symgrove.catalog import views as v
from symgrove.functions.text import size_columns
from symgrove.operators import context as g


def _limited(spark: SparkSession, sf: str) -> DataFrame:
    return g.limit_neighbours(v.edges(spark, sf))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return g.count_tokens(v.symbols(spark, sf), texts=v.texts(spark, sf))


def _radius(spark: SparkSession, sf: str) -> DataFrame:
    return g.blast_radius(_limited(spark, sf), _sizes(spark, sf))


def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return g.build_adjacency(v.edges(spark, sf)).select(
        "node_id", "role", "chunk", F.size("neighbours").cast("long").alias("n"),
        F.array_join("neighbours", ",").alias("neighbours"))


def limit_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _limited(spark, sf)


def blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    return _radius(spark, sf).select("target_id", "role", "nbr_id")


def count_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(spark, sf)


def oversize_guard(spark: SparkSession, sf: str) -> DataFrame:
    return g.oversize_guard(_radius(spark, sf), v.BUDGET).select("target_id", "role", "nbr_id")


def pack_children(spark: SparkSession, sf: str) -> DataFrame:
    return g.pack_children(_radius(spark, sf), v.BUDGET).select(
        "target_id", "nbr_id", "n_tok", "cum")


def pack_parents(spark: SparkSession, sf: str) -> DataFrame:
    return g.pack_parents(_radius(spark, sf), v.BUDGET).select(
        "target_id", "nbr_id", "base", "n_tok", "cum")


def prune_stats(spark: SparkSession, sf: str) -> DataFrame:
    return g.prune_stats(_radius(spark, sf), _sizes(spark, sf), v.BUDGET)


def prune_context(spark: SparkSession, sf: str) -> DataFrame:
    return g.prune_context(_radius(spark, sf), _sizes(spark, sf), v.BUDGET)


def limit_stored(spark: SparkSession, sf: str) -> DataFrame:
    """G2 on arrays filled from the edges with room to spare."""
    wide = g.limit_neighbours(v.edges(spark, sf), children=40, parents=40)
    return g.limit_stored_neighbours(g.fill_neighbours(v.symbols(spark, sf), wide))


def prune_context_targets(spark: SparkSession, sf: str) -> DataFrame:
    """G9 for some targets: every supplier's symbol."""
    nodes = v.nodes(spark, sf).withColumns(size_columns())
    targets = v.symbols(spark, sf).where("node_id LIKE 'supp:%'").select(F.col("node_id").alias("target_id"))
    sizes = g.count_tokens(nodes)
    radius = g.blast_radius(g.limit_neighbours(v.edges(spark, sf), targets=targets), sizes)
    return g.prune_context(radius, sizes, v.BUDGET, targets)


QUERIES = {
    "g_adjacency": adjacency,
    "g_limit_neighbours": limit_neighbours,
    "g_blast_radius": blast_radius,
    "g_count_tokens": count_tokens,
    "g_oversize_guard": oversize_guard,
    "g_pack_children": pack_children,
    "g_pack_parents": pack_parents,
    "g_prune_stats": prune_stats,
    "g_prune_context": prune_context,
    "g_limit_stored": limit_stored,
    "g_prune_context_targets": prune_context_targets,
}

ORACLES = {
    "g_adjacency": f"""WITH {v.SQL_V1},
both_ends AS (
  SELECT caller_id AS node_id, 'child' AS role, callee_id AS nbr_id FROM edges
  UNION ALL SELECT callee_id, 'parent', caller_id FROM edges),
deg AS (SELECT node_id, role, count(*) AS d FROM both_ends GROUP BY ALL),
slotted AS (
  SELECT node_id, role, nbr_id,
         CASE WHEN d > 4096 THEN CAST('0x'||substr(md5(nbr_id),1,8) AS BIGINT) % CAST(ceil(d/4096.0) AS BIGINT)
              ELSE 0 END AS chunk
  FROM both_ends JOIN deg USING (node_id, role))
SELECT node_id, role, chunk, count(*) AS n, string_agg(nbr_id, ',' ORDER BY nbr_id) AS neighbours
FROM slotted GROUP BY node_id, role, chunk""",
    "g_limit_neighbours": f"""WITH {v.SQL_V1_RADIUS}
SELECT target_id, role, nbr_id, CAST(pos AS INT) AS pos FROM lim""",
    "g_blast_radius": f"WITH {v.SQL_V1_RADIUS} SELECT target_id, role, nbr_id FROM radius",
    "g_count_tokens": f"WITH {v.SQL_V1_RADIUS} SELECT node_id, n_len, n_tok FROM sizes",
    "g_oversize_guard": f"""WITH {v.SQL_V1_RADIUS}
SELECT target_id, role, nbr_id FROM radius WHERE t_tok <= 2500""",
    "g_pack_children": f"""WITH {v.SQL_V1_PACK}
SELECT target_id, nbr_id, n_tok, CAST(cum AS BIGINT) AS cum FROM kids""",
    "g_pack_parents": f"""WITH {v.SQL_V1_PACK}
SELECT target_id, nbr_id, CAST(base AS BIGINT) AS base, n_tok, CAST(cum AS BIGINT) AS cum FROM pars""",
    "g_prune_stats": f"""WITH {v.SQL_V1_PACK},
kept AS (SELECT target_id, role, nbr_id, n_tok FROM kids
         UNION ALL SELECT target_id, role, nbr_id, n_tok FROM pars),
k AS (SELECT target_id, count(*) FILTER (role = 'child') AS kc, count(*) FILTER (role = 'parent') AS kp,
             sum(n_tok) AS tok FROM kept GROUP BY 1),
a AS (SELECT target_id, count(*) FILTER (role = 'child') AS ac, count(*) FILTER (role = 'parent') AS ap
      FROM radius GROUP BY 1)
SELECT s.node_id AS target_id, coalesce(kc, 0) AS children_kept,
       coalesce(ac, 0) - coalesce(kc, 0) AS children_dropped, coalesce(kp, 0) AS parents_kept,
       coalesce(ap, 0) - coalesce(kp, 0) AS parents_dropped,
       CAST(s.n_tok + coalesce(tok, 0) AS BIGINT) AS total_tokens
FROM sizes s LEFT JOIN k ON k.target_id = s.node_id LEFT JOIN a ON a.target_id = s.node_id""",
    "g_prune_context": f"""WITH {v.SQL_V1_PACK}
SELECT node_id AS target_id, 'target' AS role, 0 AS rank, node_id, n_tok AS tokens FROM sizes
UNION ALL SELECT target_id, role, rank, nbr_id, n_tok FROM kids
UNION ALL SELECT target_id, role, rank, nbr_id, n_tok FROM pars""",
    "g_limit_stored": f"""WITH {v.SQL_V1_RADIUS}
SELECT target_id, role, nbr_id, CAST(pos AS INT) AS pos FROM lim WHERE target_id IN (SELECT node_id FROM symbols)""",
    "g_prune_context_targets": f"""WITH {v.SQL_V1_PACK},
x AS (SELECT node_id AS target_id, 'target' AS role, 0 AS rank, node_id, n_tok AS tokens FROM sizes
UNION ALL SELECT target_id, role, rank, nbr_id, n_tok FROM kids
UNION ALL SELECT target_id, role, rank, nbr_id, n_tok FROM pars)
SELECT * FROM x WHERE starts_with(target_id, 'supp:')""",
}
