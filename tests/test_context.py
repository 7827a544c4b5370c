"""Context under a budget, against a plain greedy loop."""

import random

import pytest
from pyspark.sql import functions as F

from symgrove.operators import context as g


def _nodes(spark, rows):
    return spark.createDataFrame(rows, "node_id string, source_code string")


def _edges(spark, rows):
    return spark.createDataFrame(rows, "caller_id string, callee_id string")


def _greedy(nodes, edges, max_tokens):
    """Stop at the first neighbour that does not fit, smallest first."""
    tokens = {n: -(-len(s) // 4) for n, s in nodes.items()}
    kids, pars = {}, {}
    for caller, callee in set(edges):
        kids.setdefault(caller, set()).add(callee)
        pars.setdefault(callee, set()).add(caller)
    kept = set()
    for target in nodes:
        used = tokens[target]
        if used > max_tokens:
            continue
        for role, ids in (("child", sorted(kids.get(target, ()))[:20]),
                          ("parent", sorted(pars.get(target, ()))[:10])):
            if role == "parent" and used >= max_tokens:
                continue
            known = sorted((i for i in ids if i in nodes), key=lambda i: (len(nodes[i]), i))
            for nbr in known:
                if used + tokens[nbr] > max_tokens:
                    break
                used += tokens[nbr]
                kept.add((target, role, nbr))
    return kept


@pytest.mark.parametrize("budget", [10, 60, 200])
def test_prune_equals_greedy_loop(spark, budget):
    rng = random.Random(budget)
    names = [f"n{i}" for i in range(60)]
    nodes = {n: "x" * rng.choice([0, 3, 40, 41, 90, 250]) for n in names}
    edges = [(rng.choice(names), rng.choice([*names, "gone"])) for _ in range(900)]
    edges += [("n1", "n1")] * 3
    node_df, edge_df = _nodes(spark, list(nodes.items())), _edges(spark, edges)
    sizes = g.count_tokens(node_df)
    pruned = g.prune_context(g.blast_radius(g.limit_neighbours(edge_df), sizes), sizes, budget)
    rows = pruned.collect()
    got = {(r.target_id, r.role, r.node_id) for r in rows if r.role != "target"}
    assert got == _greedy(nodes, edges, budget)
    assert len([r for r in rows if r.role == "target"]) == len(nodes)


def test_small_child_packed_before_huge_one(spark):
    nodes = _nodes(spark, [("t", "def t(): pass"), ("huge", "def x():\n    pass\n" * 500),
                           ("tiny", "def tiny(): pass")])
    sizes = g.count_tokens(nodes)
    radius = g.blast_radius(g.limit_neighbours(_edges(spark, [("t", "huge"), ("t", "tiny")])), sizes)
    assert [r.nbr_id for r in g.pack_children(radius, 150).where("target_id = 't'").collect()] == ["tiny"]
    stats = g.prune_stats(radius, sizes, 150).where("target_id = 't'").first()
    assert (stats.children_kept, stats.children_dropped) == (1, 1)


def test_stored_arrays_use_slots_before_resolving(spark):
    nodes = spark.createDataFrame(
        [("a", [f"u{i}" for i in range(19)] + ["b", "c"], ["b"]), ("b", None, []), ("c", [], [])],
        "node_id string, child_nodes array<string>, parent_nodes array<string>")
    limited = g.limit_stored_neighbours(nodes)
    ids = {(r.target_id, r.role, r.nbr_id) for r in limited.collect()}
    assert ("a", "child", "b") in ids and ("a", "child", "c") not in ids
    sizes = g.count_tokens(nodes.selectExpr("node_id", "'x' AS source_code"))
    found = {(r.role, r.nbr_id) for r in g.blast_radius(limited, sizes).collect()}
    assert found == {("child", "b"), ("parent", "b")}


def test_targets_and_unknown_targets(spark):
    nodes = _nodes(spark, [("a", "x"), ("b", "y"), ("c", "z")])
    edges = _edges(spark, [("a", "b"), ("c", "b")])
    targets = spark.createDataFrame([("a",), ("nope",)], "target_id string")
    sizes = g.count_tokens(nodes)
    radius = g.blast_radius(g.limit_neighbours(edges, targets=targets), sizes)
    assert [(r.target_id, r.nbr_id) for r in radius.collect()] == [("a", "b")]
    assert [r.target_id for r in g.unknown_targets(targets, nodes).collect()] == ["nope"]
    with pytest.raises(ValueError, match="nope"):
        g.require_targets(targets, nodes)


def test_hot_callee_is_split_and_whole(spark):
    edges = spark.range(3000).selectExpr("concat('c', id) AS caller_id", "'log' AS callee_id")
    parents = g.build_adjacency(edges, chunk_size=100).where("node_id = 'log'").collect()
    assert len(parents) == 30 and max(len(r.neighbours) for r in parents) < 300
    assert {n for r in parents for n in r.neighbours} == {f"c{i}" for i in range(3000)}
    plan = g.limit_neighbours(edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_token_counter_is_pluggable(spark):
    nodes = spark.createDataFrame([("a", "one two three", 7)], "node_id string, source_code string, n int")
    from pyspark.sql import functions as F
    words = g.count_tokens(nodes, lambda text: F.size(F.split(text, " "))).first()
    assert words.n_tok == 3
    assert g.count_tokens(nodes, token_column="n").first().n_tok == 7


def _plan(found):
    spark = found.sparkSession
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    return plan


def test_stored_arrays_are_made_once(spark):
    edges, nodes = _edges(spark, [("a", "b"), ("c", "b")]), _nodes(spark, [("a", "x"), ("b", "y")])
    limited = g.limit_stored_neighbours(g.fill_neighbours(nodes, g.limit_neighbours(edges)))
    assert sorted(tuple(r) for r in limited.collect()) == [
        ("a", "child", "b", 1), ("b", "parent", "a", 1), ("b", "parent", "c", 2)]
    assert "Union" not in _plan(limited)


def test_neighbours_are_not_sorted_for_joins(spark):
    edges, nodes = _edges(spark, [("a", "b"), ("c", "b")]), _nodes(spark, [("a", "x"), ("b", "y")])
    found = g.blast_radius(g.limit_neighbours(edges), g.count_tokens(nodes))
    assert "SortMergeJoin" not in _plan(found)
    assert sorted((r.target_id, r.nbr_id) for r in found.collect()) == [("a", "b"), ("b", "a")]


def test_texts_are_counted_before_they_meet_nodes(spark):
    symbols = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 3), ("e", 9)], "node_id string, doc_id int")
    texts = spark.createDataFrame([(1, "12345"), (2, ""), (3, None), (4, "x")], "doc_id int, source_code string")
    counted = g.count_tokens(symbols, texts=texts)
    assert counted.columns == ["node_id", "n_len", "n_tok"]
    assert sorted(map(tuple, counted.collect())) == [("a", 5, 2), ("b", 0, 0), ("c", 5, 2), ("d", None, None)]
    own = g.count_tokens(symbols, lambda text: F.length(text) * 3, texts=texts)
    assert {r.node_id: r.n_tok for r in own.collect()} == {"a": 15, "b": 0, "c": 15, "d": None}


def test_stats_shuffle_no_text_and_sort_targets_by_hash(spark):
    from symgrove.catalog import context_queries
    plan = _plan(context_queries.prune_stats(spark, "/root/testdata/sf0.001"))
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan.splitlines()]
    lines = plan.splitlines()
    for at in [i for i, line in enumerate(lines) if "length(" in line]:
        joins = [i for i, line in enumerate(lines[:at]) if "Join" in line and "doc_id" in line]
        assert joins and depth[joins[-1]] < depth[at]       # texts are measured below the join that gives them to nodes
    assert any("length(" in line for line in lines) and "Sort [_hash" in plan
