"""From files on disk to the context of a searched symbol."""

from symgrove.plans.end_to_end import context_of_best_hits, ingest_trees, search_stored
from symgrove.plans.storage import read_nodes
from symgrove.sources.tree import files_table


def test_tree_to_context(spark, tmp_path):
    root = tmp_path / "repo" / "src"
    root.mkdir(parents=True)
    (root / "pay.py").write_text("def process_payment():\n    verify_user()\n\ndef verify_user():\n    pass\n")
    (root / "api.go").write_text("func CheckoutRoute() int {\n\treturn 1\n}\n")
    roots = spark.createDataFrame([("r", str(tmp_path / "repo"))], "repo string, root string")
    table = str(tmp_path / "table")
    nodes = ingest_trees(roots, table)
    ids = {r.symbol_name: r.node_id for r in nodes.collect()}
    assert set(ids) == {"process_payment", "verify_user", "CheckoutRoute"}
    queries = spark.createDataFrame([(1, "payment"), (2, "nothing here")], "qid bigint, query string")
    hits = search_stored(spark, table, queries)
    assert [(r.qid, r.symbol_name, r.file_path) for r in hits.collect()] == \
        [(1, "process_payment", "src/pay.py")]
    edges = spark.createDataFrame(
        [(ids["process_payment"], ids["verify_user"]), (ids["CheckoutRoute"], ids["process_payment"]),
         (ids["verify_user"], ids["CheckoutRoute"])], "caller_id string, callee_id string")
    context = context_of_best_hits(hits, read_nodes(spark, table), edges)
    assert {(r.role, r.symbol_name) for r in context.collect()} == {
        ("target", "process_payment"), ("child", "verify_user"), ("parent", "CheckoutRoute")}


def test_stored_files_table(spark, tmp_path):
    rows = spark.createDataFrame([("r", "a.py", bytearray(b"x"))], "repo string, rel_path string, content binary")
    rows.write.parquet(str(tmp_path / "files"))
    assert files_table(spark, str(tmp_path / "files")).columns == ["repo", "rel_path", "content"]


def test_repositories_with_equal_paths_keep_their_ids(spark, tmp_path):
    for repo in "xy":
        (tmp_path / repo / "src").mkdir(parents=True)
        (tmp_path / repo / "src" / "main.py").write_text("def main():\n    pass\n")
    roots = [(repo, str(tmp_path / repo)) for repo in "xy"]
    kind = "repo string, root string"
    together = ingest_trees(spark.createDataFrame(roots, kind), str(tmp_path / "both")).collect()
    for root in roots:
        apart = ingest_trees(spark.createDataFrame([root], kind), str(tmp_path / "one"))
    assert {(r.repo, r.node_id) for r in together} == {(r.repo, r.node_id) for r in apart.collect()}
    assert len({r.node_id for r in together}) == 2 and {r.repo for r in together} == {"x", "y"}


def test_empty_repository_is_an_empty_searchable_table(spark, tmp_path):
    (tmp_path / "nothing").mkdir()
    table = str(tmp_path / "table")
    nodes = ingest_trees(spark.createDataFrame([("r", str(tmp_path / "nothing"))], "repo string, root string"), table)
    assert nodes.count() == 0
    queries = spark.createDataFrame([(1, "payment"), (2, "ab")], "qid bigint, query string")
    assert search_stored(spark, table, queries).count() == 0
