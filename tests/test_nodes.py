"""Node storage, validation and lookups."""

import json

import pytest
from pyspark.sql import functions as F

from symgrove.operators import nodes as r
from symgrove.plans import manifest as m, storage as st

GRAPH = [
    ("target_1", "function", "src/main.py", "process_payment", "def process_payment(): ...",
     ["child_1"], ["parent_1"], "python"),
    ("child_1", "function", "src/auth.py", "verify_user", "def verify_user(): ...", None, None, "python"),
    ("parent_1", "method", "src/api.py", "checkout_route", "def checkout_route(): ...", [], [], "go"),
]
SCHEMA = r.CODE_NODES


def test_round_trip_and_defaults(spark, tmp_path):
    path = str(tmp_path / "table")
    assert st.append_nodes(spark.createDataFrame(GRAPH, SCHEMA), path)
    stored = st.read_nodes(spark, path)
    row = r.get_node(stored, "target_1").first()
    assert (row.child_nodes, row.parent_nodes, row.language) == (["child_1"], ["parent_1"], "python")
    assert r.get_node(stored, "child_1").first().child_nodes == []
    assert r.get_node(stored, "zzz").isEmpty() and r.get_node(stored, "").isEmpty()
    assert not st.append_nodes(spark.createDataFrame([], SCHEMA), path)
    assert stored.columns == r.STORED_COLUMNS


def test_1500_ids(spark):
    nodes = spark.range(1500).selectExpr("concat('node_', id) AS node_id", "'x' AS source_code")
    ids = spark.range(1500).selectExpr("concat('node_', id) AS node_id")
    ids = ids.union(ids).union(spark.createDataFrame([("gone",)], "node_id string"))
    assert r.get_nodes(nodes, ids).count() == 1500


def test_duplicate_stores_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    nodes = spark.createDataFrame(GRAPH, SCHEMA)
    st.append_nodes(nodes.where("node_id = 'child_1'"), path, "0")
    with pytest.raises(ValueError, match="child_1"):
        st.append_nodes(nodes, path, "1")
    assert st.read_nodes(spark, path).count() == 1
    with pytest.raises(ValueError):
        st.append_nodes(nodes.union(nodes), str(tmp_path / "other"))


def test_replayed_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "table")
    nodes = spark.createDataFrame(GRAPH, SCHEMA)
    for _ in range(2):
        st.append_nodes(nodes, path, "7")
    assert st.read_nodes(spark, path).count() == 3


def _node(i, language="python", name=None):
    return (f"n{i}", "function", f"src/f{i}.py", name or f"name_{i}", f"text {i}", None, None, language)


def test_writers_with_equal_batch_ids_do_not_meet(spark, tmp_path):
    path = str(tmp_path / "table")
    for writer in ("a", "b"):
        rows = [_node(f"{writer}{i}") for i in range(3)]
        assert st.append_nodes(spark.createDataFrame(rows, SCHEMA), path, "0", writer)
    assert st.read_nodes(spark, path).count() == 6
    again = spark.createDataFrame([_node("a0"), _node("a9")], SCHEMA)
    st.append_nodes(again, path, "0", "a")                      # a replay replaces its own batch alone
    assert {x.node_id for x in st.read_nodes(spark, path).collect()} == {"na0", "na9", "nb0", "nb1", "nb2"}
    with pytest.raises(ValueError, match="nb1"):
        st.append_nodes(spark.createDataFrame([_node("b1")], SCHEMA), path, "1", "a")
    assert st.read_nodes(spark, path).count() == 5


def test_a_batch_without_commit_is_not_read(spark, tmp_path):
    path = str(tmp_path / "table")
    st.append_nodes(spark.createDataFrame([_node(1)], SCHEMA), path, "0")
    r.with_list_defaults(spark.createDataFrame([_node(2)], SCHEMA), r.STORED_COLUMNS).write.partitionBy("language") \
        .parquet(f"{path}/nodes/folder=lost")
    nodes, index = st.read_table(spark, path)
    assert nodes.count() == 1 and index.postings.select("node_id").distinct().count() == 1
    assert m.vacuum(spark, path, st.PARTS) == 1 and nodes.count() == 1


def test_compaction_keeps_rows_keys_and_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "KEYS_PER_BUCKET", 2)
    path = str(tmp_path / "table")
    for i in range(5):
        st.append_nodes(spark.createDataFrame([_node(10 * i + j, "go" if j else "python") for j in range(4)], SCHEMA),
                        path, str(i), "w")
    before = sorted(x.node_id for x in st.read_nodes(spark, path).collect())
    old = m.Manifest(spark, path)
    assert len(old.live) == 5 and st.compact(spark, path)
    table = m.Manifest(spark, path)
    assert len(table.live) == 2 and not st.compact(spark, path)   # the writer's last batch may be tried again
    nodes, index = st.read_table(spark, path)
    assert sorted(x.node_id for x in nodes.collect()) == before
    assert index.postings.count() == sum(len(set(zip(n, n[1:], n[2:]))) for n in (f"name_{b[1:]}" for b in before))
    assert index.stats.first().n_docs == 20
    st.append_nodes(spark.createDataFrame([_node(0), _node(99)], SCHEMA), path, "0", "w")     # settled: left alone
    st.append_nodes(spark.createDataFrame([_node(77)], SCHEMA), path, "4", "w")                # the last one: replaced
    assert sorted(x.node_id for x in st.read_nodes(spark, path).collect()) == sorted(
        [b for b in before if not b.startswith("n4")] + ["n77"])
    with pytest.raises(ValueError, match="n30"):
        st.append_nodes(spark.createDataFrame([_node(30)], SCHEMA), path, "9", "w")
    assert m.vacuum(spark, path, st.PARTS) > 0
    table = m.Manifest(spark, path)
    assert len(table.live) == 2 and not table.outdated and st.read_nodes(spark, path).count() == 17
    st.append_nodes(spark.createDataFrame([_node(500 + i) for i in range(9)], SCHEMA), path, "5", "w")
    assert st.compact(spark, path) and st.read_nodes(spark, path).count() == 26


def test_of_two_compactions_of_the_same_batches_one_counts(spark, tmp_path):
    path = str(tmp_path / "table")
    for i in range(3):
        st.append_nodes(spark.createDataFrame([_node(i)], SCHEMA), path, str(i), "w")
    assert st.compact(spark, path)
    first = next(c for c in m.Manifest(spark, path).live if c.writer == m.COMPACTION)
    m.Manifest(spark, path).publish(m.COMPACTION, "late", "late", dict(first.facts), first.replaced)
    assert [c.folder for c in m.Manifest(spark, path).live if c.writer == m.COMPACTION] == [first.folder]
    assert st.read_nodes(spark, path).count() == 3


def test_key_check_reads_only_buckets_of_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "KEYS_PER_BUCKET", 4)
    path = str(tmp_path / "table")
    st.append_nodes(spark.createDataFrame([_node(i) for i in range(200)], SCHEMA), path, "0")
    batch = spark.createDataFrame([_node(7)], SCHEMA)
    keys = st.stored_keys(batch, path, m.Manifest(spark, path).live)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(bucket), EqualTo(bucket" in plan or "PushedFilters: [In(bucket" in plan
    got = [x.node_id for x in keys.collect()]
    assert "n7" in got and len(got) <= 20 and len(got) == len(set(got))


def test_language_filter_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "table")
    st.append_nodes(spark.createDataFrame(GRAPH, SCHEMA), path)
    go = st.read_nodes(spark, path).where("language = 'go'")
    plan = go._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(language" in plan
    assert go.count() == 1


def test_search_projection_leaves_source_unread(spark, tmp_path):
    path = str(tmp_path / "table")
    st.append_nodes(spark.createDataFrame(GRAPH, SCHEMA), path)
    plan = r.project_search(st.read_nodes(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "source_code" not in plan.split("ReadSchema")[1]


def test_json_lists_round_trip(spark):
    values = [["a", "b"], [], ['q"x', "é", "line\n"]]
    rows = spark.createDataFrame([(v,) for v in values], "v array<string>") \
        .select("v", r.encode_list(F.col("v")).alias("j")) \
        .select("v", "j", r.decode_list(F.col("j")).alias("back")).collect()
    assert all(row.v == row.back == json.loads(row.j) for row in rows)


def test_validation_of_every_kind(spark):
    good = ("n", None, "p", "s", "code", "python")
    bad = ("n", "module", None, "s", "code", "python")
    nodes = spark.createDataFrame(
        [good, bad], "node_id string, node_type string, file_path string, symbol_name string, "
        "source_code string, language string")
    checked = r.validate_rows(nodes, r.CODE_NODE_RULES)
    valid, quarantined = r.split_valid(checked)
    assert valid.first().node_type == "function"
    assert sorted(quarantined.first().errors) == ["file_path: missing", "node_type: not a member"]
    with pytest.raises(ValueError):
        r.assert_valid(checked)
    reports = spark.createDataFrame(
        [("0", "", "", "1.5", None, "true"), ("x", "", "", None, "maybe", None)],
        "exit_code string, stdout string, stderr string, duration_seconds string, "
        "oom_killed string, timed_out string")
    first, second = r.validate_rows(reports, r.REPORT_RULES).collect()
    assert (first.exit_code, first.duration_seconds, first.oom_killed, first.timed_out) == (0, 1.5, False, True)
    assert second.errors == ["exit_code: not int", "oom_killed: not boolean"]
    state = spark.createDataFrame(
        [("baseline", None, None, None, None, None, None), ("x", None, None, "9", None, "done", "MAYBE")],
        "mode string, current_test_script string, evaluator_feedback string, retry_count string, "
        "max_retries string, status string, final_verdict string")
    first, second = r.validate_rows(state, r.STATE_RULES).collect()
    assert (first.retry_count, first.max_retries, first.status) == (0, 3, "pending")
    assert len(second.errors) == 3 and second.retry_count == 9


def test_profile_defaults(spark):
    profile = spark.createDataFrame(
        [(None, None, None, None, None, None), ("bridge", "128m", 0.299, 3, {"A": "b"}, "img")],
        "network_mode string, memory_limit string, cpu_quota double, timeout_seconds int, "
        "environment_vars map<string,string>, custom_image string")
    first, second = r.apply_profile_defaults(profile).collect()
    assert (first.network_mode, first.memory_limit, first.cpu_quota, first.timeout_seconds) == \
        ("none", "512m", 1.0, 30)
    assert first.environment_vars == {} and first.cpu_units == 100000
    assert second.cpu_units == int(0.299 * 100000)


def test_a_fraction_is_no_integer(spark):
    rows = spark.createDataFrame([(2.7, "a"), (3.0, "a"), (None, "a")], "retry_count double, mode string")
    rules = r.RowRules(types={"retry_count": "int"}, defaults={"retry_count": 0})
    got = r.validate_rows(rows, rules).collect()
    assert [list(x.errors) for x in got] == [["retry_count: not int"], [], []]
    assert [x.retry_count for x in got[1:]] == [3, 0]


def test_nested_rules_name_the_path(spark):
    rows = spark.createDataFrame(
        [("baseline", None, None, None), ("x", ("bridge", "512m", "two", None, {"A": None, "B": "b"}),
          ({"H": None}, {}, None, {"k": "v"}, None, ["/tmp/a", None, None]), ("1", "", None, "1.5", None, "maybe"))],
        "mode string, sandbox_config struct<network_mode:string,memory_limit:string,cpu_quota:string,timeout_seconds:string,"
        "environment_vars:map<string,string>>, env_state struct<auth_headers:map<string,string>,cookies:map<string,string>,"
        "mock_credentials:map<string,string>,seeded_entities:map<string,string>,dynamic_endpoints:map<string,string>,"
        "ephemeral_files:array<string>>, execution_report struct<exit_code:string,stdout:string,stderr:string,"
        "duration_seconds:string,oom_killed:string,timed_out:string>").withColumns(
        {n: F.lit(None).cast("string") for n in ("current_test_script", "evaluator_feedback", "retry_count", "max_retries",
                                                 "status", "final_verdict")})
    first, second = r.validate_rows(rows, r.AGENT_STATE_RULES).collect()
    assert first.errors == ["sandbox_config: missing"] and first.env_state is None and first.execution_report is None
    assert set(second.errors) == {
        "mode: not a member", "sandbox_config.cpu_quota: not double", "sandbox_config.environment_vars[A]: missing",
        "env_state.auth_headers[H]: missing", "env_state.ephemeral_files[1]: missing", "env_state.ephemeral_files[2]: missing",
        "execution_report.stderr: missing", "execution_report.timed_out: not boolean"}
    assert second.sandbox_config.timeout_seconds == 30 and second.sandbox_config.cpu_quota == 1.0
    assert second.env_state.mock_credentials == {} and second.env_state.dynamic_endpoints == {}
    assert second.execution_report.duration_seconds == 1.5 and second.execution_report.oom_killed is False
    outputs = spark.createDataFrame([(None,), ("code",)], "test_script string")
    assert [x.errors for x in r.validate_rows(outputs, r.CODER_RULES).collect()] == [["test_script: missing"], []]
