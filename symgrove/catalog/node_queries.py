"""Registered queries R1-R8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from symgrove.catalog import views as v
from symgrove.operators import context as g, nodes as r
from symgrove.plans import storage
from symgrove.session import scratch_path


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    """Search columns with at most 20 child and 10 parent ids per node."""
    lists = g.limit_neighbours(v.edges(spark, sf)).groupBy("target_id").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("nbr_id")))).alias(name)
        for role, name in (("child", "child_nodes"), ("parent", "parent_nodes"))])
    return v.symbols(spark, sf).join(
        lists.withColumnRenamed("target_id", "node_id"), "node_id", "left")


def append_nodes(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "nodes")
    storage.append_nodes(v.nodes(spark, sf), path)
    return storage.read_nodes(spark, path).select(
        "node_id", "node_type", "file_path", "symbol_name", "language",
        F.md5("source_code").alias("source_md5"),
        F.size("child_nodes").cast("long").alias("n_children"))


def adjacency_json(spark: SparkSession, sf: str) -> DataFrame:
    coded = _linked(spark, sf).select(
        "node_id", *[r.encode_list(F.col(n)).alias(f"{n}_json")
                     for n in ("child_nodes", "parent_nodes")])
    back = r.decode_list(F.col("child_nodes_json"))
    return coded.select("*", F.array_join(back, "|").alias("decoded"))


def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    item, order = v.table(spark, sf, "lineitem"), v.table(spark, sf, "orders")
    batch = item.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("node_id"))
    stored = order.select(F.concat_ws(":", "o_orderkey", F.lit("1")).alias("node_id"))
    return r.duplicate_keys(batch, stored)


def _raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return v.table(spark, sf, "part").select(
        F.when(key % 13 != 0, F.concat(F.lit("part:"), key.cast("string"))).alias("node_id"),
        F.when(key % 5 == 0, "module").when(key % 5 == 1, "class")
        .when(key % 5 == 2, "method").alias("node_type"),
        F.lower("p_type").alias("file_path"),
        F.when(key % 7 != 0, F.col("p_name")).alias("symbol_name"),
        F.col("p_brand").alias("source_code"), F.lit("python").alias("language"),
        F.when(key % 3 == 0, F.lit("x")).otherwise(F.col("p_size").cast("string")).alias("size"))


def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    rules = r.RowRules(r.CODE_NODE_RULES.required, r.CODE_NODE_RULES.members, {"size": "int"},
                       r.CODE_NODE_RULES.defaults)
    checked = r.validate_rows(_raw_rows(spark, sf), rules)
    return checked.select("node_id", "node_type", "symbol_name", "size", "source_code",
                          F.array_join("errors", "; ").alias("errors"))


def _agent_states(spark: SparkSession, sf: str) -> DataFrame:
    """Nested run states and evaluator output of every event, some of them faulty."""
    key = F.col("event_id")
    number = key.cast("string")
    text_map = "map<string,string>"

    def one(name: str, value: Column) -> Column:
        return F.create_map(F.lit(name), value)

    sandbox = F.struct(
        F.when(key % 5 == 0, "mesh").when(key % 5 == 1, "bridge").alias("network_mode"),
        F.lit(None).cast("string").alias("memory_limit"), F.when(key % 4 == 0, "half").otherwise("0.5").alias("cpu_quota"),
        F.lit("30").alias("timeout_seconds"), one("K", F.when(key % 6 != 0, number)).alias("environment_vars"))
    env = F.struct(
        one("Authorization", F.when(key % 7 != 0, number)).alias("auth_headers"),
        F.when(key % 2 == 0, one("sid", number)).alias("cookies"), F.create_map().cast(text_map).alias("mock_credentials"),
        F.lit(None).cast(text_map).alias("seeded_entities"), one("db", number).alias("dynamic_endpoints"),
        F.array(F.lit("/tmp/a"), F.when(key % 3 != 0, number)).alias("ephemeral_files"))
    report = F.struct(F.when(key % 8 == 0, "one").otherwise("1").alias("exit_code"), F.lit("").alias("stdout"),
                      F.when(key % 9 != 0, "").alias("stderr"), F.lit(None).cast("string").alias("duration_seconds"),
                      F.lit("false").alias("oom_killed"), F.lit(None).cast("string").alias("timed_out"))
    return v.table(spark, sf, "events").select(
        key, F.when(key % 10 != 0, "baseline").alias("mode"), F.when(key % 11 != 0, sandbox).alias("sandbox_config"),
        F.when(key % 13 != 0, env).alias("env_state"), F.when(key % 3 == 0, report).alias("execution_report"),
        F.lit(None).cast("string").alias("current_test_script"), F.lit(None).cast("string").alias("evaluator_feedback"),
        F.lit("2").alias("retry_count"), F.lit(None).cast("string").alias("max_retries"),
        F.lit(None).cast("string").alias("status"), F.when(key % 12 == 0, "MAYBE").alias("final_verdict"),
        F.when(key % 14 != 0, "SYSTEM_SECURE").alias("verdict"), F.lit(None).cast("string").alias("feedback"),
        *[one("k", F.when(key % 15 != i, number)).alias(f"extracted_{n}")
          for i, n in enumerate(("auth_headers", "cookies", "mock_credentials", "seeded_entities", "dynamic_endpoints"))],
        F.array(F.when(key % 16 != 0, number)).alias("extracted_ephemeral_files"))


def validate_nested(spark: SparkSession, sf: str) -> DataFrame:
    states = r.validate_rows(_agent_states(spark, sf), r.AGENT_STATE_RULES).withColumnRenamed("errors", "state_errors")
    checked = r.validate_rows(states, r.BASELINE_EVALUATION_RULES)
    return checked.select(
        "event_id", F.array_join("state_errors", "; ").alias("state_errors"),
        F.array_join("errors", "; ").alias("output_errors"), "max_retries", "status",
        F.col("sandbox_config.network_mode").alias("network_mode"), F.col("sandbox_config.cpu_quota").alias("cpu_quota"),
        F.size("env_state.cookies").cast("long").alias("n_cookies"),
        F.size("env_state.seeded_entities").cast("long").alias("n_seeded"),
        F.col("execution_report.exit_code").alias("exit_code"), F.col("execution_report.timed_out").alias("timed_out"))


def profile_defaults(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    raw = v.table(spark, sf, "customer").select(
        key.alias("profile_id"), F.when(key % 4 == 0, "bridge").alias("network_mode"),
        F.when(key % 3 == 0, "1g").alias("memory_limit"),
        F.when(key % 2 == 0, F.col("c_acctbal") / 777).alias("cpu_quota"),
        F.when(key % 5 == 0, F.lit(90)).alias("timeout_seconds"),
        F.when(key % 6 == 0, F.create_map(F.lit("K"), F.col("c_name"))).alias("environment_vars"))
    env = F.array_join(F.transform(F.map_entries("environment_vars"),
                                   lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    return r.apply_profile_defaults(raw).withColumn("environment_vars", env).withColumn(
        "cpu_quota", F.round("cpu_quota", 6))


def get_node(spark: SparkSession, sf: str) -> DataFrame:
    return r.get_node(v.nodes(spark, sf), "part:7")


def get_nodes(spark: SparkSession, sf: str) -> DataFrame:
    ids = v.table(spark, sf, "orders").select(
        F.concat(F.lit("part:"), F.col("o_custkey").cast("string")).alias("node_id"))
    return r.get_nodes(v.nodes(spark, sf), ids).select(
        "node_id", "symbol_name", F.length("source_code").cast("long").alias("n_chars"))


def project_node(spark: SparkSession, sf: str) -> DataFrame:
    return r.project_search(v.symbols(spark, sf))


QUERIES = {
    "r_append_nodes": append_nodes,
    "r_adjacency_json": adjacency_json,
    "r_duplicate_keys": duplicate_keys,
    "r_validate_rows": validate_rows,
    "r_validate_nested": validate_nested,
    "r_profile_defaults": profile_defaults,
    "r_get_node": get_node,
    "r_get_nodes": get_nodes,
    "r_project_node": project_node,
}

ORACLES = {
    "r_append_nodes": f"""WITH {v.SQL_V1}
SELECT node_id, node_type, file_path, symbol_name, language, md5(source_code) AS source_md5,
       CAST(0 AS BIGINT) AS n_children FROM nodes""",
    "r_adjacency_json": f"""WITH {v.SQL_V1_RADIUS},
lists AS (
  SELECT target_id AS node_id, list(nbr_id ORDER BY nbr_id) FILTER (role = 'child') AS kids,
         list(nbr_id ORDER BY nbr_id) FILTER (role = 'parent') AS pars FROM lim GROUP BY 1)
SELECT node_id, CAST(to_json(coalesce(kids, [])) AS VARCHAR) AS child_nodes_json,
       CAST(to_json(coalesce(pars, [])) AS VARCHAR) AS parent_nodes_json,
       coalesce(array_to_string(kids, '|'), '') AS decoded
FROM symbols LEFT JOIN lists USING (node_id)""",
    "r_duplicate_keys": """WITH counts AS (
  SELECT l_orderkey||':'||l_linenumber AS node_id, count(*) AS n FROM lineitem GROUP BY 1),
known AS (SELECT DISTINCT o_orderkey||':1' AS node_id, TRUE AS is_stored FROM orders)
SELECT node_id, n, coalesce(is_stored, FALSE) AS is_stored FROM counts LEFT JOIN known USING (node_id)
WHERE n > 1 OR is_stored""",
    "r_validate_rows": """WITH raw AS (
  SELECT CASE WHEN p_partkey % 13 <> 0 THEN 'part:'||p_partkey END AS node_id,
         CASE p_partkey % 5 WHEN 0 THEN 'module' WHEN 1 THEN 'class' WHEN 2 THEN 'method' END AS node_type,
         CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS symbol_name, p_brand AS source_code,
         CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS size FROM part)
SELECT node_id, coalesce(node_type, 'function') AS node_type, symbol_name,
       TRY_CAST(size AS INTEGER) AS size, source_code,
       concat_ws('; ', CASE WHEN node_id IS NULL THEN 'node_id: missing' END,
                 CASE WHEN symbol_name IS NULL THEN 'symbol_name: missing' END,
                 CASE WHEN node_type = 'module' THEN 'node_type: not a member' END,
                 CASE WHEN size = 'x' THEN 'size: not int' END) AS errors
FROM raw""",
    "r_validate_nested": """WITH x AS (
  SELECT event_id AS k, event_id % 11 <> 0 AS box, event_id % 13 <> 0 AS env, event_id % 3 = 0 AS ran FROM events)
SELECT k AS event_id,
  concat_ws('; ', CASE WHEN k % 10 = 0 THEN 'mode: missing' END, CASE WHEN NOT box THEN 'sandbox_config: missing' END,
    CASE WHEN k % 12 = 0 THEN 'final_verdict: not a member' END,
    CASE WHEN box AND k % 5 = 0 THEN 'sandbox_config.network_mode: not a member' END,
    CASE WHEN box AND k % 4 = 0 THEN 'sandbox_config.cpu_quota: not double' END,
    CASE WHEN box AND k % 6 = 0 THEN 'sandbox_config.environment_vars[K]: missing' END,
    CASE WHEN env AND k % 7 = 0 THEN 'env_state.auth_headers[Authorization]: missing' END,
    CASE WHEN env AND k % 3 = 0 THEN 'env_state.ephemeral_files[1]: missing' END,
    CASE WHEN ran AND k % 9 = 0 THEN 'execution_report.stderr: missing' END,
    CASE WHEN ran AND k % 8 = 0 THEN 'execution_report.exit_code: not int' END) AS state_errors,
  concat_ws('; ', CASE WHEN k % 14 = 0 THEN 'verdict: missing' END,
    CASE k % 15 WHEN 0 THEN 'extracted_auth_headers[k]: missing' WHEN 1 THEN 'extracted_cookies[k]: missing'
      WHEN 2 THEN 'extracted_mock_credentials[k]: missing' WHEN 3 THEN 'extracted_seeded_entities[k]: missing'
      WHEN 4 THEN 'extracted_dynamic_endpoints[k]: missing' END,
    CASE WHEN k % 16 = 0 THEN 'extracted_ephemeral_files[0]: missing' END) AS output_errors,
  3 AS max_retries, 'pending' AS status,
  CASE WHEN box THEN CASE k % 5 WHEN 0 THEN 'mesh' WHEN 1 THEN 'bridge' ELSE 'none' END END AS network_mode,
  CASE WHEN box THEN CASE WHEN k % 4 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE END AS cpu_quota,
  CASE WHEN env THEN (k % 2 = 0)::BIGINT END AS n_cookies, CASE WHEN env THEN 0::BIGINT END AS n_seeded,
  CASE WHEN ran AND k % 8 <> 0 THEN 1 END AS exit_code, CASE WHEN ran THEN FALSE END AS timed_out
FROM x""",
    "r_profile_defaults": """SELECT c_custkey AS profile_id,
  CASE WHEN c_custkey % 4 = 0 THEN 'bridge' ELSE 'none' END AS network_mode,
  CASE WHEN c_custkey % 3 = 0 THEN '1g' ELSE '512m' END AS memory_limit,
  round(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal / 777 ELSE 1.0 END, 6) AS cpu_quota,
  CASE WHEN c_custkey % 5 = 0 THEN 90 ELSE 30 END AS timeout_seconds,
  CASE WHEN c_custkey % 6 = 0 THEN 'K='||c_name ELSE '' END AS environment_vars,
  CAST(trunc(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal / 777 * 100000 ELSE 100000 END) AS INTEGER)
    AS cpu_units FROM customer""",
    "r_get_node": f"WITH {v.SQL_V1} SELECT * FROM nodes WHERE node_id = 'part:7'",
    "r_get_nodes": f"""WITH {v.SQL_V1}
SELECT node_id, symbol_name, CAST(length(source_code) AS BIGINT) AS n_chars FROM nodes
WHERE node_id IN (SELECT 'part:'||o_custkey FROM orders)""",
    "r_project_node": f"WITH {v.SQL_V1} SELECT node_id, symbol_name, node_type, file_path FROM symbols",
}
