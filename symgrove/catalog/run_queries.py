"""Registered queries L1-L7 and L9-L13 (L8 is in stream_queries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from symgrove import constants as c
from symgrove.catalog import views as v
from symgrove.operators import runs as r


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    return r.number_attempts(v.run_log(spark, sf))


def classify_execution(spark: SparkSession, sf: str) -> DataFrame:
    return r.classify_execution(v.telemetry(spark, sf)).select(
        "event_id", "exit_code", "timed_out", "oom_killed", "duration_seconds", "run_class", "stdout", "stderr")


def clean_log_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF41")))
    return v.table(spark, sf, "documents").select(
        "doc_id", r.clean_log_text(raw).alias("text"),
        r.round_seconds(F.col("n_chars") / 7).alias("seconds"))


def retry_counter(spark: SparkSession, sf: str) -> DataFrame:
    return attempts(spark, sf).select("run_id", "event_id", "attempt")


def retry_counter_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts of a log in which some run ids and some times are unknown."""
    log = v.run_log(spark, sf)
    unknown = log.withColumns({
        "run_id": F.when(F.col("event_id") % 5 != 0, F.col("run_id")),
        "ts": F.when(F.col("event_id") % 7 != 0, F.col("ts"))})
    return r.number_attempts(unknown).select("run_id", "event_id", "attempt")


def derive_status(spark: SparkSession, sf: str) -> DataFrame:
    return attempts(spark, sf).select("event_id", r.derive_status().alias("status"))


def route_start(spark: SparkSession, sf: str) -> DataFrame:
    return v.run_log(spark, sf).select("event_id", r.route_start().alias("first_step"))


def route_next(spark: SparkSession, sf: str) -> DataFrame:
    return attempts(spark, sf).select("event_id", r.route_next().alias("next_step"))


def fold_run(spark: SparkSession, sf: str) -> DataFrame:
    return r.fold_runs(attempts(spark, sf))


def merge_env(spark: SparkSession, sf: str) -> DataFrame:
    return r.merge_env_log(attempts(spark, sf))


def _entries(name: str) -> Column:
    return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(
        e.key, F.lit("="), e.value)), ",")


def _states(spark: SparkSession, sf: str) -> DataFrame:
    """A current state per event next to what the event extracted."""
    held = F.col("event_id") % 2 == 0
    return v.run_log(spark, sf).withColumns({
        "auth_headers": F.when(held, F.create_map(
            F.lit("Authorization"), F.lit("old"), F.lit("X"), F.lit("kept"))),
        "cookies": F.when(held, F.create_map(F.lit("sid"), F.lit(""))),
        "mock_credentials": F.when(held, F.create_map(F.lit("u0"), F.lit("quote\" é\n"))),
        "seeded_entities": F.create_map(F.lit("run"), F.col("run_id").cast("string")),
        "dynamic_endpoints": F.when(~held, F.create_map(F.lit("db"), F.lit("db:1"))),
        "ephemeral_files": F.when(held, F.array(F.lit("/tmp/old")))})


def merge_env_step(spark: SparkSession, sf: str) -> DataFrame:
    return r.merge_env_row(_states(spark, sf)).select(
        "event_id", *[_entries(n).alias(n) for n in c.SECRET_MAPS + c.CLEAR_MAPS],
        F.array_join(c.FILE_LIST, ",").alias(c.FILE_LIST))


def mask_secrets(spark: SparkSession, sf: str) -> DataFrame:
    masked = r.mask_secrets(v.run_log(spark, sf), "extracted_")
    return masked.select("event_id", *[_entries(f"extracted_{n}").alias(n)
                                       for n in c.SECRET_MAPS + c.CLEAR_MAPS])


def expose_env(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf).select("event_id", r.expose_env_json(reveal=True).alias("env_state"))


def _prompt_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each numbered attempt with the node that its run works on."""
    number = F.col("event_id").cast("string")
    last = F.array_join(F.array(F.lit("test {feedback}"), number), " ")
    rows = attempts(spark, sf).select(
        F.concat(F.lit("part:"), F.col("run_id").cast("string")).alias("node_id"),
        "event_id", "mode", (F.col("attempt") - 1).alias("retry_count"),
        last.alias("current_test_script"), F.col("feedback").alias("evaluator_feedback"),
        F.lit("{}").alias("env_state"), (F.col("event_id") % 3).cast("int").alias("exit_code"),
        F.lit("out").alias("stdout"), F.col("verdict").alias("stderr"))
    return rows.join(v.nodes(spark, sf).select("node_id", "symbol_name", "file_path", "language", "source_code"), "node_id")


def render_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _prompt_rows(spark, sf).select(
        "event_id", F.md5(r.coder_prompt()).alias("coder_md5"), F.md5(r.evaluator_prompt()).alias("evaluator_md5"))


def output_schema(spark: SparkSession, sf: str) -> DataFrame:
    return r.select_output(v.run_log(spark, sf)).select(
        "event_id", "verdict", "feedback",
        *[_entries(f"extracted_{n}").alias(n) for n in c.SECRET_MAPS + c.CLEAR_MAPS],
        F.array_join(f"extracted_{c.FILE_LIST}", ",").alias(c.FILE_LIST))


QUERIES = {
    "l_classify_execution": classify_execution,
    "l_clean_log_text": clean_log_text,
    "l_retry_counter": retry_counter,
    "l_retry_counter_nulls": retry_counter_nulls,
    "l_derive_status": derive_status,
    "l_route_start": route_start,
    "l_route_next": route_next,
    "l_fold_run": fold_run,
    "l_merge_env": merge_env,
    "l_merge_env_step": merge_env_step,
    "l_mask_secrets": mask_secrets,
    "l_expose_env": expose_env,
    "l_render_prompt": render_prompt,
    "l_output_schema": output_schema,
}

FOLD_SQL = f"WITH {v.SQL_V4} SELECT run_id, end_attempt, verdict, status FROM folded"

ORACLES = {
    "l_classify_execution": f"""WITH {v.SQL_V4},
x AS (SELECT *, disconnected AND elapsed >= 29 AS late FROM telemetry),
y AS (SELECT *, api_error OR (disconnected AND NOT late) AS host FROM x)
SELECT event_id,
  CASE WHEN host THEN -1 WHEN late THEN 137 ELSE coalesce(status_code, 1) END AS exit_code,
  late AND NOT host AS timed_out, oom AND NOT host AS oom_killed,
  CASE WHEN host THEN 0.0::DOUBLE ELSE round_even(elapsed, 2) END AS duration_seconds,
  CASE WHEN host THEN 'host_error' WHEN oom THEN 'oom' WHEN late THEN 'timeout'
       WHEN status_code = 0 THEN 'clean' ELSE 'failed' END AS run_class,
  CASE WHEN host THEN '' ELSE coalesce(stdout, '') END AS stdout,
  CASE WHEN host THEN 'no result from the host: lost '||event_id ELSE coalesce(stderr, '') END AS stderr
FROM y""",
    "l_clean_log_text": """SELECT doc_id, text||chr(65533)||'A' AS text,
  round_even(n_chars / 7, 2) AS seconds FROM documents""",
    "l_retry_counter": f"WITH {v.SQL_V4} SELECT run_id, event_id, attempt FROM attempts",
    "l_retry_counter_nulls": """WITH log AS (
  SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN user_id END AS run_id,
         CASE WHEN event_id % 7 <> 0 THEN ts END AS ts FROM events)
SELECT run_id, event_id, CAST(row_number() OVER (
  PARTITION BY run_id ORDER BY ts NULLS FIRST, event_id) AS INT) AS attempt FROM log""",
    "l_derive_status": f"WITH {v.SQL_V4} SELECT event_id, status FROM judged",
    "l_route_start": """SELECT event_id,
  CASE WHEN user_id % 2 = 0 THEN 'baseline_coder' ELSE 'adversary_coder' END AS first_step FROM events""",
    "l_route_next": f"WITH {v.SQL_V4} SELECT event_id, next_step FROM judged",
    "l_fold_run": FOLD_SQL,
    "l_merge_env": f"""WITH {v.SQL_V4},
live AS (SELECT * FROM attempts WHERE mode = 'baseline' AND verdict = 'SYSTEM_SECURE'),
entries AS (
  SELECT run_id, attempt, 'auth_headers' AS field, 'Authorization' AS key, 'Bearer '||event_id AS value FROM live
  UNION ALL SELECT run_id, attempt, 'cookies', 'sid', sid FROM live
  UNION ALL SELECT run_id, attempt, 'mock_credentials', 'u'||(event_id % 3), event_id::VARCHAR FROM live
  UNION ALL SELECT run_id, attempt, 'seeded_entities', 'k', k FROM live
  UNION ALL SELECT run_id, attempt, 'dynamic_endpoints', 'db', 'localhost:'||event_id FROM live)
SELECT run_id, field, key, arg_max(value, attempt) AS value, max(attempt) AS attempt, 0 AS pos
FROM entries GROUP BY run_id, field, key
UNION ALL SELECT run_id, 'ephemeral_files', NULL, '/tmp/'||event_id, attempt, 0 FROM live
UNION ALL SELECT run_id, 'ephemeral_files', NULL, '/tmp/shared', attempt, 1 FROM live""",
    "l_merge_env_step": f"""WITH {v.SQL_V4},
x AS (SELECT *, mode = 'baseline' AND verdict = 'SYSTEM_SECURE' AS m, event_id % 2 = 0 AS h FROM attempts)
SELECT event_id,
  CASE WHEN m AND h THEN 'Authorization=Bearer '||event_id||',X=kept' WHEN m THEN 'Authorization=Bearer '||event_id
       WHEN h THEN 'Authorization=old,X=kept' ELSE '' END AS auth_headers,
  CASE WHEN m THEN 'sid='||sid WHEN h THEN 'sid=' ELSE '' END AS cookies,
  CASE WHEN m AND h AND event_id % 3 <> 0 THEN 'u0=quote" é'||chr(10)||',u'||(event_id % 3)||'='||event_id
       WHEN m THEN 'u'||(event_id % 3)||'='||event_id
       WHEN h THEN 'u0=quote" é'||chr(10) ELSE '' END AS mock_credentials,
  'run='||run_id||CASE WHEN m THEN ',k='||k ELSE '' END AS seeded_entities,
  CASE WHEN m THEN 'db=localhost:'||event_id WHEN h THEN '' ELSE 'db=db:1' END AS dynamic_endpoints,
  concat_ws(',', CASE WHEN h THEN '/tmp/old' END, CASE WHEN m THEN '/tmp/'||event_id||',/tmp/shared' END)
    AS ephemeral_files
FROM x""",
    "l_mask_secrets": f"""WITH {v.SQL_V4}
SELECT event_id, 'Authorization=**********' AS auth_headers,
  'sid='||CASE WHEN sid = '' THEN '' ELSE '**********' END AS cookies,
  'u'||(event_id % 3)||'=**********' AS mock_credentials, 'k='||k AS seeded_entities,
  'db=localhost:'||event_id AS dynamic_endpoints FROM attempts""",
    "l_expose_env": """WITH x AS (SELECT *, event_id % 2 = 0 AS h, chr(10) AS n FROM events)
SELECT event_id, '{'||n||'  "auth_headers": '||
  CASE WHEN h THEN '{'||n||'    "Authorization": "old",'||n||'    "X": "kept"'||n||'  }' ELSE '{}' END||','||n||
  '  "cookies": '||CASE WHEN h THEN '{'||n||'    "sid": ""'||n||'  }' ELSE '{}' END||','||n||
  '  "mock_credentials": '||CASE WHEN h THEN '{'||n||'    "u0": "quote\\" \\u00e9\\n"'||n||'  }' ELSE '{}' END||','||n||
  '  "seeded_entities": {'||n||'    "run": "'||user_id||'"'||n||'  },'||n||
  '  "dynamic_endpoints": '||CASE WHEN h THEN '{}' ELSE '{'||n||'    "db": "db:1"'||n||'  }' END||','||n||
  '  "ephemeral_files": '||CASE WHEN h THEN '['||n||'    "/tmp/old"'||n||'  ]' ELSE '[]' END||n||'}' AS env_state
FROM x""",
    "l_render_prompt": f"""WITH {v.SQL_V1}, {v.SQL_V4},
x AS (SELECT a.*, n.*, chr(10) AS nl, attempt > 1 AS again, mode = 'baseline' AS b, 'test {{feedback}} '||event_id AS script
      FROM attempts a JOIN nodes n ON n.node_id = 'part:'||a.run_id),
texts AS (
SELECT event_id,
  CASE WHEN b THEN 'Write tests of the normal behaviour of ' ELSE 'Write tests that try to break ' END
  ||symbol_name||' ('||language||', '||file_path||').'||nl||'Source:'||nl||source_code||nl||
  CASE WHEN b THEN '' ELSE 'Environment:'||nl||'{{}}'||nl END||'Last test:'||nl||
  CASE WHEN again THEN script ELSE '(nothing was tried yet)' END||nl||'Feedback:'||nl||
  CASE WHEN again THEN feedback WHEN b THEN '(nothing was tried yet)' ELSE '(no attack was tried yet)' END||nl AS coder,
  CASE WHEN b THEN 'Judge a run of normal-behaviour tests.' ELSE 'Judge a run of adversarial tests.' END
  ||nl||'Source:'||nl||source_code||nl||'Test:'||nl||script||nl||'Exit code: '||(event_id % 3)||nl||'Output:'||nl||
  'out'||nl||'Errors:'||nl||verdict||nl AS evaluator
FROM x)
SELECT event_id, md5(coder) AS coder_md5, md5(evaluator) AS evaluator_md5 FROM texts""",
    "l_output_schema": f"""WITH {v.SQL_V4}, x AS (SELECT *, mode = 'baseline' AS b FROM attempts)
SELECT event_id, verdict, feedback,
  CASE WHEN b THEN 'Authorization=Bearer '||event_id ELSE '' END AS auth_headers,
  CASE WHEN b THEN 'sid='||sid ELSE '' END AS cookies,
  CASE WHEN b THEN 'u'||(event_id % 3)||'='||event_id ELSE '' END AS mock_credentials,
  CASE WHEN b THEN 'k='||k ELSE '' END AS seeded_entities,
  CASE WHEN b THEN 'db=localhost:'||event_id ELSE '' END AS dynamic_endpoints,
  CASE WHEN b THEN '/tmp/'||event_id||',/tmp/shared' ELSE '' END AS ephemeral_files FROM x""",
}
