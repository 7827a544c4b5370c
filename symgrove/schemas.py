"""Schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())
_M = T.MapType(T.StringType(), T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


CODE_NODES = _struct(
    node_id=_S, node_type=_S, file_path=_S, symbol_name=_S, source_code=_S,
    child_nodes=_A, parent_nodes=_A, language=_S,
)
SEARCH_COLUMNS = ["node_id", "symbol_name", "node_type", "file_path"]

FILES = _struct(repo=_S, rel_path=_S, content=T.BinaryType())
SCANNED_FILES = _struct(repo=_S, rel_path=_S, content=T.BinaryType(), read_error=_S)
EDGES = _struct(caller_id=_S, callee_id=_S)
SEARCH_QUERIES = _struct(qid=T.LongType(), query=_S)
IGNORE_LINES = _struct(repo=_S, line=_S)

SANDBOX_PROFILE = _struct(
    network_mode=_S, memory_limit=_S, cpu_quota=T.DoubleType(),
    timeout_seconds=T.IntegerType(), environment_vars=_M, custom_image=_S,
)
EXECUTION_REPORT = _struct(
    exit_code=T.IntegerType(), stdout=_S, stderr=_S, duration_seconds=T.DoubleType(),
    oom_killed=T.BooleanType(), timed_out=T.BooleanType(),
)
ENV_STATE = _struct(
    auth_headers=_M, cookies=_M, mock_credentials=_M, seeded_entities=_M,
    dynamic_endpoints=_M, ephemeral_files=_A,
)
TELEMETRY = _struct(
    run_id=T.LongType(), attempt=T.IntegerType(), status_code=T.IntegerType(),
    elapsed=T.DoubleType(), timeout_seconds=T.IntegerType(), disconnected=T.BooleanType(),
    api_error=T.BooleanType(), oom=T.BooleanType(), stdout=_S, stderr=_S, error_message=_S,
)
ATTEMPTS = _struct(
    run_id=T.LongType(), attempt=T.IntegerType(), mode=_S, verdict=_S,
    max_retries=T.IntegerType(), feedback=_S, extracted_auth_headers=_M,
    extracted_cookies=_M, extracted_mock_credentials=_M, extracted_seeded_entities=_M,
    extracted_dynamic_endpoints=_M, extracted_ephemeral_files=_A,
)
AGENT_STATE = T.StructType(
    _struct(mode=_S).fields
    + [T.StructField("sandbox_config", SANDBOX_PROFILE), T.StructField("env_state", ENV_STATE)]
    + _struct(current_test_script=_S).fields
    + [T.StructField("execution_report", EXECUTION_REPORT)]
    + _struct(
        evaluator_feedback=_S, retry_count=T.IntegerType(), max_retries=T.IntegerType(),
        status=_S, final_verdict=_S, internal_system_error=_S,
    ).fields
)
