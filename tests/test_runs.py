"""Run-log operators against a step-by-step loop."""

import json
import random

import pytest
from pyspark.sql import functions as F

from symgrove import constants as c
from symgrove.operators import runs as r
from symgrove.plans.skew import sliced_row_number

ATTEMPT = "run_id bigint, attempt int, mode string, verdict string, max_retries int"


def _loop(rows):
    """Replay one run's verdicts in order until it ends."""
    verdict, status, end = None, "pending", None
    for _, attempt, mode, verdict, limit in sorted(rows):
        done = verdict == "VULNERABILITY_FOUND" or (mode == "baseline" and verdict == "SYSTEM_SECURE")
        status = "completed" if done else "failed" if attempt >= limit else "pending"
        if status != "pending":
            end = attempt
            break
    return end, verdict, status


def _log(seed, runs=60):
    rng = random.Random(seed)
    rows = []
    for run in range(runs):
        mode, limit = rng.choice(c.MODES), rng.randint(1, 5)
        rows += [(run, i + 1, mode, rng.choice(c.VERDICTS), limit) for i in range(rng.randint(1, 6))]
    rng.shuffle(rows)
    return rows


def test_fold_equals_loop(spark):
    rows = _log(1)
    got = {x.run_id: (x.end_attempt, x.verdict, x.status)
           for x in r.fold_runs(spark.createDataFrame(rows, ATTEMPT)).collect()}
    assert got == {run: _loop([x for x in rows if x[0] == run]) for run in {x[0] for x in rows}}


@pytest.mark.parametrize("mode,verdict,attempt,status,step", [
    ("baseline", "SYSTEM_SECURE", 1, "completed", "end"),
    ("baseline", "SYNTAX_ERROR", 1, "pending", "baseline_coder"),
    ("adversarial", "SYNTAX_ERROR", 2, "pending", "adversary_coder"),
    ("adversarial", "SYSTEM_SECURE", 2, "pending", "adversary_coder"),
    ("adversarial", "SYSTEM_SECURE", 3, "failed", "end"),
    ("adversarial", "VULNERABILITY_FOUND", 1, "completed", "end"),
    ("baseline", "VULNERABILITY_FOUND", 3, "completed", "end"),
    ("baseline", "SYNTAX_ERROR", 3, "failed", "end"),
])
def test_status_and_routing(spark, mode, verdict, attempt, status, step):
    row = spark.createDataFrame([(1, attempt, mode, verdict, 3)], ATTEMPT).select(
        r.derive_status().alias("s"), r.route_next().alias("n"), r.route_start().alias("f")).first()
    assert (row.s, row.n) == (status, step)
    assert row.f == ("baseline_coder" if mode == "baseline" else "adversary_coder")


def test_hot_run_is_numbered_by_slices(spark):
    rows = spark.range(5000).selectExpr(
        "IF(id % 3 = 0, id, 7) AS run_id", "timestamp_seconds(id * 500 % 900000) AS ts", "id AS event_id")
    got = r.number_attempts(rows)
    want = sliced_row_number(rows, ["run_id"], ["ts", "event_id"], F.lit(0), "attempt")
    assert got.exceptAll(want).isEmpty() and got.count() == 5000
    top = got.where("run_id = 7").agg(F.max("attempt"), F.count_distinct("attempt"), F.count("*")).first()
    assert top[0] == top[1] == top[2]


TELEMETRY = ("status_code int, elapsed double, timeout_seconds int, disconnected boolean, "
             "api_error boolean, oom boolean, stdout string, stderr string, error_message string")


@pytest.mark.parametrize("row,want", [
    ((0, 1.234, 3, False, False, False), (0, False, False, 1.23, "clean")),
    ((None, 1.0, 3, False, False, False), (1, False, False, 1.0, "failed")),
    ((None, 2.0, 3, True, False, False), (137, True, False, 2.0, "timeout")),
    ((None, 1.9, 3, True, False, True), (-1, False, False, 0.0, "host_error")),
    ((0, 1.0, 3, False, True, False), (-1, False, False, 0.0, "host_error")),
    ((137, 1.0, 3, False, False, True), (137, False, True, 1.0, "oom")),
    ((None, 3.5, 3, True, False, True), (137, True, True, 3.5, "oom")),
    ((2, 1.0, None, None, None, None), (2, False, False, 1.0, "failed")),
])
def test_execution_classes(spark, row, want):
    got = r.classify_execution(spark.createDataFrame([(*row, "out", None, "gone")], TELEMETRY)).first()
    assert (got.exit_code, got.timed_out, got.oom_killed, got.duration_seconds, got.run_class) == want
    lost = got.run_class == "host_error"
    assert (got.stdout, got.stderr) == (("", "no result from the host: gone") if lost else ("out", ""))


def test_lost_connection_without_a_time_is_a_host_error(spark):
    row = (None, None, 3, True, None, None, "out", "err", None)
    got = r.classify_execution(spark.createDataFrame([row], TELEMETRY)).first()
    assert (got.run_class, got.exit_code, got.stdout, got.stderr) == ("host_error", -1, "", "no result from the host: ")


def test_invalid_utf8_is_replaced_like_python(spark):
    raw = [b"ok", b"\xff", b"a\xe2\x82z", b"\xf0\x9f\x98\x80", b"\xed\xa0\x80x", b""]
    rows = spark.createDataFrame([(bytearray(x),) for x in raw], "b binary") \
        .select("b", r.clean_log_text(F.col("b")).alias("t")).collect()
    assert all(x.t == bytes(x.b).decode("utf-8", errors="replace") for x in rows)


MAPS = c.SECRET_MAPS + c.CLEAR_MAPS


def _state(spark, rows):
    fields = [f"{p}{n} map<string,string>" for p in ("", "extracted_") for n in MAPS]
    fields += ["ephemeral_files array<string>", "extracted_ephemeral_files array<string>"]
    return spark.createDataFrame(rows, "mode string, verdict string, " + ", ".join(fields))


def _row(mode, verdict, now, new, files, new_files):
    return (mode, verdict, *[now] * 5, *[new] * 5, files, new_files)


def test_attempts_of_unknown_runs_and_times_are_numbered(spark):
    log = spark.createDataFrame([(None, None, 1), (None, "2024-01-02", 2), (7, None, 3), (7, "2024-01-01", 4), (7, "2024-01-03", 5)],
                                "run_id bigint, ts string, event_id bigint").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(x.event_id, x.attempt) for x in r.number_attempts(log).collect()} == {(1, 1), (2, 2), (3, 1), (4, 2), (5, 3)}


def test_environment_merge_steps(spark):
    rows = [_row("baseline", "SYSTEM_SECURE", {"a": "1", "b": "2"}, {"b": "9", "c": "3"}, ["x"], ["x", "y"]),
            _row("adversarial", "SYSTEM_SECURE", {"a": "1"}, {"a": "2"}, ["x"], ["y"]),
            _row("baseline", "SYNTAX_ERROR", None, {"a": "2"}, None, ["y"]),
            _row("baseline", "SYSTEM_SECURE", None, None, None, None)]
    got = r.merge_env_row(_state(spark, rows)).collect()
    assert [x.auth_headers for x in got] == [{"a": "1", "b": "9", "c": "3"}, {"a": "1"}, {}, {}]
    assert list(got[0].auth_headers) == ["a", "b", "c"]           # an overwritten key keeps its place
    assert [x.ephemeral_files for x in got] == [["x", "x", "y"], ["x"], [], []]
    assert got[0].dynamic_endpoints == got[0].auth_headers


def test_environment_merge_log_equals_steps(spark):
    rng = random.Random(5)
    rows = [(rng.randint(1, 4), i, rng.choice(c.MODES), rng.choice(c.VERDICTS),
             {rng.choice("abc"): str(i)}, [f"/tmp/{i % 3}", "/tmp/s"]) for i in range(60)]
    log = spark.createDataFrame(
        rows, "run_id bigint, attempt int, mode string, verdict string, m map<string,string>, f array<string>"
    ).select("*", *[F.col("m").alias(f"extracted_{n}") for n in MAPS], F.col("f").alias("extracted_ephemeral_files"))
    want_maps, want_files = {}, {}
    for run, _, mode, verdict, values, files in rows:
        if mode == "baseline" and verdict == "SYSTEM_SECURE":
            want_maps.setdefault(run, {}).update(values)
            want_files.setdefault(run, []).extend(files)
    got = r.merge_env_log(log)
    maps, files = {}, {}
    for x in got.orderBy("run_id", "attempt", "pos").collect():
        if x.field == "ephemeral_files":
            files.setdefault(x.run_id, []).append(x.value)
        elif x.field == "cookies":
            maps.setdefault(x.run_id, {})[x.key] = x.value
    assert maps == want_maps and files == want_files
    masked = r.mask_entries(got).where("field = 'auth_headers'").select("value").distinct().collect()
    assert [x.value for x in masked] == [c.SECRET_MASK]


def test_masking(spark):
    row = _row("baseline", "SYSTEM_SECURE", {"a": "secret", "b": ""}, None, ["f"], None)
    got = r.mask_secrets(_state(spark, [row])).first()
    for name in c.SECRET_MAPS:
        assert got[name] == {"a": c.SECRET_MASK, "b": ""}
    assert got.seeded_entities == {"a": "secret", "b": ""} and got.ephemeral_files == ["f"]


def test_exposed_json_equals_python(spark):
    values = {"k\"ey": "v\\al\n\t\u0001\u001f\x7f", "é": "😀 ü", "plain": "Bearer abc"}
    rows = [_row("baseline", "SYSTEM_SECURE", values, None, ["/tmp/é", "b"], None),
            _row("baseline", "SYSTEM_SECURE", None, None, None, None)]
    with pytest.raises(PermissionError):
        r.expose_env_json()
    got = [x[0] for x in _state(spark, rows).select(r.expose_env_json(reveal=True)).collect()]
    full = {n: values for n in MAPS} | {"ephemeral_files": ["/tmp/é", "b"]}
    empty = {n: {} for n in MAPS} | {"ephemeral_files": []}
    assert [json.loads(x) for x in got] == [full, empty]
    # The order of map keys is the map's own; the text is otherwise the same.
    assert [json.dumps(json.loads(x), indent=2) for x in got] == got


def test_prompts(spark):
    rows = spark.createDataFrame(
        [("baseline", 0, "{feedback}", "old", "fb"), ("adversarial", 0, "s", "old", "fb"),
         ("adversarial", 2, "s", "old {x}", None)],
        "mode string, retry_count int, source_code string, current_test_script string, evaluator_feedback string")
    text = "{source_code}|{previous_test}|{feedback}|{{x}}"
    got = [x[0] for x in rows.select(r.coder_prompt(text, text)).collect()]
    assert got == [
        f"{{feedback}}|(nothing was tried yet)|(nothing was tried yet)|{{x}}",
        f"s|(nothing was tried yet)|(no attack was tried yet)|{{x}}", "s|old {x}||{x}"]


def test_adversarial_output_has_no_extracted_data(spark):
    rows = [_row(m, "SYSTEM_SECURE", None, {"a": "1"}, None, ["f"]) for m in c.MODES]
    baseline, adversarial = r.select_output(_state(spark, rows)).collect()
    assert baseline.extracted_cookies == {"a": "1"} and baseline.extracted_ephemeral_files == ["f"]
    assert adversarial.extracted_cookies == {} and adversarial.extracted_ephemeral_files == []


def test_attempts_of_one_day_are_numbered_in_several_tasks(spark, monkeypatch):
    from symgrove.plans import skew
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 1).when(F.col("id") % 30 != 2, F.col("id") % 7).alias("run_id"),
        F.when(F.col("id") % 11 != 0, F.timestamp_seconds(F.lit(1_000_000) + F.col("id") * 7919 % 500)).alias("ts"),
        (F.col("id") * 31 % 3000).alias("event_id")).repartition(5)
    want = {(x.run_id, x.event_id, x.attempt) for x in sliced_row_number(rows, ["run_id"], ["ts", "event_id"], F.lit(0), "attempt").collect()}
    monkeypatch.setattr(skew, "SLICE_ROWS", 400)
    got = r.number_attempts(rows)
    assert {(x.run_id, x.event_id, x.attempt) for x in got.collect()} == want and got.columns == [*rows.columns, "attempt"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "numbered-ranges" in plan
