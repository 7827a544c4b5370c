"""Test-run logs: classification, routing, folding, environment state."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F

from symgrove import constants as c
from symgrove.functions import json_text as j
from symgrove.plans.skew import sliced_row_number

_EMPTY_MAP, _EMPTY_LIST = "map<string,string>", "array<string>"


def _map(name: str) -> Column:
    return F.coalesce(F.col(name), F.create_map().cast(_EMPTY_MAP))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(_EMPTY_LIST))


# --- L1, L2: one execution --------------------------------------------------------

def classify_execution(telemetry: DataFrame, error_prefix: str = "no result from the host: ") -> DataFrame:
    """L1: report columns of each run from its raw telemetry.

    A lost connection at or past the timeout (less the grace) is a timeout;
    any earlier one, and any host error, leaves no result at all: no output,
    and the error in place of the error output. An unknown elapsed time is no
    timeout.
    """
    limit = F.coalesce("timeout_seconds", F.lit(c.PROFILE_TIMEOUT)) - c.TIMEOUT_GRACE_SECONDS
    lost = F.coalesce("disconnected", F.lit(False))
    late = lost & F.coalesce(F.col("elapsed") >= limit, F.lit(False))
    host_error = F.coalesce("api_error", F.lit(False)) | (lost & ~late)
    exit_code = (
        F.when(host_error, c.HOST_ERROR_EXIT_CODE).when(late, c.TIMEOUT_EXIT_CODE)
        .otherwise(F.coalesce("status_code", F.lit(c.MISSING_STATUS_EXIT_CODE))))
    timed_out = late & ~host_error
    oom = F.coalesce("oom", F.lit(False)) & ~host_error
    run_class = (
        F.when(host_error, "host_error").when(oom, "oom").when(timed_out, "timeout")
        .when(exit_code == 0, "clean").otherwise("failed"))
    return telemetry.withColumns({
        "exit_code": exit_code.cast("int"), "timed_out": timed_out, "oom_killed": oom,
        "stdout": F.when(host_error, "").otherwise(F.coalesce("stdout", F.lit(""))),
        "stderr": F.when(host_error, F.concat(F.lit(error_prefix), F.coalesce("error_message", F.lit(""))))
        .otherwise(F.coalesce("stderr", F.lit(""))),
        "duration_seconds": F.when(host_error, 0.0).otherwise(round_seconds(F.col("elapsed"))),
        "run_class": run_class})


def round_seconds(seconds: Column) -> Column:
    return F.bround(seconds, 2)


def clean_log_text(raw: Column) -> Column:
    """L2: bytes as text, invalid UTF-8 replaced."""
    return F.make_valid_utf8(raw.cast("binary").cast("string"))


# --- L3-L8: attempts ------------------------------------------------------------------

def number_attempts(log: DataFrame, order: tuple[str, ...] = ("ts", "event_id"),
                    slice_of: Column | None = None) -> DataFrame:
    """L3: ``attempt`` counts the executions of each run from one.

    Numbered by day of the leading timestamp unless another slice is given,
    so one endless run is not sorted by a single task.
    """
    cut = F.date_trunc("day", order[0]) if slice_of is None else slice_of
    return sliced_row_number(log, ["run_id"], list(order), cut, "attempt")


def _is(name: str, value: str) -> Column:
    return F.col(name) == value


def derive_status() -> Column:
    """L4: run status after an attempt."""
    secured = _is("mode", "baseline") & _is("verdict", "SYSTEM_SECURE")
    return (
        F.when(_is("verdict", "VULNERABILITY_FOUND") | secured, "completed")
        .when(F.col("attempt") >= F.col("max_retries"), "failed").otherwise("pending"))


def route_start() -> Column:
    """The first step of a run."""
    return F.when(_is("mode", "baseline"), "baseline_coder").otherwise("adversary_coder")


def route_next() -> Column:
    """The step after an attempt; exhausted retries end a run first."""
    return (
        F.when(F.col("attempt") >= F.col("max_retries"), "end")
        .when(_is("verdict", "SYNTAX_ERROR"), route_start())
        .when(_is("verdict", "VULNERABILITY_FOUND"), "end")
        .when(_is("verdict", "SYSTEM_SECURE"),
              F.when(_is("mode", "baseline"), "end").otherwise("adversary_coder")))


def fold_runs(attempts: DataFrame) -> DataFrame:
    """(run_id, end_attempt, verdict, status) of every run.

    A run ends at its first terminal attempt, whatever order rows arrive in.
    One aggregation with map-side partials: a hot run sends one row per task.
    The same call works on a stream.
    """
    ends = F.when(route_next() == "end", F.col("attempt"))
    folded = (
        attempts.select("run_id", "attempt", "verdict", derive_status().alias("status"),
                        ends.alias("ends"))
        .groupBy("run_id")
        .agg(F.min("ends").alias("end_attempt"), F.min_by("verdict", "ends").alias("end_verdict"),
             F.min_by("status", "ends").alias("end_status"),
             F.max_by("verdict", "attempt").alias("last_verdict"))
    )
    return folded.select(
        "run_id", "end_attempt",
        F.when(F.col("end_attempt").isNull(), F.col("last_verdict"))
        .otherwise(F.col("end_verdict")).alias("verdict"),
        F.coalesce("end_status", F.lit("pending")).alias("status"))


# --- L9-L11: environment state ------------------------------------------------------------

def _merges() -> Column:
    return _is("mode", "baseline") & _is("verdict", "SYSTEM_SECURE")


def merge_env_row(rows: DataFrame) -> DataFrame:
    """L9 for one step: current state columns updated by ``extracted_*``.

    Later values win, in the place that their key has already; new keys and
    files are appended; rows that do not merge are kept as they are.
    """
    def updated(now: Column, new: Column) -> Column:
        kept = F.transform_values(now, lambda key, value: F.when(F.map_contains_key(new, key), F.element_at(new, key)).otherwise(value))
        added = F.map_filter(new, lambda key, _value: ~F.map_contains_key(now, key))
        return F.when(_merges(), F.map_concat(kept, added)).otherwise(now)

    merged = {name: updated(_map(name), _map(f"extracted_{name}"))
              for name in c.SECRET_MAPS + c.CLEAR_MAPS}
    files = _list(c.FILE_LIST)
    merged[c.FILE_LIST] = F.when(
        _merges(), F.concat(files, _list(f"extracted_{c.FILE_LIST}"))).otherwise(files)
    return rows.withColumns(merged)


def merge_env_log(attempts: DataFrame) -> DataFrame:
    """L9 for a whole log, in long form: one row per entry of a run's state.

    Maps give (run_id, field, key, value) with the latest attempt's value.
    Files keep every occurrence; order them by (attempt, pos). Nothing is
    collected per run, so a run's state may be of any size.
    """
    live = attempts.where(_merges())
    tagged = F.array(*[
        F.struct(F.lit(name).alias("field"), F.map_entries(_map(f"extracted_{name}")).alias("e"))
        for name in c.SECRET_MAPS + c.CLEAR_MAPS])
    entries = (
        live.select("run_id", "attempt", F.inline(tagged))
        .select("run_id", "attempt", "field", F.inline("e"))
        .groupBy("run_id", "field", "key")
        .agg(F.max_by("value", "attempt").alias("value"), F.max("attempt").alias("attempt"))
        .select("run_id", "field", "key", "value", "attempt", F.lit(0).alias("pos"))
    )
    files = live.select(
        "run_id", F.lit(c.FILE_LIST).alias("field"), F.lit(None).cast("string").alias("key"),
        "attempt", F.posexplode(_list(f"extracted_{c.FILE_LIST}")).alias("pos", "value")) \
        .select("run_id", "field", "key", "value", "attempt", "pos")
    return entries.unionByName(files)


def mask_secrets(states: DataFrame, prefix: str = "") -> DataFrame:
    """Secret values replaced by a mask, empty ones by nothing."""
    return states.withColumns({
        prefix + name: F.transform_values(
            _map(prefix + name),
            lambda _k, v: F.when(F.length(v) > 0, c.SECRET_MASK).otherwise(""))
        for name in c.SECRET_MAPS})


def mask_entries(entries: DataFrame) -> DataFrame:
    """L10 on the long form of :func:`merge_env_log`."""
    secret = F.col("field").isin(c.SECRET_MAPS)
    return entries.withColumn(
        "value", F.when(secret & (F.length("value") > 0), c.SECRET_MASK).otherwise(F.col("value")))


def expose_env_json(reveal: bool = False) -> Column:
    """Unmasked JSON of the six state fields; only with ``reveal=True``."""
    if not reveal:
        raise PermissionError("secrets are only written with reveal=True")
    fields = {n: j.map_block(_map(n)) for n in c.SECRET_MAPS + c.CLEAR_MAPS}
    fields[c.FILE_LIST] = j.list_block(_list(c.FILE_LIST))
    return j.object_text(fields)


# --- L12, L13: prompts and outputs -----------------------------------------------------------

BASELINE_CODER = """Write tests of the normal behaviour of {symbol_name} ({language}, {file_path}).
Source:
{source_code}
Last test:
{previous_test}
Feedback:
{feedback}
"""
ADVERSARY_CODER = """Write tests that try to break {symbol_name} ({language}, {file_path}).
Source:
{source_code}
Environment:
{env_state}
Last test:
{previous_test}
Feedback:
{feedback}
"""
BASELINE_EVALUATOR = """Judge a run of normal-behaviour tests.
Source:
{source_code}
Test:
{current_test_script}
Exit code: {exit_code}
Output:
{stdout}
Errors:
{stderr}
"""
ADVERSARY_EVALUATOR = BASELINE_EVALUATOR.replace("normal-behaviour", "adversarial")


def fill_template(template: str, fields: dict[str, Column] | None = None) -> Column:
    """A template with each ``{name}`` replaced by that column.

    The template is cut into literals and columns once, so braces inside the
    substituted values are plain text.
    """
    parts = []
    for literal, name, _spec, _conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            value = (fields or {}).get(name, F.col(name))
            parts.append(F.coalesce(value.cast("string"), F.lit("")))
    return F.concat(*parts)


def coder_prompt(baseline: str = BASELINE_CODER, adversary: str = ADVERSARY_CODER,
                 no_test: str = "(nothing was tried yet)", no_attack: str = "(no attack was tried yet)") -> Column:
    """The coder's prompt of each row by mode.

    Earlier test and feedback appear from the second attempt on, before it
    ``no_test``, and ``no_attack`` as an adversary's feedback. The
    adversary's ``env_state`` is a column made by :func:`expose_env_json`.
    """
    again = F.col("retry_count") > 0
    previous = F.when(again, F.col("current_test_script")).otherwise(no_test)

    def feedback(first: str) -> Column:
        return F.when(again, F.col("evaluator_feedback")).otherwise(first)

    return F.when(_is("mode", "baseline"), fill_template(
        baseline, {"previous_test": previous, "feedback": feedback(no_test)})).otherwise(
        fill_template(adversary, {"previous_test": previous,
                                  "feedback": feedback(no_attack)}))


def evaluator_prompt(baseline: str = BASELINE_EVALUATOR,
                     adversary: str = ADVERSARY_EVALUATOR) -> Column:
    """The evaluator's prompt of each row by mode."""
    return F.when(_is("mode", "baseline"), fill_template(baseline)) \
        .otherwise(fill_template(adversary))


def select_output(rows: DataFrame) -> DataFrame:
    """Adversarial rows carry verdict and feedback, no extracted data."""
    baseline = _is("mode", "baseline")
    kept = {f"extracted_{n}": F.when(baseline, _map(f"extracted_{n}"))
            .otherwise(F.create_map().cast(_EMPTY_MAP)) for n in c.SECRET_MAPS + c.CLEAR_MAPS}
    name = f"extracted_{c.FILE_LIST}"
    kept[name] = F.when(baseline, _list(name)).otherwise(F.array().cast(_EMPTY_LIST))
    return rows.withColumns(kept)
