"""Node rows: key check, validation and lookups (R2-R8); ``plans.storage`` appends them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from symgrove import constants as c
from symgrove.functions.text import size_columns
from symgrove.schemas import CODE_NODES, SEARCH_COLUMNS

NODE_COLUMNS = CODE_NODES.fieldNames()
_LIST = "array<string>"
# Beside the node: its repository, and the two facts that packing needs of its text.
STORED_COLUMNS = [*NODE_COLUMNS, "repo", "n_len", "n_tok"]


def with_list_defaults(nodes: DataFrame, columns: list[str] = NODE_COLUMNS) -> DataFrame:
    """All node columns; absent or null neighbour lists read as empty, an absent repository as null."""
    lists = {}
    for name in ("child_nodes", "parent_nodes"):
        empty = F.array().cast(_LIST)
        lists[name] = F.coalesce(F.col(name), empty) if name in nodes.columns else empty
    if "repo" in columns:
        sizes = {n: F.col(n) if n in nodes.columns else size for n, size in size_columns().items()}
        lists |= sizes | ({} if "repo" in nodes.columns else {"repo": F.lit(None).cast("string")})
    return nodes.withColumns(lists).select(*columns)


# --- R3: key check -----------------------------------------------------------

def duplicate_keys(batch: DataFrame, stored: DataFrame | None = None,
                   key: str = "node_id") -> DataFrame:
    """Keys that occur twice in the batch or are stored already."""
    rows = batch.select(key, F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("is_stored"))
    if stored is not None:
        known = stored.where(F.col(key).isNotNull())
        rows = rows.unionByName(known.select(key, F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("is_stored")))
    # Both sides meet in one aggregation, partial sums first.
    counts = rows.groupBy(key).agg(F.sum("n").alias("n"), F.max("is_stored").alias("is_stored"))
    return counts.where((F.col("n") > 1) | (F.col("is_stored") & (F.col("n") > 0)))


def assert_unique_key(batch: DataFrame, stored: DataFrame | None = None,
                      key: str = "node_id") -> None:
    """Raise before anything is written if a key would repeat."""
    clashes = duplicate_keys(batch, stored, key).take(5)
    if clashes:
        raise ValueError(f"duplicate {key}: {[row[key] for row in clashes]}")


# --- R2: JSON text for exchange ----------------------------------------------

def encode_list(column: Column) -> Column:
    return F.to_json(F.coalesce(column, F.array().cast(_LIST)))


def decode_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, _LIST), F.array().cast(_LIST))


# --- R4, R5: validation and defaults -----------------------------------------

@dataclass(frozen=True)
class RowRules:
    """What a valid row of one kind looks like, down to what it holds.

    ``maps`` and ``lists`` name columns of text without null values; a null
    one is empty. ``structs`` gives the rules of nested records, which may be
    null unless they are required too.
    """

    required: tuple[str, ...] = ()
    members: dict[str, list[str]] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    maps: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()
    structs: dict[str, RowRules] = field(default_factory=dict)


CODE_NODE_RULES = RowRules(
    required=("node_id", "file_path", "symbol_name", "source_code", "language"),
    members={"node_type": c.NODE_TYPES}, defaults={"node_type": "function"})
PROFILE_RULES = RowRules(
    members={"network_mode": c.NETWORK_MODES},
    types={"cpu_quota": "double", "timeout_seconds": "int"},
    defaults={"network_mode": c.PROFILE_NETWORK, "memory_limit": c.PROFILE_MEMORY,
              "cpu_quota": c.PROFILE_CPU, "timeout_seconds": c.PROFILE_TIMEOUT})
REPORT_RULES = RowRules(
    required=("exit_code", "stdout", "stderr"),
    types={"exit_code": "int", "duration_seconds": "double", "oom_killed": "boolean",
           "timed_out": "boolean"},
    defaults={"duration_seconds": 0.0, "oom_killed": False, "timed_out": False})
STATE_RULES = RowRules(
    required=("mode",),
    members={"mode": c.MODES, "status": c.STATUSES, "final_verdict": c.VERDICTS},
    types={"retry_count": "int", "max_retries": "int"},
    defaults={"current_test_script": "", "evaluator_feedback": "", "retry_count": 0,
              "max_retries": c.MAX_RETRIES, "status": "pending"})
EVALUATION_RULES = RowRules(
    required=("verdict",), members={"verdict": c.VERDICTS}, defaults={"feedback": ""})
ENV_STATE_RULES = RowRules(maps=tuple(c.SECRET_MAPS + c.CLEAR_MAPS), lists=(c.FILE_LIST,))
BASELINE_EVALUATION_RULES = replace(
    EVALUATION_RULES, maps=tuple(f"extracted_{n}" for n in c.SECRET_MAPS + c.CLEAR_MAPS),
    lists=(f"extracted_{c.FILE_LIST}",))
CODER_RULES = RowRules(required=("test_script",))
AGENT_STATE_RULES = replace(
    STATE_RULES, required=("mode", "sandbox_config"),
    structs={"sandbox_config": replace(PROFILE_RULES, maps=("environment_vars",)), "env_state": ENV_STATE_RULES,
             "execution_report": REPORT_RULES})


def _fits(value: Column, kind: str) -> Column:
    """True if a value that is not null can be of this type without losing anything."""
    castable = value.try_cast(kind).isNotNull()
    if kind != "int":
        return castable
    number = value.try_cast("double")
    return castable & (number.isNull() | (number == F.floor(number)))


def _errors(rules: RowRules, of: Callable[[str], Column], path: str = "") -> Column:
    """Array of what is wrong with the fields that ``of`` gives, each with its path."""
    found = [F.when(of(n).isNull(), F.lit(f"{path}{n}: missing")) for n in rules.required]
    found += [F.when(of(n).isNotNull() & ~of(n).isin(allowed), F.lit(f"{path}{n}: not a member"))
              for n, allowed in rules.members.items()]
    found += [F.when(of(n).isNotNull() & ~_fits(of(n), kind), F.lit(f"{path}{n}: not {kind}"))
              for n, kind in rules.types.items()]
    parts = [F.array_compact(F.array(*found))] if found else []
    none = F.array().cast(_LIST)
    without = {n: F.map_keys(F.map_filter(of(n), lambda _, value: value.isNull())) for n in rules.maps}
    without |= {n: F.filter(F.transform(of(n), lambda x, i: F.when(x.isNull(), i.cast("string"))), lambda i: i.isNotNull())
                for n in rules.lists}
    for n, places in without.items():
        begin = F.lit(f"{path}{n}[")
        parts.append(F.coalesce(F.transform(places, lambda at: F.concat(begin, at, F.lit("]: missing"))), none))  # noqa: B023
    for n, inner in rules.structs.items():
        parts.append(F.when(of(n).isNotNull(), _errors(inner, of(n).getField, f"{path}{n}.")).otherwise(none))
    return F.concat(*parts) if parts else none


def _fixed(rules: RowRules, of: Callable[[str], Column], types: T.StructType) -> dict[str, Column]:
    """The fields that rules coerce or complete."""
    fixed = {n: of(n).try_cast(kind) for n, kind in rules.types.items()}
    for name, value in rules.defaults.items():
        fixed[name] = F.coalesce(fixed.get(name, of(name)), F.lit(value))
    for n in rules.maps:
        fixed[n] = F.coalesce(of(n), F.create_map().cast(types[n].dataType))
    for n in rules.lists:
        fixed[n] = F.coalesce(of(n), F.array().cast(types[n].dataType))
    for n, inner in rules.structs.items():
        own = types[n].dataType
        parts = _fixed(inner, of(n).getField, own)
        record = F.struct(*[parts.get(f.name, of(n).getField(f.name)).alias(f.name) for f in own])
        fixed[n] = F.when(of(n).isNotNull(), record)
    return fixed


def validate_rows(rows: DataFrame, rules: RowRules) -> DataFrame:
    """Rows with defaults and types applied and an ``errors`` array.

    A null required field, a value outside its enumeration, one that cannot be
    coerced and a null value in a map or list gives one entry each, with its
    path: ``env_state.cookies[sid]: missing``. Split on ``size(errors)`` with
    :func:`split_valid`.
    """
    fixed = _fixed(rules, F.col, rows.schema)
    checked = rows.withColumn("errors", _errors(rules, F.col))
    return checked.withColumns(fixed) if fixed else checked


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their errors)."""
    bad = F.size("errors") > 0
    return checked.where(~bad).drop("errors"), checked.where(bad)


def assert_valid(checked: DataFrame) -> None:
    """Strict form: raise on the first quarantined rows."""
    bad = split_valid(checked)[1].select("errors").take(5)
    if bad:
        raise ValueError(f"invalid rows: {[row.errors for row in bad]}")


def apply_profile_defaults(profiles: DataFrame) -> DataFrame:
    """Run profiles with defaults, and the CPU quota in period units."""
    env = F.coalesce(F.col("environment_vars"),
                     F.create_map().cast("map<string,string>"))
    return profiles.withColumns({
        "network_mode": F.coalesce("network_mode", F.lit(c.PROFILE_NETWORK)),
        "memory_limit": F.coalesce("memory_limit", F.lit(c.PROFILE_MEMORY)),
        "cpu_quota": F.coalesce("cpu_quota", F.lit(c.PROFILE_CPU)),
        "timeout_seconds": F.coalesce("timeout_seconds", F.lit(c.PROFILE_TIMEOUT)),
        "environment_vars": env,
    }).withColumn("cpu_units", (F.col("cpu_quota") * c.CPU_PERIOD).cast("int"))


# --- R6-R8: lookups and projections --------------------------------------------

def get_node(nodes: DataFrame, node_id: str | None) -> DataFrame:
    """The node with this id; no rows for an unknown, empty or null id."""
    return nodes.where(F.col("node_id") == node_id) if node_id else nodes.limit(0)


def get_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored nodes among ``ids``; repeats collapse, unknown ids vanish.

    Order by node_id at the edge if order matters. Spark broadcasts the ids
    when their measured size allows and shuffles otherwise.
    """
    return nodes.join(ids.select("node_id"), "node_id", "left_semi")


def project_search(nodes: DataFrame) -> DataFrame:
    """The four search columns; the source text stays unread."""
    return nodes.select(*SEARCH_COLUMNS)


def project_full(nodes: DataFrame) -> DataFrame:
    """The full eight-column row."""
    return with_list_defaults(nodes)
