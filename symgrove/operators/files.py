"""File filters, ignore rules and rebuild decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from symgrove import constants as c
from symgrove.functions import paths as p
from symgrove.functions.ids import fingerprint
from symgrove.functions.text import strip_space
from symgrove.plans.sizing import fits_broadcast, hinted


def literal_map(values: dict[str, str]) -> Column:
    """A fixed lookup table as a map literal: no join is needed."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value for key, or null."""
    return F.try_element_at(literal_map(values), key)


# --- F2-F5: which files are read ----------------------------------------------

def searched_dirs(dirs: Column) -> Column:
    """True if no directory is hidden or in the skip list."""
    skipped = F.array(*[F.lit(d) for d in c.SKIP_DIRS])
    return ~F.arrays_overlap(dirs, skipped) & ~F.exists(dirs, lambda d: d.startswith("."))


def prune_dirs(files: DataFrame) -> DataFrame:
    """drop files below a hidden or skipped directory."""
    return files.where(searched_dirs(p.directories(F.col("rel_path"))))


def map_language(files: DataFrame) -> DataFrame:
    """add ``language`` by extension; unsupported files are dropped."""
    language = lookup(c.EXTENSION_LANGUAGE, p.extension(F.col("rel_path")))
    return files.withColumn("language", language).where(F.col("language").isNotNull())


def split_readable(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable files, files whose bytes could not be read)."""
    bad = F.col("read_error").isNotNull()
    return scanned.where(~bad).drop("read_error"), scanned.where(bad).drop("content")


def ingest_coverage(files: DataFrame, nodes: DataFrame, supported: list[str]) -> DataFrame:
    """per language, files and nodes and why it gave none."""
    per_file = files.groupBy("language").agg(F.count("*").alias("n_files"))
    per_node = nodes.groupBy("language").agg(F.count("*").alias("n_nodes"))
    status = (
        F.when(~F.col("language").isin(supported), "no rules")
        .when(F.col("n_nodes") == 0, "no symbols").otherwise("extracted"))
    return (
        per_file.join(per_node, "language", "left")
        .withColumn("n_nodes", F.coalesce("n_nodes", F.lit(0)))
        .withColumn("status", status)
    )


# --- F6, F7: ignore rules ---------------------------------------------------------

def normalize_ignore_rules(lines: DataFrame, repos: DataFrame) -> DataFrame:
    """distinct (repo, rule) of all ignore lines and the skip list."""
    text = F.rtrim(F.when(F.col("line").startswith("/"), F.concat(F.lit("."), F.col("line")))
                   .otherwise(F.col("line")), F.lit("/"))
    own = (
        lines.select("repo", strip_space(F.col("line")).alias("line"))
        .where((F.col("line") != "") & ~F.col("line").startswith("#")
               & ~F.col("line").startswith("!"))
        .select("repo", text.alias("rule"))
    )
    fixed = repos.select("repo", F.explode(F.array(*[F.lit(d) for d in c.SKIP_DIRS])).alias("rule"))
    return own.unionByName(fixed).distinct()


def _compiled_rules(rules: DataFrame) -> DataFrame:
    """(repo, first, needle, regex) to test against ``/./path/``.

    ``first`` is the path component a rule without wildcards starts with.
    A rule whose only wildcard is a ``*`` at one end is a plain substring
    test; others are a regex.
    """
    rule = F.col("rule")
    literal = ~rule.rlike(r"[*?\[\\]")
    head, tail = rule.rlike(r"^\*[^*?\[\\]*$"), rule.rlike(r"^[^*?\[\\]*\*$")
    slash = F.lit("/")
    needle = (
        F.when(literal, F.concat(slash, rule, slash))
        .when(head, F.concat(F.substring(rule, F.lit(2), F.length(rule)), slash))
        .when(tail, F.concat(slash, F.substring(rule, F.lit(1), F.length(rule) - 1))))
    # The rule "." is the root itself and drops every file.
    first = F.when(literal & (rule != "."), F.element_at(F.split(F.regexp_replace(rule, r"^\./", ""), "/"), 1))
    return rules.select(
        "repo", first.alias("first"), needle.alias("needle"),
        F.concat(F.lit("/"), p.glob_regex(rule), F.lit("/")).alias("regex"))


def _matchers(globs: DataFrame) -> DataFrame:
    """One row per repository: its substring tests, and all other wildcard rules as one regex."""
    regexes = F.collect_list(F.when(F.col("needle").isNull(), F.col("regex")))
    return globs.groupBy("repo").agg(
        F.collect_list("needle").alias("needles"),
        F.when(F.size(regexes) > 0, F.array_join(F.transform(regexes, lambda r: F.concat(F.lit("(?:"), r, F.lit(")"))), "|"))
        .alias("regex"))


def apply_ignore_rules(files: DataFrame, rules: DataFrame,
                       small: bool | None = None) -> DataFrame:
    """files that no rule of their repository matches.

    Rules match whole names at any depth, or from the root if they start with
    ``./``; a matched directory drops what is below it. Rules without
    wildcards, the bulk, join on (repo, component). All wildcard rules of a
    repository are one row, so a file meets one row however many there are.
    Rules of a measured small size are broadcast and files stay in place;
    otherwise give it a manifest without contents, as both joins shuffle.
    """
    small = fits_broadcast(rules, "rule") if small is None else small
    compiled = _compiled_rules(rules)
    plain = hinted(compiled.where(F.col("first").isNotNull()).select("repo", "first", "needle"), small)
    matchers = hinted(_matchers(compiled.where(F.col("first").isNull())), small)
    padded = F.concat(F.lit("/./"), F.col("rel_path"), F.lit("/"))
    parts = files.select(
        "repo", "rel_path", padded.alias("padded"),
        F.explode(F.array_distinct(F.split("rel_path", "/"))).alias("first"))
    dropped = (
        parts.alias("f").join(plain.alias("r"), (F.col("f.repo") == F.col("r.repo"))
                              & (F.col("f.first") == F.col("r.first"))
                              & F.contains(F.col("f.padded"), F.col("r.needle")), "left_semi")
        .select("repo", "rel_path").distinct()
    )
    hit = F.exists("needles", lambda n: F.contains(padded, n)) \
        | F.coalesce(F.call_function("rlike", padded, F.col("regex")), F.lit(False))
    return (
        files.join(matchers, "repo", "left").where(~F.coalesce(hit, F.lit(False))).drop("needles", "regex")
        .join(dropped, ["repo", "rel_path"], "left_anti").select(*files.columns)
    )


# --- F8-F11: environment definitions and test files --------------------------------

def require_file(repos: DataFrame, files: DataFrame, rel_path: str) -> DataFrame:
    """F8: repositories without the required file."""
    having = files.where(F.col("rel_path") == rel_path).select("repo")
    return repos.select("repo").distinct().join(having, "repo", "left_anti")


def assert_required_file(repos: DataFrame, files: DataFrame, rel_path: str) -> None:
    """Strict form of :func:`require_file`."""
    missing = require_file(repos, files, rel_path).take(5)
    if missing:
        raise FileNotFoundError(f"{rel_path} not found in {[row.repo for row in missing]}")


def content_tags(files: DataFrame, rel_path: str, prefix: str) -> DataFrame:
    """(repo, tag) with the fingerprint of each repository's file."""
    return files.where(F.col("rel_path") == rel_path).select(
        "repo", fingerprint(F.col("content"), prefix).alias("tag"))


def rebuild_decision(tags: DataFrame, built: DataFrame) -> DataFrame:
    """``reuse`` a registered tag, ``build`` any other."""
    known = built.select("tag").distinct().withColumn("known", F.lit(True))
    return tags.join(known, "tag", "left").select(
        *tags.columns, F.when(F.col("known"), "reuse").otherwise("build").alias("action"))


def test_file_lookup(rows: DataFrame, stem: str = "generated_test") -> DataFrame:
    """test file name and run command of each row's language."""
    language = F.lower("language")
    suffix = F.coalesce(lookup(c.TEST_SUFFIX, language), F.lit(c.DEFAULT_TEST_SUFFIX))
    name = F.concat(F.lit(stem), suffix)
    template = F.coalesce(lookup(c.RUN_COMMAND, language), F.lit(c.DEFAULT_RUN_COMMAND))
    command = F.replace(F.replace(template, F.lit("{f}"), name), F.lit("{s}"),
                        F.regexp_replace(name, r"\.[^.]*$", ""))
    return rows.withColumns({"test_file": name, "run_command": command})
