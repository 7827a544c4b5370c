"""Registered queries F1-F11 (F12 is in stream_queries)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from symgrove import rules as ru
from symgrove.catalog import views as v
from symgrove.operators import files as f, symbols as b
from symgrove.session import scratch_path
from symgrove.sources import tree


def _write_batch(batch: pa.RecordBatch, root: str) -> int:
    for repo, rel, content in zip(*[batch.column(name) for name in ("repo", "rel_path", "content")]):
        tree.write_bytes(f"{root}/{repo}/{rel}", content.as_buffer())
    return batch.num_rows


def write_files(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Write batches of (repo, rel_path, content); texts go to disk out of the batch, one by one, and are copied nowhere."""
    for batch in batches:
        written = _write_batch(batch, root)
        del batch       # the next one is received without it
        yield pa.RecordBatch.from_pydict({"n": [written]})


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write (repo, rel_path, content) as files below root/repo; returns roots."""
    tasks = files.sparkSession.sparkContext.defaultParallelism
    files.repartition(tasks, "repo", "rel_path").mapInArrow(lambda batches: write_files(batches, root), "n long") \
        .agg(F.sum("n")).collect()
    return files.select("repo").distinct().withColumn(
        "root", F.concat(F.lit(f"{root}/"), F.col("repo")))


_TREES: dict[tuple[str, str], DataFrame] = {}


def fixture_tree(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, root) of the files view written out as a tree, once per application."""
    key = spark.sparkContext.applicationId, sf
    if key not in _TREES:
        path = scratch_path(spark, "tree")
        write_tree(v.files(spark, sf), path).write.parquet(f"{path}-roots")
        _TREES[key] = spark.read.parquet(f"{path}-roots")
    return _TREES[key]


def scan(spark: SparkSession, sf: str) -> DataFrame:
    return tree.scan_files(fixture_tree(spark, sf)).select(
        "repo", "rel_path", "language", F.md5("content").alias("content_md5"),
        F.col("read_error").isNull().alias("readable"))


def prune_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return f.prune_dirs(v.files(spark, sf)).select("repo", "rel_path")


def _supported(spark: SparkSession, sf: str) -> DataFrame:
    return f.map_language(f.prune_dirs(v.files(spark, sf)))


def map_language(spark: SparkSession, sf: str) -> DataFrame:
    return _supported(spark, sf).select("repo", "rel_path", "language")


def skip_unreadable(spark: SparkSession, sf: str) -> DataFrame:
    manifest = f.map_language(tree.list_tree(fixture_tree(spark, sf))).drop("language")
    gone = manifest.select("repo", "root", F.lit("gone/missing.py").alias("rel_path")).distinct()
    scanned = tree.read_files(manifest.unionByName(gone, allowMissingColumns=True))
    good, bad = f.split_readable(scanned)
    size = F.octet_length("content").cast("long")
    return good.select("repo", "rel_path", size.alias("n_bytes"), F.lit("").alias("read_error")) \
        .unionByName(bad.select("repo", "rel_path", F.lit(None).cast("long").alias("n_bytes"),
                                "read_error"))


def ingest_coverage(spark: SparkSession, sf: str) -> DataFrame:
    code = v.code_files(spark, sf)
    files = _supported(spark, sf).select("language").unionByName(code.select("language"))
    return f.ingest_coverage(files, b.symbol_nodes(code), list(ru.RULES))


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    return f.normalize_ignore_rules(v.ignore_lines(spark, sf), v.repos(spark, sf))


def apply_ignore(spark: SparkSession, sf: str) -> DataFrame:
    manifest = v.files(spark, sf).select("repo", "rel_path")
    return f.apply_ignore_rules(manifest, _rules(spark, sf))


def require_file(spark: SparkSession, sf: str) -> DataFrame:
    return f.require_file(v.repos(spark, sf), v.files(spark, sf), v.REQUIRED_FILE)


def _tags(spark: SparkSession, sf: str) -> DataFrame:
    return f.content_tags(v.files(spark, sf), v.REQUIRED_FILE, "sandbox")


def rebuild(spark: SparkSession, sf: str) -> DataFrame:
    built = _tags(spark, sf).join(
        v.repos(spark, sf).where(F.col("repo").rlike(r"^src(1|5|9|13|17)-")), "repo", "left_semi")
    return f.rebuild_decision(_tags(spark, sf), built)


def test_file_lookup(spark: SparkSession, sf: str) -> DataFrame:
    languages = F.array(*[F.lit(x) for x in (
        "Python", "go", "java", "rust", "C-Sharp", "erlang", "kotlin", "cobol", "bash")])
    rows = v.table(spark, sf, "documents").select(
        "doc_id", F.get(languages, (F.col("doc_id") % 9).cast("int")).alias("language"))
    return f.test_file_lookup(rows)


QUERIES = {
    "f_scan": scan,
    "f_prune_dirs": prune_dirs,
    "f_map_language": map_language,
    "f_skip_unreadable": skip_unreadable,
    "f_ingest_coverage": ingest_coverage,
    "f_ignore_rules": _rules,
    "f_apply_ignore": apply_ignore,
    "f_require_file": require_file,
    "f_fingerprint": _tags,
    "f_rebuild": rebuild,
    "f_test_file_lookup": test_file_lookup,
}

ORACLES = {
    "f_scan": f"""WITH {v.SQL_V2}
SELECT repo, rel_path, language, md5(content) AS content_md5, TRUE AS readable FROM supported""",
    "f_prune_dirs": f"WITH {v.SQL_V2} SELECT repo, rel_path FROM kept",
    "f_map_language": f"WITH {v.SQL_V2} SELECT repo, rel_path, language FROM supported",
    "f_skip_unreadable": f"""WITH {v.SQL_V2}
SELECT repo, rel_path, CAST(strlen(content) AS BIGINT) AS n_bytes, '' AS read_error FROM supported
UNION ALL SELECT DISTINCT repo, 'gone/missing.py', NULL, 'FileNotFoundError' FROM supported""",
    "f_ingest_coverage": f"""WITH {v.SQL_V2}, {v.SQL_V3},
fl AS (SELECT language FROM supported UNION ALL
       SELECT language FROM (SELECT DISTINCT rel_path, language FROM chunk)),
nl AS (SELECT language, count(*) AS n_nodes FROM v3_nodes GROUP BY 1)
SELECT language, count(*) AS n_files, coalesce(any_value(n_nodes), 0) AS n_nodes,
       CASE WHEN language = 'javascript' THEN 'no rules' WHEN coalesce(any_value(n_nodes), 0) = 0
            THEN 'no symbols' ELSE 'extracted' END AS status
FROM fl LEFT JOIN nl USING (language) GROUP BY language""",
    "f_ignore_rules": f"WITH {v.SQL_V2} SELECT repo, rule FROM rules",
    "f_apply_ignore": f"""WITH {v.SQL_V2}
SELECT repo, rel_path FROM files f
WHERE NOT EXISTS (SELECT 1 FROM patterns p WHERE p.repo = f.repo
                  AND regexp_matches('/./'||f.rel_path||'/', p.re))""",
    "f_require_file": f"""WITH {v.SQL_V2}
SELECT repo FROM repos WHERE repo NOT IN
  (SELECT repo FROM files WHERE rel_path = '.sandbox/Dockerfile')""",
    "f_fingerprint": f"""WITH {v.SQL_V2}
SELECT repo, 'sandbox:'||substr(sha256(content),1,12) AS tag FROM files
WHERE rel_path = '.sandbox/Dockerfile'""",
    "f_rebuild": f"""WITH {v.SQL_V2},
tags AS (SELECT repo, content, 'sandbox:'||substr(sha256(content),1,12) AS tag FROM files
         WHERE rel_path = '.sandbox/Dockerfile')
SELECT repo, tag, CASE WHEN content = 'FROM image:1' THEN 'reuse' ELSE 'build' END AS action FROM tags""",
    "f_test_file_lookup": """WITH l AS (
  SELECT * FROM (VALUES (0, 'Python', '.py', 'python generated_test.py'),
    (1, 'go', '_test.go', 'go test generated_test_test.go'),
    (2, 'java', 'Test.java', 'java generated_testTest.java'),
    (3, 'rust', '.rs', 'rustc generated_test.rs && ./generated_test'),
    (4, 'C-Sharp', 'Tests.cs', 'csc generated_testTests.cs && mono generated_testTests.exe'),
    (5, 'erlang', '_SUITE.erl', 'erlc generated_test_SUITE.erl && erl -noshell -s generated_test_SUITE test -s init stop'),
    (6, 'kotlin', 'Test.kt', 'kotlinc generated_testTest.kt -include-runtime -d test.jar && java -jar test.jar'),
    (7, 'cobol', '.txt', 'cat generated_test.txt'),
    (8, 'bash', '.bats', 'bats generated_test.bats')) v(k, language, suffix, run_command))
SELECT doc_id, language, 'generated_test'||suffix AS test_file, run_command
FROM documents JOIN l ON k = doc_id % 9""",
}
