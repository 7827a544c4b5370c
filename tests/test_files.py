"""Tree source, path filters and ignore rules."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from symgrove import constants as c
from symgrove.functions import paths as p
from symgrove.operators import files as f
from symgrove.sources import tree


def _write(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def _roots(spark, *pairs):
    return spark.createDataFrame(list(pairs), "repo string, root string")


def test_scan_keeps_hidden_files_and_prunes_directories(spark, tmp_path):
    _write(tmp_path, {
        "src/api/server.py": "def start_server(): pass", "src/utils/math.go": "func Add() int { return 1 }",
        "node_modules/express/index.js": "x", ".git/objects/hidden.py": "x", "src/notes.txt": "x",
        "src/.hid.py": "h", "__init__.py": "i", "_pkg/deep/er/x.py": "d", "src/.py": "no extension",
        "src/Build/ok.py": "case", "src/build/no.py": "x", "top.R": "r", "top.r": "x"})
    os.symlink(tmp_path / "src", tmp_path / "linked")
    os.symlink(tmp_path / "top.R", tmp_path / "again.R")
    got = {r.rel_path: (r.language, bytes(r.content)) for r in
           tree.scan_files(_roots(spark, ("a", str(tmp_path)))).collect()}
    assert set(got) == {"src/api/server.py", "src/utils/math.go", "src/.hid.py", "__init__.py",
                        "_pkg/deep/er/x.py", "src/Build/ok.py", "top.R", "again.R"}
    assert got["_pkg/deep/er/x.py"] == ("python", b"d")


def test_every_extension_is_scanned(spark, tmp_path):
    _write(tmp_path, {f"dummy{ext}": "x" for ext in c.EXTENSION_LANGUAGE})
    got = {r.rel_path: r.language for r in tree.scan_files(_roots(spark, ("a", str(tmp_path)))).collect()}
    assert got == {f"dummy{ext}": lang for ext, lang in c.EXTENSION_LANGUAGE.items()}
    assert len(got) == 26 and len(set(got.values())) == 22


def test_unreadable_file_is_kept_apart(spark, tmp_path):
    _write(tmp_path, {"a.py": "x", "b.py": b"\xff\x00"})
    manifest = tree.list_tree(_roots(spark, ("r", str(tmp_path)))).unionByName(
        spark.createDataFrame([("r", str(tmp_path), "gone.py")], "repo string, root string, rel_path string"),
        allowMissingColumns=True)
    good, bad = f.split_readable(tree.read_files(manifest))
    assert {r.rel_path: bytes(r.content) for r in good.collect()} == {"a.py": b"x", "b.py": b"\xff\x00"}
    assert [(r.rel_path, r.read_error) for r in bad.collect()] == [("gone.py", "FileNotFoundError")]


def test_two_roots_and_missing_root(spark, tmp_path):
    _write(tmp_path, {"one/x.py": "1", "two/x.py": "2"})
    roots = _roots(spark, ("one", str(tmp_path / "one")), ("two", f"file://{tmp_path}/two"),
                   ("none", str(tmp_path / "none")))
    good, bad = f.split_readable(tree.scan_files(roots))
    assert {(r.repo, bytes(r.content)) for r in good.collect()} == {("one", b"1"), ("two", b"2")}
    assert [(r.repo, r.rel_path, r.read_error) for r in bad.collect()] == [("none", "", "FileNotFoundError")]


def test_read_tasks_hold_equal_bytes(spark, tmp_path, monkeypatch):
    from symgrove.plans import skew
    monkeypatch.setattr(skew, "OPEN_BYTES", 0)
    monkeypatch.setattr(skew, "LEAST_TASK", 1)
    rows = [(f"r{i % 3}", f"f{i}", 10_000 if i % 97 == 0 else 1 + i * 7919 % 60) for i in range(5000)] + [("big", "b", 400_000)]
    files = spark.createDataFrame(rows, "repo string, rel_path string, n_bytes bigint")
    packed = skew.byte_packed(files, "n_bytes", ["repo", "rel_path"], tasks=16)
    assert packed.columns == files.columns and packed.count() == len(rows)
    sums = packed.groupBy(F.spark_partition_id().alias("p")).agg(
        F.sum("n_bytes").alias("n"), F.max("n_bytes").alias("largest"), F.count("*").alias("files")).collect()
    most = sum(r[2] for r in rows) // 16 + 1
    assert [r.files for r in sums if r.largest == 400_000] == [1]
    usual = sorted(r.n for r in sums if r.largest < most)
    assert usual[-1] <= most + 10_000 and usual[1] >= most / 2     # the last one holds what is left
    assert skew.byte_packed(files.limit(0), "n_bytes", ["repo", "rel_path"]).count() == 0


def _peak(batches):
    """Rows of the batches, bytes of the largest, and the most bytes that Python and Arrow held meanwhile."""
    import tracemalloc

    import pyarrow as pa
    rows, largest, most, before = 0, 0, 0, pa.total_allocated_bytes()
    tracemalloc.start()
    for batch in batches:
        rows, largest = rows + batch.num_rows, max(largest, batch.nbytes)
        most = max(most, pa.total_allocated_bytes() - before)
        del batch
    most += tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, largest, most


def test_files_are_read_and_written_a_few_at_a_time(tmp_path):
    import pyarrow as pa

    from symgrove.catalog import file_queries
    names = [f"d/{i}.py" for i in range(60)]
    given = pa.RecordBatch.from_pydict({"repo": ["r"] * 60, "rel_path": names, "content": ["é" * (1 << 19)] * 60})
    rows, _, most = _peak(file_queries.write_files(iter([given, given.slice(0, 0)]), str(tmp_path)))
    assert rows == 2 and most < 4 << 20
    assert all((tmp_path / "r" / n).read_bytes() == "é".encode() * (1 << 19) for n in names)
    paths = pa.RecordBatch.from_pydict({"repo": ["r"] * 61, "root": [f"{tmp_path}/r"] * 61, "rel_path": [*names, "gone"]})
    rows, largest, most = _peak(tree._read_rows(iter([paths])))
    assert rows == 61 and largest < 6 << 20 and most < 20 << 20     # 60 MB in all


def test_unreadable_directory_is_a_row(spark, tmp_path, monkeypatch):
    _write(tmp_path, {"a/x.py": "1", "b/y.py": "2"})
    os.symlink(tmp_path / "nowhere", tmp_path / "a" / "lost.py")
    rows = list(tree._list_dirs(iter([__import__("pandas").DataFrame(
        {"repo": ["r", "r"], "root": [str(tmp_path)] * 2, "rel_path": ["a", "a/x.py"]})])))
    got = {(r.rel_path, r.is_dir, r.list_error) for frame in rows for r in frame.itertuples()}
    assert got == {("a/x.py", False, None), ("a/lost.py", False, None), ("a/x.py", False, "NotADirectoryError")}
    good, bad = f.split_readable(tree.scan_files(_roots(spark, ("r", str(tmp_path)))))
    assert {r.rel_path for r in good.collect()} == {"a/x.py", "b/y.py"}
    assert [(r.rel_path, r.read_error) for r in bad.collect()] == [("a/lost.py", "FileNotFoundError")]


def test_extension_matches_splitext(spark):
    names = ["a.py", ".py", "..py", "a.b.py", "a", "a.", "...a.py", ".a.py", "d.x/e", "d.x/.y", "é.R",
             "x.py/y.tar.gz", "..", "a..py", "n\nl.py"]
    rows = spark.createDataFrame([(n,) for n in names], "n string") \
        .select("n", p.extension(F.col("n")).alias("e")).collect()
    assert {r.n: r.e for r in rows} == {n: os.path.splitext(n.split("/")[-1])[1] for n in names}


def test_relative_paths(spark):
    rows = spark.createDataFrame([("/t/r/src/a.py", "/t/r/"), ("/t/rx/a.py", "/t/r"), ("/t/r/b", "/t/r")],
                                 "path string, root string")
    got = [r[0] for r in rows.select(p.relative_to(F.col("path"), F.col("root"))).collect()]
    assert got == ["src/a.py", "/t/rx/a.py", "b"]


LINES = ["# comment", "heavy_dataset/", "/root_cache", "*.log", "!important.log", "",
         "malicious_dir'; rm -rf /; '", "docs/*.md", "tmp?", "a/b", "[xy]1", "gen*", "q.c+"]
PATHS = ["heavy_dataset/data.bin", "sub/heavy_dataset/x", "root_cache/cache.bin", "sub/root_cache/x",
         "debug.log", "important.log", "valid_file.txt", "docs/x.md", "docs/deep/x.md", "tmp1/x", "tmp12/x",
         "a/b/c", "z/a/b", "a/bc", "x1", "z1", "s/generated/x", "regen/x", "q.c+", "qxc+", ".hidden/keep",
         "node_modules/m.js", "src/build/x", "logs/x.log/y", "loga", "malicious_dir'; rm -rf /; '"]


def _glob(rule):
    out = []
    for ch in rule:
        out.append(".*" if ch == "*" else "." if ch == "?" else ch if ch in "[]" else re.escape(ch))
    return "".join(out)


@pytest.mark.parametrize("small", [True, False])
def test_ignore_rules_against_brute_force(spark, small):
    repos = spark.createDataFrame([("r",), ("bare",)], "repo string")
    lines = spark.createDataFrame([("r", x) for x in LINES + LINES[:3]], "repo string, line string")
    rules = f.normalize_ignore_rules(lines, repos)
    own = {r.rule for r in rules.where("repo = 'r'").collect()}
    assert own == set(c.SKIP_DIRS) | {
        "heavy_dataset", "./root_cache", "*.log", "malicious_dir'; rm -rf /; '", "docs/*.md", "tmp?",
        "a/b", "[xy]1", "gen*", "q.c+"}
    files = spark.createDataFrame([(r, x) for r in ("r", "bare") for x in PATHS], "repo string, rel_path string")
    kept = f.apply_ignore_rules(files, rules, small).collect()

    def dropped(path, chosen):
        return any(re.search(f"/{_glob(rule)}/", f"/./{path}/", re.S) for rule in chosen)

    assert {r.rel_path for r in kept if r.repo == "r"} == {x for x in PATHS if not dropped(x, own)}
    assert {r.rel_path for r in kept if r.repo == "bare"} == \
        {x for x in PATHS if not dropped(x, c.SKIP_DIRS)}
    assert len(kept) == len({(r.repo, r.rel_path) for r in kept})


def test_required_file_fingerprint_and_rebuild(spark):
    content = "FROM python:3.11"
    files = spark.createDataFrame(
        [("a", ".env/Dockerfile", content), ("b", "x", ""), ("c", ".env/Dockerfile", "FROM go")],
        "repo string, rel_path string, content string")
    repos = files.select("repo")
    assert [r.repo for r in f.require_file(repos, files, ".env/Dockerfile").collect()] == ["b"]
    with pytest.raises(FileNotFoundError, match="Dockerfile"):
        f.assert_required_file(repos, files, ".env/Dockerfile")
    tags = f.content_tags(files, ".env/Dockerfile", "box")
    first = "box:" + hashlib.sha256(content.encode()).hexdigest()[:12]
    assert tags.where("repo = 'a'").first().tag == first
    built = spark.createDataFrame([(first,), (first,)], "tag string")
    assert {(r.repo, r.action) for r in f.rebuild_decision(tags, built).collect()} == \
        {("a", "reuse"), ("c", "build")}


def test_test_file_names(spark):
    rows = spark.createDataFrame([(x,) for x in [*c.TEST_SUFFIX, "COBOL"]], "language string")
    got = {r.language: r for r in f.test_file_lookup(rows, "t").collect()}
    assert got["COBOL"].test_file == "t.txt" and got["COBOL"].run_command == "cat t.txt"
    assert got["rust"].run_command == "rustc t.rs && ./t"
    assert got["c-sharp"].run_command == "csc tTests.cs && mono tTests.exe"
    assert all(r.test_file in r.run_command or lang == "erlang" for lang, r in got.items())


def test_ignore_rules_that_are_no_plain_globs(spark):
    lines = ["foo[", "build\\output", "bin\\Debug", "[^b]1", "[!c]2", "[z-a]x", "q[]]", "t\\", "[a&&b]7", "\\*s"]
    paths = ["foo[", "foo", "buildoutput", "builds/output", "binDebug", "binxebug", "a1", "b1/c", "c2", "d2/e", "mx", "q]", "q",
             "t\\", "&7", "a7", "*s", "xs"]
    rules = f.normalize_ignore_rules(spark.createDataFrame([("r", x) for x in lines], "repo string, line string"),
                                     spark.createDataFrame([("r",)], "repo string"))
    files = spark.createDataFrame([("r", x) for x in paths], "repo string, rel_path string")
    for small in (True, False):
        kept = {r.rel_path for r in f.apply_ignore_rules(files, rules, small).collect()}
        assert set(paths) - kept == {"foo[", "buildoutput", "binDebug", "a1", "d2/e", "q]", "t\\", "&7", "a7", "*s"}
    root = f.normalize_ignore_rules(spark.createDataFrame([("r", "/")], "repo string, line string"),
                                    spark.createDataFrame([("r",)], "repo string"))
    for small in (True, False):
        assert f.apply_ignore_rules(files, root, small).count() == 0
