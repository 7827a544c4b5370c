"""Streams give what one batch over the same rows gives."""

import random

from symgrove.operators.files import map_language, prune_dirs
from symgrove.operators.runs import fold_runs
from symgrove.operators.symbols import symbol_nodes
from symgrove.plans import manifest as m
from symgrove.plans.end_to_end import ingest_trees, search_stored
from symgrove.plans.storage import read_nodes
from symgrove.schemas import FILES
from symgrove.streaming.folding import fold_stream, latest_runs
from symgrove.streaming.ingest import ingest_stream

from test_runs import ATTEMPT, _log


def test_fold_stream_with_late_rows_in_two_starts(spark, tmp_path):
    rows = _log(9, 40)
    random.Random(2).shuffle(rows)
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, ATTEMPT).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).parquet(source)
        fold_stream(stream, out, check).awaitTermination()
    got = latest_runs(spark, out)
    want = fold_runs(spark.createDataFrame(rows, ATTEMPT))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_ingest_stream_resumes_and_equals_batch(spark, tmp_path):
    def drop(names):
        rows = [("r", n, bytearray(f"def f_{i}():\n    pass\n".encode())) for i, n in names]
        spark.createDataFrame(rows, FILES).repartition(2, "rel_path").write.mode("append").parquet(source)

    source, table, check = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check")
    first = [(i, f"src/a{i}.py") for i in range(6)] + [(90, "node_modules/x.py"), (91, "notes.txt")]
    for names in (first, [(i, f"src/b{i}.py") for i in range(6, 9)], [(92, "only.txt")]):
        drop(names)
        ingest_stream(spark, source, table, check, files_per_batch=1).awaitTermination()
    files = map_language(prune_dirs(spark.read.schema(FILES).parquet(source)))
    want = symbol_nodes(files, ("repo", "rel_path"))
    got = read_nodes(spark, table)
    assert got.count() == 9
    assert sorted(r.node_id for r in got.collect()) == sorted(r.node_id for r in want.collect())


def _drop(spark, path, repo, names):
    rows = [(repo, f"src/{n}.py", bytearray(f"def {n}():\n    pass\n".encode())) for n in names]
    spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(path)


def test_streams_with_their_own_checkpoints_add_to_one_table(spark, tmp_path):
    table = str(tmp_path / "table")
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "c.py").write_text("def gamma_three():\n    pass\n")
    ingest_trees(spark.createDataFrame([("z", str(tmp_path / "tree"))], "repo string, root string"), table)
    for i, (repo, name) in enumerate([("x", "alpha_one"), ("y", "beta_two")]):
        _drop(spark, str(tmp_path / f"in{i}"), repo, [name])
        ingest_stream(spark, str(tmp_path / f"in{i}"), table, str(tmp_path / f"check{i}")).awaitTermination()
    # The first stream goes on after a restart.
    _drop(spark, str(tmp_path / "in0"), "x", ["delta_four"])
    ingest_stream(spark, str(tmp_path / "in0"), table, str(tmp_path / "check0")).awaitTermination()
    names = {"alpha_one", "beta_two", "gamma_three", "delta_four"}
    assert {r.symbol_name for r in read_nodes(spark, table).collect()} == names
    asked = spark.createDataFrame(list(enumerate(sorted(names))), "qid bigint, query string")
    assert {r.symbol_name for r in search_stored(spark, table, asked).collect()} == names
    writers = {c.writer for c in m.Manifest(spark, table).live}
    assert len(writers) == 3 and sum(w.startswith("stream:") for w in writers) == 2


def test_two_streams_of_runs_and_compaction(spark, tmp_path):
    out, logs = str(tmp_path / "out"), [_log(9, 40), [(r + 1000, *rest) for r, *rest in _log(4, 12)]]
    for i, rows in enumerate(logs):
        source = str(tmp_path / f"in{i}")
        for part in (rows[::3], rows[1::3], rows[2::3]):
            spark.createDataFrame(part, ATTEMPT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).parquet(source)
        fold_stream(stream, out, str(tmp_path / f"check{i}"), compact_every=2).awaitTermination()
    want = fold_runs(spark.createDataFrame(logs[0] + logs[1], ATTEMPT))
    got = latest_runs(spark, out)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    live = m.Manifest(spark, out).live
    assert any(c.writer == m.COMPACTION for c in live) and len(live) < 6
    some = latest_runs(spark, out, [1, 1001])
    assert some.exceptAll(want.where("run_id IN (1, 1001)")).isEmpty() and some.count() == \
        want.where("run_id IN (1, 1001)").count()


def test_files_of_a_batch_are_scanned_by_several_tasks(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    _drop(spark, source, "x", [f"name_{i}" for i in range(40)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ingest_stream(spark, source, table, str(tmp_path / "check")).awaitTermination()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert read_nodes(spark, table).count() == 40
    assert len(list((tmp_path / "table" / "nodes").rglob("part-*.parquet"))) > 1
