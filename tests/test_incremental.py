import pytest
from pyspark.sql import functions as F

from lodelens.operators import incremental as I

SCAN = "project_id string, rel_path string, file_hash string, mtime_ns long, size long, scanned_at timestamp, extra int"
FILES = "project_id string, run_id string, rel_path string, file_hash string, mtime_ns long, size long, language string"
RUNS = "project_id string, run_id string, run_seq int, status string, logged_at timestamp"
T = __import__("datetime").datetime


def tables(spark, scan, files, runs):
    return spark.createDataFrame(scan, SCAN), spark.createDataFrame(files, FILES), spark.createDataFrame(runs, RUNS)


def test_hash_size_time_and_failed_runs(spark):
    t = T(2024, 1, 1)
    scan = [
        ("p", "same", "AB", 1, 1, t, 0), ("p", "case", "sha256:ab", 9, 9, t, 0), ("p", "changed", "ff", 1, 1, t, 0), ("p", "new", "aa", 1, 1, t, 0),
        ("p", "nohash", None, 5, 7, t, 0), ("p", "nohash2", None, 5, 8, t, 0), ("p", "failed", "cc", 1, 1, t, 0), ("p", "nostat", None, None, 7, t, 0),
        ("p", "old", "00", 1, 1, T(2023, 1, 1), 0), ("p", "old", "11", 1, 1, t, 0), ("p", "old", "11", 1, 1, t, 0), ("p", None, "x", 1, 1, t, 0),
    ]
    files = [
        ("p", "r1", "same", "ab", 3, 3, None), ("p", "r1", "case", "AB", 1, 1, None), ("p", "r1", "changed", "ee", 1, 1, None), ("p", "r1", "nohash", "zz", 5, 7, None),
        ("p", "r1", "nohash2", "zz", 5, 7, None), ("p", "r2", "failed", "cc", 1, 1, None), ("p", "r1", "nostat", "q", None, 7, None), ("p", "r1", "gone", "q", 1, 7, None),
        ("p", "r1", "old", "99", 1, 1, None), ("p", "r3", "old", "11", 1, 1, None), ("p", "r3", "old", "11", 1, 1, None),
    ]
    runs = [
        ("p", "r1", 1, "running", t), ("p", "r1", 1, "Succeeded", T(2024, 1, 2)), ("p", "r2", 2, "SUCCEEDED", t), ("p", "r2", 2, "failed", T(2024, 1, 3)),
        ("p", "r3", 3, " succeeded", t), ("p", "r3", 3, " succeeded", t),
    ]
    got = sorted(r.rel_path for r in I.files_to_index(*tables(spark, scan, files, runs)).collect())
    assert got == ["changed", "failed", "new", "nohash2", "nostat"]


def test_empty_tables_and_null_projects(spark):
    t = T(2024, 1, 1)
    assert I.files_to_index(*tables(spark, [], [], [])).count() == 0
    scan = [(None, "a", "x", 1, 1, t, 0), ("p", "b", None, None, None, None, 0)]
    assert I.files_to_index(*tables(spark, scan, [], [])).count() == 2


def test_change_states(spark):
    s = "k string, hash string, mtime_ns long, size long"
    old = spark.createDataFrame([("a", "1", 1, 1), ("b", "1", 1, 1), ("c", "1", 1, 1)], s)
    new = spark.createDataFrame([("a", "1", 2, 2), ("b", "2", 1, 1), ("d", "1", 1, 1)], s)
    assert {r.k: r.state for r in I.change_states(old, new, ["k"]).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "added"}


def test_index_pending_commits_and_repeats(spark, tmp_path):
    t = T(2024, 1, 1)
    files, runs = [("p", "r1", "same", "ab", 3, 3, None)], [("p", "r1", 1, "succeeded", t)]
    scan = [("p", "same", "AB", 1, 1, t, 0), ("p", "new", "aa", 1, 1, t, 0), (None, "orphan", None, None, None, t, 0)]
    state = str(tmp_path / "state")
    names = lambda s: sorted(r.rel_path for r in I.index_pending(*tables(spark, s, files, runs), state).collect())
    assert names(scan) == ["new", "orphan"]
    # what was taken is known now; without hash, size and time there is no telling that it is the same
    assert names(scan) == ["orphan"]
    # there and back again: each change counts
    later = lambda h, d: [*scan, ("p", "new", h, 1, 1, T(2024, 1, d), 0)]
    assert names(later("bb", 2)) == ["new", "orphan"] and names(later("aa", 3)) == ["new", "orphan"]
    assert sorted(r.rel_path for r in I.index_pending(*tables(spark, scan, files, runs)).collect()) == ["new", "orphan"]
    assert I.index_pending(*tables(spark, [], [], [])).count() == 0


def write(folder, name, *ids):
    import pandas as pd

    folder.mkdir(parents=True, exist_ok=True)
    pd.DataFrame({"id": list(ids)}).to_parquet(folder / name)


def test_a_file_that_changes_back_is_processed_again_and_deletions_are_seen(spark, tmp_path):
    src = tmp_path / "src"
    write(src / "deep" / "er", "a b.parquet", 1)
    write(src, "b.parquet", 2)
    run = I.IncrementalRun(spark, str(tmp_path / "state"), str(tmp_path / "out"))
    go = lambda: run.run(str(src), lambda df: df.select("id", "source_path"), glob="*.parquet")
    ids = lambda: sorted(r.id for r in run.result().collect())
    assert len(go()) == 1 and ids() == [1, 2] and go() == []
    for x in (7, 1):
        write(src / "deep" / "er", "a b.parquet", x)
        assert len(go()) == 1 and ids() == sorted([x, 2])
    # touched: another time, the same content
    import os

    os.utime(src / "b.parquet", (1, 1))
    n = run.manifest().where("path like '%/b.parquet'").first().source_batch
    assert len(go()) == 1 and ids() == [1, 2] and run.manifest().where("path like '%/b.parquet'").first().source_batch == n
    (src / "b.parquet").unlink()
    assert len(go()) == 1 and ids() == [1] and run.manifest().count() == 1


def test_failures_between_all_steps_and_two_writers(spark, tmp_path, monkeypatch):
    from lodelens import shared

    src = tmp_path / "src"
    for i in range(3):
        write(src, f"{i}.parquet", i)
    run = I.IncrementalRun(spark, str(tmp_path / "state"), str(tmp_path / "out"), max_files=2)
    double = lambda df: df.selectExpr("id", "id * 2 as x", "source_path")

    def lost(*a, **k):
        raise OSError("lost")

    with pytest.raises(OSError):
        run.run(str(src), lost)
    for owner, step in ((I.Ledger, "record"), (I.Ledger, "commit"), (shared, "_rename")):
        with monkeypatch.context() as m:
            m.setattr(owner, step, lost)
            with pytest.raises(OSError):
                run.run(str(src), double)
        assert run.manifest().count() == 0
    assert run.run(str(src), double)
    assert sorted((r.id, r.x) for r in run.result().collect()) == [(0, 0), (1, 2), (2, 4)]
    version = run.ledger.version()
    with pytest.raises(shared.Conflict):
        run.ledger.commit(version - 1, "late")
