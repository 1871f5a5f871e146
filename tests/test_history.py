import pytest

from lodelens.plans import history as H

SCHEMA = "project_id string, commit string, parents array<string>, ts long, author string, message string, paths array<struct<path: string, status: string, added: int, deleted: int, old_path: string>>, loaded_at timestamp"


def commits(spark, rows):
    full = [("p", c, parents, ts, author, msg, None if files is None else [(f, "M", a, d, None) for f, a, d in files], None) for c, parents, ts, author, msg, files in rows]
    return spark.createDataFrame(full, SCHEMA)


def test_grouping_by_commit_and_ticket(spark):
    c = commits(spark, [("c1", ["x"], 1, "a", "ABC-1 add a", [("a.py", 1, 0)]), ("c2", ["x"], 2, "a", "ABC-1 add b", [("./b.py", 1, 0)]), ("c3", ["x"], 3, "a", "no ticket", [("c.py", 1, 0)]), ("c3", ["x"], 3, "a", "no ticket", [("c.py", 1, 0)])])
    assert H.change_sets(H.change_ids(c)).count() == 3
    assert {(r.change, r.n_files) for r in H.change_sets(H.change_ids(c, "ticket")).collect()} == {("ABC-1", 2), ("c3", 1)}


def test_noise(spark):
    c = commits(spark, [("big", ["x"], 1, "a", "m", [(f"f{i}", 1, 0) for i in range(51)]), ("merge", ["x", "y"], 2, "a", "m", [("z", 1, 0)]), ("none", None, None, None, None, None)])
    r = H.noise(H.change_ids(c), 50).first()
    assert (r.kept, r.large, r.empty, r.merges) == (0, 1, 2, 1)


def test_churn_and_hotspots(spark):
    day = 86400
    now = 200 * day
    c = commits(spark, [("1", ["x"], now, "a", "fix hot path", [("hot.py", 3, -2)]), ("2", ["x"], now - 100 * day, "a", "feature", [("hot.py", 1, 1)]), ("3", ["x"], now - day, "a", "other", [("low.py", 1, 0)])])
    churn = H.churn(H.kept_files(H.change_ids(c)))
    r = {x.path: x for x in churn.collect()}
    assert (r["hot.py"].changes, r["hot.py"].recent_changes, r["hot.py"].fix_density, r["hot.py"].churn_lines) == (2, 1, 0.5, 5)
    files = spark.createDataFrame([("p", "hot.py", 1, 1, 10.0), ("p", "low.py", 1, 1, 1.0)], "project_id string, path string, chunks long, symbols long, indent_complexity double")
    q = {x.path: x.quadrant for x in H.hotspots(churn, files).collect()}
    assert q == {"hot.py": "high_churn_high_complexity", "low.py": "low_churn_low_complexity"}


def test_cochange_ranks_by_lift(spark):
    sets = [["a.py", "barrel.py"]] * 3 + [["a.py", "barrel.py", "specific.py"]] * 2 + [["barrel.py"]] * 4 + [["z.py"]]
    c = commits(spark, [(f"c{i}", ["x"], i, "a", "m", [(f, 1, 0) for f in s]) for i, s in enumerate(sets)])
    rows = [r for r in H.cochange(H.kept_files(H.change_ids(c))).collect() if r.path == "a.py"]
    best = {r.other: r for r in rows}
    assert best["specific.py"].rank == 1 and best["specific.py"].lift == 2.0 and best["specific.py"].confidence == 0.4
    assert best["barrel.py"].lift == pytest.approx(1.111111)


def test_windows_break_on_author_and_gap(spark):
    h = 3600
    c = commits(spark, [("a", ["x"], 0, "u", "", [("f", 1, 0)]), ("b", ["x"], 2 * h, "u", "", [("g", 1, 0)]), ("c", ["x"], 4 * h + 1, "u", "", [("f", 1, 0)]), ("d", ["x"], 4 * h + 2, "v", "", [("f", 1, 0)]), ("e", ["x"], 4 * h + 3, "u", "", [("f", 1, 0)])])
    got = {tuple(sorted(r.commits)) for r in H.change_ids(c, "window").groupBy("change").agg({"commit": "collect_list"}).toDF("change", "commits").collect()}
    assert got == {("a", "b"), ("c",), ("d",), ("e",)}


def test_merge_groups_and_defects(spark):
    c = commits(spark, [("new", ["x"], 9, "u", "", [("f", 1, 0)]), ("m", ["x", "y"], 8, "u", "", []), ("old2", ["x"], 7, "u", "", [("f", 1, 0)]), ("old1", ["x"], 6, "u", "", [("f", 1, 0)])])
    assert {r.change for r in H.change_ids(c, "merge").select("change").distinct().collect()} == {"merge-window:new", "merge-window:old2"}
    a = spark.createDataFrame([("f1", "i1", "./bug.py", 1), ("f2", "i1", "bug.py", None), ("", "i1", "bug.py", 1)], "fix_commit string, introducing_commit string, path string, lines int")
    r = H.defects(a).first()
    assert (r.path, r.defect_introducing_lines, r.defect_introducing_commits, r.fix_commits_with_szz) == ("bug.py", 2, 1, 2)


def test_unsafe_patterns_fall_back(spark):
    from lodelens.functions.text import safe_pattern

    for bad in ("[", "(a+)+$", "x" * 600, "(a|aa)+$", "(a?)*b", "(.*)*", "(\\w+\\s?)*$"):
        with pytest.warns(UserWarning):
            assert safe_pattern(bad, "d") == "d"
    assert safe_pattern("(?P<t>a)", "d") == "(?<t>a)"


def test_empty_history(spark):
    c = commits(spark, [])
    for mode in ("commit", "ticket", "window", "merge"):
        assert H.cochange(H.kept_files(H.change_ids(c, mode))).count() == 0


def test_ticket_groups_and_introducers(spark):
    c = commits(spark, [("c1", ["x"], 1, "a", "[AB-1] (7) one", [("a", 1, 0)]), ("c2", ["x"], 2, "a", "none", [("a", 1, 0)])])
    ids = lambda p: sorted(r.change for r in H.change_ids(c, "ticket", p).collect())
    assert ids(r"\[([A-Z]+-\d+)\]") == ["AB-1", "c2"] and ids(r"\[([A-Z]+)-\d+\] \((?P<ticket>\d+)\)") == ["7", "c2"] and ids(r"[A-Z]+-\d+") == ["AB-1", "c2"]
    a = spark.createDataFrame([("p", "f1", "i2", "x", 1), ("p", "f2", "i1", "x", 1), ("p", "f3", "i3", "x", 5)], "project_id string, fix_commit string, introducing_commit string, path string, lines int")
    assert [(r.introducing_commit, r["rank"]) for r in H.introducers(a, 2).orderBy("rank").collect()] == [("i3", 1), ("i1", 2)]


def test_many_rows_of_one_time_are_several_ranges(spark):
    from pyspark.sql import functions as F

    from lodelens.operators.ordered import numbered_runs, previous_rows

    rows = [("k", 0, f"{(i * 37) % 997:03x}é", i % 5) for i in range(300)] + [("k", t, f"c{t}", 1) for t in (-3, 5, 9)] + [(None, 0, "z", 1)]
    df = spark.createDataFrame(rows, "k string, t long, id string, v int").dropDuplicates(["k", "id"])
    every = sorted((r for r in df.where("k = 'k'").collect()), key=lambda r: (r.t, r.id.encode()))
    got = {r.id: r.before.id if r.before else None for r in previous_rows(df, ["k"], "t", ["id"], ["id"], ranges=8).where("k = 'k'").collect()}
    assert got == {b.id: a.id if a else None for a, b in zip([None, *every], every)}
    runs = {r.id: r.run for r in numbered_runs(df, ["k"], "t", ["id"], lambda b, r: b["v"] != r["v"], ["v"], ranges=8).where("k = 'k'").collect()}
    want, n, before = {}, 0, None
    for r in every:
        n += before is None or before != r.v
        want[r.id], before = n, r.v
    assert runs == want


def test_staleness_and_the_map_with_history(spark):
    import datetime

    c = commits(spark, [("a", ["x"], 100, "u", "", [("d/f", 1, 0)]), ("b", ["x"], 200, "u", "", [("d/f", 1, 0)])])
    at = lambda s: datetime.datetime.fromtimestamp(s, datetime.timezone.utc)
    runs = spark.createDataFrame([("p", "Succeeded", None, at(150), at(150)), ("p", "failed", None, at(300), at(300))], "project_id string, status string, started_at timestamp, finished_at timestamp, logged_at timestamp")
    r = H.staleness(c, runs).first()
    assert (r.indexed_at, r.commits_since, r.newest_commit_ts, r.git_stale) == (150, 1, 200, True)
    assert H.staleness(c, runs.where("false")).first().commits_since == 2
    files = spark.createDataFrame([("p", "d/f", 1, 1, 10.0), ("p", "e/g", 2, 1, 1.0)], "project_id string, path string, chunks long, symbols long, indent_complexity double")
    m = {x.dir: (x.files, x.chunks, x.changes, x.hotspots) for x in H.mapped(files, H.hotspots(H.churn(H.kept_files(H.change_ids(c))), files)).collect()}
    assert m == {"d": (1, 1, 2, 1), "e": (1, 2, 0, 0)}
