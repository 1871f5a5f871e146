import random
from itertools import combinations

import pytest

from lodelens import shared
from lodelens.llm import cooccurrence as C

SCHEMA = "project_id string, commit string, parents array<string>, paths array<struct<path: string, status: string, added: int, deleted: int, old_path: string>>, author string, extra int"
DELIVERY = "grp string, basket string, n_parents int, items array<string>"


def commits(spark, rows):
    return spark.createDataFrame([("p", c, par, None if fs is None else [(f, "M", 1, 1, None) for f in fs], None, 0) for c, par, fs in rows], SCHEMA)


def frame(spark, rows):
    return spark.createDataFrame([(g, b, p, sorted(i)) for g, b, p, i in rows], DELIVERY)


def counted(baskets):
    """Brute force over {(group, basket): items}."""
    pairs, items, groups = {}, {}, {}
    for (g, _), fs in baskets.items():
        groups[g] = groups.get(g, 0) + 1
        for f in fs:
            items[g, f] = items.get((g, f), 0) + 1
        for x in combinations(sorted(fs), 2):
            pairs[g, *x] = pairs.get((g, *x), 0) + 1
    return {(g, a, b, n, items[g, a], items[g, b], groups[g]) for (g, a, b), n in pairs.items()}


def found(table, *touched):
    return {(r.grp, r.item_a, r.item_b, r.support, r.n_a, r.n_b, r.n_baskets) for r in table.scores(*touched).collect()}


def test_spellings_duplicates_merges_and_nulls(spark):
    rows = [("c%d" % i, ["x"], ["a.py", "./b.py", "b.py", ".\\b.py ", "", None]) for i in range(5)] + [("m", ["x", "y"], ["a.py", "b.py"]), ("n", None, None), (None, ["x"], ["a.py"]), ("big", ["x"], [f"f{i}" for i in range(51)])]
    rows += [("o%d" % i, [], ["c.py"]) for i in range(20)] + rows[:3]
    got = C.co_changes(commits(spark, rows), 5, 3.0).collect()
    assert [(r.item_a, r.item_b, r.support, r.n_baskets) for r in got] == [("a.py", "b.py", 5, 25)]
    assert C.co_changes(commits(spark, []), 1, 0.0).count() == 0


def test_updates_equal_a_fresh_count(spark, tmp_path):
    rnd = random.Random(1)
    baskets = {("p" if i % 3 else "q", f"b{i}"): rnd.sample("abcdefgh", rnd.randint(1, 5)) for i in range(40)}
    # short hashes: items clash all the time and must be told apart all the same
    t = C.PairCounts(spark, str(tmp_path / "pairs"), bits=3)
    assert t.scores().count() == 0
    first = {k: v for k, v in baskets.items() if k[1] < "b3"}
    t.update(frame(spark, [(g, b, 1, i) for (g, b), i in first.items()]), "one")
    assert found(t) == counted(first)
    for k in [k for k in baskets if k[1] in ("b1", "b10")]:
        baskets[k] = [*baskets[k], "z"]
    second = {k: v for k, v in baskets.items() if k[1] >= "b3" or k[1] in ("b1", "b10")}
    t.update(frame(spark, [(g, b, 1, i) for (g, b), i in second.items()]), "two")
    assert t.update(frame(spark, [("p", "x", 1, ["a"])]), "two") is None
    greatest = {k: max(sorted(v), sorted(first.get(k, []))) for k, v in baskets.items()}
    assert found(t) == counted(greatest)
    gone = [k for k in greatest if k[1] in ("b5", "b22")]
    touched = t.update(frame(spark, []), "three", withdrawn=spark.createDataFrame(gone, "grp string, basket string"))
    left = {k: v for k, v in greatest.items() if k not in gone}
    assert found(t) == counted(left) and found(t, touched) == {r for r in counted(left) if r[0] in {g for g, _ in gone}}
    # what was withdrawn may come again
    t.update(frame(spark, [(*gone[0], 0, ["y", "z"])]), "four")
    assert found(t) == counted(left | {gone[0]: ["y", "z"]})


def test_how_deliveries_are_batched_does_not_matter(spark, tmp_path):
    rows = [("p", "c", 2, ["a", "b"]), ("p", "c", 1, ["a", "b"]), ("p", "d", 1, ["a"]), ("p", "d", 0, ["a", "b"]), ("p", "d", 1, ["b"]), ("p", "e", 1, ["a", "b", "c"]), ("p", "e", 1, ["a", "b", "c"])]
    results = []
    for k, cuts in enumerate(([rows], [rows[:1], rows[1:4], rows[4:]], [rows[::-1][:5], rows[::-1][5:]])):
        t = C.PairCounts(spark, str(tmp_path / f"t{k}"))
        for i, part in enumerate(cuts):
            t.update(frame(spark, part), f"b{i}")
        results.append(found(t))
    assert all(r == results[0] for r in results) and ("p", "a", "b", 1, 1, 2, 2) in results[0]


def test_an_update_that_fails_changes_nothing_and_the_second_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    t = C.PairCounts(spark, str(tmp_path / "t"))
    t.update(frame(spark, [("p", "c", 1, ["a", "b"])]), "one")
    before = found(t)
    for step in ("_exceptions", "_write", "_compared"):
        with monkeypatch.context() as m:
            m.setattr(C.PairCounts, step, lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                t.update(frame(spark, [("p", "d", 1, ["a", "b"])]), "two")
        assert found(t) == before
    commit = shared.commit_version

    def late(*a, **k):
        monkeypatch.setattr(shared, "commit_version", commit)
        C.PairCounts(spark, t.folder).update(frame(spark, [("p", "e", 1, ["a", "c"])]), "other")
        return commit(*a, **k)

    monkeypatch.setattr(shared, "commit_version", late)
    with pytest.raises(shared.Conflict):
        t.update(frame(spark, [("p", "d", 1, ["a", "b"])]), "two")
    t.update(frame(spark, [("p", "d", 1, ["a", "b"])]), "two")
    assert {(r[1], r[2], r[3]) for r in found(t)} == {("a", "b", 2), ("a", "c", 1)}


def test_a_small_batch_rewrites_little(spark, tmp_path):
    t = C.PairCounts(spark, str(tmp_path / "t"))
    t.update(frame(spark, [("p", f"c{i}", 1, ["a", f"x{i}", f"y{i}"]) for i in range(300)]), "one")
    big = t._head()[1]["runs"]["pairs"][0]
    t.update(frame(spark, [("p", "new", 1, ["a", "x1"])]), "two")
    runs = t._head()[1]["runs"]["pairs"]
    assert runs[0] == big and runs[1]["rows"] == 1
