import pytest
from pyspark.sql import functions as F

from lodelens.plans import evaluation as E
from lodelens.plans import lifecycle as Y
from lodelens.plans import retrieval as R


def test_routing(spark):
    rows = {"parseFile": 1, "parse_file now": 1, "the HTTP client": 1, "say 'x y'": 1, "open main.py": 1, "call _private once": 1, "one": 1, "how does it work": 0, "the bar function": 0}
    df = spark.createDataFrame([(k,) for k in rows], "q string")
    assert {r.q: int(r.h) for r in df.select("q", R.is_hybrid("q").alias("h")).collect()} == rows


def test_fusion_scores_and_buckets(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, chunk_id string, rank int")
    t = spark.createDataFrame([(1, "b", 1)], "query_id long, chunk_id string, rank int")
    info = spark.createDataFrame([("a", "foo", "x.py", None), ("b", "bar", "y.py", None)], "chunk_id string, symbol string, rel_path string, chunk_role string")
    s = R.fuse(v, t, ["chunk_id"]).join(info, "chunk_id").withColumn("q", F.lit("the bar function"))
    best = s.withColumn("s", R.hybrid_score("rrf", "q", "symbol", "rel_path", "chunk_role")).orderBy(F.desc("s")).first()
    assert best.chunk_id == "b" and best.s == pytest.approx(1 / 62 + 1 / 61 + 0.3)
    n = spark.createDataFrame([(0.3, "hybrid", 1, False), (-1.0, "vector", 1, False), (0.0, "x", 1, True), (-9.0, "vector", 20, False)], "r double, m string, k int, a boolean")
    got = [r[0] for r in n.select(R.normalized("r", "m", "k", "a")).collect()]
    assert got == [1.0, 0.6, 0.6, 0.08]
    assert [r[0] for r in spark.createDataFrame([(0.72,), (0.5,), (0.25,), (0.2,)], "s double").select(R.relevance("s")).collect()] == ["high", "medium", "low", "uncertain"]
    with pytest.raises(ValueError):
        R.at_least("x", "huge")


def test_knn_and_search(spark):
    e = spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 0), (4, None, 0), (5, [1.0], 0)], "vec_id long, embedding array<float>, label int")
    assert [r.vec_id for r in R.nearest(e, [1.0, 0.1], 2).collect()] == [2, 3]
    q = e.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    b = R.nearest_batch(e, q, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.distance) for r in b] == [(1, 0.0), (2, 2.0)]
    assert R.match_estimate(R.nearest_batch(e, q, 3)).first().n == 1
    docs = spark.createDataFrame([("p", "1", "a.py", "python", "walkTree", "executable", "walk the tree of files"), ("p", "2", "b.py", "python", "parse", None, "parse a query"), ("p", "3", "c", None, None, None, None)],
                                 "project_id string, chunk_id string, rel_path string, language string, symbol string, chunk_role string, search_text string")
    qs = spark.createDataFrame([(1, "walkTree"), (2, "parse the query please"), (3, "")], "query_id long, query string")
    hits = R.search(docs, qs, k=2).collect()
    first = {r.query_id: r.chunk_id for r in hits if r["rank"] == 1}
    assert first[2] == "2" and all(0 <= r.score_normalized <= 1 for r in hits)


def test_metrics_and_gate(spark):
    cases = spark.createDataFrame([(1, "x.py", None, None, ["d.py"], "nl"), (2, None, ["y.py"], "foo", None, None), (3, "z.py", None, None, None, "nl")],
                                  "query_id long, expected_path string, expected_paths array<string>, expected_symbol string, distractor_paths array<string>, category string")
    hits = spark.createDataFrame([(1, 1, "d.py", ""), (1, 2, "x.py", ""), (2, 1, "y.py", "bar"), (2, 3, "y.py", "A.Foo")], "query_id long, rank int, rel_path string, symbol string")
    m = {r.value: r for r in E.metrics(E.ranks(cases, hits), ["category"]).collect()}
    assert m["all"].n == 3 and m["all"].hit1 == 0 and m["all"].hit5 == pytest.approx(0.6667) and m["all"].mrr == pytest.approx((0.5 + 1 / 3) / 3, abs=1e-4)
    assert m["nl"].mean_delta_rank == -1 and m["(none)"].hnsr5 == 1
    base = spark.createDataFrame([("nl", 0.04, 0.5, 0.7, 0.25), ("gone", 0.0, 0.0, 0.0, 0.0)], "value string, hit1 double, hit5 double, hit10 double, mrr double")
    g = {(r.value, r.metric): r.passed for r in E.gate(base, E.metrics(E.ranks(cases, hits), ["category"])).collect()}
    assert g["nl", "hit1"] and not g["nl", "hit10"] and not g["gone", "hit1"]


def test_cache_and_store(spark, tmp_path):
    c = spark.createDataFrame([("a", 2, [1.0, 2.0], 5.0), ("a", 2, [1.0, 2.0], 9.0), ("b", 2, [1.0, 2.0], 1.0), ("c", 2, None, 7.0), (None, 2, None, None)], "h string, dim int, vec array<float>, last_used_at double")
    assert Y.cache_compact(c).count() == 3
    w = spark.createDataFrame([("a",), ("a",), ("c",), ("z",), (None,)], "h string")
    assert {r.h for r in Y.cache_misses(w, c, 2).collect()} == {"c", "z"}
    assert Y.cache_lookup(w.where("h is not null"), c, 2, 11.0).where("h = 'a'").first().last_used_at == 11.0
    assert {r.h for r in Y.cache_evict(c, 180).collect()} == {"a", "c"} and Y.cache_evict(c, 10**9).count() == 3 and Y.cache_evict(c, 0).count() == 0
    store = Y.ChunkStore(spark, str(tmp_path / "s"))
    assert store.health() == ["not_indexed"]
    rows = spark.createDataFrame([("1", "a.py", "python", None, "def a"), ("2", "b.py", "python", "b", "def b")], "chunk_id string, rel_path string, language string, symbol string, content string")
    assert store.create(rows) == 2
    assert store.upsert(rows.where("chunk_id = '1'").withColumn("content", F.lit("new")).withColumn("more", F.lit(1)), rows.select("rel_path").where("rel_path = 'b.py'")) == 1
    assert store.chunks().first().content == "new" and store.health(store.chunks()) == [] and store.postings().where("term = 'new'").count() == 1
    store.create(rows)
    assert store.reclaim(dry_run=True) == []  # the version before still has buckets of the first
    store.create(rows)
    old = store.reclaim(dry_run=True)
    assert [n.split("-")[0] for n in old] == ["chunks_g1", "chunks_g2", "postings_g1", "postings_g2"] and store.storage()["active"] > 0
    store.reclaim()
    assert store.delete_paths(rows.select("rel_path").limit(0)) == 2 and store.count() == 2


ROW = "chunk_id string, rel_path string, language string, symbol string, content string"


def test_store_touches_only_the_buckets_it_must(spark, tmp_path):
    store = Y.ChunkStore(spark, str(tmp_path / "s"), buckets=8)
    rows = spark.createDataFrame([(str(i), f"f{i}.py", "python", None, f"word{i}") for i in range(24)], ROW)
    store.create(rows)
    before = store.head()["chunks"]
    assert store.upsert(rows.where("chunk_id = '3'").withColumn("content", F.lit("other")), rows.select("rel_path").where("false")) == 24
    after = store.head()["chunks"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.chunks().where("content = 'other'").count() == 1
    assert store.postings().where("term = 'word3'").count() == 0 and store.postings().where("term = 'word4'").count() == 1
    assert store.add(rows.where("chunk_id = '4'").withColumn("chunk_id", F.lit("4b"))) == 25 and store.health() == []
    with pytest.raises(PermissionError):
        Y.ChunkStore(spark, store.folder, read_only=True).create(rows)
    store.drop()
    assert store.head() is None and store.count() == 0


def test_catalogue_refusal_text_index_failure_and_health(spark, tmp_path, monkeypatch):
    store = Y.ChunkStore(spark, str(tmp_path / "s"), buckets=2)
    rows = spark.createDataFrame([("1", "a.py", "python", None, "def a"), ("2", "b.py", "python", "b", "def b")], ROW)
    store.create(rows, model="m1", git={"commit": "c1"})
    files = lambda n: spark.createDataFrame([("p", "a.py", n)], "project_id string, path string, chunks long")
    with pytest.raises(ValueError):
        store.write_catalog(files(1))
    store.write_catalog(files(2))
    assert store.catalog().count() == 1 and store.health(root=str(tmp_path), model="m1", git={"commit": "c1"}) == []
    scan = spark.createDataFrame([("a.py", "h", 1, 1)], "rel_path string, hash string, mtime_ns long, size long")
    assert store.health(root=str(tmp_path / "none"), model="m2", git={"commit": "c2"}, files=scan, scan=scan.withColumn("hash", F.lit("x"))) == ["root_missing", "model_drift", "git_stale", "index_stale"]
    with monkeypatch.context() as m:
        m.setattr(R, "postings", lambda *a: (_ for _ in ()).throw(OSError("no index")))
        with pytest.warns(UserWarning):
            store.upsert(rows, rows.select("rel_path"))
    assert store.health() == ["text_index_missing", "catalog_stale"] and store.chunks().count() == 2
    with pytest.raises(LookupError):
        store.postings()


def test_one_file_again_and_paths_that_escape(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def a():\n    return 1\n")
    (tmp_path / "secret.py").write_text("x = 1\n")
    (root / "link.py").symlink_to(tmp_path / "secret.py")
    store = Y.ChunkStore(spark, str(tmp_path / "s"), buckets=2)
    store.create(spark.createDataFrame([("1", "b.py", "python", None, "def b")], ROW))
    assert store.reindex_file(str(root), "a.py") == 2 and store.chunks().where("symbol = 'a'").count() == 1
    (root / "a.py").unlink()
    assert store.reindex_file(str(root), "./a.py") == 1
    for bad in ("../secret.py", "/etc/passwd", "link.py", "x/../../secret.py", "", "."):
        with pytest.raises(ValueError):
            store.reindex_file(str(root), bad)


def test_projects_orphans_and_cache_put(spark, tmp_path):
    home = str(tmp_path / "home")
    rows = spark.createDataFrame([("1", "a.py", "python", None, "x")], ROW)
    for n in ("live", "gone"):
        Y.ChunkStore(spark, f"{home}/{n}", buckets=1).create(rows)
    (tmp_path / "home" / "half").mkdir()
    roots = {"live": str(tmp_path), "gone": str(tmp_path / "nowhere")}
    assert Y.orphans(spark, home, roots) == ["gone", "half"] and Y.orphans(spark, home, roots, remove=True) == ["gone", "half"]
    assert Y.orphans(spark, home, roots) == [] and Y.remove_project(spark, home, "live") and not Y.remove_project(spark, home, "live")
    with pytest.raises(ValueError):
        Y.remove_project(spark, home, "..")
    c = spark.createDataFrame([("a", 2, [1.0, 2.0], 5.0)], "h string, dim int, vec array<float>, last_used_at double")
    new = spark.createDataFrame([("a", 2, [3.0, 4.0]), ("b", 2, [1.0]), ("c", 1, [float("nan")]), (None, 1, [1.0]), ("d", 1, None), ("e", 1, [7.0])], "h string, dim int, vec array<float>")
    got = {r.h: (r.vec, r.last_used_at) for r in Y.cache_put(c, new, 9.0).collect()}
    assert got == {"a": ([3.0, 4.0], 9.0), "e": ([7.0], 9.0)}


def test_many_queries_take_the_blocked_way(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, [rnd.choice((0.0, 1.0, 2.0)) for _ in range(3)]) for i in range(60)] + [(60, None), (61, [1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    few, many = ({(r.query_id, r.vec_id, r["rank"], r.distance) for r in R.nearest_batch(e, q, 4, block=b).collect()} for b in (512, 7))
    want = set()
    for i, x in rows[:60:2]:
        best = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in rows[:60])[:4]
        want |= {(i, j, n + 1, d) for n, (d, j) in enumerate(best)}
    assert few == many == want


def test_previews_reasons_hints_and_reranking(spark):
    docs = spark.createDataFrame([("p", "1", "a.py", "python", "walkTree", "executable", "walk the tree of files"), ("p", "2", "b.py", "python", "parse", None, "parse a query")],
                                 "project_id string, chunk_id string, rel_path string, language string, symbol string, chunk_role string, search_text string")
    qs = spark.createDataFrame([(1, "walkTree"), (2, "parse the query please")], "query_id long, query string")
    hits = R.search(docs, qs, k=2)
    got = {(r.query_id, r.chunk_id): r for r in hits.collect()}
    assert got[1, "1"].matched_in == ["symbol", "content"] and got[2, "2"].matched_in == ["symbol", "content"]
    back = R.search(docs, qs, k=2, reranker=lambda h: h.withColumn("rerank_score", F.when(F.col("search_text").contains("tree"), -5.0).otherwise(5.0)))
    assert {r.query_id: r.chunk_id for r in back.where("rank = 1").collect()} == {1: "2", 2: "2"}
    t = spark.createDataFrame([("\n first line\nsome retry here\n", "retry"), ("\n\n only\nthis", "none"), (None, "x"), ("y" * 300, "z")], "c string, q string")
    assert [r[0] for r in t.select(R.preview("c", "q")).collect()] == ["some retry here", "only", "", "y" * 159 + "…"]
    none = R.hints(hits.where("false"), qs).collect()
    assert {(r.query_id, r.n_hits, r.hint) for r in none} == {(1, 0, "no_hits"), (2, 0, "no_hits")}


def test_baseline_is_saved_and_cases_are_made(spark, tmp_path):
    c = spark.createDataFrame([("p", str(i), f"d/{i % 3}.py", f"sym{i}", None if i % 2 else "Python") for i in range(40)], "project_id string, chunk_id string, rel_path string, symbol string, language string")
    cases = E.starter_cases(c, 1)
    assert cases.count() == 40 and {tuple(r.distractor_paths) for r in cases.where("expected_path = 'd/1.py'").collect()} == {("d/0.py", "d/2.py")}
    hits = cases.select("query_id", F.lit(1).alias("rank"), F.col("expected_path").alias("rel_path"), F.col("expected_symbol").alias("symbol"))
    report = E.run(cases, hits, ["category"])
    E.save_baseline(str(tmp_path / "base.json"), report)
    base = E.load_baseline(spark, str(tmp_path / "base.json"))
    assert base.exceptAll(report.select(*base.columns)).isEmpty() and E.gate(base, report).where("NOT passed").isEmpty()
    with pytest.raises(FileNotFoundError):
        E.load_baseline(spark, str(tmp_path / "none.json"))


def test_best_hits_without_scores_of_all_matches(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    text = lambda: " ".join(rnd.choices(words, [40, 20, 10, 8, 6, 5, 4, 3, 2, 1, 1, 0.2], k=rnd.randint(1, 9)))
    docs = [(f"p{i % 3}", f"c{i // 3}", text()) for i in range(300)] + [("p1", "none", None), ("p1", "c7", "w1 w11 w11"), ("p2", "zz", "")]
    docs = spark.createDataFrame(docs, "project_id string, chunk_id string, search_text string").where("NOT (project_id = 'p1' AND chunk_id = 'c7' AND search_text <> 'w1 w11 w11')")
    asked = [(i, " ".join(rnd.sample(words, rnd.randint(1, 5)))) for i in range(60)] + [(60, ""), (61, "unknown"), (62, "w0 W1"), (63, "w1 w0"), (64, "unknown w11")]
    asked = spark.createDataFrame(asked, "query_id long, query string")
    ids = ["chunk_id", "project_id"]
    columns = ["query_id", *ids, "score", "rank"]
    want = R.top(R.text_hits(docs, asked, ids), 5, ids).select(*columns).collect()
    monkeypatch.setattr(R, "text_hits", None)
    for asked_at_once, rows_at_once in ((R.ASKED, R.DOCS), (7, 20)):
        monkeypatch.setattr(R, "ASKED", asked_at_once)
        monkeypatch.setattr(R, "DOCS", rows_at_once)
        got = R.best_text_hits(docs, asked, 5, ids, pool=5).select(*columns).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 250


def test_rows_of_one_id_are_one_text(spark):
    docs = spark.createDataFrame([("p", "a", "x y"), ("p", "a", "x z"), ("p", "b", "x z")], "project_id string, chunk_id string, search_text string")
    got = R.best_text_hits(docs, spark.createDataFrame([(1, "x z")], "query_id long, query string"), 5, ["chunk_id", "project_id"]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b"]


def test_gate_never_scores_all_matching_rows(spark, tmp_path, monkeypatch):
    from lodelens.plans import registry

    schema = "project_id string, chunk_id string, rel_path string, language string, symbol string, symbol_kind string, chunk_role string, start_line int, text string"
    rows = [("p", f"c{i}", f"d/f{i}.py", "python", f"sym{i}", None, None, 1, f"def sym{i}") for i in range(120)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "chunks.parquet"))
    monkeypatch.setattr(R, "text_hits", None)
    got = {(r.value, r.metric): (r.now, r.passed) for r in registry.baseline_gate(spark, str(tmp_path)).collect()}
    assert len(got) == 16 and got["all", "hit1"] == got["python", "hit1"] == (1.0, True) and got["cobol", "mrr"] == (None, False)
