from pyspark.sql import functions as F

from lodelens.functions import paths, text
from lodelens.plans import catalog as C
from lodelens.plans import lookup as L

CH = "project_id string, rel_path string, chunk_id string, language string, symbol string, symbol_kind string, chunk_role string, start_line int, end_line int, text string"
META = "project_id string, path string, language string, chunks int, indent_complexity double"


def chunks(spark):
    rows = [
        ("p", "src/app.py", "1", "python", "A", "class_definition", None, 1, 9, "class A:\n  retry(1)"), ("p", "src/app.py", "2", "python", "A.run", "function_definition", "executable", 3, 5, "def run\nretry() retry()"),
        ("p", "src/app.py", "2", "python", "A.run", "function_definition", "executable", 3, 5, "def run\nretry() retry()"), ("p", "tests/test_x.py", "3", "python", "t", "function_definition", "", 1, 2, "x"),
        ("p", "docs/readme.md", "4", "markdown", None, "section", None, None, None, None), ("p", None, "5", None, None, None, None, None, None, "y"),
    ]
    return spark.createDataFrame(rows, CH)


def test_catalog_map_filters_and_facets(spark):
    meta = spark.createDataFrame([("p", "src/app.py", None, 7, 2.5), ("p", "empty/none.go", "go", 0, None)], META)
    files = C.build(chunks(spark), meta)
    by = {r.path: r for r in files.collect()}
    assert by["src/app.py"].chunks == 2 and by["src/app.py"].roles == {"executable": 2} and len(by["src/app.py"].symbols) == 2
    assert by["empty/none.go"].chunks == 0 and by["docs/readme.md"].kinds == ["doc"] and by["docs/readme.md"].dir == "docs"
    t = C.totals(C.filtered(files)).first()
    assert (t.files, t.chunks, t.symbols) == (3, 4, 3)
    names = lambda **k: {r.path for r in C.filtered(files, **k).collect()}
    assert names(non_empty=False) == {"src/app.py", "empty/none.go", "docs/readme.md", "tests/test_x.py"}
    assert names(code_only=True) == {"src/app.py", "tests/test_x.py"} and names(kinds="test") == {"tests/test_x.py"}
    assert names(path_prefix="src") == {"src/app.py"} and names(path_prefix="sr") == set() and names(path_glob="**/*.md") == {"docs/readme.md"}
    assert names(symbol_kinds="class_definition") == {"src/app.py"} and names(min_symbols=2) == {"src/app.py"}
    m = {r.dir: r for r in C.directory_map(C.filtered(files), 1).collect()}
    assert m["src"].languages == {"python": 1} and m["src"].roles == {"executable": 2} and m["docs"].kinds == {"doc": 1}
    f = {(r.facet, r.value): r.n for r in C.facet_counts(files).collect()}
    assert f["chunk_role", "executable"] == 2 and f["kind", "doc"] == 1 and f["language", "go"] == 1
    assert C.page(C.directory_counts(files, 0), [F.col("dir")], 0, 0).count() == 0


def test_globs(spark):
    import re

    ok = lambda g, p: bool((r := paths.glob_regex(g)) and re.search(r, p))
    assert ok("src/**/*.py", "src/a.py") and ok("src/**/*.py", "src/a/b.py") and not ok("*.py", "src/a.py")
    assert ok("**", "a/b") and ok("src/**", "src") and ok("a?c/[!x]*", "abc/y") and not ok("a?c/[!x]*", "abc/x")
    assert not ok("/".join(["**"] * 40 + ["x"]), "/".join("a" * 36)) and paths.glob_regex("a" * 513) is None


def test_roles_languages_generated_complexity(spark):
    rows = [("src/x.py", "python", "function_definition"), (".github/w.yml", "yaml", "file"), ("a/test_x.py", "python", "module"), ("x.html", "html", ""), ("x.go", "go", "type_declaration"), (None, None, None)]
    df = spark.createDataFrame(rows, "p string, l string, k string")
    assert [r[0] for r in df.select(paths.chunk_role("p", "l", "k")).collect()] == ["executable", "config", "test", "template", "comment", "comment"]
    assert [r[0] for r in df.select(paths.language("p")).collect()] == ["python", "yaml", "python", "html", "go", None]
    t = spark.createDataFrame([("def f():\n    a\n# c\n\tb\n        c\n",), ("x\ny",), ("a\0  b",), (None,), ("",)], "t string")
    assert [r[0] for r in t.select(text.indent_complexity("t")).collect()] == [4.0, 0.0, 0.0, 0.0, 0.0]
    g = spark.createDataFrame([("// Code generated by x", "go"), ("\n" * 9 + "@generated", "go"), ("@generated", "rst"), ("x" * 5001, "go"), ("x" * 5001, "markdown"), (None, None)], "t string, l string")
    assert [r[0] for r in g.select(text.looks_generated("t", "l")).collect()] == [True, False, False, True, False, False]


def test_lookups(spark):
    c = chunks(spark)
    assert [r.chunk_id for r in L.definitions(c.distinct(), "run").collect()] == ["2"]
    assert L.suggestions(c, "ru").first() is not None
    assert [(r.chunk_id, r.parent_id) for r in L.parents(c.distinct()).collect()] == [("2", "1")]
    n = L.neighbours(c.distinct(), c.where("chunk_id = '1'"), 9).collect()
    assert [(r.neighbour_id, r.relative_position) for r in n] == [("2", 1)]
    g = L.grep(c.distinct(), r"retry\(").collect()
    assert [(r.rel_path, r.matches, r.lines, r.first_line) for r in g] == [("src/app.py", 3, 2, 2)]
    assert L.grep(c, "(a+)+$").count() == 0


def test_suggestions_pages_of_grep_and_context(spark):
    assert L.likeness("ru", "A.run") == 2 * 2 / 7 + L.BEGINS and L.likeness("un", "A.run") == 2 * 2 / 7 + L.CONTAINS
    c = chunks(spark).distinct()
    assert [(r.symbol, r.score) for r in L.suggestions(c, "A.run").collect()][0] == ("A.run", 1.0)
    found, like = L.find_definition(c, "run")
    assert like is None and found.count() == 1 and L.find_definition(c, "rum")[1].first().symbol == "A.run"
    r = L.grep_page(c, r"retry\(", limit=1, include_lines=True, max_matches=1).first()
    assert (r.rel_path, r.matches, r.has_more, [(x.line_no, x.line) for x in r.listed]) == ("src/app.py", 3, False, [(2, "  retry(1)")])
    assert L.grep_page(c, "nothing at all").count() == 0
    got = {r.chunk_id: r for r in L.get_chunks(c, c.where("chunk_id = '2'")).collect()}
    assert got["2"].parent_id == "1" and [n.neighbour_id for n in got["2"].neighbours] == ["1"] and len(got) == 1
    assert {(r.symbol, r.n_chunks) for r in L.symbol_inventory(c).collect()} == {("A", 1), ("A.run", 1), ("t", 1)}


def test_repeated_rows_with_texts(spark):
    rows = [("p", "1", "x" * 9), ("p", "1", "x" * 9), ("p", "1", "y"), ("p", "2", None), ("p", "2", None), (None, None, None)]
    df = spark.createDataFrame(rows, "project_id string, chunk_id string, text string")
    assert sorted(map(str, C.distinct_chunks(df, "project_id", "chunk_id", "text").collect())) == sorted(map(str, df.distinct().collect()))


def test_names_by_the_table(spark):
    c = chunks(spark).distinct()
    names = spark.createDataFrame([(1, "run"), (2, "A.run"), (3, "un"), (4, ""), (5, None), (6, "rum")], "query_id long, name string")
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in L.definitions_of(c, names).collect()} == {(1, "2", 1), (2, "2", 1)}
    got = {}
    for r in L.suggestions_of(c, names).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.symbol, r.score))
    for q, n in ((1, "run"), (2, "A.run"), (3, "un"), (6, "rum")):
        want = sorted(((-L.likeness(n.lower(), s), s) for s in ("A", "A.run", "t") if L.likeness(n.lower(), s) >= L.LEAST))
        assert sorted(got.get(q, [])) == [(i + 1, s, round(min(-x, 1.0), 3)) for i, (x, s) in enumerate(want)]
