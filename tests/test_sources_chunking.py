import subprocess

from lodelens.functions import chunking as K
from lodelens.sources import files, gitlog
from lodelens.sources.ignore import rule


def test_walk(spark, tmp_path):
    for name, body in {"src/a.py": "x = 1\n", "src/b.bin": "x", "src/c.weird": "a\0b", "node_modules/x.js": "x", "keep/z.min.js": "x", "keep/skip.log": "x", "keep/e.py": "", "README.md": "# hi"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (tmp_path / ".gitignore").write_text("*.log\n/secret/\n")
    files.register(spark)
    df = spark.read.format("source_tree").load(str(tmp_path))
    got = {r.rel_path: r for r in df.collect()}
    assert set(got) == {".gitignore", "README.md", "src/a.py"} and got["src/a.py"].language == "python"
    assert rule("docs/**/x?.md")[0].match("docs/a/xy.md") and rule("# c") is None and rule("!a/")[1:] == (True, True)


def test_git_log_and_blame(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=T", "-c", "user.email=t@t.test", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "bug.py").write_text("a\nb\nc\nd\ne\nf\n")
    run("add", ".")
    run("commit", "-qm", "add bug")
    (tmp_path / "bug.py").write_text("a\nB\nc\nd\ne\nf\n")
    run("commit", "-qam", "fix it")
    run("mv", "bug.py", "moved.py")
    run("commit", "-qm", "rename")
    rows = list(gitlog.log(str(tmp_path)))
    assert [r[4] for r in rows] == ["rename", "fix it", "add bug"]
    assert rows[0][5] == [("moved.py", "R", 0, 0, "bug.py")] and rows[1][5] == [("bug.py", "M", 1, 1, None)]
    assert gitlog.blame_fix(str(tmp_path), rows[1][0]) == [(rows[1][0], rows[2][0], "bug.py", 1)]
    files.register(spark)
    assert spark.read.format("git_log").load(str(tmp_path)).count() == 3
    assert gitlog.snapshot(str(tmp_path))["dirty"] is False and len(gitlog.ref_fingerprint(str(tmp_path))) == 64
    fixes = spark.createDataFrame([(rows[1][0],)], "commit string")
    assert gitlog.attributions(fixes, str(tmp_path)).count() == 1


def test_chunkers():
    py = "import os\n\nX = 1\n\n@d\ndef f():\n    pass\n\nclass A:\n    def m(self):\n        return 1\n"
    got = [(c.symbol, c.symbol_kind, c.start_line, c.end_line) for c in K.chunk_text(py, "python")]
    assert got == [(None, "module", 1, 1), ("X", "assignment", 3, 3), ("f", "decorated_definition", 5, 7), ("A", "class_definition", 9, 11)]
    md = "intro\n\n# A\ntext\n```\n# no\n```\n## B\nmore"
    assert [(c.symbol, c.start_line, c.end_line) for c in K.chunk_text(md, "markdown")] == [(None, 1, 1), ("A", 3, 7), ("A > B", 8, 9)]
    assert [c.symbol for c in K.chunk_text("T\n===\nx\n\nU\n---\ny\n", "rst")] == ["T", "T > U"]
    go = "package x\n\nfunc (s *S) Run(a int) error {\n\treturn nil\n}\n"
    assert [(c.symbol, c.symbol_kind) for c in K.chunk_text(go, "go")] == [(None, "module"), ("Run", "method_declaration")]
    big = "class B:\n" + "".join(f"    def m{i}(self):\n" + "        x = 'abcdefghij'\n" * 30 for i in range(4))
    parts = K.chunk_text(big, "python")
    assert {"B", "B.m0", "B.m3"} <= {c.symbol for c in parts} and all(len(c.text) <= K.MAX_CHARS for c in parts)
    long = K.chunk_text("x" * 5000, None)
    assert [len(c.text) for c in long] == [1920, 1920, 1640] and K.chunk_text("", "python") == [] and K.chunk_text("def (", "python")[0].symbol_kind == "file"


def test_prose_overlaps_and_windows():
    text = "\n\n".join(f"paragraph {i} " + "word " * 60 for i in range(20))
    parts = K.chunk_text(text, "text")
    assert all(len(c.text) <= K.MAX_CHARS for c in parts) and all(a.end_line >= b.start_line for a, b in zip(parts, parts[1:]))
    lines = K.chunk_text("\n".join(f"line {i}" * 5 for i in range(300)), None)
    assert lines[0].start_line == 1 and lines[-1].end_line == 300 and all(b.start_line <= a.end_line for a, b in zip(lines, lines[1:]))


def test_registry_is_complete(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["project_id", "rel_path"]


def test_stream(spark, tmp_path):
    from lodelens.streaming.windows import process_new

    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.range(5).write.parquet(src)
    for _ in range(2):
        process_new(spark.readStream.schema("id long").parquet(src), lambda b: b, out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_one_large_folder_is_divided(spark, tmp_path):
    for i in range(6):
        (tmp_path / "src" / f"d{i}" / "e").mkdir(parents=True)
        (tmp_path / "src" / f"d{i}" / "e" / "a.py").write_text("x = 1\n")
        (tmp_path / "src" / f"d{i}" / "b.py").write_text("x = 1\n")
    files.register(spark)
    want = sorted(f"src/d{i}/{n}" for i in range(6) for n in ("b.py", "e/a.py"))
    for n in (1, 4, 64):
        df = spark.read.format("source_tree").option("partitions", n).load(str(tmp_path))
        assert sorted(r.rel_path for r in df.collect()) == want
        assert n == 1 or df.rdd.getNumPartitions() >= n - 60


def test_log_in_ranges(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=T", "-c", "user.email=t@t.test", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(7):
        (tmp_path / "a").write_text(f"{i}\n")
        run("add", ".")
        run("commit", "-qm", f"m{i}")
    files.register(spark)
    read = lambda **o: sorted(r.message for r in spark.read.format("git_log").options(**o).load(str(tmp_path)).collect())
    assert read(commitsperpartition=2) == read() == [f"m{i}" for i in range(7)]
    assert read(commitsperpartition=2, maxcommits=3) == ["m4", "m5", "m6"] and read(range="HEAD~2..HEAD", commitsperpartition=1) == ["m5", "m6"]


def test_go_groups():
    go = "package x\n\nconst (\n\tA = 1\n\tB = 2\n)\n\nvar (\n\tc int\n)\n\nfunc F() {\n}\n"
    assert [(c.symbol, c.symbol_kind, c.start_line, c.end_line) for c in K.chunk_text(go, "go")][1:] == [("A", "const_declaration", 3, 6), ("c", "var_declaration", 8, 10), ("F", "function_declaration", 12, 13)]


def test_windows_against_a_plain_definition():
    import random

    rnd = random.Random(2)
    for _ in range(300):
        lines = ["x" * rnd.choice((0, 1, 5, 9, 30)) for _ in range(rnd.randint(1, 12))]
        limit, overlap = rnd.choice((10, 20)), rnd.choice((0, 3))
        got = list(K.line_windows(lines, 1, None, "f", limit, overlap))
        assert all(len(c.text) <= limit and c.text.strip() for c in got)
        covered = {n for c in got for n in range(c.start_line, c.end_line + 1)}
        assert {i + 1 for i, x in enumerate(lines) if x.strip()} <= covered
        for a, b in zip(got, got[1:]):
            if a.end_line < len(lines) and a.start_line < b.start_line and max(len(x) for x in lines[a.start_line - 1 : b.end_line]) <= limit:
                # none could have been longer, and each begins as late as the overlap allows
                assert len("\n".join(lines[a.start_line - 1 : a.end_line + 1])) > limit
                assert b.start_line == a.start_line + 1 or sum(len(x) + 1 for x in lines[b.start_line : a.end_line]) < max(overlap, 1)
