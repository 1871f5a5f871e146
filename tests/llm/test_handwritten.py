from lodelens.llm import handwritten as H

SCHEMA = "project_id string, rel_path string, language string, size long, content string, scanned_at timestamp, extra int"
CODE = "import x\n\ndef walk(tree, budget):\n    for node in tree:\n        if node.cost > budget:\n            return node\n    total = sum(tree)\n    print(total, budget, 'of all that was seen')\n    return None\n"


def kind(path, content, language=None):
    return H.judge(path, language, content)[0]


def test_rules():
    licence = "".join(f"# licence line {i}\n" for i in range(20))
    assert kind("a/x.py", licence + "# Code generated by tool v1. DO NOT EDIT.\n" + CODE) == "generated"
    assert kind("a/x.py", "# AUTOGENERATED, do not edit by hand\n" + CODE) == "generated" and kind("a/x.py", "# Automatisch erzeugt von x\n" + CODE) == "generated"
    assert kind("a/x_pb2.py", CODE) is None and kind("a/x.py", CODE + '# The writer puts "Code generated by us, do not edit" on top.\n') is None
    assert kind("a/x.py", "# Written by hand: this one is not generated, so edits are welcome.\n" + CODE) is None
    assert kind("a/x.ts", "".join(f"field_{i} = table.add_row({i}, \"w\");\n" for i in range(30))) == "generated"
    assert kind("a/x.js", "function a(b,c){return b+c};var d=a(1,2);" * 40) == "minified" and kind("a/x.min.js", CODE) is None
    assert kind("a/x.c", "static const char t[] = {\n" + "    0x10, 0x22, 0x9f, 0x00, 0x1b, 0x40, 0x5e, 0x61,\n" * 20 + "};\n") == "data"
    assert kind("a/x.py", CODE * 3 + "T = [1, 2, 3]\n") is None and kind("node_modules/pkg/x.py", CODE) == "vendored" and kind("vendor/pkg/x.py", CODE) is None and kind("node_modules/x.py", CODE) is None
    assert kind("a/package-lock.json", "{}") == "lock" and kind("a/fetch_lockfile.json", '{"a": 1}') is None and kind("docs/a.md", "generated by x. do not edit") is None
    assert kind("x.py", None) is None and kind("x.py", "") is None and kind("a/Pods/k/x.py", None) == "vendored"


def test_copies_across_projects(spark):
    other = CODE.replace("walk", "scan")
    rows = [
        ("p", "lib/x.py", None, 1, CODE, None, 0), ("q", "src/tools/renamed.py", None, 1, "# Copyright q\n" + CODE.replace("\n", "\r\n"), None, 0), ("p", "own.py", None, 1, other, None, 0), ("p", "own2.py", None, 1, other, None, 0),
        ("r", "Pods/k/y.py", None, 1, CODE.replace("tree", "bush"), None, 0), ("r", "app/y.py", None, 1, CODE.replace("tree", "bush"), None, 0), ("p", None, None, 1, CODE, None, 0), ("p", "lib/x.py", None, 1, CODE, None, 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.project_id, r.rel_path) for r in H.not_handwritten(df).collect()}
    assert got == {("p", "lib/x.py"), ("q", "src/tools/renamed.py"), ("r", "Pods/k/y.py"), ("r", "app/y.py")}
    assert H.not_handwritten(df.where("false")).count() == 0


def test_latest_scan_counts(spark):
    from datetime import datetime as T

    rows = [("p", "x.py", None, 1, "# @generated\n" + CODE, T(2024, 1, 1), 0), ("p", "x.py", None, 1, CODE, T(2024, 1, 2), 0)]
    assert H.not_handwritten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_folders_of_small_files(spark):
    leaves = spark.createDataFrame([("p", "a/lib/m/x", "1", False), ("p", "a/lib/m/y", "2", False), ("q", "z/k/x", "1", False), ("q", "z/k/y", "2", False), ("q", "z/o", "3", False)], "project_id string, node string, h string, known boolean")
    assert {("p", "a/lib/m"), ("q", "z/k")} <= {(r.project_id, r.node) for r in H.merkle_copies(leaves).collect()}


def test_blobs_of_every_length_and_layout():
    import base64
    import random

    raw = random.Random(1).randbytes(15_000)
    for n in (19_000, 20_000, 30_000):
        for said in (raw.hex(), "".join(f"\\x{b:02x}" for b in raw), base64.b64encode(raw * 2).decode()):
            for path, head, tail in (("a/x.py", "DATA = (", ")"), ("a/x.go", "var t = []string{", "}"), ("a/x.c", "char t[] = {", "};")):
                assert kind(path, f'import x\n{head}\n    "{said[:n]}",\n{tail}\n') == "data", (n, path)
    b = base64.b64encode(raw[:3000]).decode()
    wrapped = "\n".join(b[i : i + 76] for i in range(0, len(b), 76))
    assert kind("a/x.py", f'import x\n\nDATA = """\n{wrapped}\n"""\n') == "data"
    assert kind("a/x.py", CODE * 3 + f'ICON = "{b[:300]}"\n') is None
    field = [f"field_{i} = table.add_row({i});" for i in range(4000)]
    assert H.is_generated_layout(field) and not H.is_generated_layout(field + CODE.splitlines() * 200)
    assert H.is_literals('"\\"' * 200_000) and not H.is_literals("1" * 200_000 + "n") and not H.is_literals('["a", f(1)]')


def test_short_files_of_a_shared_folder(spark):
    def row(project, path, content):
        return project, path, None, 1, content, None, 0

    short, index = "", "module.exports = require('./lib/walk').walk;\nmodule.exports.all = true;\n"
    rows = [row(p, f"{at}/{n}", c) for p, at in (("p", "lib/walk"), ("q", "src/tools/k")) for n, c in (("__init__.py", short), ("x.py", CODE), ("sub/index.js", index))]
    rows += [row(p, "pkg/__init__.py", "") for p in "pqr"] + [row("q", "src/own.py", CODE.replace("walk", "scan")), row("p", "own/index.js", index)]
    # many short ones are as good as a long one; known copies mark their folder's twin in the same project
    rows += [row(p, f"{at}/f{i}.js", f"module.exports = require('./other/place/of/number{i}');\n") for p, at in (("p", "m"), ("r", "w/m2")) for i in range(5)]
    rows += [row("s", f"{at}/{n}", c) for at in ("Pods/k", "app/k") for n, c in (("y.py", CODE.replace("tree", "bush")), ("__init__.py", ""))]
    got = {(r.project_id, r.rel_path) for r in H.not_handwritten(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(p, f"{at}/{n}") for p, at in (("p", "lib/walk"), ("q", "src/tools/k")) for n in ("__init__.py", "x.py", "sub/index.js")}
    want |= {(p, f"{at}/f{i}.js") for p, at in (("p", "m"), ("r", "w/m2")) for i in range(5)}
    assert got == want | {("s", f"{at}/{n}") for at in ("Pods/k", "app/k") for n in ("y.py", "__init__.py")}


def test_folders_for_copies_need_evidence(spark):
    def row(project, path, content):
        return project, path, None, 1, content, None, 0

    code = [CODE.replace("walk", f"walk{i}").replace("tree", f"tree{i}") for i in range(12)]
    own = [("p", "src/deps/resolver.py"), ("p", "app/external/client.py"), ("p", "vendor/own/x.py")]
    rows = [row(*o, code[i]) for i, o in enumerate(own)]
    # a version, a licence, a header, a copy of another file of the package
    copies = [("q", "third_party/k-1.2.0/a.py", code[3]), ("q", "deps/m/a.py", code[4]), ("q", "deps/m/LICENSE", "x"), ("q", "vendor/n/a.py", code[5]), ("q", "vendor/n/b.py", "# Vendored from upstream.\n" + code[6]), ("q", "extern/o/a.py", code[7]), ("q", "extern/o/b.py", code[8])]
    rows += [row(*c) for c in copies] + [row("r", "lib/any.py", code[8])]
    got = {(r.project_id, r.rel_path) for r in H.not_handwritten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(p, n) for p, n, _ in copies if not n.endswith("LICENSE")} | {("r", "lib/any.py")}
