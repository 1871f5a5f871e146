"""Generated, minified and vendored source files, and data saved as code.

Method. Content leaves and directories get Merkle hashes, bottom-up, level by level; a subtree or a file that occurs in more than
one project marks a third-party copy wherever it lies; short files, which alone may agree by chance, are marked by their folder. Header rules (what the leading comment says) and
layout rules (how the lines look) find generated and minified files, lock files and data tables. A telling name
or directory is never enough on its own, except a package in the folders that package managers fill: in a folder like ``vendor`` or
``deps`` a package is a copy if a file of it stands elsewhere too or says so, or if it has a version, a licence or a package file.

Scale. File contents are read once, by Arrow batches, and never shuffled: what leaves the Python worker is one narrow row per
file. A directory's hash is a count, a sum and an exclusive-or over its entries' hashes, so a directory with a
third of all files is combined before the shuffle. Copies are found by grouping hashes, without pairs of projects.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodelens import shared

# Folders that package managers fill; what lies in a package below them is installed.
PACKAGE_FOLDERS = ["node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "Pods", "Carthage", "Godeps"]
# Folders where third-party copies often lie, and hand-written code may.
VENDOR_FOLDERS = ["vendor", "_vendor", "_vendored", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "extern", "deps"]
# What a published package brings along.
PACKAGE_MARKS = [
    "license", "license.txt", "license.md", "copying", "notice", "authors", "package.json", "setup.py", "setup.cfg", "pyproject.toml", "pkg-info", "metadata", "record",
    "go.mod", "cargo.toml", "pom.xml", "gemspec", "composer.json", "version", "version.txt", "vendor.json", "modules.txt", "readme.vendor", "metadata.json",
]
# Names of files in which package managers record exact versions.
LOCK_NAMES = [
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "poetry.lock", "Pipfile.lock",
    "pdm.lock", "uv.lock", "Cargo.lock", "Gemfile.lock", "composer.lock", "go.sum", "packages.lock.json", "mix.lock",
    "pubspec.lock", "Podfile.lock", "flake.lock", "gradle.lockfile", "deps.lock.json", "Package.resolved",
]
# Extensions of program text, with the marks of their line comments.
PROGRAM = {
    "py": "#", "pyi": "#", "rb": "#", "sh": "#", "pl": "#", "r": "#", "ts": "//", "tsx": "//", "js": "//", "jsx": "//",
    "mjs": "//", "cjs": "//", "go": "//", "c": "//", "h": "//", "cc": "//", "cpp": "//", "hpp": "//", "cs": "//",
    "java": "//", "kt": "//", "scala": "//", "rs": "//", "swift": "//", "php": "//", "dart": "//", "lua": "--",
}
BY_LANGUAGE = {
    "python": "py", "ruby": "rb", "typescript": "ts", "javascript": "js", "go": "go", "c": "c", "cpp": "cpp",
    "csharp": "cs", "java": "java", "rust": "rs", "kotlin": "kt", "php": "php", "swift": "swift", "scala": "scala", "css": "css",
}
#: Extensions that are configuration or documents whatever they hold (lock files apart).
OTHER = {"md", "rst", "txt", "adoc", "json", "yaml", "yml", "toml", "ini", "cfg", "xml", "html", "htm", "csv", "sql", "lock"}

_NEGATED = re.compile(
    r"\b(?:not|never|isn't|aren't|wasn't|un)[\s-]*(?:been\s+|machine[\s-]|auto(?:matically)?[\s-]?)?generated|\b(?<!edit )(?<!change )(?<!modify )by hand\b"
    r"|hand[\s-]?(?:written|kept|made|maintained)|edits? (?:are|is) welcome|please edit|feel free to edit",
    re.I,
)
_GENERATED = re.compile(
    r"@generated\b|<auto-?generated|\bauto(?:matically)?[\s-]*generated\b"
    r"|\b(?:code|file|source|module|class|header|this)\b[^\n]{0,40}\b(?:was|is|been)?\s*generated\s+(?:by|from|with|using|on|at|automatically)\b"
    r"|^\W*generated\s+(?:by|from|with|using|on|automatically)\b"
    r"|\bmachine[\s-](?:written|generated|made)\b|\b(?:produced|created|emitted|written) (?:automatically|by (?:a|the) (?:tool|generator|compiler|machine|script))\b"
    r"|\bdo(?:n't| not) (?:edit|modify|change|touch)\b|\bchanges (?:to this file )?(?:will be|are) (?:lost|overwritten)\b"
    r"|\bany (?:manual )?(?:changes|edits) [^\n]{0,30}(?:lost|overwritten)\b"
    r"|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bnicht (?:bearbeiten|ändern|editieren)\b"
    r"|\b(?:généré|genere|créé)e?s? automatiquement\b|\bne pas (?:modifier|éditer)\b"
    r"|\b(?:generad|cread)[oa]s? automáticamente\b|\bno (?:editar|modificar)\b|\bgenerat[oa] automaticamente\b|\bgerado automaticamente\b"
    r"|\b(?:instead of|rather than|without) (?:changing|editing) (?:this|it)\b|\bregenerate[sd]? (?:this|by|with|from|it)\b",
    re.I | re.M,
)
#: What a writer of files says about its output; in code that merely speaks of it, quoted.
_QUOTED = re.compile(r"[\"'`“][^\"'`”\n]*(?:generated|do not edit)[^\"'`”\n]*[\"'`”]", re.I)
_THIRD_PARTY = re.compile(
    r"\b(?:imported|vendored|copied|taken|bundled|mirrored|forked|adapted|borrowed|pulled)\b[^\n]{0,40}"
    r"\b(?:third[\s-]party|upstream|project|package|library|repository|release|from)\b"
    r"|\bthird[\s-]party (?:source|code|copy|file|module|library|component)\b|\bupstream (?:changes|source|copy|version|file)\b"
    r"|\blocal patches\b|\bupstream\s*:\s*\S|\bvendored\b",
    re.I,
)
_NO_COPY = re.compile(r"\b(?:not|never|no|isn't|nothing)\b[^\n]{0,24}\b(?:vendored|third[\s-]party|copied|imported|upstream|bundled)", re.I)
#: Parts in which the files below a folder ask whether it is a copy.
PARTS = 8
#: Texts of fewer lines or characters are too short to tell a copy from a coincidence.
MIN_LINES, MIN_CHARS = 4, 120
_EOL = re.compile(r"\r\n?|\n|\x0b|\x0c| | ")
_WORD = re.compile(r"[^\W\d_]+(?:_[^\W\d_]+)*|_+")
_NUMBER = re.compile(r"\d+")
#: What is no string in a line of literals: numbers, constants, bytes, punctuation. Possessive, so that no line is read twice.
_PLAIN = re.compile(
    r"(?:[-+]?(?:0[xX][0-9a-fA-F]++|\d[\d_.]*+(?:[eE][-+]?\d++)?)[uUlLfF]*+|true|false|null|None|nil|True|False|\\x[0-9a-fA-F]{2}|[\s\[\](){},;:=>|&*\\.+^]++)*+"
)
_STRING_AT = re.compile(r"""(?:b|r|u|f|L)?(?:"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+')""")
_OPEN_STRING = re.compile(r'"[A-Za-z0-9+/=]*+')
#: Encoded bytes: a long run of them, or a line of nothing else as encoders wrap it.
_BLOB = re.compile(r"[A-Za-z0-9+/=\\]{200,}")
_BLOB_LINE = re.compile(r"[\s\"'`]*(?=[^\n]{0,200}\d)(?=[^\n]{0,200}[A-Za-z])[A-Za-z0-9+/=]{40,}[\s\"'`;,)\\]*")
_LOCK_TEXT = re.compile(r'"?(?:lockfileVersion|integrity|checksum|content-hash|resolved|sha256|sha512)"?\s*[:=]|\bh1:|^\[\[package\]\]', re.M)


def leading_comment(lines: list[str], mark: str) -> tuple[str, int]:
    """The text of the comments before the first code line, and that line's index. A ``#!`` line is passed over."""
    said, i, inside = [], 0, None
    for i, line in enumerate(lines):
        s = line.strip()
        if inside:
            said.append(s)
            if inside in s:
                inside = None
        elif not s or (i == 0 and s.startswith("#!")) or s in ("'use strict';", '"use strict";', "<?php"):
            continue
        elif s.startswith(mark) or (mark == "//" and s.startswith("#region")):
            said.append(s)
        elif mark == "//" and s.startswith("/*"):
            said.append(s)
            if "*/" not in s[2:]:
                inside = "*/"
        elif mark == "#" and s.startswith("=begin"):
            said.append(s)
            inside = "=end"
        elif mark == "#" and s[:3] in ('"""', "'''"):
            said.append(s)
            if s.count(s[:3]) < 2:
                inside = s[:3]
        else:
            return "\n".join(said), i
    return "\n".join(said), len(lines) if lines else i


def is_generated_layout(code: list[str]) -> bool:
    """Nearly all lines are of a few shapes and count upwards: accessors, registrations, field tables.

    ``code`` are the lines that are neither blank nor in the leading comment.
    """
    if len(code) < 8:
        return False
    shapes, counted = Counter(), []
    for line in code:
        shapes[_WORD.sub("w", _NUMBER.sub("0", line.strip()))] += 1
        n = _NUMBER.search(line)
        if n and len(n.group()) < 12:
            counted.append(int(n.group()))
    top = shapes.most_common(4)
    few = [n for _, n in top if n >= max(3, 0.12 * len(code))]
    if sum(few) < 0.9 * len(code) or len(counted) < 6:
        return False
    steps = sum(b - a in (0, 1) for a, b in zip(counted, counted[1:]))
    return steps >= 0.9 * (len(counted) - 1) and counted[-1] - counted[0] >= 5


def is_literals(line: str) -> bool:
    """Whether a line holds nothing but literals and punctuation. Linear in the line's length."""
    at, unclosed = 0, False
    while True:
        at = _PLAIN.match(line, at).end()
        if at == len(line):
            return True
        m = None
        # behind a quote that nothing closes, the later ones are all escaped, so none of them is closed either
        if not (unclosed and line[at] == '"'):
            m = _STRING_AT.match(line, at)
        if m is None:
            if line[at] != '"':
                return False
            unclosed = True
            m = _OPEN_STRING.match(line, at)
        at = m.end()


def is_data(code: list[str]) -> bool:
    """Most of the text is literals: number and string tables, or encoded blobs, in lines of any length."""
    total = sum(map(len, code))
    blobs = [len(line) if _BLOB_LINE.fullmatch(line) else sum(map(len, _BLOB.findall(line))) for line in code]
    if total < 400 or len(code) < 3:
        return sum(blobs) >= max(200, 0.7 * total)
    data = [is_literals(line) for line in code]
    rows = sum(d and len(line.strip()) > 3 for d, line in zip(data, code))
    held = sum(len(line) if d else b for d, b, line in zip(data, blobs, code))
    return held >= 0.85 * total and (rows >= 6 or total > 2000 or sum(blobs) >= 0.7 * total)


def is_minified(lines: list[str], ext: str) -> bool:
    """Little white space beside full lines, as a minifier writes; wrapped output included."""
    code = [s for s in (x.strip() for x in lines) if s and not s.startswith(("/*", "//", "*"))]
    total = sum(map(len, code))
    if total < 200 or ext not in ("js", "mjs", "cjs", "jsx", "ts", "css"):
        return False
    full = sum(len(x) for x in code if len(x) >= 100)
    blanks = sum(x.count(" ") + x.count("\t") for x in code)
    return full >= 0.8 * total and blanks <= 0.09 * total and sum(x.startswith((" ", "\t")) for x in lines) <= 0.25 * len(lines)


def judge(rel_path: str, language: str | None, content: str | None) -> tuple[str | None, str | None, int, int]:
    """What a file is (vendored, lock, generated, minified, data, or None) by itself, its leaf hash, its lines and characters.

    The leaf hash, and what is counted, leave out the leading comment, line ends and blank space at line ends; it is None for
    documents and configuration.
    """
    path = rel_path.replace("\\", "/").strip("/ ")
    *folders, name = path.split("/")
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else BY_LANGUAGE.get((language or "").lower(), "")
    if ext not in PROGRAM and ext not in OTHER and ext != "css":
        ext = BY_LANGUAGE.get((language or "").lower(), ext)
    text = content or ""
    if name in LOCK_NAMES or (re.search(r"(?:^|[.-])lock\.(?:json|ya?ml)$", name) and _LOCK_TEXT.search(text)):
        return "lock", None, 0, 0
    in_packages = any(f in PACKAGE_FOLDERS for f in folders[:-1])
    if ext not in PROGRAM and ext != "css":
        return ("vendored" if in_packages and ext not in OTHER and text else None), None, 0, 0
    lines = [x.rstrip() for x in _EOL.split(text)]
    said, start = leading_comment(lines, PROGRAM.get(ext, "//"))
    code = [x for x in lines[start:] if x]
    leaf = hashlib.blake2b("\n".join(code).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return _kind(in_packages, ext, said, lines, code), leaf, len(code), sum(map(len, code))


def _kind(in_packages: bool, ext: str, said: str, lines: list[str], code: list[str]) -> str | None:
    """What a program file is by its folders, leading comment and code lines."""
    if in_packages:
        return "vendored"
    for line in said.split("\n"):
        if _THIRD_PARTY.search(line) and not _NO_COPY.search(line):
            return "vendored"
    if is_minified(lines, ext):
        return "minified"
    if ext == "css":
        return None
    plain = _QUOTED.sub("", said)
    if _GENERATED.search(plain) and not _NEGATED.search(plain):
        return "generated"
    if is_generated_layout(code):
        return "generated"
    if is_data(code):
        return "data"
    return None


_VERSION = re.compile(r"[-_@]v?\d+(?:\.\d+)+\S*$")


def package(rel_path: str) -> tuple[str | None, bool]:
    """The package folder a file lies in, right below a folder for third-party copies, and whether the file shows that it is one.

    That is a version in the folder's name, or a licence or package file at its top.
    """
    *folders, name = rel_path.replace("\\", "/").strip("/ ").split("/")
    for i, f in enumerate(folders[:-1]):
        if f in VENDOR_FOLDERS:
            top = len(folders) == i + 2 and name.lower() in PACKAGE_MARKS
            return "/".join(folders[: i + 2]), top or bool(_VERSION.search(folders[i + 1]))
    return None, False


def judged_files(records: DataFrame) -> DataFrame:
    """(project_id, rel_path, kind, leaf, lines, chars, root, mark) of each file's latest scan; ties go to the greatest row."""

    def run(batches):
        for pdf in batches:
            got = [judge(p, x, c) for p, x, c in zip(pdf["rel_path"], pdf["language"], pdf["content"])]
            roots = [package(p) for p in pdf["rel_path"]]
            yield pd.DataFrame(
                {
                    "project_id": pdf["project_id"], "rel_path": pdf["rel_path"], "scanned_at": pdf["scanned_at"],
                    "kind": [g[0] for g in got], "leaf": [g[1] for g in got], "lines": [g[2] for g in got], "chars": [g[3] for g in got],
                    "root": [r for r, _ in roots], "mark": [m for _, m in roots],
                }
            )

    files = records.where(F.col("rel_path").isNotNull()).select("project_id", "rel_path", "language", "content", F.unix_micros("scanned_at").alias("scanned_at"))
    seen = (
        shared.spread(files)
        .mapInPandas(run, "project_id string, rel_path string, scanned_at long, kind string, leaf string, lines long, chars long, root string, mark boolean")
    )
    newest = F.max(F.struct("scanned_at", "leaf", "kind", "lines", "chars", "root", "mark")).alias("x")
    return seen.groupBy("project_id", "rel_path").agg(newest).select("project_id", "rel_path", "x.kind", "x.leaf", "x.lines", "x.chars", "x.root", "x.mark")


def merkle_copies(leaves: DataFrame) -> DataFrame:
    """(project_id, node, folder): files and folders whose Merkle hash occurs in several projects, or is that of a known copy.

    ``leaves`` has (project_id, node, h, known), one row per file, and (lines, chars), without which every file counts as long
    enough. A file or folder with fewer than ``MIN_LINES`` and ``MIN_CHARS`` in all is a coincidence, but a short file enters the
    hash of its folder. A folder is known if all its files are. Folder hashes are computed bottom-up, one level a
    round, however deep the tree.
    """
    for column, least in (("lines", MIN_LINES), ("chars", MIN_CHARS)):
        if column not in leaves.columns:
            leaves = leaves.withColumn(column, F.lit(least))
    held = ["known", "lines", "chars"]
    depth = F.size(F.split("node", "/"))
    level_of = leaves.withColumn("depth", depth)
    deepest = level_of.agg(F.max("depth")).first()[0] or 0
    nodes, below = [level_of.select("project_id", "node", "h", *held)], None
    for d in range(deepest, 1, -1):
        here = level_of.where(F.col("depth") == d).select("project_id", "node", "h", *held)
        here = here if below is None else here.unionByName(below)
        entry = F.xxhash64(F.substring_index("node", "/", -1), "h")
        other = F.xxhash64(F.lit(5), F.substring_index("node", "/", -1), "h")
        below = (
            here.select(
                "project_id",
                F.expr("left(node, length(node) - length(substring_index(node, '/', -1)) - 1)").alias("node"),
                entry.alias("e1"),
                other.alias("e2"),
                *held,
            )
            .groupBy("project_id", "node")
            .agg(
                F.count("*").alias("n"), F.expr("bit_xor(e1)").alias("x"), F.expr("bit_xor(e2)").alias("y"),
                F.min("known").alias("known"), F.sum("lines").alias("lines"), F.sum("chars").alias("chars"),
            )
            .select("project_id", "node", F.concat_ws(":", "n", "x", "y").alias("h"), *held)
        )
        below = shared.kept(below, f"merkle{d}")
        nodes.append(below)
    every = nodes[0].withColumn("folder", F.lit(False))
    for n in nodes[1:]:
        every = every.unionByName(n.withColumn("folder", F.lit(True)))
    every = every.where((F.col("lines") >= MIN_LINES) & (F.col("chars") >= MIN_CHARS))
    per_project = every.groupBy("h", "project_id").agg(F.max("known").alias("known"))
    copied = per_project.groupBy("h").agg(F.count("*").alias("n"), F.max("known").alias("known")).where("n > 1 OR known").select("h")
    return every.join(copied, "h", "left_semi").select("project_id", "node", "folder")


def not_handwritten(records: DataFrame) -> DataFrame:
    """(project_id, rel_path, kind): files that nobody wrote by hand for their project.

    kind is vendored, generated, minified, data or lock. Null projects are one project of their own, rows without path
    name no file, a file without content can only be vendored. Of repeated rows the last scan counts. An empty
    table gives no rows; other columns are ignored.
    """
    files = shared.kept(judged_files(records), "judged")
    plain = F.regexp_replace(F.translate("rel_path", "\\", "/"), "^(?:\\./|/)+", "")
    # files another rule has settled are no evidence of copying, except known third-party ones
    leaves = files.where(F.col("leaf").isNotNull() & (F.col("kind").isNull() | (F.col("kind") == "vendored"))).select(
        "project_id", plain.alias("node"), F.col("leaf").alias("h"), F.col("kind").isNotNull().alias("known"), "lines", "chars"
    )
    copies = shared.kept(merkle_copies(leaves).distinct(), "copies")
    # a file is a copy if it, or a folder above it, is one, however short
    own = files.where("kind IS NULL AND leaf IS NOT NULL").select("project_id", "rel_path", "root", plain.alias("node"))
    on = [F.col("u.project_id").eqNullSafe(F.col("c.project_id")), F.col("u.node") == F.col("c.node")]
    by_hash = own.alias("u").join(copies.where("NOT folder").alias("c"), on, "left_semi")
    # each file asks for the folders above it; a folder with very many files is asked for in parts
    parts = F.split("node", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    part = F.pmod(F.xxhash64("rel_path"), F.lit(PARTS)).cast("int").alias("part")
    up = own.where(F.size(parts) > 1).select("project_id", "rel_path", "root", part, F.explode(above).alias("node"))
    folders = copies.where("folder").select("project_id", "node", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    folders = folders.hint("merge")  # its size is not known before it is multiplied: never sent to all tasks
    by_folder = up.alias("u").join(folders.alias("c"), [*on, F.col("u.part") == F.col("c.part")], "left_semi")
    copied = shared.kept(by_hash.select("project_id", "rel_path", "root").unionByName(by_folder.select("project_id", "rel_path", "root")).distinct(), "copied")
    # in a folder for third-party copies, a package of which anything is known to be a copy, or which shows what it is, is one
    shown = files.where("root IS NOT NULL AND (mark OR kind = 'vendored')").select("project_id", "root")
    shown = shown.unionByName(copied.where("root IS NOT NULL").select("project_id", "root")).distinct()
    here = [F.col("u.project_id").eqNullSafe(F.col("c.project_id")), F.col("u.root") == F.col("c.root")]
    packaged = own.where("root IS NOT NULL").alias("u").join(shown.alias("c"), here, "left_semi").select("project_id", "rel_path")
    vendored = copied.select("project_id", "rel_path").unionByName(packaged).distinct().withColumn("kind", F.lit("vendored"))
    return files.where("kind IS NOT NULL").select("project_id", "rel_path", "kind").unionByName(vendored)
