"""Commits of a repository as a data source, ``spark.read.format("git_log").load(root)``, and blame-based attributions."""

from __future__ import annotations

import hashlib
import re
import subprocess

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodelens import shared

COMMIT = "commit string, parents array<string>, ts bigint, author string, message string, paths array<struct<path: string, status: string, added: int, deleted: int, old_path: string>>"


def git(root: str, *args: str, timeout: int = 120) -> str:
    got = subprocess.run(["git", "-c", "core.quotepath=off", "-C", root, *args], capture_output=True, timeout=timeout, check=True)
    return got.stdout.decode("utf-8", "replace")


def blocks(root: str, *args: str, mark: bytes = b"\x1e"):
    """What git writes, in pieces that begin with ``mark``, read as it comes."""
    with subprocess.Popen(["git", "-c", "core.quotepath=off", "-C", root, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
        rest = b""
        while more := run.stdout.read(1 << 16):
            *done, rest = (rest + more).split(mark)
            yield from (d.decode("utf-8", "replace") for d in done if d)
        if rest:
            yield rest.decode("utf-8", "replace")
        said = run.stderr.read()
    if run.returncode:
        raise subprocess.CalledProcessError(run.returncode, ["git", *args], stderr=said)


def _which(rev_range: str | None, all_refs: bool) -> list[str]:
    return [*(["--all"] if all_refs else []), *([rev_range] if rev_range else [] if all_refs else ["HEAD"])]


def log(root: str, max_commits: int | None = None, rev_range: str | None = None, all_refs: bool = False, skip: int = 0):
    """Commits newest first, without the first ``skip``; read as git writes them. Binary files count no lines, renames keep the old path; raw and numstat rows pair by place."""
    args = ["log", "--date-order", "-M", "--raw", "--numstat", "-z", "--format=%x1e%H%x1f%P%x1f%ct%x1f%an%x1f%s%x1d"]
    if max_commits is not None:
        args.append(f"-n{max_commits}")
    args += [f"--skip={skip}", *_which(rev_range, all_refs)]
    for block in blocks(root, *args):
        head, _, body = block.partition("\x1d")
        sha, parents, ts, author, message = head.split("\x1f", 4)
        cells = [x.lstrip("\n") for x in body.split("\0")]
        raw, stats, i = [], [], 0
        while i < len(cells):
            cell = cells[i]
            if cell.startswith(":"):
                status = cell.split()[4]
                if status[0] in "RC":
                    raw.append((status[0], cells[i + 1], cells[i + 2]))
                    i += 3
                else:
                    raw.append((status[0], None, cells[i + 1]))
                    i += 2
                continue
            m = re.match(r"(\d+|-)\t(\d+|-)\t(.*)", cell, re.S)
            if m:
                stats.append(tuple(0 if x == "-" else int(x) for x in m.groups()[:2]))
                i += 1 if m.group(3) else 3
                continue
            i += 1
        stats += [(0, 0)] * (len(raw) - len(stats))
        paths = [(new, st, a, d, old) for (st, old, new), (a, d) in zip(raw, stats)]
        yield sha, parents.split(), int(ts), author[:200], message.strip()[:240], paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.n = str(options.get("path")), options.get("maxcommits")
        self.range, self.all = options.get("range"), str(options.get("allrefs", "false")).lower() == "true"
        self.step = int(options.get("commitsperpartition", 5000))

    def partitions(self):
        """Ranges of the log, of ``commitsperpartition`` commits; only their number is asked for here."""
        n = int(git(self.root, "rev-list", "--count", *_which(self.range, self.all)))
        n = min(n, int(self.n)) if self.n else n
        return [InputPartition((at, min(self.step, n - at))) for at in range(0, n, self.step)] or [InputPartition((0, 0))]

    def read(self, part):
        skip, n = part.value
        yield from log(self.root, n, self.range, self.all, skip)


class GitLog(DataSource):
    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return COMMIT

    def reader(self, schema):
        return _Reader(self.options)


def snapshot(root: str) -> dict:
    """Work tree, ref, commit and whether there are changes; a detached head is named by its commit."""
    commit = git(root, "rev-parse", "HEAD").strip()
    ref = git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()
    return {
        "worktree": git(root, "rev-parse", "--show-toplevel").strip(), "commit": commit, "ref": commit[:12] if ref == "HEAD" else ref,
        "dirty": bool(git(root, "status", "--porcelain").strip()),
    }


def ref_fingerprint(root: str) -> str:
    lines = sorted(git(root, "for-each-ref", "--format=%(refname)%00%(objectname)").splitlines())
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+", re.M)


def blame_fix(root: str, fix: str) -> list[tuple[str, str, str, int]]:
    """(fix, introducing commit, path, lines) for the lines a fix removes or changes, by blaming them in its parent."""
    parent, counts, path = f"{fix}^", {}, None
    for part in re.split(r"(?m)^diff --git .*$", git(root, "diff", "--unified=0", "-w", "-M", "--no-color", parent, fix))[1:]:
        old = re.search(r"^--- a/(.*)$", part, re.M)
        if not old:
            continue
        path = old.group(1).rstrip("\t")
        for m in _HUNK.finditer(part):
            start, n = int(m.group(1)), int(m.group(2) or 1)
            if not n:
                continue
            for line in git(root, "blame", "-w", "--root", "--line-porcelain", f"-L{start},{start + n - 1}", parent, "--", path).splitlines():
                if re.match(r"[0-9a-f]{40} \d+ \d+", line):
                    key = (fix, line[:40], path)
                    counts[key] = counts.get(key, 0) + 1
    return [(*k, n) for k, n in sorted(counts.items())]


def attributions(fixes: DataFrame, root: str, known: DataFrame | None = None) -> DataFrame:
    """Blame every fix commit that is not known yet, in parallel, and add the known ones. The repository must be readable by all."""
    todo = fixes.select("commit").distinct()
    if known is not None:
        todo = todo.join(known.select(F.col("fix_commit").alias("commit")).distinct(), "commit", "left_anti")
    schema = "fix_commit string, introducing_commit string, path string, lines int"

    def run(batches):
        for pdf in batches:
            rows = [r for c in pdf["commit"] for r in blame_fix(root, c)]
            yield pd.DataFrame(rows, columns=["fix_commit", "introducing_commit", "path", "lines"])

    # an explicit number: a fix costs seconds of blame though its row is small, and partitions would be joined by size
    todo = shared.kept(todo, "fixes")
    tasks = max(1, min(todo.count(), 4 * todo.sparkSession.sparkContext.defaultParallelism))
    found = todo.repartition(tasks, "commit").mapInPandas(run, schema)
    return found if known is None else known.select("fix_commit", "introducing_commit", "path", "lines").unionByName(found)
