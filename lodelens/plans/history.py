"""Change history: change sets, churn, co-change rules, defects, hotspots.

All results are per project. Nothing is collected per project or per change set: change sets are rows (project, change, path)
until a set's size is known, and only sets within ``max_files`` become arrays.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodelens.functions import paths, text
from lodelens.operators.ordered import numbered_runs, previous_rows

# Default patterns.
TICKET = r"([A-Z][A-Z0-9]+-\d+|#[0-9]+)"
FIX = r"(?i)\b(fix(e[sd])?|bug|hotfix|patch|close[sd]?\s+#\d+)\b"


def distinct_commits(commits: DataFrame) -> DataFrame:
    """One row per (project, commit); of differing deliveries the greatest row counts. Null parents are none.

    Given its own result (kept as a table, say, as several steps read it) it gives it back.
    """
    if "n_parents" in commits.columns:
        return commits
    n = F.greatest(F.coalesce(F.size("parents"), F.lit(0)), F.lit(0))
    row = F.struct(
        F.coalesce("ts", F.lit(0)).alias("ts"), F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("message", F.lit("")).alias("message"), n.alias("n_parents"), F.coalesce("paths", F.array()).alias("paths"),
    )
    return (
        commits.where(F.col("commit").isNotNull())
        .groupBy("project_id", "commit")
        .agg(F.max(row).alias("r"))
        .select("project_id", "commit", "r.*")
    )


def change_ids(commits: DataFrame, group_by: str = "commit", ticket_regex: str | None = None, window_hours: float = 2.0) -> DataFrame:
    """Distinct commits with ``change``: the commit, its ticket, its author's window, or its stretch between merges.

    Windows break where the author changes in the order of time or a gap exceeds ``window_hours``. Stretches between
    merges follow the log (newest first) and are named after their newest commit; merges belong to none.
    """
    c = distinct_commits(commits)
    mode = {"pr": "merge"}.get(group_by, group_by)
    if mode == "ticket":
        pattern = text.safe_pattern(ticket_regex, TICKET)
        found = F.regexp_extract("message", pattern, ticket_group(pattern))
        return c.withColumn("change", F.when(found != "", found).otherwise(F.col("commit")))
    if mode == "window":
        gap = int(max(0.0, window_hours) * 3600)

        def begins(before, row):
            new = before["author"] != row["author"]
            return new | (row["ts"] - before["ts"] > gap) if gap else new

        runs = numbered_runs(c, ["project_id"], "ts", ["commit"], begins, ["author", "ts"])
        return runs.withColumn("change", F.concat(F.lit("window:"), "run")).drop("run")
    if mode == "merge":
        back = c.withColumn("_t", -F.col("ts"))
        runs = numbered_runs(back, ["project_id"], "_t", ["commit"], lambda b, r: (b["n_parents"] > 1) | (r["n_parents"] > 1), ["n_parents"])
        plain = runs.where("n_parents <= 1")
        newest = plain.groupBy("project_id", "run").agg(F.min_by("commit", F.struct("_t", "commit")).alias("newest"))
        joined = plain.join(newest.withColumnRenamed("project_id", "_p").withColumnRenamed("run", "_r"), (F.col("project_id").eqNullSafe(F.col("_p"))) & (F.col("run") == F.col("_r")))
        return joined.withColumn("change", F.concat(F.lit("merge-window:"), "newest")).drop("_t", "run", "_p", "_r", "newest")
    return c.withColumn("change", F.col("commit"))


def ticket_group(pattern: str) -> int:
    """The group of a pattern that holds the ticket: the one named so, else the first, else the whole match."""
    compiled = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    return compiled.groupindex.get("ticket") or min(1, compiled.groups)


def change_files(ids: DataFrame) -> DataFrame:
    """(project_id, change, path, lines): merges list no paths; numbers below zero are zero."""
    e = ids.where("n_parents <= 1").select("project_id", "change", F.explode("paths").alias("p"))
    lines = F.greatest(F.coalesce("p.added", F.lit(0)), F.lit(0)) + F.greatest(F.coalesce("p.deleted", F.lit(0)), F.lit(0))
    return (
        e.select("project_id", "change", paths.plain("p.path").alias("path"), lines.cast("long").alias("lines"))
        .where("path <> ''")
        .groupBy("project_id", "change", "path")
        .agg(F.sum("lines").alias("lines"))
    )


def change_sets(ids: DataFrame, max_files: int = 50, fix_regex: str | None = None) -> DataFrame:
    """(project_id, change, commits, ts, n_authors, is_fix, n_files, state): state is kept, large or empty."""
    heads = ids.groupBy("project_id", "change").agg(
        F.count("*").alias("commits"), F.max("ts").alias("ts"), F.count_distinct(F.when(F.col("author") != "", F.col("author"))).alias("n_authors"),
        F.max(F.col("message").rlike(text.safe_pattern(fix_regex, FIX))).alias("is_fix"),
        F.sum(F.when(F.col("n_parents") > 1, 1).otherwise(0)).alias("merges"),
    )
    sizes = change_files(ids).groupBy("project_id", "change").agg(F.count("*").alias("n_files"))
    joined = _left(heads, sizes, ["project_id", "change"], ["n_files"])
    n = F.coalesce("n_files", F.lit(0))
    return joined.withColumn("n_files", n).withColumn("state", F.when(n == 0, "empty").when(n > max_files, "large").otherwise("kept"))


def _left(a: DataFrame, b: DataFrame, keys: list[str], take: list[str], how: str = "left") -> DataFrame:
    """Left (semi) join that treats null keys as equal."""
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    j = a.alias("a").join(b.alias("b"), on, how)
    return j if how != "left" else j.select("a.*", *[F.col(f"b.{t}") for t in take])


def kept_files(ids: DataFrame, max_files: int = 50, fix_regex: str | None = None) -> DataFrame:
    """(project_id, change, path, lines, ts, is_fix) of kept change sets."""
    sets = change_sets(ids, max_files, fix_regex).where("state = 'kept'").select("project_id", "change", "ts", "is_fix")
    f, s = change_files(ids).alias("f"), sets.alias("s")
    return f.join(s, [F.col("f.project_id").eqNullSafe(F.col("s.project_id")), F.col("f.change") == F.col("s.change")]).select("f.*", "s.ts", "s.is_fix")


def noise(ids: DataFrame, max_files: int = 50) -> DataFrame:
    """Per project: change sets kept, skipped as large or empty, and merge commits."""
    s = change_sets(ids, max_files)
    def n(state):
        return F.sum(F.when(F.col("state") == state, 1).otherwise(0)).alias(state)

    return s.groupBy("project_id").agg(n("kept"), n("large"), n("empty"), F.sum("merges").alias("merges"))


def churn(files: DataFrame, recent_days: int = 90) -> DataFrame:
    """Per project and path: changes, churn_lines, last_touched_ts, recent_changes, fix_density. "Now" is the project's last change."""
    now = files.groupBy("project_id").agg(F.max("ts").alias("now"))
    f = _left(files, now, ["project_id"], ["now"])
    recent = F.when(F.col("ts") >= F.col("now") - recent_days * 86400, 1).otherwise(0)
    return f.groupBy("project_id", "path").agg(
        F.count("*").alias("changes"), F.sum("lines").alias("churn_lines"), F.max("ts").alias("last_touched_ts"),
        F.sum(recent).alias("recent_changes"), F.round(F.sum(F.col("is_fix").cast("int")) / F.count("*"), 6).alias("fix_density"),
    )


def cochange(files: DataFrame, limit: int = 5) -> DataFrame:
    """For each file its ``limit`` strongest companions: support, confidence, lift, by lift, support, confidence, path.

    Pairs are made inside one change set of bounded size by two generators; a file in very many change sets is summed
    before the shuffle.
    """
    sets = files.groupBy("project_id", "change").agg(F.array_sort(F.collect_list("path")).alias("fs"))
    totals = sets.groupBy("project_id").agg(F.count("*").alias("n"))
    counts = files.groupBy("project_id", "path").agg(F.count("*").alias("n_file"))
    left = sets.select("project_id", F.posexplode("fs").alias("i", "a"), "fs")
    pairs = left.select("project_id", "a", F.explode(F.expr("slice(fs, i + 2, size(fs))")).alias("b")).groupBy("project_id", "a", "b").agg(F.count("*").alias("support"))
    both = pairs.select("project_id", "support", F.inline(F.array(F.struct(F.col("a").alias("path"), F.col("b").alias("other")), F.struct(F.col("b").alias("path"), F.col("a").alias("other")))))
    s = _left(both, counts, ["project_id", "path"], ["n_file"])
    s = _left(s, counts.selectExpr("project_id", "path as other", "n_file as n_other"), ["project_id", "other"], ["n_other"])
    s = _left(s, totals, ["project_id"], ["n"])
    s = s.withColumn("confidence", F.round(F.col("support") / F.col("n_file"), 6)).withColumn(
        "lift", F.round(F.col("support") * F.col("n") / (F.col("n_file") * F.col("n_other")), 6)
    )
    w = Window.partitionBy("project_id", "path").orderBy(F.desc("lift"), F.desc("support"), F.desc("confidence"), "other")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("project_id", "path", "other", "support", "confidence", "lift", "rank")


def fix_commits(commits: DataFrame, fix_regex: str | None = None) -> DataFrame:
    """Single-parent commits whose message matches the pattern, each once."""
    c = distinct_commits(commits)
    return c.where((F.col("n_parents") == 1) & F.col("message").rlike(text.safe_pattern(fix_regex, FIX))).select("project_id", "commit", "ts", "message")


def attribution_counts(attributions: DataFrame) -> DataFrame:
    """(fix_commit, introducing_commit, path) -> lines, each row counting at least one."""
    return attributions.groupBy("fix_commit", "introducing_commit", "path").agg(F.sum(F.greatest(F.coalesce("lines", F.lit(1)), F.lit(1))).alias("lines"))


def defects(attributions: DataFrame) -> DataFrame:
    """Per path: introducing lines, distinct introducers and fixes; :func:`introducers` lists them."""
    a = attributions.withColumn("path", paths.plain("path")).where("path <> '' AND fix_commit <> '' AND introducing_commit <> ''")
    keys = [k for k in ("project_id",) if k in a.columns]
    return a.groupBy(*keys, "path").agg(
        F.sum(F.greatest(F.coalesce("lines", F.lit(1)), F.lit(1)).cast("long")).alias("defect_introducing_lines"),
        F.count_distinct("introducing_commit").alias("defect_introducing_commits"),
        F.count_distinct("fix_commit").alias("fix_commits_with_szz"),
    )


def introducers(attributions: DataFrame, limit: int = 20) -> DataFrame:
    """(project_id, path, introducing_commit, lines, fixes, rank): the ``limit`` first introducers of each path, by most lines, then by commit."""
    a = attributions.withColumn("path", paths.plain("path")).where("path <> '' AND fix_commit <> '' AND introducing_commit <> ''")
    g = a.groupBy("project_id", "path", "introducing_commit").agg(
        F.sum(F.greatest(F.coalesce("lines", F.lit(1)), F.lit(1)).cast("long")).alias("lines"), F.count_distinct("fix_commit").alias("fixes")
    )
    w = Window.partitionBy("project_id", "path").orderBy(F.desc("lines"), "introducing_commit")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def staleness(commits: DataFrame, runs: DataFrame) -> DataFrame:
    """(project_id, indexed_at, commits_since, newest_commit_ts, git_stale): what happened since the last succeeded run finished (epoch seconds).

    Projects without a succeeded run have no ``indexed_at`` and are stale if they have commits.
    """
    done = F.lower(F.trim("status")) == "succeeded"
    last = runs.where(done).groupBy("project_id").agg(F.max(F.floor(F.unix_micros(F.coalesce("finished_at", "started_at", "logged_at")) / 1_000_000)).cast("long").alias("indexed_at"))
    c = distinct_commits(commits).select("project_id", "commit", "ts")
    j = _left(c, last, ["project_id"], ["indexed_at"])
    since = F.when(F.col("indexed_at").isNull() | (F.col("ts") > F.col("indexed_at")), 1).otherwise(0)
    g = j.groupBy("project_id").agg(F.max("indexed_at").alias("indexed_at"), F.sum(since).alias("commits_since"), F.max("ts").alias("newest_commit_ts"))
    return g.withColumn("git_stale", F.col("commits_since") > 0)


def mapped(files: DataFrame, spots: DataFrame, depth: int = 1) -> DataFrame:
    """The directory map with history: files and chunks of the catalogue, and changes, churn, defects and hotspots of the same paths.

    ``files`` has project_id, path, chunks; ``spots`` are :func:`hotspots`. Paths with history but no file count as changed, not as files.
    """
    f = files.select("project_id", "path", "chunks").withColumn("there", F.lit(1))
    j = f.join(spots, ["project_id", "path"], "full_outer").withColumn("dir", paths.directory_at("path", depth))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    hot = F.when(F.col("quadrant") == "high_churn_high_complexity", 1)
    return j.groupBy("project_id", "dir").agg(
        n("there").alias("files"), n("chunks").alias("chunks"), n("changes").alias("changes"), n("churn_lines").alias("churn_lines"),
        n("defect_introducing_commits").alias("defects"), n(hot).alias("hotspots"), F.max("last_touched_ts").alias("last_touched_ts"),
    )


def previous_touch(commits: DataFrame, fix_regex: str | None = None) -> DataFrame:
    """Attributions without blame: to each file of a fix the last commit before it that touched the file, with its deleted lines.

    The stand-in where there is no repository to blame; one row per (project, fix, introducer, path).
    """
    c = distinct_commits(commits)
    e = c.where("n_parents <= 1").select("project_id", "commit", "ts", "n_parents", "message", F.explode("paths").alias("p"))
    e = e.select("project_id", "commit", "ts", (F.col("message").rlike(text.safe_pattern(fix_regex, FIX)) & (F.col("n_parents") == 1)).alias("is_fix"), paths.plain("p.path").alias("path"), F.coalesce("p.deleted", F.lit(0)).alias("deleted"))
    e = e.where("path <> ''").groupBy("project_id", "path", "commit", "ts", "is_fix").agg(F.sum("deleted").alias("deleted"))
    before = previous_rows(e, ["project_id", "path"], "ts", ["commit"], ["commit"])
    return before.where("is_fix AND before IS NOT NULL").select(
        "project_id", F.col("commit").alias("fix_commit"), F.col("before.commit").alias("introducing_commit"), "path", F.greatest("deleted", F.lit(1)).cast("int").alias("lines")
    )


def hotspots(churned: DataFrame, files: DataFrame, defective: DataFrame | None = None) -> DataFrame:
    """Churn, complexity and defects per project and path, with quadrant and scores; only files with changes or defects.

    ``files`` has project_id, path, chunks, symbols, indent_complexity. The thresholds are the medians of the positive values; chunks
    plus symbols stand in where the complexity is null.
    """
    keys = ["project_id", "path"]
    comp = files.withColumn("complexity", F.coalesce(F.greatest("indent_complexity", F.lit(0.0)), (F.col("chunks") + F.col("symbols")).cast("double"))).select(*keys, "complexity")
    both = churned.join(comp, keys, "full_outer")
    limits = both.groupBy("project_id").agg(
        F.coalesce(F.median(F.when(F.col("changes") > 0, F.col("changes"))), F.lit(0.0)).alias("change_limit"),
        F.coalesce(F.median(F.when(F.col("complexity") > 0, F.col("complexity"))), F.lit(0.0)).alias("complexity_limit"),
    )
    if defective is None:
        defective = both.select(*keys).where("false").selectExpr(*keys, "0L as defect_introducing_lines", "0L as defect_introducing_commits")
    j = both.join(defective, keys, "full_outer").join(limits, "project_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("changes", "churn_lines", "recent_changes", "last_touched_ts", "defect_introducing_lines", "defect_introducing_commits")}
    j = j.withColumns(zero).withColumns({"complexity": F.coalesce("complexity", F.lit(0.0)), "fix_density": F.coalesce("fix_density", F.lit(0.0))})
    high = (F.col("change_limit") > 0) & (F.col("changes") >= F.col("change_limit"))
    hard = (F.col("complexity_limit") > 0) & (F.col("complexity") >= F.col("complexity_limit"))
    quadrant = F.concat(F.when(high, "high_churn_").otherwise("low_churn_"), F.when(hard, "high_complexity").otherwise("low_complexity"))
    j = j.withColumn("quadrant", quadrant).withColumn("score", F.round(F.col("changes") * F.greatest("complexity", F.lit(1.0)), 6))
    j = j.withColumn("defect_score", F.col("defect_introducing_commits") * F.greatest("changes", F.lit(1)) + F.col("defect_introducing_lines"))
    return j.where("changes > 0 OR defect_score > 0").select(*keys, "changes", "churn_lines", "recent_changes", "last_touched_ts", "fix_density", "complexity", "defect_introducing_commits", "defect_introducing_lines", "quadrant", "score", "defect_score")


def ranked_hotspots(spots: DataFrame, limit: int = 25) -> DataFrame:
    order = [(F.col("quadrant") != "high_churn_high_complexity").cast("int"), F.desc("score"), F.desc("defect_score"), F.desc("changes"), F.desc("churn_lines"), F.col("path")]
    w = Window.partitionBy("project_id").orderBy(*order)
    return spots.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
