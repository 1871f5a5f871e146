"""All registered queries of the core, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodelens.functions import chunking, paths, text
from lodelens.operators import incremental
from lodelens.plans import catalog, evaluation, history, lifecycle, lookup, retrieval
from lodelens.shared import kept, spread, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def core_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def core_sql() -> dict[str, str]:
    return dict(_SQL)


# -- processing what is new -----------------------------------------------------------------------
_HASH = "nullif(regexp_replace(lower(trim({})), '^sha256:', ''), '')"
_NOW_WAS = f"""
now AS (
    SELECT project_id, rel_path, {_HASH.format("file_hash")} AS h, mtime_ns, size FROM file_records
    WHERE rel_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, rel_path
        ORDER BY scanned_at DESC NULLS LAST, h DESC NULLS LAST, mtime_ns DESC NULLS LAST, size DESC NULLS LAST) = 1),
run AS (
    SELECT project_id, run_id, run_seq, lower(trim(status)) AS st FROM index_runs
    QUALIFY row_number() OVER (PARTITION BY project_id, run_id ORDER BY logged_at DESC NULLS LAST, st DESC) = 1),
was AS (
    SELECT f.project_id, f.rel_path, {_HASH.format("f.file_hash")} AS h, f.mtime_ns, f.size FROM files f JOIN run r
        ON r.project_id = f.project_id AND r.run_id = f.run_id AND r.st = 'succeeded' WHERE f.rel_path IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY f.project_id, f.rel_path
        ORDER BY r.run_seq DESC NULLS LAST, h DESC NULLS LAST, f.mtime_ns DESC NULLS LAST, f.size DESC NULLS LAST) = 1)
"""
_SAME = "CASE WHEN now.h IS NOT NULL AND was.h IS NOT NULL THEN now.h = was.h ELSE coalesce(now.size = was.size AND now.mtime_ns = was.mtime_ns, false) END"


def _scan_and_index(spark, d):
    return incremental.latest_scan(table(spark, d, "file_records")), incremental.indexed_files(table(spark, d, "files"), table(spark, d, "index_runs"))


@query(f"WITH {_NOW_WAS} SELECT now.project_id, now.rel_path FROM now LEFT JOIN was ON now.project_id IS NOT DISTINCT FROM was.project_id AND now.rel_path = was.rel_path WHERE was.rel_path IS NULL OR NOT {_SAME}")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.index_pending(table(spark, d, "file_records"), table(spark, d, "files"), table(spark, d, "index_runs"))


_CHANGES = f"""WITH {_NOW_WAS} SELECT coalesce(now.project_id, was.project_id) AS project_id, coalesce(now.rel_path, was.rel_path) AS rel_path,
    CASE WHEN was.rel_path IS NULL THEN 'added' WHEN now.rel_path IS NULL THEN 'deleted' WHEN {_SAME} THEN 'unchanged' ELSE 'changed' END AS state
FROM now FULL JOIN was ON now.project_id = was.project_id AND now.rel_path = was.rel_path"""


@query(_CHANGES)
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    now, was = _scan_and_index(spark, d)
    return incremental.change_states(was, now, ["project_id", "rel_path"])


@query(f"SELECT project_id, state, count(*) AS n FROM ({_CHANGES}) GROUP BY 1, 2")
def index_plan_counts(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.plan_counts(change_detection(spark, d))


@query(f"""WITH {_NOW_WAS}, h AS (SELECT DISTINCT project_id, rel_path FROM chunks WHERE rel_path IS NOT NULL)
SELECT h.project_id, h.rel_path, (r NOT LIKE 'same%') AS stale, r AS freshness_reason FROM (
    SELECT h.*, CASE WHEN was.rel_path IS NULL THEN 'never indexed' WHEN now.rel_path IS NULL THEN 'gone from the scan'
        WHEN now.size = was.size AND now.mtime_ns = was.mtime_ns THEN 'same size and time'
        WHEN now.h = was.h THEN 'same content under another time' ELSE 'other content now' END AS r
    FROM h LEFT JOIN was USING (project_id, rel_path) LEFT JOIN now USING (project_id, rel_path)) h""")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    now, was = _scan_and_index(spark, d)
    hits = catalog.distinct_chunks(table(spark, d, "chunks"), "project_id", "rel_path").where("rel_path IS NOT NULL")
    return retrieval.freshness(hits, now, was).select("project_id", "rel_path", "stale", "freshness_reason")


@query("""WITH l AS (SELECT *, lower(trim(status)) AS st FROM index_runs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY logged_at DESC NULLS LAST, run_seq DESC NULLS LAST, st DESC, run_id DESC) = 1)
SELECT l.project_id, (SELECT count(DISTINCT run_id) FROM index_runs r WHERE r.project_id = l.project_id) AS n_runs, l.run_id, l.st AS status FROM l ORDER BY 1 LIMIT 50""")
def project_inventory(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.inventory(table(spark, d, "index_runs"))


# -- history --------------------------------------------------------------------------------------
_PLAIN = r"regexp_replace(replace({}, '\', '/'), '^(\s|/|\./)+|(\s|/)+$', '', 'g')"
_FIXED = r"regexp_matches({}, '(?i)\b(fix(e[sd])?|bug|hotfix|patch|close[sd]?\s+#\d+)\b')"
_COMMITS = """
c AS (SELECT project_id, "commit" AS commit_id, any_value(coalesce(ts, 0)) AS ts, any_value(coalesce(author, '')) AS author, any_value(coalesce(message, '')) AS message,
    any_value(coalesce(len(parents), 0)) AS np, any_value(coalesce(paths, [])) AS paths FROM commits WHERE "commit" IS NOT NULL GROUP BY 1, 2)"""
_IDS = {
    "commit": "ids AS (SELECT *, commit_id AS change FROM c)",
    "ticket": r"ids AS (SELECT *, coalesce(nullif(regexp_extract(message, '([A-Z][A-Z0-9]+-\d+|#[0-9]+)', 0), ''), commit_id) AS change FROM c)",
    "window": """w1 AS (SELECT *, CASE WHEN lag(commit_id) OVER o IS NULL OR lag(author) OVER o <> author OR ts - lag(ts) OVER o > 7200 THEN 1 ELSE 0 END AS nw FROM c
        WINDOW o AS (PARTITION BY project_id ORDER BY ts, commit_id)),
    ids AS (SELECT *, 'window:' || (sum(nw) OVER (PARTITION BY project_id ORDER BY ts, commit_id ROWS UNBOUNDED PRECEDING))::BIGINT AS change FROM w1)""",
    "merge": """w1 AS (SELECT *, CASE WHEN lag(commit_id) OVER o IS NULL OR lag(np) OVER o > 1 OR np > 1 THEN 1 ELSE 0 END AS nw FROM c
        WINDOW o AS (PARTITION BY project_id ORDER BY ts DESC, commit_id)),
    w2 AS (SELECT *, sum(nw) OVER (PARTITION BY project_id ORDER BY ts DESC, commit_id ROWS UNBOUNDED PRECEDING) AS run FROM w1),
    ids AS (SELECT *, 'merge-window:' || first_value(commit_id) OVER (PARTITION BY project_id, run ORDER BY ts DESC, commit_id) AS change FROM w2 WHERE np <= 1)""",
}
_FILES = f"""
cf AS (SELECT project_id, change, path, sum(n)::BIGINT AS lines FROM (
    SELECT project_id, change, {_PLAIN.format("p.path")} AS path, greatest(coalesce(p.added, 0), 0) + greatest(coalesce(p.deleted, 0), 0) AS n
    FROM (SELECT project_id, change, unnest(paths) AS p FROM ids WHERE np <= 1)) WHERE path <> '' GROUP BY 1, 2, 3),
cs AS (SELECT h.*, coalesce(s.n, 0) AS n_files, CASE WHEN coalesce(s.n, 0) = 0 THEN 'empty' WHEN s.n > 50 THEN 'large' ELSE 'kept' END AS state FROM (
    SELECT project_id, change, count(*) AS commits, max(ts) AS ts, count(DISTINCT nullif(author, '')) AS n_authors, bool_or({_FIXED.format("message")}) AS is_fix,
        sum(CASE WHEN np > 1 THEN 1 ELSE 0 END)::BIGINT AS merges FROM ids GROUP BY 1, 2) h
    LEFT JOIN (SELECT project_id, change, count(*) AS n FROM cf GROUP BY 1, 2) s USING (project_id, change)),
kf AS (SELECT cf.*, cs.ts, cs.is_fix FROM cf JOIN cs USING (project_id, change) WHERE cs.state = 'kept')"""


def _with(mode: str) -> str:
    return f"WITH {_COMMITS}, {_IDS[mode]}, {_FILES}"


def _commits(spark, d):
    """Distinct commits, written once: what follows reads them several times, with few columns each."""
    return kept(history.distinct_commits(table(spark, d, "commits")), "commits")


def _ids(spark, d, mode="commit"):
    ids = history.change_ids(table(spark, d, "commits"), mode)
    return kept(ids, f"changes-{mode}")


_SETS = "SELECT project_id, change, commits, ts, n_authors, is_fix, n_files, state FROM cs"
_SET_COLUMNS = ["project_id", "change", "commits", "ts", "n_authors", "is_fix", "n_files", "state"]


@query(f"{_with('commit')} {_SETS}")
def commit_groups(spark: SparkSession, d: str) -> DataFrame:
    return history.change_sets(_ids(spark, d)).select(*_SET_COLUMNS)


@query(f"{_with('ticket')} {_SETS}")
def ticket_groups(spark: SparkSession, d: str) -> DataFrame:
    return history.change_sets(_ids(spark, d, "ticket")).select(*_SET_COLUMNS)


@query(f"{_with('window')} {_SETS}")
def change_windows(spark: SparkSession, d: str) -> DataFrame:
    return history.change_sets(_ids(spark, d, "window")).select(*_SET_COLUMNS)


@query(f"{_with('merge')} {_SETS}")
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    return history.change_sets(_ids(spark, d, "merge")).select(*_SET_COLUMNS)


@query(f"""{_with('commit')} SELECT project_id, sum((state = 'kept')::INT)::BIGINT AS kept, sum((state = 'large')::INT)::BIGINT AS large, sum((state = 'empty')::INT)::BIGINT AS empty, sum(merges)::BIGINT AS merges FROM cs GROUP BY 1""")
def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    return history.noise(_ids(spark, d))


_CHURN = """SELECT kf.project_id, path, count(*) AS changes, sum(lines)::BIGINT AS churn_lines, max(ts) AS last_touched_ts, sum((ts >= now - 7776000)::INT)::BIGINT AS recent_changes,
    round(sum(is_fix::INT) / count(*), 6) AS fix_density FROM kf JOIN (SELECT project_id, max(ts) AS now FROM kf GROUP BY 1) m ON m.project_id = kf.project_id GROUP BY 1, 2"""


@query(f"{_with('commit')} {_CHURN}")
def churn(spark: SparkSession, d: str) -> DataFrame:
    return history.churn(history.kept_files(_ids(spark, d)))


@query(f"{_with('ticket')} {_CHURN}")
def churn_by_ticket(spark: SparkSession, d: str) -> DataFrame:
    return history.churn(history.kept_files(_ids(spark, d, "ticket")))


_RULES = """, nf AS (SELECT project_id, path, count(*) AS n FROM kf GROUP BY 1, 2), nt AS (SELECT project_id, count(DISTINCT change) AS n FROM kf GROUP BY 1),
pr AS (SELECT a.project_id, a.path, b.path AS other, count(*) AS support FROM kf a JOIN kf b ON a.project_id = b.project_id AND a.change = b.change AND a.path <> b.path GROUP BY 1, 2, 3),
ru AS (SELECT pr.*, round(support / f.n, 6) AS confidence, round(support * nt.n / (f.n * g.n), 6) AS lift FROM pr JOIN nt ON nt.project_id = pr.project_id
    JOIN nf f ON f.project_id = pr.project_id AND f.path = pr.path JOIN nf g ON g.project_id = pr.project_id AND g.path = pr.other)
SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY lift DESC, support DESC, confidence DESC, other)::INT AS rank FROM ru QUALIFY rank <= {n}"""


@query(_with("commit") + _RULES.replace("{n}", "5"))
def cochange_topn(spark: SparkSession, d: str) -> DataFrame:
    return history.cochange(history.kept_files(_ids(spark, d)), 5)


@query(_with("ticket") + _RULES.replace("{n}", "1"))
def cochange_best_by_ticket(spark: SparkSession, d: str) -> DataFrame:
    return history.cochange(history.kept_files(_ids(spark, d, "ticket")), 1)


@query(f"WITH {_COMMITS} SELECT project_id, commit_id AS commit, ts, message FROM c WHERE np = 1 AND {_FIXED.format('message')}")
def fix_commits(spark: SparkSession, d: str) -> DataFrame:
    return history.fix_commits(table(spark, d, "commits"))


_ATTRIBUTED = f"""
e AS (SELECT project_id, path, commit_id, ts, is_fix, sum(deleted) AS deleted FROM (
    SELECT project_id, commit_id, ts, ({_FIXED.format("message")} AND np = 1) AS is_fix, {_PLAIN.format("p.path")} AS path, coalesce(p.deleted, 0) AS deleted
    FROM (SELECT *, unnest(paths) AS p FROM c WHERE np <= 1)) WHERE path <> '' GROUP BY ALL),
atr AS (SELECT * FROM (SELECT project_id, path, commit_id AS fix_commit, is_fix, lag(commit_id) OVER (PARTITION BY project_id, path ORDER BY ts, commit_id) AS introducing_commit,
    greatest(deleted, 1)::INT AS lines FROM e) WHERE is_fix AND introducing_commit IS NOT NULL)"""
_DEFECTS = "SELECT project_id, path, sum(lines)::BIGINT AS defect_introducing_lines, count(DISTINCT introducing_commit) AS defect_introducing_commits, count(DISTINCT fix_commit) AS fix_commits_with_szz FROM atr GROUP BY 1, 2"


@query(f"WITH {_COMMITS}, {_ATTRIBUTED} SELECT project_id, fix_commit, introducing_commit, path, lines FROM atr")
def defect_attribution(spark: SparkSession, d: str) -> DataFrame:
    return history.previous_touch(_commits(spark, d))


@query(f"WITH {_COMMITS}, {_ATTRIBUTED} {_DEFECTS}")
def defect_intro(spark: SparkSession, d: str) -> DataFrame:
    return history.defects(history.previous_touch(_commits(spark, d)))


# -- catalogue ------------------------------------------------------------------------------------
_ENDS = r"regexp_extract({}, '[^.](\.[^.]+)$', 1)"
_PX = r"replace(coalesce({}, ''), '\', '/')"
_NAME = r"regexp_extract({}, '([^/]*)$', 1)"


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _role_sql(path, lang, kind):
    p, name = f"lower({_PX.format(path)})", _NAME.format(f"lower({_PX.format(path)})")
    end, low, k = _ENDS.format(name), f"lower(coalesce({lang}, ''))", f"lower(coalesce({kind}, ''))"
    words = " OR ".join(f"contains({k}, '{w}')" for w in paths.EXECUTABLE_KINDS)
    return rf"""CASE WHEN {name} IN {_in(paths.CONFIG_NAMES)} OR {end} IN {_in(paths.ROLE_CONFIG_ENDS)} OR contains('/' || {p}, '/.github/') THEN 'config'
    WHEN regexp_matches('/' || {p} || '/', '/tests?/') OR regexp_matches({name}, '^test_|_test\.py$|\.(test|spec)\.(js|ts)$') THEN 'test'
    WHEN {end} IN {_in(paths.TEMPLATE_ENDS)} OR {low} IN ('html', 'css') THEN 'template'
    WHEN {k} IN ('comment', 'prose', 'section', 'file') OR {low} IN ('markdown', 'rst', 'text') THEN 'comment' WHEN {words} THEN 'executable' ELSE 'comment' END"""


def _kinds_sql(path, lang):
    p, name = f"lower({_PX.format(path)})", _NAME.format(f"lower({_PX.format(path)})")
    end, low = _ENDS.format(name), f"lower(coalesce({lang}, ''))"
    return rf"""[x FOR x IN [CASE WHEN regexp_matches('/' || {p} || '/', '/tests?/') OR regexp_matches({name}, '^test_|_test\.py$|\.(test|spec)\.(js|jsx|ts|tsx)$') THEN 'test' END,
    CASE WHEN regexp_matches('/' || {p} || '/', '/migrations?/') THEN 'migration' END,
    CASE WHEN {name} IN {_in(paths.CONFIG_NAMES)} OR {end} IN {_in(paths.KIND_CONFIG_ENDS)} OR contains({name}, '.config.') THEN 'config' END,
    CASE WHEN {end} IN {_in(paths.DOC_ENDS)} OR {low} IN ('markdown', 'rst', 'text') THEN 'doc' END] IF x IS NOT NULL]"""


_DIR = r"coalesce(nullif(regexp_replace({}, '/?[^/]*$', ''), ''), '.')"
_CATALOG = f"""
run AS (SELECT project_id, run_id, run_seq, lower(trim(status)) AS st FROM index_runs QUALIFY row_number() OVER (PARTITION BY project_id, run_id ORDER BY logged_at DESC NULLS LAST, st DESC) = 1),
meta AS (SELECT f.project_id, f.rel_path AS path, f.language, f.chunks, f.indent_complexity FROM files f JOIN run r ON r.project_id = f.project_id AND r.run_id = f.run_id AND r.st = 'succeeded'
    WHERE f.rel_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f.project_id, f.rel_path ORDER BY r.run_seq DESC NULLS LAST, f.file_hash DESC NULLS LAST, f.mtime_ns DESC NULLS LAST,
        f.size DESC NULLS LAST, f.language DESC NULLS LAST, f.chunks DESC NULLS LAST, f.indent_complexity DESC NULLS LAST) = 1),
ch AS (SELECT *, coalesce(nullif(chunk_role, ''), {_role_sql('rel_path', 'language', 'symbol_kind')}) AS role FROM (
    SELECT DISTINCT project_id, rel_path, chunk_id, language, symbol, symbol_kind, chunk_role, start_line, end_line FROM chunks WHERE rel_path <> '')),
pf AS (SELECT project_id, rel_path AS path, max(language) AS cl, count(*) AS n,
    count(DISTINCT CASE WHEN symbol <> '' THEN (coalesce(start_line, 0), symbol, lower(coalesce(symbol_kind, '')), end_line) END) AS ns,
    list(DISTINCT lower(coalesce(symbol_kind, ''))) FILTER (symbol <> '') AS sk, list(DISTINCT role) AS rs FROM ch GROUP BY 1, 2),
ft AS (SELECT project_id, path, {_DIR.format(_PX.format('path'))} AS dir, coalesce(language, cl, '') AS language, coalesce(n, chunks, 0)::BIGINT AS chunks,
    coalesce(indent_complexity, 0.0) AS indent_complexity, coalesce(ns, 0) AS symbols, coalesce(sk, []) AS sk, coalesce(rs, []) AS rs,
    {_kinds_sql('path', "coalesce(language, cl, '')")} AS kinds FROM meta FULL JOIN pf USING (project_id, path))"""


def _catalog(spark, d):
    return catalog.build(table(spark, d, "chunks"), catalog.manifest(table(spark, d, "files"), table(spark, d, "index_runs")))


@query(f"WITH {_CATALOG} SELECT project_id, path, dir, language, chunks, indent_complexity, symbols::BIGINT AS symbols, array_to_string(kinds, ',') AS kinds, array_to_string(list_sort(rs), ',') AS roles FROM ft")
def catalog_files(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).select(
        "project_id", "path", "dir", "language", "chunks", "indent_complexity", F.size("symbols").cast("long").alias("symbols"),
        F.array_join("kinds", ",").alias("kinds"), F.array_join(F.array_sort(F.map_keys("roles")), ",").alias("roles"),
    )


@query(f"WITH {_CATALOG} SELECT project_id, count(*) AS files, sum(chunks)::BIGINT AS chunks, sum(symbols)::BIGINT AS symbols FROM ft GROUP BY 1")
def totals(spark: SparkSession, d: str) -> DataFrame:
    return catalog.totals(_catalog(spark, d))


@query(f"""WITH {_CATALOG} SELECT project_id, count(*) AS files, sum(chunks)::BIGINT AS chunks, sum(symbols)::BIGINT AS symbols FROM ft
WHERE chunks > 0 AND len(list_intersect(rs, ['executable', 'test'])) > 0 AND language IN ('python', 'go') AND symbols >= 2 GROUP BY 1""")
def filtered_totals(spark: SparkSession, d: str) -> DataFrame:
    return catalog.totals(catalog.filtered(_catalog(spark, d), code_only=True, languages=["python", "go"], min_symbols=2))


@query(f"""WITH {_CATALOG} SELECT project_id, path FROM ft WHERE chunks > 0 AND list_contains(kinds, 'test') AND len(list_intersect(sk, ['function_definition', 'method'])) > 0 AND list_contains(rs, 'test')""")
def filter_kinds(spark: SparkSession, d: str) -> DataFrame:
    files = catalog.filtered(_catalog(spark, d), kinds="test", chunk_roles="test", symbol_kinds=["function_definition", "method"])
    return files.select("project_id", "path")


@query(rf"WITH {_CATALOG} SELECT project_id, path FROM ft WHERE chunks > 0 AND ({_PX.format('path')} = 'docs' OR starts_with({_PX.format('path')}, 'docs/'))")
def path_prefix(spark: SparkSession, d: str) -> DataFrame:
    return catalog.filtered(_catalog(spark, d), path_prefix="./docs/").select("project_id", "path")


@query(rf"WITH {_CATALOG} SELECT project_id, path FROM ft WHERE chunks > 0 AND regexp_matches({_PX.format('path')}, '^(.*/)?storage/[^/]*_[^/]*\.(py|go|js)$')")
def path_glob(spark: SparkSession, d: str) -> DataFrame:
    files = _catalog(spark, d)
    out = None
    for end in ("py", "go", "js"):
        got = catalog.filtered(files, path_glob=f"**/**/storage/*_*.{end}").select("project_id", "path")
        out = got if out is None else out.unionByName(got)
    return out


def _dir_sql(depth):
    parts = f"string_split({_PX.format('path')}, '/')"
    return f"CASE WHEN len({parts}) <= 1 THEN '.' ELSE array_to_string({parts}[1:least(len({parts}) - 1, {depth})], '/') END"


@query(f"WITH {_CATALOG} SELECT project_id, {_dir_sql(1)} AS dir, count(*) AS files, sum(chunks)::BIGINT AS chunks, sum(symbols)::BIGINT AS symbols FROM ft WHERE chunks > 0 GROUP BY 1, 2")
def dir_map_depth1(spark: SparkSession, d: str) -> DataFrame:
    return catalog.directory_counts(catalog.filtered(_catalog(spark, d)), 1)


@query(f"WITH {_CATALOG} SELECT project_id, {_dir_sql(2)} AS dir, count(*) AS files, sum(chunks)::BIGINT AS chunks, sum(symbols)::BIGINT AS symbols FROM ft WHERE chunks > 0 GROUP BY 1, 2")
def dir_map_depth2(spark: SparkSession, d: str) -> DataFrame:
    return catalog.directory_counts(catalog.filtered(_catalog(spark, d)), 2)


def _counted(alias: str, rows: str) -> str:
    """SQL of one map of a directory as text, key=count in the order of the keys."""
    return f"""{alias} AS (SELECT project_id, dir, string_agg(k || '=' || n, ',' ORDER BY k) AS v FROM (SELECT project_id, dir, k, count(*) AS n FROM ({rows}) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query(f"""WITH {_CATALOG}, b AS (SELECT project_id, path, {_dir_sql(1)} AS dir, chunks, symbols, language, kinds FROM ft WHERE chunks > 0),
{_counted("lg", "SELECT project_id, dir, language AS k FROM b WHERE language <> ''")}, {_counted("kd", "SELECT project_id, dir, unnest(kinds) AS k FROM b")},
{_counted("rl", "SELECT b.project_id, dir, role AS k FROM b JOIN ch ON ch.project_id = b.project_id AND ch.rel_path = b.path")},
t AS (SELECT project_id, dir, count(*) AS files, sum(chunks)::BIGINT AS chunks, sum(symbols)::BIGINT AS symbols FROM b GROUP BY 1, 2)
SELECT t.*, lg.v AS languages, kd.v AS kinds, rl.v AS roles FROM t LEFT JOIN lg USING (project_id, dir) LEFT JOIN kd USING (project_id, dir) LEFT JOIN rl USING (project_id, dir)""")
def dir_map_full(spark: SparkSession, d: str) -> DataFrame:
    m = catalog.directory_map(catalog.filtered(_catalog(spark, d)), 1)
    said = {c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",") for c in ("languages", "kinds", "roles")}
    return m.withColumns(said)


@query(f"""WITH {_CATALOG} SELECT project_id, {_dir_sql(2)} AS dir, count(*) AS files, sum(chunks)::BIGINT AS chunks, sum(symbols)::BIGINT AS symbols FROM ft WHERE chunks > 0 GROUP BY 1, 2
ORDER BY chunks DESC, dir, project_id LIMIT 20 OFFSET 5""")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    return catalog.sorted_page(catalog.directory_counts(catalog.filtered(_catalog(spark, d)), 2), "chunks", 5, 20)


@query(f"""WITH {_CATALOG} SELECT project_id, facet, value, count(*) AS n FROM (
    SELECT project_id, 'dir' AS facet, dir AS value FROM ft UNION ALL SELECT project_id, 'language', coalesce(nullif(language, ''), '(none)') FROM ft
    UNION ALL SELECT project_id, 'chunk_role', role FROM ch UNION ALL SELECT project_id, 'kind', unnest(kinds) FROM ft) GROUP BY 1, 2, 3""")
def catalog_facets(spark: SparkSession, d: str) -> DataFrame:
    return catalog.facet_counts(_catalog(spark, d))


@query(f"SELECT project_id, chunk_id, {_role_sql('rel_path', 'language', 'symbol_kind')} AS role FROM (SELECT DISTINCT project_id, chunk_id, rel_path, language, symbol_kind FROM chunks)")
def chunk_role(spark: SparkSession, d: str) -> DataFrame:
    c = catalog.distinct_chunks(table(spark, d, "chunks"), "project_id", "chunk_id", "rel_path", "language", "symbol_kind")
    return c.select("project_id", "chunk_id", paths.chunk_role("rel_path", "language", "symbol_kind").alias("role"))


@query(f"SELECT project_id, rel_path, array_to_string({_kinds_sql('rel_path', 'language')}, ',') AS kinds FROM (SELECT DISTINCT project_id, rel_path, language FROM file_records)")
def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_records").select("project_id", "rel_path", "language").distinct()
    return f.select("project_id", "rel_path", F.array_join(paths.file_kinds("rel_path", "language"), ",").alias("kinds"))


_LANG_MAP = "map([" + ", ".join(f"'.{e}'" for es in paths.LANGUAGES.values() for e in es) + "], [" + ", ".join(f"'{k}'" for k, es in paths.LANGUAGES.items() for _ in es) + "])"


@query(f"SELECT project_id, rel_path, {_LANG_MAP}[lower({_ENDS.format(_NAME.format('rel_path'))})] AS detected FROM (SELECT DISTINCT project_id, rel_path FROM file_records)")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_records").select("project_id", "rel_path").distinct()
    return f.select("project_id", "rel_path", paths.language("rel_path").alias("detected"))


_MARKED = " OR ".join(f"contains(lower(array_to_string(string_split(content, chr(10))[1:8], chr(10))), '{m}')" for m in text.GENERATED_MARKERS)


@query(f"""SELECT DISTINCT project_id, rel_path, file_hash, (coalesce(language, '') <> 'rst' AND ({_MARKED})) OR (coalesce(language, '') NOT IN ('markdown', 'rst', 'text')
    AND len([x FOR x IN string_split(content, chr(10))[1:500] IF length(x) > 5000]) > 0) AS generated FROM file_records WHERE content IS NOT NULL""")
def generated_filter(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_records").where("content IS NOT NULL")
    return f.select("project_id", "rel_path", "file_hash", text.looks_generated("content", "language").alias("generated")).distinct()


_LINES = r"string_split(regexp_replace(content, '\r\n?|[\x0B\x0C]', chr(10), 'g'), chr(10))"
_LEADS = r"[string_split(regexp_extract(l, '^[ \t]*'), chr(9)) FOR l IN {} IF regexp_matches(l, '\S') AND NOT regexp_matches(l, '^\s*(#|//|/\*|\*|--|<!--)')]".format(_LINES)


@query(f"""SELECT project_id, rel_path, CASE WHEN coalesce(content, '') = '' OR contains(content, chr(0)) OR length(content) > 1000000 THEN 0.0 ELSE round(coalesce(list_sum(
    [coalesce(list_sum([(length(x) // 4 + 1) * 4 FOR x IN s[1:len(s) - 1]]), 0) + length(s[len(s)]) FOR s IN {_LEADS}]), 0) / 4.0, 3) END AS complexity FROM (SELECT DISTINCT project_id, rel_path, content FROM file_records)""")
def indent_complexity(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_records").select("project_id", "rel_path", "content").distinct()
    return f.select("project_id", "rel_path", text.indent_complexity("content").alias("complexity"))


@query("""SELECT coalesce(nullif(lower(language), ''), '(none)') AS language, count(DISTINCT (project_id, coalesce(rel_path, ''))) AS files, count(*) AS chunks,
    sum(greatest(length(coalesce(text, '')) // 4, 1))::BIGINT AS tokens FROM (SELECT DISTINCT project_id, chunk_id, rel_path, language, text FROM chunks) GROUP BY 1""")
def lang_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.language_stats(table(spark, d, "chunks"))


_SPOTS = f"""{_with('commit')}, {_CATALOG}, {_ATTRIBUTED}, chn AS ({_CHURN}), df AS ({_DEFECTS}),
bo AS (SELECT project_id, path, chn.* EXCLUDE (project_id, path), greatest(f.indent_complexity, 0.0) AS complexity FROM chn FULL JOIN ft f USING (project_id, path)),
li AS (SELECT project_id, coalesce(median(changes) FILTER (changes > 0), 0) AS cl, coalesce(median(complexity) FILTER (complexity > 0), 0) AS xl FROM bo GROUP BY 1),
jo AS (SELECT project_id, path, coalesce(changes, 0) AS changes, coalesce(churn_lines, 0) AS churn_lines, coalesce(recent_changes, 0) AS recent_changes, coalesce(last_touched_ts, 0) AS last_touched_ts,
    coalesce(fix_density, 0.0) AS fix_density, coalesce(complexity, 0.0) AS complexity, coalesce(defect_introducing_commits, 0) AS defect_introducing_commits,
    coalesce(defect_introducing_lines, 0) AS defect_introducing_lines FROM bo FULL JOIN df USING (project_id, path)),
sp AS (SELECT jo.*, CASE WHEN cl > 0 AND changes >= cl THEN 'high_churn_' ELSE 'low_churn_' END || CASE WHEN xl > 0 AND complexity >= xl THEN 'high_complexity' ELSE 'low_complexity' END AS quadrant,
    round(changes * greatest(complexity, 1.0), 6) AS score, defect_introducing_commits * greatest(changes, 1) + defect_introducing_lines AS defect_score FROM jo LEFT JOIN li USING (project_id)),
hs AS (SELECT * FROM sp WHERE changes > 0 OR defect_score > 0)"""


def _spots(spark, d):
    commits = _commits(spark, d)
    files = _catalog(spark, d).select("project_id", "path", "chunks", F.size("symbols").cast("long").alias("symbols"), "indent_complexity")
    defective = history.defects(history.previous_touch(commits)).drop("fix_commits_with_szz")
    return history.hotspots(history.churn(history.kept_files(history.change_ids(commits))), files, defective)


@query(f"{_SPOTS} SELECT project_id, path, changes, complexity, quadrant, score, defect_score FROM hs")
def hotspot_quadrants(spark: SparkSession, d: str) -> DataFrame:
    return _spots(spark, d).select("project_id", "path", "changes", "complexity", "quadrant", "score", "defect_score")


@query(f"""{_SPOTS} SELECT project_id, path, score, defect_score, row_number() OVER (PARTITION BY project_id ORDER BY (quadrant <> 'high_churn_high_complexity')::INT, score DESC, defect_score DESC,
    changes DESC, churn_lines DESC, path)::INT AS rank FROM hs QUALIFY rank <= 25""")
def hotspot_rank(spark: SparkSession, d: str) -> DataFrame:
    return history.ranked_hotspots(_spots(spark, d)).select("project_id", "path", "score", "defect_score", "rank")


# -- identities -----------------------------------------------------------------------------------
_BODY = "'path: ' || coalesce(rel_path, '') || CASE WHEN coalesce(symbol, '') <> '' THEN chr(10) || 'symbol: ' || symbol ELSE '' END || CASE WHEN coalesce(language, '') <> '' THEN chr(10) || 'language: ' || language ELSE '' END || chr(10) || chr(10) || coalesce(text, '')"
_CHUNKS = f"ck AS (SELECT *, {_BODY} AS body FROM (SELECT DISTINCT project_id, chunk_id, rel_path, language, symbol, symbol_kind, chunk_role, start_line, text FROM chunks))"


def _chunks(spark, d):
    """Distinct chunks with the text that is searched."""
    columns = ["project_id", "chunk_id", "rel_path", "language", "symbol", "symbol_kind", "chunk_role", "start_line", "text"]
    c = catalog.distinct_chunks(spread(table(spark, d, "chunks").select(*columns)), *columns)
    return c.withColumn("search_text", text.search_text("rel_path", "symbol", "language", "text"))


@query(f"WITH {_CHUNKS} SELECT project_id, chunk_id, sha256(body) AS body_hash, sha256('hashed-64' || chr(0) || '1' || chr(0) || 'none' || chr(0) || body) AS embedding_hash FROM ck")
def identity_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select(
        "project_id", "chunk_id", F.sha2("search_text", 256).alias("body_hash"), text.embedding_hash("hashed-64", "1", "none", "search_text").alias("embedding_hash")
    )


@query("""SELECT project_id, chunk_id, left(sha256(rel_path), 12) || ':' || o || ':' || left(sha256(text), 8) AS recomputed FROM (
    SELECT project_id, chunk_id, rel_path, text, row_number() OVER (PARTITION BY project_id, rel_path ORDER BY coalesce(start_line, 0), chunk_id) - 1 AS o
    FROM (SELECT DISTINCT project_id, chunk_id, rel_path, start_line, text FROM chunks WHERE rel_path IS NOT NULL AND text IS NOT NULL))""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = catalog.distinct_chunks(table(spark, d, "chunks"), "project_id", "chunk_id", "rel_path", "start_line", "text").where("rel_path IS NOT NULL AND text IS NOT NULL")
    return lookup.with_positions(c).select("project_id", "chunk_id", text.chunk_id("rel_path", F.col("position") - 1, "text").alias("recomputed"))


@query("""WITH c AS (SELECT DISTINCT project_id, chunk_id FROM chunks), g AS (SELECT project_id, left(sha256(chunk_id), 2) AS g, count(*) AS n, sum(('0x' || left(sha256(chunk_id), 12))::BIGINT)::VARCHAR AS s FROM c GROUP BY 1, 2)
SELECT project_id, '1:chunks_g1:' || sum(n)::BIGINT || ':' || left(sha256(string_agg(g || '|' || n || '|' || s, chr(10) ORDER BY g || '|' || n || '|' || s)), 32) AS token FROM g GROUP BY 1""")
def catalog_token(spark: SparkSession, d: str) -> DataFrame:
    return catalog.token(table(spark, d, "chunks"), 1, "chunks_g1")


# -- lookups --------------------------------------------------------------------------------------
def _names(spark, d):
    """The symbols that the cases whose id is divisible by 20 expect, and their last parts."""
    e = table(spark, d, "eval_cases").where("item_id % 20 = 0 AND expected_symbol <> ''")
    leaf = F.substring_index("expected_symbol", ".", -1)
    return e.select(F.col("item_id").alias("query_id"), F.col("expected_symbol").alias("name")).unionByName(e.select((-F.col("item_id") - 1).alias("query_id"), leaf.alias("name")))


@query(r"""WITH nm AS (SELECT item_id AS query_id, expected_symbol AS name FROM eval_cases WHERE item_id % 20 = 0 AND expected_symbol <> '' UNION ALL
    SELECT -item_id - 1, regexp_extract(expected_symbol, '[^.]*$') FROM eval_cases WHERE item_id % 20 = 0 AND expected_symbol <> ''
    UNION ALL SELECT 1000000000 + ('0x' || left(md5(symbol), 10))::BIGINT, regexp_extract(symbol, '[^.]*$') FROM (SELECT DISTINCT symbol FROM chunks WHERE symbol <> '' AND ('0x' || left(md5(symbol), 10))::BIGINT % 20 = 0)),
m AS (SELECT query_id, c.*, lower(coalesce(symbol_kind, '')) IN ('module', 'file') AS weak FROM nm JOIN (SELECT DISTINCT project_id, chunk_id, rel_path, symbol, symbol_kind, start_line FROM chunks) c ON name <> '' AND (symbol = name OR ends_with(symbol, '.' || name))),
k AS (SELECT *, bool_or(NOT weak) OVER (PARTITION BY query_id) AS strong FROM m)
SELECT query_id, project_id, chunk_id, rel_path, symbol, symbol_kind, row_number() OVER (PARTITION BY query_id ORDER BY rel_path, start_line NULLS FIRST, chunk_id, project_id)::INT AS rank FROM k WHERE NOT weak OR NOT strong QUALIFY rank <= 20""")
def find_definition(spark: SparkSession, d: str) -> DataFrame:
    c = catalog.distinct_chunks(table(spark, d, "chunks"), "project_id", "chunk_id", "rel_path", "symbol", "symbol_kind", "start_line")
    number = F.conv(F.left(F.md5("symbol"), F.lit(10)), 16, 10).cast("long")
    more = table(spark, d, "chunks").where("symbol <> ''").select("symbol").distinct().where(number % 20 == 0)
    names = _names(spark, d).unionByName(more.select((number + 1_000_000_000).alias("query_id"), F.substring_index("symbol", ".", -1).alias("name")))
    return lookup.definitions_of(c, names).select("query_id", "project_id", "chunk_id", "rel_path", "symbol", "symbol_kind", "rank")


@query()
def symbol_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Names with their second character left out, as a typing error."""
    wrong = _names(spark, d).withColumn("name", F.concat(F.substring("name", 1, 1), F.expr("substring(name, 3)")))
    return lookup.suggestions_of(table(spark, d, "chunks"), wrong)


@query(r"""WITH c AS (SELECT DISTINCT project_id, rel_path, chunk_id, symbol, coalesce(start_line, 0) AS line FROM chunks)
SELECT a.project_id, a.chunk_id, arg_min(b.chunk_id, (b.line, b.chunk_id)) AS parent_id FROM c a JOIN c b ON a.project_id = b.project_id AND a.rel_path = b.rel_path AND a.chunk_id <> b.chunk_id
    AND contains(a.symbol, '.') AND b.symbol = regexp_replace(a.symbol, '\.[^.]*$', '') AND b.symbol <> '' GROUP BY 1, 2""")
def symbol_parent(spark: SparkSession, d: str) -> DataFrame:
    return lookup.parents(catalog.distinct_chunks(table(spark, d, "chunks"), "project_id", "rel_path", "chunk_id", "symbol", "start_line"))


@query("""WITH p AS (SELECT project_id, rel_path, chunk_id, symbol_kind, row_number() OVER (PARTITION BY project_id, rel_path ORDER BY coalesce(start_line, 0), chunk_id) AS pos
    FROM (SELECT DISTINCT project_id, rel_path, chunk_id, start_line, symbol_kind FROM chunks))
SELECT a.project_id, a.chunk_id, b.chunk_id AS neighbour_id, b.pos - a.pos AS relative_position FROM p a JOIN p b ON a.project_id = b.project_id AND a.rel_path = b.rel_path AND a.chunk_id <> b.chunk_id
    AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 WHERE a.symbol_kind = 'function_definition'""")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    c = catalog.distinct_chunks(table(spark, d, "chunks"), "project_id", "rel_path", "chunk_id", "start_line", "symbol_kind")
    return lookup.neighbours(c, c.where("symbol_kind = 'function_definition'"), 2)


@query(r"""WITH l AS (SELECT project_id, rel_path, coalesce(start_line, 1) + generate_subscripts(ls, 1) - 1 AS no, unnest(ls) AS line
    FROM (SELECT project_id, rel_path, start_line, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT project_id, chunk_id, rel_path, start_line, text FROM chunks) WHERE regexp_matches(text, '(?i)\bretry\w*\('))),
h AS (SELECT *, len(regexp_extract_all(line, '(?i)\bretry\w*\(')) AS n FROM l)
SELECT project_id, rel_path, sum(n)::BIGINT AS matches, count(DISTINCT no) AS lines, min(no) AS first_line, max(no) AS last_line FROM h WHERE n > 0 GROUP BY 1, 2""")
def grep_counts(spark: SparkSession, d: str) -> DataFrame:
    c = catalog.distinct_chunks(table(spark, d, "chunks"), "project_id", "chunk_id", "rel_path", "start_line", "text")
    return lookup.grep(c, r"\bretry\w*\(", ignore_case=True)


# -- retrieval ------------------------------------------------------------------------------------
_DIST = "list_sum([({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE) FOR i IN range(1, len({a}) + 1)])"
_FIRST = "[" + ", ".join(f"{0.25 if i % 3 else -0.125}" for i in range(64)) + "]"


@query(f"SELECT vec_id, label, round({_DIST.format(a='embedding', b=f'({_FIRST})')}, 6) AS distance FROM embeddings ORDER BY {_DIST.format(a='embedding', b=f'({_FIRST})')}, vec_id LIMIT 10")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    near = retrieval.nearest(table(spark, d, "embeddings"), [0.25 if i % 3 else -0.125 for i in range(64)], 10)
    return near.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, label, round({_DIST.format(a='embedding', b=f'({_FIRST})')}, 6) AS distance FROM embeddings WHERE label = 3 ORDER BY {_DIST.format(a='embedding', b=f'({_FIRST})')}, vec_id LIMIT 10")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    near = retrieval.nearest(table(spark, d, "embeddings"), [0.25 if i % 3 else -0.125 for i in range(64)], 10, where=F.col("label") == 3)
    return near.select("vec_id", "label", F.round("distance", 6).alias("distance"))


_BATCH = f"""b AS (SELECT q.vec_id AS query_id, e.vec_id, {_DIST.format(a='q.embedding', b='e.embedding')} AS distance FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, e.vec_id) <= {{k}})"""


def _batch(spark, d, k):
    e = table(spark, d, "embeddings")
    return retrieval.nearest_batch(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), k)


@query("WITH " + _BATCH.replace("{k}", "8") + " SELECT query_id, vec_id, round(distance, 6) AS distance FROM b")
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d, 8).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query("WITH " + _BATCH.replace("{k}", "20") + """, s AS (SELECT query_id, 1 / (1 + distance) AS sim, max(1 / (1 + distance)) OVER (PARTITION BY query_id) AS top FROM b)
SELECT query_id, sum((sim >= top * 0.85)::INT)::BIGINT AS n, count(*) AS candidates, round(max(top), 6) AS top_similarity FROM s GROUP BY 1""")
def vector_estimate(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.match_estimate(_batch(spark, d, 20))


_TOK = "[lower(x) FOR x IN regexp_extract_all({}, '[A-Za-z0-9_]+')]"
_BM25 = f"""{_CHUNKS}, tk AS (SELECT project_id, chunk_id, {_TOK.format('body')} AS ts FROM ck), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tk),
po AS (SELECT project_id, chunk_id, term, len(any_value(ts)) AS dl, count(*) AS tf FROM (SELECT project_id, chunk_id, ts, unnest(ts) AS term FROM tk) GROUP BY 1, 2, 3),
qt AS (SELECT query_id, unnest(list_distinct({_TOK.format('query')})) AS term FROM q), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
sc AS (SELECT query_id, project_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
    FROM qt JOIN po USING (term) JOIN df USING (term), st GROUP BY 1, 2, 3),
tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id, project_id)::INT AS rank FROM sc QUALIFY rank <= {{k}})"""
_CASES = "q AS (SELECT item_id AS query_id, query FROM eval_cases WHERE item_id % 20 = 0)"


def _cases(spark, d):
    return table(spark, d, "eval_cases").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "query")


def _bm25(spark, d, k):
    return retrieval.top(retrieval.text_hits(kept(_chunks(spark, d), "chunks"), _cases(spark, d), ["project_id", "chunk_id"]), k, ["chunk_id", "project_id"])


@query(f"WITH {_CASES}, " + _BM25.replace("{k}", "10") + " SELECT query_id, project_id, chunk_id, round(score, 6) AS score, rank FROM tp")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, 10).select("query_id", "project_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_CASES}, " + _BM25.replace("{k}", "10") + " SELECT query_id, count(*) AS n, false AS is_lower_bound FROM sc GROUP BY 1")
def fts_count(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.match_count(retrieval.text_hits(_chunks(spark, d), _cases(spark, d), ["project_id", "chunk_id"]))


@query(f"WITH {_CASES}, " + _BM25.replace("{k}", "10") + " SELECT query_id, least(count(*), 1000) AS n, count(*) > 1000 AS is_lower_bound FROM sc GROUP BY 1")
def fts_count_bound(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.match_count(retrieval.text_hits(_chunks(spark, d), _cases(spark, d), ["project_id", "chunk_id"]), 1000)


@query(f"SELECT item_id, CASE WHEN len([x FOR x IN regexp_split_to_array(query, '\\s+') IF x <> '']) = 1 OR " + " OR ".join("regexp_matches(query, '{}')".format(s.replace("'", "''")) for s in retrieval.IDENTIFIER_SIGNS) + " THEN 'hybrid' ELSE 'vector' END AS mode FROM (SELECT item_id, query FROM eval_cases UNION ALL SELECT -('0x' || left(md5(coalesce(project_id, '') || symbol), 12))::BIGINT, symbol FROM (SELECT DISTINCT project_id, symbol FROM chunks WHERE symbol IS NOT NULL))")
def classify_query(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "chunks").where("symbol IS NOT NULL").select("project_id", "symbol").distinct()
    key = -F.conv(F.left(F.md5(F.concat(F.coalesce("project_id", F.lit("")), "symbol")), F.lit(12)), 16, 10).cast("long")
    q = table(spark, d, "eval_cases").select("item_id", "query").unionByName(symbols.select(key.alias("item_id"), F.col("symbol").alias("query")))
    return q.select("item_id", F.when(retrieval.is_hybrid("query"), "hybrid").otherwise("vector").alias("mode"))


_SLOT = "(('0x' || left(md5(t), 6))::BIGINT % 64)"
_NEAR = f"""cv AS (SELECT project_id, chunk_id, {_SLOT} AS slot, count(*) AS c FROM (SELECT project_id, chunk_id, unnest(ts) AS t FROM tk) GROUP BY 1, 2, 3),
qv AS (SELECT query_id, {_SLOT} AS slot, count(*) AS c FROM (SELECT query_id, unnest({_TOK.format('query')}) AS t FROM q) GROUP BY 1, 2),
cn AS (SELECT project_id, chunk_id, sqrt(sum(c * c)) AS n FROM cv GROUP BY 1, 2), qn AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM qv GROUP BY 1),
dt AS (SELECT query_id, project_id, chunk_id, sum(cv.c * qv.c) AS d FROM cv JOIN qv USING (slot) GROUP BY 1, 2, 3),
vh AS (SELECT qn.query_id, cn.project_id, cn.chunk_id, round(2 - 2 * coalesce(d, 0) / (cn.n * qn.n), 9) AS distance, row_number() OVER (PARTITION BY qn.query_id ORDER BY distance, cn.chunk_id, cn.project_id) AS rank
    FROM cn CROSS JOIN qn LEFT JOIN dt ON dt.query_id = qn.query_id AND dt.project_id = cn.project_id AND dt.chunk_id = cn.chunk_id QUALIFY rank <= 20)"""
_HYBRID = f"""{_CASES}, {_BM25.replace("{k}", "20")}, {_NEAR},
fu AS (SELECT query_id, project_id, chunk_id, sum(1 / (60 + rank)) AS rrf FROM (SELECT query_id, project_id, chunk_id, rank FROM vh UNION ALL SELECT query_id, project_id, chunk_id, rank FROM tp) GROUP BY 1, 2, 3)"""


@query(f"WITH {_HYBRID} SELECT query_id, project_id, chunk_id, round(rrf, 6) AS rrf FROM fu")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    c, q, ids = kept(_chunks(spark, d), "chunks"), _cases(spark, d), ["project_id", "chunk_id"]
    words = retrieval.top(retrieval.text_hits(c, q, ids), 20, ["chunk_id", "project_id"])
    return retrieval.fuse(retrieval.candidates(c, q, 20), words, ids).select("query_id", *ids, F.round("rrf", 6).alias("rrf"))


_BOOST = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in retrieval.ROLE_BOOST.items()) + " ELSE 0 END"
_SIGNS = " OR ".join("regexp_matches(query, '{}')".format(x.replace("'", "''")) for x in retrieval.IDENTIFIER_SIGNS)
_MODE = f"CASE WHEN len([x FOR x IN regexp_split_to_array(query, '\\s+') IF x <> '']) = 1 OR {_SIGNS} THEN 'hybrid' ELSE 'vector' END"


def _ranked_sql(mode: str) -> str:
    """Scores and ranks of all queries, in the mode given as an expression over ``query``."""
    sym, name, toks = "coalesce(symbol, '')", _NAME.format("coalesce(rel_path, '')"), _TOK.format("query")
    return f"""{_HYBRID}, qm AS (SELECT query_id, query, {toks} AS qt0, {mode} AS mode FROM q),
sc2 AS (SELECT query_id, project_id, chunk_id, symbol, rel_path, mode, qt0, round(CASE WHEN mode = 'hybrid' THEN rrf
    + 0.10 * len(list_intersect(list_distinct(qt0), list_distinct({_TOK.format(sym)}))) + CASE WHEN list_contains(qt0, lower({sym})) THEN 0.20 ELSE 0 END
    + CASE WHEN len(list_intersect(qt0, {_TOK.format(name)})) > 0 THEN 0.05 ELSE 0 END ELSE -distance END + {_BOOST.format("chunk_role")}, 6) AS score
    FROM (SELECT query_id, project_id, chunk_id, rrf, NULL::DOUBLE AS distance, 'hybrid' AS m FROM fu UNION ALL SELECT query_id, project_id, chunk_id, NULL, distance, 'vector' FROM vh) x
    JOIN qm USING (query_id) JOIN ck USING (project_id, chunk_id) WHERE m = mode),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, project_id)::INT AS rank FROM sc2 QUALIFY rank <= 8),
nz AS (SELECT *, round(greatest(0, least(1, 0.8 * CASE WHEN mode = 'hybrid' THEN greatest(0, least(1, score / 0.30)) ELSE 1 / (1 + greatest(0, -score)) END + 0.2 * greatest(0, 1 - (rank - 1) * 0.12))), 3) AS score_normalized FROM rk),
rl AS (SELECT *, CASE WHEN score_normalized >= 0.72 THEN 'high' WHEN score_normalized >= 0.5 THEN 'medium' WHEN score_normalized >= 0.25 THEN 'low' ELSE 'uncertain' END AS relevance,
    CASE WHEN {sym} <> '' AND (list_contains(qt0, lower({sym})) OR len(list_intersect(qt0, {_TOK.format(sym)})) > 0) THEN 'a query word is in the symbol'
        WHEN len(list_intersect(qt0, {_TOK.format(name)})) > 0 THEN 'a query word is in the file name' WHEN mode = 'hybrid' THEN 'by similarity and words together' ELSE 'by similarity' END AS match_reason FROM nz)"""


def _search(spark, d, mode="auto", **more):
    return retrieval.search(kept(_chunks(spark, d), "chunks"), _cases(spark, d), k=8, mode=mode, **more)


_FORCED = _ranked_sql("'hybrid'")


@query(f"WITH {_FORCED} SELECT query_id, project_id, chunk_id, score, rank FROM rl")
def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "hybrid").select("query_id", "project_id", "chunk_id", "score", "rank")


@query(f"WITH {_FORCED} SELECT query_id, chunk_id, score_normalized, relevance FROM rl")
def relevance_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "hybrid").select("query_id", "chunk_id", "score_normalized", "relevance")


@query(f"WITH {_ranked_sql(_MODE)} SELECT query_id, project_id, chunk_id, mode, score, rank, score_normalized, relevance, match_reason FROM rl")
def search_code(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).select("query_id", "project_id", "chunk_id", "mode", "score", "rank", "score_normalized", "relevance", "match_reason")


@query(f"""WITH {_ranked_sql("'vector'")}, w AS (SELECT query_id, count(*) FILTER (rank > 1) AS rest, count(*) FILTER (rank > 1 AND relevance = 'uncertain') AS weak FROM rl GROUP BY 1)
SELECT query_id, rest > 0 AND rest = weak AS weak_tail FROM w""")
def tail_weakness(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "vector").select("query_id", "weak_tail").distinct()


@query(f"""WITH {_ranked_sql(_MODE)}, pv AS (SELECT query_id, project_id, chunk_id, qt0, [trim(x) FOR x IN regexp_split_to_array(coalesce(ck.text, ''), '\\r\\n|\\r|\\n') IF trim(x) <> ''] AS ls FROM rl JOIN ck USING (project_id, chunk_id)),
px AS (SELECT query_id, project_id, chunk_id, coalesce([x FOR x IN ls IF len(list_intersect(qt0, {_TOK.format('x')})) > 0][1], ls[1], '') AS line FROM pv)
SELECT query_id, project_id, chunk_id, CASE WHEN length(line) > 160 THEN left(line, 159) || '…' ELSE line END AS preview FROM px""")
def search_previews(spark: SparkSession, d: str) -> DataFrame:
    c = kept(_chunks(spark, d), "chunks")
    hits = retrieval.search(c, _cases(spark, d), k=8).select("query_id", "query", "project_id", "chunk_id")
    return hits.join(c.select("project_id", "chunk_id", "text"), ["project_id", "chunk_id"]).select("query_id", "project_id", "chunk_id", retrieval.preview("text", "query").alias("preview"))


@query(f"WITH {_CASES}, " + _BM25.replace("{k}", "10") + """, f AS (SELECT DISTINCT project_id, chunk_id, rel_path, language, chunk_role FROM chunks), h AS (SELECT query_id, f.* FROM tp JOIN f USING (project_id, chunk_id)),
""" + _CATALOG + f""", pp AS (SELECT project_id, rel_path AS path, max(language) AS hl FROM h GROUP BY 1, 2), pj AS (SELECT pp.*, ft.dir, ft.language, ft.kinds FROM pp LEFT JOIN ft USING (project_id, path))
SELECT facet, value, count(*) AS n FROM (SELECT 'dir' AS facet, coalesce(dir, {_DIR.format(_PX.format('path'))}) AS value FROM pj UNION ALL SELECT 'language', coalesce(nullif(hl, ''), nullif(language, ''), '(none)') FROM pj
    UNION ALL SELECT 'kind', unnest(coalesce(kinds, {_kinds_sql('path', 'hl')})) FROM pj UNION ALL SELECT 'chunk_role', coalesce(nullif(chunk_role, ''), '(none)') FROM h) GROUP BY 1, 2""")
def hit_facets(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d).select("project_id", "chunk_id", "rel_path", "language", "chunk_role")
    return catalog.hit_facets(_bm25(spark, d, 10).join(c, ["project_id", "chunk_id"]), _catalog(spark, d))


# -- evaluation -----------------------------------------------------------------------------------
#: Cases whose answer is in the data: every 20th documented symbol asks for its own chunk; other files of its folder are the distractors.
_SELF = f"""sy AS (SELECT project_id, chunk_id, rel_path, symbol, {_DIR.format(_PX.format('rel_path'))} AS dir, coalesce(nullif(lower(language), ''), 'none') AS category FROM (SELECT DISTINCT project_id, chunk_id, rel_path, symbol, language FROM chunks WHERE symbol <> '' AND rel_path IS NOT NULL)
    WHERE ('0x' || left(md5(chunk_id), 6))::BIGINT % 20 = 0),
fo AS (SELECT project_id, {_DIR.format(_PX.format('rel_path'))} AS dir, min(rel_path) AS lo, max(rel_path) AS hi FROM chunks WHERE rel_path IS NOT NULL GROUP BY 1, 2),
cs0 AS (SELECT ('0x' || left(md5(project_id || chunk_id), 12))::BIGINT AS query_id, symbol || ' ' || category AS query, rel_path, symbol, category, [x FOR x IN list_distinct([lo, hi]) IF x <> rel_path] AS others
    FROM sy JOIN fo USING (project_id, dir)), q AS (SELECT query_id, query FROM cs0)"""


def _self_cases(spark, d):
    return evaluation.starter_cases(catalog.distinct_chunks(table(spark, d, "chunks"), "project_id", "chunk_id", "rel_path", "symbol", "language"))


def _self_ranks(spark, d):
    cases, ids = kept(_self_cases(spark, d), "cases"), ["chunk_id", "project_id"]
    hits = retrieval.best_text_hits(_chunks(spark, d), cases.select("query_id", "query"), 10, ids)
    return evaluation.ranks(cases, hits.join(table(spark, d, "chunks").select(*ids, "rel_path", "symbol"), ids))


def _metrics_sql(groups: str) -> str:
    """Metrics over ``rn`` (t, n: ranks of an expected hit and of a distractor, hd: whether the case has distractors, and the group columns)."""
    hit = ", ".join(f"round(avg((coalesce(t, 99) <= {k})::INT), 4) AS hit{k}" for k in (1, 5, 10))
    hnsr = ", ".join(f"round(avg((coalesce(t, 99) <= {k} AND coalesce(n, 99) > {k})::INT), 4) AS hnsr{k}" for k in (5, 10))
    return f"""mt AS (SELECT grouping_, value, count(*) AS n, {hit}, round(avg(coalesce(1 / t, 0)), 4) AS mrr, {hnsr}, round(avg(CASE WHEN hd THEN coalesce(n, 11) - t END), 4) AS mean_delta_rank FROM ({groups}) GROUP BY 1, 2)"""


_METRICS = f"""WITH {_SELF}, {_BM25.replace("{k}", "10")},
rn AS (SELECT s.query_id, s.category, min(CASE WHEN ck.rel_path = s.rel_path AND contains(lower(coalesce(ck.symbol, '')), lower(s.symbol)) THEN rank END) AS t, min(CASE WHEN list_contains(s.others, ck.rel_path) THEN rank END) AS n,
    bool_or(len(s.others) > 0) AS hd FROM cs0 s LEFT JOIN tp USING (query_id) LEFT JOIN ck ON ck.project_id = tp.project_id AND ck.chunk_id = tp.chunk_id GROUP BY 1, 2),
{_metrics_sql("SELECT 'overall' AS grouping_, 'all' AS value, t, n, hd FROM rn UNION ALL SELECT 'category', category, t, n, hd FROM rn")}"""


@query(f"{_METRICS} SELECT grouping_ AS grouping, * EXCLUDE (grouping_) FROM mt")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics(_self_ranks(spark, d), ["category"])


#: A baseline of its own, one group of which no report has.
_BASE = [("all", 0.75), ("python", 0.6), ("go", 0.9), ("cobol", 0.5)]


@query(f"""{_METRICS}, bs AS (SELECT * FROM (VALUES {", ".join(f"('{g}', {x})" for g, x in _BASE)}) v(value, base)),
lb AS (SELECT value, base, unnest(['hit1', 'hit5', 'hit10', 'mrr']) AS metric FROM bs), lg AS (SELECT value, unnest(['hit1', 'hit5', 'hit10', 'mrr']) AS metric, unnest([hit1, hit5, hit10, mrr]) AS now FROM mt)
SELECT value, metric, base::DOUBLE AS base, now, coalesce(round(now - base, 9) >= -0.05, false) AS passed FROM lb LEFT JOIN lg USING (value, metric)""")
def baseline_gate(spark: SparkSession, d: str) -> DataFrame:
    base = spark.createDataFrame([(g, x, x, x, x) for g, x in _BASE], "value string, hit1 double, hit5 double, hit10 double, mrr double")
    return evaluation.gate(base, evaluation.metrics(_self_ranks(spark, d), ["category"]))


_OVERLAP = f"""ov AS (SELECT item_id AS query_id, CASE WHEN len(u) = 0 THEN 0.0 ELSE len(i) / len(u) END AS o FROM (SELECT item_id, list_distinct(list_concat(a, b)) AS u, list_distinct(list_intersect(a, b)) AS i FROM (
    SELECT item_id, {_TOK.format('query')} AS a, {_TOK.format("coalesce(expected_symbol, '') || ' ' || coalesce(expected_path, '')")} AS b FROM eval_cases)))"""


@query(f"""WITH {_ranked_sql(_MODE).replace("QUALIFY rank <= 8", "QUALIFY rank <= 10")}, {_OVERLAP},
ec AS (SELECT item_id AS query_id, list_distinct(list_concat(coalesce([x FOR x IN expected_paths IF x IS NOT NULL], []), CASE WHEN expected_path IS NULL THEN [] ELSE [expected_path] END)) AS ep, expected_symbol, coalesce(distractor_paths, []) AS dp, category FROM eval_cases WHERE item_id % 20 = 0),
rn AS (SELECT ec.query_id, ec.category, CASE WHEN round(o, 6) = 0 THEN 'zero' WHEN round(o, 6) < 0.03 THEN 'low' WHEN round(o, 6) < 0.10 THEN 'medium' ELSE 'high' END AS bucket,
    min(CASE WHEN list_contains(ep, rl.rel_path) AND (expected_symbol IS NULL OR contains(lower(coalesce(rl.symbol, '')), lower(expected_symbol))) THEN rank END) AS t, min(CASE WHEN list_contains(dp, rl.rel_path) THEN rank END) AS n, bool_or(len(dp) > 0) AS hd
    FROM ec LEFT JOIN ov USING (query_id) LEFT JOIN rl USING (query_id) GROUP BY 1, 2, 3),
{_metrics_sql("SELECT 'overall' AS grouping_, 'all' AS value, t, n, hd FROM rn UNION ALL SELECT 'category', coalesce(category, '(none)'), t, n, hd FROM rn UNION ALL SELECT 'overlap_bucket', bucket, t, n, hd FROM rn")}
SELECT grouping_ AS grouping, * EXCLUDE (grouping_) FROM mt""")
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """Search over the labelled cases whose id is divisible by 20."""
    e = table(spark, d, "eval_cases").where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    said = F.concat(F.coalesce("expected_symbol", F.lit("")), F.lit(" "), F.coalesce("expected_path", F.lit("")))
    cases = evaluation.lexical_overlap(e.withColumn("expected_text", said)).drop("query", "expected_text")
    hits = retrieval.search(kept(_chunks(spark, d), "chunks"), _cases(spark, d), k=10)
    return evaluation.run(cases, hits, ["category", "overlap_bucket"])


@query(f"""SELECT item_id, round(o, 6) AS overlap, CASE WHEN round(o, 6) = 0 THEN 'zero' WHEN round(o, 6) < 0.03 THEN 'low' WHEN round(o, 6) < 0.10 THEN 'medium' ELSE 'high' END AS overlap_bucket FROM (
    SELECT item_id, CASE WHEN len(u) = 0 THEN 0.0 ELSE len(i) / len(u) END AS o FROM (SELECT item_id, list_distinct(list_concat(a, b)) AS u, list_distinct(list_intersect(a, b)) AS i FROM (
        SELECT item_id, {_TOK.format('query')} AS a, {_TOK.format("coalesce(expected_symbol, '') || ' ' || coalesce(expected_path, '')")} AS b FROM eval_cases)))""")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_cases")
    pairs = e.select("item_id", "query", F.concat(F.coalesce("expected_symbol", F.lit("")), F.lit(" "), F.coalesce("expected_path", F.lit(""))).alias("expected_text"))
    return evaluation.lexical_overlap(pairs).select("item_id", "overlap", "overlap_bucket")


# -- cache ----------------------------------------------------------------------------------------
@query("""WITH w AS (SELECT DISTINCT chunk_hash AS h FROM chunks WHERE chunk_hash IS NOT NULL UNION SELECT h FROM embed_cache WHERE dim = 128)
SELECT h FROM w WHERE h NOT IN (SELECT h FROM embed_cache WHERE dim = 96 AND len(vec) = 96 AND h IS NOT NULL)""")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "embed_cache")
    wanted = table(spark, d, "chunks").select(F.col("chunk_hash").alias("h")).unionByName(cache.where("dim = 128").select("h"))
    return lifecycle.cache_misses(wanted, cache, 96)


_CACHE = "cc AS (SELECT h, dim, max(coalesce(last_used_at, 0)) AS last_used_at, any_value(coalesce(len(vec), 0)) * 4 + 80 AS b FROM embed_cache WHERE h IS NOT NULL GROUP BY 1, 2)"


@query(f"""WITH {_CACHE}, t AS (SELECT sum(b) AS b, count(*) AS n FROM cc), r AS (SELECT cc.*, row_number() OVER (ORDER BY last_used_at, h, dim) AS k FROM cc)
SELECT h, dim FROM r, t WHERE k > ceil((t.b - 200000) / (t.b / t.n))""")
def cache_evict(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.cache_evict(table(spark, d, "embed_cache"), 200_000).select("h", "dim")


@query(f"WITH {_CACHE} SELECT dim, count(*) AS rows, sum(b - 80)::BIGINT AS bytes, round(min(last_used_at), 3) AS oldest FROM cc GROUP BY 1")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.cache_stats(table(spark, d, "embed_cache"))


# -- chunking -------------------------------------------------------------------------------------
@query()
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_records").select("project_id", "rel_path", paths.language("rel_path").alias("language"), "content").distinct()
    return chunking.chunked(f)


@query("""SELECT project_id, chunk_id, generate_subscripts(starts, 1) - 1 AS piece, substr(text, unnest(starts), 1920) AS piece_text FROM (
    SELECT project_id, chunk_id, text, range(1, greatest(length(text) - 240, 1) + 1, 1680) AS starts FROM (SELECT DISTINCT project_id, chunk_id, text FROM chunks WHERE length(text) > 1920))""")
def hard_split(spark: SparkSession, d: str) -> DataFrame:
    c = catalog.distinct_chunks(table(spark, d, "chunks"), "project_id", "chunk_id", "text").where("length(text) > 1920")
    return chunking.cut_texts(c)


# -- sessions of the event stream (batch form) ----------------------------------------------------
@query("""WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOURS THEN 1 ELSE 0 END AS n, event_id FROM events),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, g""")
def activity_sessions(spark: SparkSession, d: str) -> DataFrame:
    from lodelens.streaming.windows import activity_windows

    w = activity_windows(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id")
    return w.select("user_id", F.unix_micros("start").alias("start_us"), "n")


# -- more of the catalogue, history and storage -----------------------------------------------------
@query(r"""WITH l AS (SELECT project_id, rel_path, coalesce(start_line, 1) + generate_subscripts(ls, 1) - 1 AS no, unnest(ls) AS line
    FROM (SELECT project_id, rel_path, start_line, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT project_id, chunk_id, rel_path, start_line, text FROM chunks) WHERE regexp_matches(text, '(?i)\bretry\w*\('))),
h AS (SELECT project_id, rel_path, no, len(regexp_extract_all(line, '(?i)\bretry\w*\(')) AS n FROM l WHERE regexp_matches(line, '(?i)\bretry\w*\(')),
f AS (SELECT project_id, rel_path, sum(n)::BIGINT AS matches, count(DISTINCT no) AS n_lines, array_to_string(list_sort(list_distinct(list(no)))[1:3], ',') AS line_numbers FROM h GROUP BY 1, 2)
SELECT project_id, rel_path, matches, n_lines, line_numbers, (SELECT count(*) FROM f) > 13 AS has_more, row_number() OVER (ORDER BY matches DESC, rel_path, project_id)::INT - 3 AS place FROM f QUALIFY place BETWEEN 1 AND 10""")
def grep_page(spark: SparkSession, d: str) -> DataFrame:
    c = catalog.distinct_chunks(table(spark, d, "chunks"), "project_id", "chunk_id", "rel_path", "start_line", "text")
    page = lookup.grep_page(c, r"\bretry\w*\(", limit=10, offset=3, max_matches=3, ignore_case=True)
    return page.select("project_id", "rel_path", "matches", "n_lines", F.array_join(F.transform("listed", lambda x: x["line_no"].cast("string")), ",").alias("line_numbers"), "has_more", "place")


@query("""SELECT project_id, symbol, lower(coalesce(symbol_kind, '')) AS symbol_kind, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT rel_path) AS n_files FROM chunks WHERE symbol <> '' GROUP BY 1, 2, 3""")
def symbol_inventory(spark: SparkSession, d: str) -> DataFrame:
    return lookup.symbol_inventory(table(spark, d, "chunks"))


@query("""WITH c AS (SELECT DISTINCT project_id, rel_path, chunk_id, symbol, symbol_kind, coalesce(start_line, 0) AS line FROM chunks),
p AS (SELECT *, row_number() OVER (PARTITION BY project_id, rel_path ORDER BY line, chunk_id) AS pos FROM c), w AS (SELECT * FROM p WHERE symbol LIKE '%.load%'),
n AS (SELECT w.project_id, w.chunk_id, string_agg((b.pos - w.pos) || ':' || b.chunk_id, ' ' ORDER BY b.pos) AS near FROM w JOIN p b ON b.project_id = w.project_id AND b.rel_path = w.rel_path AND b.chunk_id <> w.chunk_id AND abs(b.pos - w.pos) <= 1 GROUP BY 1, 2),
a AS (SELECT w.project_id, w.chunk_id, arg_min(b.chunk_id, (b.line, b.chunk_id)) AS parent_id FROM w JOIN c b ON b.project_id = w.project_id AND b.rel_path = w.rel_path AND b.chunk_id <> w.chunk_id AND b.symbol = regexp_replace(w.symbol, '\\.[^.]*$', '') AND b.symbol <> '' GROUP BY 1, 2)
SELECT project_id, chunk_id, w.symbol, parent_id, coalesce(near, '') AS near FROM w LEFT JOIN n USING (project_id, chunk_id) LEFT JOIN a USING (project_id, chunk_id)""")
def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    c = kept(catalog.distinct_chunks(table(spark, d, "chunks"), "project_id", "rel_path", "chunk_id", "symbol", "symbol_kind", "start_line"), "chunks")
    got = lookup.get_chunks(c, c.where(F.col("symbol").contains(".load")), 1)
    near = F.array_join(F.transform(F.coalesce("neighbours", F.array().cast("array<struct<relative_position:bigint,neighbour_id:string>>")), lambda x: F.concat_ws(":", x["relative_position"].cast("string"), x["neighbour_id"])), " ")
    return got.select("project_id", "chunk_id", "symbol", "parent_id", near.alias("near"))


@query(f"""{_SPOTS}, ff AS (SELECT project_id, path, chunks, 1 AS there FROM ft), jm AS (SELECT project_id, path, there, ff.chunks, hs.changes, hs.churn_lines, hs.defect_introducing_commits, hs.quadrant, hs.last_touched_ts FROM ff FULL JOIN hs USING (project_id, path))
SELECT project_id, {_dir_sql(1)} AS dir, coalesce(sum(there), 0)::BIGINT AS files, coalesce(sum(chunks), 0)::BIGINT AS chunks, coalesce(sum(changes), 0)::BIGINT AS changes, coalesce(sum(churn_lines), 0)::BIGINT AS churn_lines,
    coalesce(sum(defect_introducing_commits), 0)::BIGINT AS defects, count(*) FILTER (quadrant = 'high_churn_high_complexity') AS hotspots, max(last_touched_ts) AS last_touched_ts FROM jm GROUP BY 1, 2""")
def map_with_history(spark: SparkSession, d: str) -> DataFrame:
    return history.mapped(_catalog(spark, d).select("project_id", "path", "chunks"), _spots(spark, d), 1)


@query(f"""WITH {_COMMITS}, la AS (SELECT project_id, max(epoch_us(coalesce(finished_at, started_at, logged_at)) // 1000000) AS indexed_at FROM index_runs WHERE lower(trim(status)) = 'succeeded' GROUP BY 1)
SELECT c.project_id, any_value(indexed_at) AS indexed_at, sum((indexed_at IS NULL OR ts > indexed_at)::INT)::BIGINT AS commits_since, max(ts) AS newest_commit_ts, sum((indexed_at IS NULL OR ts > indexed_at)::INT) > 0 AS git_stale
FROM c LEFT JOIN la ON la.project_id = c.project_id GROUP BY 1""")
def index_staleness(spark: SparkSession, d: str) -> DataFrame:
    return history.staleness(table(spark, d, "commits"), table(spark, d, "index_runs"))


@query(f"""WITH {_COMMITS}, {_ATTRIBUTED}, g AS (SELECT project_id, path, introducing_commit, sum(greatest(lines, 1))::BIGINT AS lines, count(DISTINCT fix_commit) AS fixes FROM atr GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY lines DESC, introducing_commit)::INT AS rank FROM g QUALIFY rank <= 20""")
def defect_introducers(spark: SparkSession, d: str) -> DataFrame:
    return history.introducers(history.previous_touch(_commits(spark, d)))


@query(f"WITH {_COMMITS}, {_ATTRIBUTED} SELECT fix_commit, introducing_commit, path, sum(greatest(lines, 1))::BIGINT AS lines FROM atr GROUP BY 1, 2, 3")
def attribution_pairs(spark: SparkSession, d: str) -> DataFrame:
    return history.attribution_counts(history.previous_touch(_commits(spark, d)))


@query(f"WITH {_CATALOG} SELECT project_id, path, chunks, least(symbols, 3)::INT AS shown, symbols::INT AS n_symbols, symbols > 3 AS symbols_has_more FROM ft")
def compact_files(spark: SparkSession, d: str) -> DataFrame:
    return catalog.compact(_catalog(spark, d), 3).select("project_id", "path", "chunks", F.size("symbols").alias("shown"), "n_symbols", "symbols_has_more")


@query(f"""WITH {_CATALOG}, cc2 AS (SELECT project_id, rel_path, count(DISTINCT chunk_id) AS n FROM chunks WHERE rel_path IS NOT NULL GROUP BY 1, 2)
SELECT cc2.* FROM cc2 LEFT JOIN meta ON meta.project_id IS NOT DISTINCT FROM cc2.project_id AND meta.path = cc2.rel_path WHERE meta.path IS NULL""")
def orphaned_chunks(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.orphaned_chunks(table(spark, d, "chunks"), catalog.manifest(table(spark, d, "files"), table(spark, d, "index_runs")))


@query(f"""WITH st AS ({_CHANGES}), td AS (SELECT project_id, rel_path FROM st WHERE state IN ('added', 'changed')),
fl AS (SELECT project_id, count(*) FILTER (state <> 'deleted') AS files, count(*) FILTER (state = 'deleted') AS removed FROM st WHERE state <> 'unchanged' GROUP BY 1),
ck AS (SELECT DISTINCT c.project_id, c.chunk_id, c.chunk_hash FROM chunks c JOIN td USING (project_id, rel_path)),
n AS (SELECT project_id, count(DISTINCT chunk_id) AS chunks FROM ck GROUP BY 1),
m AS (SELECT project_id, count(DISTINCT chunk_hash) AS missing_embeddings FROM ck WHERE chunk_hash IS NOT NULL AND chunk_hash NOT IN (SELECT h FROM embed_cache WHERE dim = 96 AND len(vec) = 96 AND h IS NOT NULL) GROUP BY 1)
SELECT project_id, files, removed, coalesce(chunks, 0) AS chunks, coalesce(missing_embeddings, 0) AS missing_embeddings FROM fl LEFT JOIN n USING (project_id) LEFT JOIN m USING (project_id)""")
def index_plan_totals(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.plan_totals(change_detection(spark, d), table(spark, d, "chunks"), table(spark, d, "embed_cache"), 96)


@query("""WITH u AS (SELECT h, dim, coalesce(last_used_at, 0) AS l FROM embed_cache WHERE h IS NOT NULL UNION ALL
    SELECT 'put:' || (length(h) % 7), dim, 2e9 FROM embed_cache WHERE h IS NOT NULL AND vec IS NOT NULL AND len(vec) = dim AND len([x FOR x IN vec IF x IS NULL OR isnan(x) OR isinf(x)]) = 0)
SELECT h, dim, max(l) AS last_used_at FROM u GROUP BY 1, 2""")
def cache_put(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "embed_cache")
    new = cache.where("h IS NOT NULL").select(F.concat(F.lit("put:"), (F.length("h") % 7).cast("string")).alias("h"), "dim", "vec")
    return lifecycle.cache_put(cache, new, 2e9).select("h", "dim", "last_used_at")


@query(f"""WITH {_ranked_sql(_MODE)}, b AS (SELECT query_id, rl.project_id, rl.chunk_id, rank, length(coalesce(ck.text, ''))::BIGINT AS len FROM rl JOIN ck USING (project_id, chunk_id)),
u AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b)
SELECT query_id, project_id, chunk_id, rank, greatest(0, least(len, 4000 - used))::BIGINT AS granted FROM u""")
def search_budget(spark: SparkSession, d: str) -> DataFrame:
    c = kept(_chunks(spark, d), "chunks")
    hits = retrieval.search(c, _cases(spark, d), k=8).select("query_id", "project_id", "chunk_id", "rank")
    sized = hits.join(c.select("project_id", "chunk_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("len")), ["project_id", "chunk_id"])
    return retrieval.budget(sized, "len", 4000).select("query_id", "project_id", "chunk_id", "rank", "granted")


@query(f"""WITH {_ranked_sql(_MODE)}, g AS (SELECT query_id, count(*) AS n, count(*) FILTER (relevance <> 'uncertain') AS sure, count(*) FILTER (rank > 1) AS rest, count(*) FILTER (rank > 1 AND relevance = 'uncertain') AS weak FROM rl GROUP BY 1),
es AS (SELECT query_id, count(*) AS e FROM sc GROUP BY 1), hn AS (SELECT q.query_id, coalesce(n, 0) AS n_hits, [x FOR x IN [CASE WHEN coalesce(n, 0) = 0 THEN 'no_hits' END, CASE WHEN n > 0 AND sure = 0 THEN 'only_uncertain' END, CASE WHEN rest > 0 AND rest = weak THEN 'weak_tail' END,
    CASE WHEN e > coalesce(n, 0) THEN 'more_matches' END] IF x IS NOT NULL] AS hs FROM q LEFT JOIN g USING (query_id) LEFT JOIN es USING (query_id))
SELECT query_id, n_hits, unnest(CASE WHEN len(hs) = 0 THEN [NULL] ELSE hs END) AS hint FROM hn""")
def search_hints(spark: SparkSession, d: str) -> DataFrame:
    c, q = kept(_chunks(spark, d), "chunks"), _cases(spark, d)
    return retrieval.hints(retrieval.search(c, q, k=8), q, retrieval.match_count(retrieval.text_hits(c, q, ["project_id", "chunk_id"])))
