"""The catalogue of files: built from chunks and the files manifest, filtered, mapped to directories, counted by facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodelens.functions import paths
from lodelens.operators import incremental

MAX_DEPTH, MAX_LIMIT = 20, 500
#: Hashes of repeated rows that are sent to all tasks at most; beyond it whole rows are shuffled.
MAX_REPEATED = 1_000_000


def distinct_chunks(chunks: DataFrame, *columns: str) -> DataFrame:
    """Repeated rows once; only the columns asked for are read.

    Texts aren't shuffled for it: where ``text`` is asked for, only rows whose key and text hash occur several times are compared as a whole.
    """
    rows = chunks.select(*columns)
    if "text" not in rows.columns:
        return rows.distinct()
    keys = [c for c in ("project_id", "chunk_id") if c in rows.columns]
    rows = rows.withColumn("_h", F.xxhash64(*keys, "text"))
    twice = rows.select("_h").groupBy("_h").count().where("count > 1").select("_h")
    n = twice.limit(MAX_REPEATED + 1).count()
    if not n:
        return rows.drop("_h")
    if n > MAX_REPEATED:
        return rows.drop("_h").distinct()
    few = F.broadcast(twice)
    return rows.join(few, "_h", "left_anti").unionByName(rows.join(few, "_h", "left_semi").distinct()).drop("_h")


def role_of(df: DataFrame) -> Column:
    """The stored role, or the derived one where it is missing."""
    return F.coalesce(F.nullif("chunk_role", F.lit("")), paths.chunk_role("rel_path", "language", "symbol_kind"))


def manifest(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Per project and path what the newest succeeded run wrote: language, chunks, indent_complexity."""
    row = F.max(F.struct("run_seq", "file_hash", "mtime_ns", "size", "language", "chunks", "indent_complexity")).alias("r")
    return (
        files.where("rel_path IS NOT NULL")
        .join(incremental.succeeded_runs(runs), ["project_id", "run_id"])
        .groupBy("project_id", "rel_path")
        .agg(row)
        .select("project_id", F.col("rel_path").alias("path"), "r.language", "r.chunks", "r.indent_complexity")
    )


def build(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per file of the manifest or the chunks: counts, role map, symbols and chunk references in order, kinds.

    Languages of the manifest win; chunks present in the table win over the manifest's count.
    """
    c = distinct_chunks(chunks, "project_id", "rel_path", "chunk_id", "language", "symbol", "symbol_kind", "chunk_role", "start_line", "end_line")
    c = c.where("rel_path IS NOT NULL AND rel_path <> ''").withColumn("role", role_of(c))
    roles = c.groupBy("project_id", "rel_path", "role").count()
    role_maps = roles.groupBy("project_id", "rel_path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "count")))).alias("roles"))
    symbol = F.struct(F.coalesce("start_line", F.lit(0)).alias("start_line"), F.col("symbol").alias("name"), F.lower(F.coalesce("symbol_kind", F.lit(""))).alias("kind"), "end_line")
    ref = F.struct(F.coalesce("start_line", F.lit(0)).alias("start_line"), "chunk_id", "end_line")
    per_file = c.groupBy("project_id", "rel_path").agg(
        F.max("language").alias("chunk_language"), F.count("*").alias("n_chunks"),
        F.array_sort(F.collect_set(F.when(F.coalesce("symbol", F.lit("")) != "", symbol))).alias("symbols"),
        F.array_sort(F.collect_list(ref)).alias("refs"),
    )
    per_file = per_file.join(role_maps, ["project_id", "rel_path"]).withColumnRenamed("rel_path", "path")
    j = meta.join(per_file, ["project_id", "path"], "full_outer")
    lang = F.coalesce("language", "chunk_language", F.lit(""))
    return j.select(
        "project_id", "path", paths.directory("path").alias("dir"), lang.alias("language"),
        F.coalesce("n_chunks", "chunks", F.lit(0)).cast("long").alias("chunks"),
        F.coalesce("indent_complexity", F.lit(0.0)).alias("indent_complexity"),
        F.coalesce("roles", F.create_map().cast("map<string,bigint>")).alias("roles"),
        F.coalesce("symbols", F.array()).alias("symbols"), F.coalesce("refs", F.array()).alias("refs"),
        paths.file_kinds("path", lang).alias("kinds"),
    )


def _values(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x or [])


def filtered(
    files: DataFrame, *, non_empty: bool = True, code_only: bool = False, languages=None, chunk_roles=None, kinds=None,
    path_prefix: str | None = None, path_glob: str | None = None, symbol_kinds=None, min_symbols: int = 0,
) -> DataFrame:
    """All conditions hold at once; lists mean any of their values."""
    present = F.map_keys(F.map_filter("roles", lambda _, n: n > 0))
    def any_of(column, wanted):
        return F.arrays_overlap(column, F.array(*[F.lit(w) for w in wanted]))

    if non_empty:
        files = files.where("chunks > 0")
    if code_only:
        files = files.where(any_of(present, ["executable", "test"]))
    if w := _values(languages):
        files = files.where(F.col("language").isin(w))
    if w := _values(chunk_roles):
        files = files.where(any_of(present, w))
    if w := _values(kinds):
        files = files.where(any_of(F.col("kinds"), w))
    files = files.where(paths.has_prefix("path", path_prefix) & paths.matches_glob("path", path_glob))
    if w := _values(symbol_kinds):
        files = files.where(any_of(F.transform("symbols", lambda s: s["kind"]), w))
    return files.where(F.size("symbols") >= max(0, min_symbols)) if min_symbols > 0 else files


def totals(files: DataFrame) -> DataFrame:
    return files.groupBy("project_id").agg(
        F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.sum(F.size("symbols")).cast("long").alias("symbols")
    )


def directory_map(files: DataFrame, depth: int = 1) -> DataFrame:
    """Per project and directory down to ``depth`` segments: files, chunks, symbols, and maps of languages, roles and kinds.

    The maps come from pre-aggregated (directory, key) counts, one small row a key.
    """
    depth = max(0, min(int(depth), MAX_DEPTH))
    f = files.withColumn("dir", paths.directory_at("path", depth))
    base = f.groupBy("project_id", "dir").agg(
        F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.sum(F.size("symbols")).cast("long").alias("symbols")
    )
    for name, key in (("languages", F.when(F.col("language") != "", F.array("language"))), ("kinds", F.col("kinds"))):
        base = base.join(_map_of(f.select("project_id", "dir", F.explode(key).alias("k"), F.lit(1).cast("long").alias("n")), name), ["project_id", "dir"], "left")
    role_rows = f.select("project_id", "dir", F.explode("roles").alias("k", "n"))
    return base.join(_map_of(role_rows, "roles"), ["project_id", "dir"], "left")


def _map_of(rows: DataFrame, name: str) -> DataFrame:
    counts = rows.groupBy("project_id", "dir", "k").agg(F.sum("n").alias("n"))
    return counts.groupBy("project_id", "dir").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))


def directory_counts(files: DataFrame, depth: int) -> DataFrame:
    """The numbers of :func:`directory_map` without the maps."""
    f = files.withColumn("dir", paths.directory_at("path", max(0, min(int(depth), MAX_DEPTH))))
    return f.groupBy("project_id", "dir").agg(
        F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.sum(F.size("symbols")).cast("long").alias("symbols")
    )


def sorted_page(rows: DataFrame, sort: str = "path", offset: int = 0, limit: int = 50) -> DataFrame:
    """Directories in the order of path, files, chunks or symbols (others: path), one page of them."""
    order = {"files": F.desc("files"), "chunks": F.desc("chunks"), "symbols": F.desc("symbols")}.get(sort)
    keys = [*([order] if order is not None else []), F.col("dir"), F.col("project_id")]
    return page(rows, keys, offset, limit)


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """Offset pagination; limits are clamped to 0..MAX_LIMIT."""
    limit = max(0, min(int(limit), MAX_LIMIT))
    return rows.orderBy(*order).offset(max(0, int(offset))).limit(limit)


def facet_counts(files: DataFrame, facets: list[str] | None = None) -> DataFrame:
    """(project_id, facet, value, n) for dir, language, chunk_role and kind, in one pass and one shuffle."""
    wanted = facets or ["dir", "language", "chunk_role", "kind"]
    one = F.lit(1).cast("long")
    def entry(facet, value, n):
        return F.struct(F.lit(facet).alias("facet"), value.alias("value"), n.alias("n"))

    parts = {
        "dir": F.array(entry("dir", F.col("dir"), one)),
        "language": F.array(entry("language", F.when(F.col("language") == "", "(none)").otherwise(F.col("language")), one)),
        "chunk_role": F.transform(F.map_entries("roles"), lambda e: entry("chunk_role", e["key"], e["value"])),
        "kind": F.transform("kinds", lambda k: entry("kind", k, one)),
    }
    rows = files.select("project_id", F.inline(F.concat(*[parts[f] for f in wanted])))
    return rows.groupBy("project_id", "facet", "value").agg(F.sum("n").alias("n"))


def hit_facets(hits: DataFrame, files: DataFrame) -> DataFrame:
    """(facet, value, n) over search hits: dir, language and kind once per distinct path, chunk_role per row."""
    per_path = hits.select("project_id", F.col("rel_path").alias("path"), "language").groupBy("project_id", "path").agg(F.max("language").alias("hit_language"))
    f = per_path.join(files.select("project_id", "path", "dir", "language", "kinds"), ["project_id", "path"], "left")
    lang = F.coalesce(F.nullif("hit_language", F.lit("")), F.nullif("language", F.lit("")), F.lit("(none)"))
    one = f.select(
        F.inline(F.concat(
            F.array(F.struct(F.lit("dir").alias("facet"), F.coalesce("dir", paths.directory("path")).alias("value")), F.struct(F.lit("language").alias("facet"), lang.alias("value"))),
            F.transform(F.coalesce("kinds", paths.file_kinds("path", "hit_language")), lambda k: F.struct(F.lit("kind").alias("facet"), k.alias("value"))),
        ))
    )
    roles = hits.select(F.lit("chunk_role").alias("facet"), F.coalesce(F.nullif("chunk_role", F.lit("")), F.lit("(none)")).alias("value"))
    return one.unionByName(roles).groupBy("facet", "value").agg(F.count("*").alias("n"))


def compact(files: DataFrame, symbols_limit: int = 20) -> DataFrame:
    """Body-free rows: symbols clipped, with a flag for more."""
    return files.select(
        "project_id", "path", "dir", "language", "chunks", "indent_complexity", F.slice("symbols", 1, symbols_limit).alias("symbols"),
        F.size("symbols").alias("n_symbols"), (F.size("symbols") > symbols_limit).alias("symbols_has_more"),
    )


def token(chunks: DataFrame, generation: int, table: str) -> DataFrame:
    """Per project the commit token of a catalogue: generation, table, row count and a hash of the sorted chunk ids.

    The ids are hashed in two levels (256 groups by hash prefix), so no group of unbounded size is collected.
    """
    ids = distinct_chunks(chunks, "project_id", "chunk_id").withColumn("g", F.left(F.sha2("chunk_id", 256), F.lit(2)))
    sums = ids.groupBy("project_id", "g").agg(F.count("*").alias("n"), F.sum(F.conv(F.left(F.sha2("chunk_id", 256), F.lit(12)), 16, 10).cast("decimal(38,0)")).alias("s"))
    return sums.groupBy("project_id").agg(
        F.concat_ws(":", F.lit(str(generation)), F.lit(table), F.sum("n").cast("string"),
                    F.left(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "g", "n", F.col("s").cast("string")))), "\n"), 256), F.lit(32))).alias("token")
    )


def language_stats(chunks: DataFrame) -> DataFrame:
    """Files, chunks and estimated tokens per language; the estimate is recomputed from the text."""
    c = distinct_chunks(chunks, "project_id", "chunk_id", "rel_path", "language", F.greatest(F.floor(F.length(F.coalesce("text", F.lit(""))) / 4), F.lit(1)).alias("tokens"))
    return c.groupBy(F.coalesce(F.nullif(F.lower("language"), F.lit("")), F.lit("(none)")).alias("language")).agg(
        F.count_distinct("project_id", F.coalesce("rel_path", F.lit(""))).alias("files"), F.count("*").alias("chunks"), F.sum("tokens").cast("long").alias("tokens")
    )
