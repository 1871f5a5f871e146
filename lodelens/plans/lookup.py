"""Exact lookups: definitions, suggestions, chunk neighbours and parents, pattern scans."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodelens.functions import text


def definitions(chunks: DataFrame, name: str, k: int = 20) -> DataFrame:
    """Chunks whose symbol is the name or ends in ``.name``; module and file kinds only if nothing else matches."""
    hit = chunks.where((F.col("symbol") == name) | F.col("symbol").endswith("." + name))
    weak = F.lower(F.coalesce("symbol_kind", F.lit(""))).isin("module", "file")
    strong = hit.where(~weak).limit(1).count() > 0
    rows = hit.where(~weak) if strong else hit
    return rows.orderBy("rel_path", F.col("start_line").asc_nulls_first(), "chunk_id", "project_id").limit(k)


def definitions_of(chunks: DataFrame, names: DataFrame, k: int = 20) -> DataFrame:
    """:func:`definitions` for a table of names (query_id, name): the rows of ``chunks`` with query_id and rank, at most ``k`` a name.

    A symbol is found under each of its dotted endings, so names meet symbols by an ordinary join.
    """
    parts = F.split("symbol", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    named = chunks.where("symbol <> ''").withColumn("name", F.explode(F.array_distinct(endings)))
    hit = named.join(names.where("name <> ''").select("query_id", "name").distinct(), "name")
    weak = F.lower(F.coalesce("symbol_kind", F.lit(""))).isin("module", "file")
    every = Window.partitionBy("query_id")
    hit = hit.withColumn("_strong", F.max(~weak).over(every)).where(~weak | ~F.col("_strong")).drop("_strong")
    w = every.orderBy("rel_path", F.col("start_line").asc_nulls_first(), "chunk_id", "project_id")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("name")


# What a symbol's likeness gains where the name begins it, stands in it, or stands in its last part; the least that counts.
BEGINS, CONTAINS, IN_LEAF, LEAST = 0.45, 0.30, 0.20, 0.45


MAX_NAMES = 10_000


def _gain(needle: str, low: str) -> float:
    """What a symbol in lower case gains for a common beginning or containment."""
    leaf = low.rpartition(".")[2]
    gains = ((leaf.startswith(needle) or low.startswith(needle), BEGINS), (needle in low, CONTAINS), (needle in leaf, IN_LEAF))
    return next((g for holds, g in gains if holds), 0.0)


def likeness(needle: str, symbol: str) -> float:
    """Ratio of matching blocks, letter case aside, and the gain; not yet cut at 1."""
    low = symbol.lower()
    return SequenceMatcher(None, needle, low).ratio() + _gain(needle, low)


def suggestions_of(chunks: DataFrame, names: DataFrame, k: int = 8, at_least: float = LEAST) -> DataFrame:
    """(query_id, symbol, score, rank): for each name of a table (query_id, name) the symbols like it, best first, then by symbol; scores are cut at 1.

    At most ``MAX_NAMES`` names. Symbols that can't be like enough, by the upper bounds of the ratio, are not measured.
    """
    rows = names.where("name <> ''").select("query_id", "name").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names at once")
    asked = [(r.query_id, r.name.lower()) for r in rows]
    symbols = chunks.where("symbol IS NOT NULL AND symbol <> ''").select("symbol").distinct()

    def score(batches):
        for pdf in batches:
            found = []
            for s in pdf["symbol"]:
                m = SequenceMatcher(None, "", s.lower())
                for q, needle in asked:
                    m.set_seq1(needle)
                    gain = _gain(needle, s.lower())
                    if m.real_quick_ratio() + gain >= at_least and m.quick_ratio() + gain >= at_least:
                        found.append((q, s, m.ratio() + gain))
            yield pd.DataFrame(found, columns=["query_id", "symbol", "raw"])

    kind = names.schema["query_id"].dataType.simpleString()
    scored = symbols.mapInPandas(score, f"query_id {kind}, symbol string, raw double").where(F.col("raw") >= at_least)
    w = Window.partitionBy("query_id").orderBy(F.desc("raw"), "symbol")
    scored = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return scored.select("query_id", "symbol", F.round(F.least("raw", F.lit(1.0)), 3).alias("score"), "rank")


def suggestions(chunks: DataFrame, name: str, k: int = 8, at_least: float = LEAST) -> DataFrame:
    """(symbol, score): :func:`suggestions_of` for one name."""
    one = chunks.sparkSession.createDataFrame([(1, name)], "query_id int, name string")
    return suggestions_of(chunks, one, k, at_least).orderBy("rank").select("symbol", "score")


def find_definition(chunks: DataFrame, name: str, k: int = 20) -> tuple[DataFrame, DataFrame | None]:
    """Definitions of a name; if there are none, symbols like it as well."""
    if not name or not name.strip():
        raise ValueError("a name is needed")
    found = definitions(chunks, name, k)
    return found, (suggestions(chunks, name) if found.isEmpty() else None)


def symbol_inventory(chunks: DataFrame) -> DataFrame:
    """(project_id, symbol, symbol_kind, n_chunks, n_files) of all symbols."""
    c = chunks.where("symbol <> ''").groupBy("project_id", "symbol", F.lower(F.coalesce("symbol_kind", F.lit(""))).alias("symbol_kind"))
    return c.agg(F.count_distinct("chunk_id").alias("n_chunks"), F.count_distinct("rel_path").alias("n_files"))


def get_chunks(chunks: DataFrame, wanted: DataFrame, window: int = 1) -> DataFrame:
    """The wanted chunks (project_id, chunk_id) with their parent and, in order, their neighbours (id and relative position)."""
    ids = ["project_id", "chunk_id"]
    c = chunks.join(wanted.select(*ids).distinct(), ids, "left_semi")
    paths = c.select("project_id", "rel_path").distinct()
    there = chunks.join(paths, ["project_id", "rel_path"], "left_semi")
    near = neighbours(there, c, window).groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("relative_position", "neighbour_id"))).alias("neighbours"))
    return c.join(parents(there), ids, "left").join(near, ids, "left")


def with_positions(chunks: DataFrame) -> DataFrame:
    """Position of each chunk in its file, by line then id."""
    w = Window.partitionBy("project_id", "rel_path").orderBy(F.coalesce("start_line", F.lit(0)), "chunk_id")
    return chunks.withColumn("position", F.row_number().over(w))


def neighbours(chunks: DataFrame, wanted: DataFrame, window: int = 1) -> DataFrame:
    """(project_id, chunk_id, neighbour_id, relative_position) for the wanted chunks, within ``window`` (0 to 5) places."""
    window = max(0, min(int(window), 5))
    p = with_positions(chunks.select("project_id", "rel_path", "chunk_id", "start_line"))
    w = p.join(wanted.select("project_id", "chunk_id"), ["project_id", "chunk_id"], "left_semi")
    near = w.select("project_id", "rel_path", F.col("chunk_id").alias("of"), F.col("position").alias("at"), F.explode(F.sequence(F.col("position") - window, F.col("position") + window)).alias("position"))
    return near.join(p, ["project_id", "rel_path", "position"]).where("of <> chunk_id").select(
        "project_id", F.col("of").alias("chunk_id"), F.col("chunk_id").alias("neighbour_id"), (F.col("position") - F.col("at")).cast("long").alias("relative_position")
    )


def parents(chunks: DataFrame) -> DataFrame:
    """(project_id, chunk_id, parent_id): the chunk of the same file whose symbol is the dotted prefix; the first, not itself."""
    c = chunks.select("project_id", "rel_path", "chunk_id", "symbol", F.coalesce("start_line", F.lit(0)).alias("line"))
    kids = c.where(F.col("symbol").contains(".")).withColumn("parent", F.regexp_replace("symbol", r"\.[^.]*$", ""))
    tops = c.where("symbol <> ''").select("project_id", "rel_path", F.col("symbol").alias("parent"), F.col("chunk_id").alias("parent_id"), F.col("line").alias("parent_line"))
    j = kids.join(tops, ["project_id", "rel_path", "parent"]).where("chunk_id <> parent_id")
    return j.groupBy("project_id", "chunk_id").agg(F.min(F.struct("parent_line", "parent_id")).alias("p")).select("project_id", "chunk_id", "p.parent_id")


def grep_lines(chunks: DataFrame, pattern: str, ignore_case: bool = False, default: str = r"(?!)") -> DataFrame:
    """(project_id, rel_path, line_no, line, n): every line with a match once, and its matches.

    Lines end at ``\\n``; a chunk's first line is its start_line, or 1; a line that stands in several chunks counts once (of differing ones the
    greatest). A pattern that isn't safe matches nothing.
    """
    p = ("(?i)" if ignore_case else "") + text.safe_pattern(pattern, default)
    rows = chunks.where(F.col("text").rlike(p)).select(
        "project_id", "rel_path", F.coalesce("start_line", F.lit(1)).alias("first"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line")
    )
    hits = rows.withColumn("n", F.regexp_count("line", F.lit(p))).where("n > 0").withColumn("line_no", (F.col("first") + F.col("i")).cast("long"))
    return hits.groupBy("project_id", "rel_path", "line_no").agg(F.max(F.struct("line", "n")).alias("r"), F.sum("n").alias("all")).select(
        "project_id", "rel_path", "line_no", "r.line", F.col("r.n").cast("long").alias("n"), F.col("all").cast("long").alias("in_chunks")
    )


def grep(chunks: DataFrame, pattern: str, ignore_case: bool = False, default: str = r"(?!)") -> DataFrame:
    """Per project and path: matches (in all chunks), and the number, first and last of the distinct lines with one."""
    return grep_lines(chunks, pattern, ignore_case, default).groupBy("project_id", "rel_path").agg(
        F.sum("in_chunks").alias("matches"), F.count("*").alias("lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
    )


def grep_page(chunks: DataFrame, pattern: str, limit: int = 50, offset: int = 0, max_matches: int = 500, include_lines: bool = False, ignore_case: bool = False) -> DataFrame:
    """One page of files, most matches first, then by path: matches, has_more, and their line numbers in order (with the lines, if asked for).

    Of a file the first ``max_matches`` lines are listed.
    """
    lines = grep_lines(chunks, pattern, ignore_case)
    files = lines.groupBy("project_id", "rel_path").agg(F.sum("in_chunks").alias("matches"), F.count("*").alias("n_lines"))
    limit, offset = max(1, min(int(limit), 500)), max(0, int(offset))
    order = [F.desc("matches"), F.col("rel_path"), F.col("project_id")]
    page = files.orderBy(*order).offset(offset).limit(limit + 1)
    page = page.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # of one page's rows
    more = page.select(F.max("place").alias("_n"))
    page = page.where(F.col("place") <= limit).join(F.broadcast(more)).withColumn("has_more", F.col("_n") > limit).drop("_n")
    w = Window.partitionBy("project_id", "rel_path").orderBy("line_no")
    listed = lines.join(F.broadcast(page.select("project_id", "rel_path")), ["project_id", "rel_path"], "left_semi").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_matches)
    what = F.struct("line_no", *(["line"] if include_lines else []))
    listed = listed.groupBy("project_id", "rel_path").agg(F.array_sort(F.collect_list(what)).alias("listed"))
    return page.join(listed, ["project_id", "rel_path"])
