"""Quality of retrieval: ranks of expected and distracting hits, metrics in groups, and a gate against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodelens import shared
from lodelens.functions import text


def load_cases(spark, path: str) -> DataFrame:
    """Cases from a JSON array with a fixed schema; rows without query or expected path are an error."""
    schema = "query string, expected_path string, expected_paths array<string>, expected_symbol string, distractor_paths array<string>, category string"
    cases = spark.read.schema(schema).option("multiLine", True).json(path)
    bad = cases.where("query IS NULL OR trim(query) = '' OR (expected_path IS NULL AND coalesce(size(expected_paths), 0) < 1)")
    if not bad.isEmpty():
        raise ValueError("a case lacks its query or its expected path")
    return cases.withColumn("item_id", F.xxhash64("query"))


def starter_cases(chunks: DataFrame, every: int = 20) -> DataFrame:
    """Cases made from the symbols of a table, one of ``every`` documented chunks: the symbol asks for its own file, and the first and last other
    file of the same folder are the distractors."""
    from lodelens.functions import paths

    c = chunks.where("symbol <> '' AND rel_path IS NOT NULL")
    folder = paths.directory("rel_path").alias("dir")
    ends = chunks.where("rel_path IS NOT NULL").groupBy("project_id", folder).agg(F.min("rel_path").alias("lo"), F.max("rel_path").alias("hi"))
    hashed = F.conv(F.left(F.md5("chunk_id"), F.lit(6)), 16, 10).cast("long")
    category = F.coalesce(F.nullif(F.lower("language"), F.lit("")), F.lit("none"))
    c = c.where(hashed % every == 0).select("project_id", "chunk_id", "rel_path", "symbol", folder, category.alias("category")).join(ends, ["project_id", "dir"])
    others = F.array_distinct(F.filter(F.array("lo", "hi"), lambda x: x != F.col("rel_path")))
    return c.select(
        F.conv(F.left(F.md5(F.concat("project_id", "chunk_id")), F.lit(12)), 16, 10).cast("long").alias("query_id"), F.concat("symbol", F.lit(" "), "category").alias("query"),
        F.col("rel_path").alias("expected_path"), F.lit(None).cast("array<string>").alias("expected_paths"), F.col("symbol").alias("expected_symbol"),
        others.alias("distractor_paths"), "category",
    )


def run(cases: DataFrame, hits: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The report over search hits: :func:`metrics` of :func:`ranks`, overall and for each value of the columns in ``by``."""
    return metrics(ranks(cases, hits, [c for c in by if c != "category"]), by, k)


def save_baseline(path: str, report: DataFrame) -> None:
    """Write a report, one small row a group, as JSON; a reader sees the old one or the new one."""
    shared.commit_json(report.sparkSession, path, {"groups": [r.asDict() for r in report.orderBy("grouping", "value").collect()]})


def load_baseline(spark, path: str) -> DataFrame:
    """A saved report; an error if there is none."""
    saved = shared.read_json(spark, path)
    if saved is None:
        raise FileNotFoundError(path)
    schema = "grouping string, value string, n long, hit1 double, hit5 double, hit10 double, mrr double, hnsr5 double, hnsr10 double, mean_delta_rank double"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(g[c] for c in names) for g in saved["groups"]], schema)


def ranks(cases: DataFrame, hits: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per case the first rank of an expected hit (path, and symbol if given) and of a distractor; null if not among the hits.

    ``cases`` has query_id, expected_path, expected_paths, expected_symbol, distractor_paths, category; hits query_id, rank, rel_path, symbol.
    """
    expected = F.array_union(F.coalesce("expected_paths", F.array().cast("array<string>")), F.array_compact(F.array("expected_path")))
    j = cases.withColumn("expected", expected).join(hits.select("query_id", "rank", "rel_path", "symbol"), "query_id", "left")
    symbol_ok = F.col("expected_symbol").isNull() | F.contains(F.lower(F.coalesce("symbol", F.lit(""))), F.lower("expected_symbol"))
    good = F.array_contains("expected", F.col("rel_path")) & symbol_ok
    wrong = F.array_contains(F.coalesce("distractor_paths", F.array().cast("array<string>")), F.col("rel_path"))
    return j.groupBy("query_id", "category", *(keep or [])).agg(
        F.min(F.when(good, F.col("rank"))).alias("target_rank"), F.min(F.when(wrong, F.col("rank"))).alias("negative_rank"),
        F.max(F.coalesce(F.size("distractor_paths") > 0, F.lit(False))).alias("has_distractors"),
    )


def metrics(ranked: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """n, hit@1/5/10, MRR, HNSR@5/10 and the mean rank distance, overall and per value of each column in ``by``.

    One shuffle: every case is counted once for each grouping.
    """
    t, n = F.col("target_rank"), F.col("negative_rank")
    def hnsr(at):
        return F.when((t <= at) & (n.isNull() | (n > at)), 1.0).otherwise(0.0)

    delta = F.when(t.isNotNull() & F.col("has_distractors"), F.coalesce(n, F.lit(k + 1)) - t)
    groups = F.array(
        F.struct(F.lit("overall").alias("grouping"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("grouping"), F.coalesce(F.col(c), F.lit("(none)")).alias("value")) for c in by]
    )
    g = ranked.select("*", F.inline(groups))
    def hit(at):
        return F.round(F.avg(F.when(t <= at, 1.0).otherwise(0.0)), 4)

    return g.groupBy("grouping", "value").agg(
        F.count("*").alias("n"), hit(1).alias("hit1"), hit(5).alias("hit5"), hit(10).alias("hit10"),
        F.round(F.avg(F.coalesce(1 / t, F.lit(0.0))), 4).alias("mrr"), F.round(F.avg(hnsr(5)), 4).alias("hnsr5"), F.round(F.avg(hnsr(10)), 4).alias("hnsr10"),
        F.round(F.avg(delta), 4).alias("mean_delta_rank"),
    )


def lexical_overlap(pairs: DataFrame) -> DataFrame:
    """Adds overlap and overlap_bucket for (query, expected_text)."""
    return pairs.withColumn("overlap", F.round(text.jaccard("query", "expected_text"), 6)).withColumn("overlap_bucket", text.overlap_bucket("overlap"))


def gate(baseline: DataFrame, current: DataFrame, margin: float = 0.05) -> DataFrame:
    """(value, metric, base, now, passed): passed if the metric dropped by at most ``margin``; a missing group fails."""
    names = ["hit1", "hit5", "hit10", "mrr"]
    def long(df):
        return df.select("value", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in names])))

    j = long(baseline).withColumnRenamed("x", "base").join(long(current).withColumnRenamed("x", "now"), ["value", "metric"], "left")
    return j.withColumn("passed", F.coalesce(F.round(F.col("now") - F.col("base"), 9) >= -margin, F.lit(False)))
