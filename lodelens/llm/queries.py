"""The registered queries of this subpackage, over whole tables, and SQL where it can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodelens.llm import cooccurrence, funcdocs, handwritten, leakage, neighbours, packing, personal, splitting
from lodelens.shared import kept, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.co_changes(table(spark, sf_dir, "commits"), min_support=5, min_lift=3.0)
    return pairs.selectExpr("grp as project_id", "item_a as path_a", "item_b as path_b")


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.co_changes(table(spark, sf_dir, "commits"), min_support=5, min_lift=3.0)
    return pairs.selectExpr(
        "grp as project_id", "item_a as path_a", "item_b as path_b", "support", "n_a", "n_b", "n_baskets",
        "round(lift, 6) as lift", "round(pmi, 6) as pmi",
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "embed_cache"), k=5, min_cosine=0.8)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = funcdocs.function_docs(table(spark, sf_dir, "chunks"), with_code=False)
    return docs.select("chunk_id", "func_name").distinct()


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funcdocs.function_docs(table(spark, sf_dir, "chunks"), with_code=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("n_pieces > 1").select("chunk_id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"), limit=1920, overlap=240)


def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of each chunk: none over the limit, all of the text covered, overlaps as wanted, texts and estimates right."""
    whole = table(spark, sf_dir, "chunks").where(F.length("text") > 1920).select("project_id", "chunk_id", "text").distinct()
    w = Window.partitionBy("project_id", "chunk_id", "n_chars").orderBy("piece")
    whole = whole.withColumn("n_chars", F.length("text"))
    ends = p5_pieces(spark, sf_dir).withColumnRenamed("text", "piece_text")
    last = ends.groupBy("project_id", "chunk_id", "piece", "n_pieces", "start_char", "end_char", "piece_text", "token_estimate").count().join(whole, ["project_id", "chunk_id"])
    last = last.withColumn("shared", F.lag("end_char").over(w) - F.col("start_char"))
    n = F.length("piece_text")
    return last.groupBy("project_id", "chunk_id", "n_chars").agg(
        F.min((n <= 1920) & (n == F.col("end_char") - F.col("start_char"))).alias("within"),
        ((F.min("start_char") == 0) & (F.max("end_char") == F.col("n_chars"))).alias("covered"), F.min(F.coalesce(F.col("shared").between(240, 360), F.lit(True))).alias("overlaps"),
        F.min((F.expr("substr(text, start_char + 1, end_char - start_char)") == F.col("piece_text")) & (F.col("token_estimate") == F.greatest(F.lit(1), F.floor(n / 4)))).alias("same_text"),
        (F.count("*") == F.max("n_pieces")).alias("complete"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_kinds(spark, sf_dir).select("project_id", "rel_path")


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf_dir, "file_records"))


def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(table(spark, sf_dir, "documents"), capacity=4096)


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the windows: every document stands in them once, its pieces follow each other, and no window is over the capacity."""
    placed = kept(p7_sequences(spark, sf_dir), "placed")
    windows = placed.where("window_id IS NOT NULL").groupBy("window_id").agg(F.sum("n_tokens").alias("held"), F.max(F.col("at_token") + F.col("n_tokens")).alias("end"))
    windows = windows.select("window_id", ((F.col("held") <= 4096) & (F.col("held") == F.col("end"))).alias("fits"))
    j = placed.join(windows, "window_id", "left")
    return j.groupBy("doc_id").agg(
        F.sum((F.col("first_token") == 0).cast("long")).alias("times"), F.min(F.coalesce("fits", F.lit(True))).alias("fits"),
        F.min((F.col("n_tokens") == 0) | (F.col("n_tokens") + F.col("first_token") <= F.lit(4096) * (F.col("piece") + 1))).alias("follows"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases"))


def p8_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of whole items without an edit, told again by comparing letters: what SQL can say of problem 8."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases")

    def plain(c):
        return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))

    whole = leakage.leaked(docs, items).where("n_edits = 0 AND n_words = item_words").select("doc_id", "item_id")
    j = whole.join(docs.select("doc_id", plain("text").alias("t")), "doc_id").join(items.select("item_id", plain("query").alias("q")), "item_id")
    return j.where(F.contains("t", "q") & (F.trim("q") != "")).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    finds = personal.personal_lines(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"))
    return finds.where(F.col("kind").isin("email", "phone", "id_number", "address", "person"))


def p9_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts replaced under the key of the session (``spark.lodelens.pseudonym.key``), or a new one that nobody knows."""
    key = (spark.conf.get("spark.lodelens.pseudonym.key", None) or secrets.token_hex(32)).encode()
    return personal.pseudonymised(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"), key).select("doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_scores, p3_found, p4_found, p4_pairs, p5_found, p5_pieces, p5_checks, p6_found, p6_kinds, p7_sequences, p7_checks, p8_found, p8_leaks, p8_verbatim, p9_found, p9_texts)}


_P1 = r"""
WITH d AS (
    SELECT project_id, "commit" AS c, coalesce(len([x FOR x IN parents IF x IS NOT NULL]), 0) AS np,
        list_sort(list_distinct([y FOR y IN
            [regexp_replace(replace(x.path, '\', '/'), '^(\s|/|\./)+|(\s|/)+$', '', 'g') FOR x IN paths]
            IF y IS NOT NULL AND y <> '' AND y <> '.'])) AS fs
    FROM commits WHERE project_id IS NOT NULL AND "commit" IS NOT NULL),
s AS (SELECT project_id, c, max(fs) AS fs FROM d GROUP BY 1, 2 HAVING max(np) <= 1),
b AS (SELECT project_id, c, unnest(fs) AS f FROM s WHERE len(fs) BETWEEN 1 AND 50),
g AS (SELECT project_id, count(DISTINCT c) AS n FROM b GROUP BY 1),
i AS (SELECT project_id, f, count(*) AS n FROM b GROUP BY 1, 2),
p AS (SELECT x.project_id, x.f AS fa, y.f AS fb, count(*) AS s FROM b x JOIN b y
    ON x.project_id = y.project_id AND x.c = y.c AND x.f < y.f GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT {columns}
FROM p JOIN g ON g.project_id = p.project_id JOIN i a ON a.project_id = p.project_id AND a.f = fa
    JOIN i b ON b.project_id = p.project_id AND b.f = fb
WHERE s * g.n >= 3 * a.n * b.n
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1.replace("{columns}", "p.project_id, fa AS path_a, fb AS path_b"),
        "p1_scores": _P1.replace(
            "{columns}",
            "p.project_id, fa AS path_a, fb AS path_b, s AS support, a.n AS n_a, b.n AS n_b, g.n AS n_baskets,"
            " round(s * g.n / (a.n * b.n), 6) AS lift, round(log2(s * g.n / (a.n * b.n)), 6) AS pmi",
        ),
        "p3_found": """WITH u AS (SELECT h, dim, max(vec)::DOUBLE[] AS v FROM embed_cache WHERE h IS NOT NULL AND vec IS NOT NULL AND len(vec) = dim
                AND len([x FOR x IN vec IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN vec IF x <> 0]) > 0 GROUP BY 1, 2),
            c AS (SELECT a.h, a.dim, b.h AS o, round(list_cosine_similarity(a.v, b.v), 12) AS s FROM u a JOIN u b ON a.dim = b.dim AND a.h <> b.h),
            r AS (SELECT h, o FROM c WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY h, dim ORDER BY s DESC, o) <= 5)
            SELECT DISTINCT least(h, o) AS h_a, greatest(h, o) AS h_b FROM r""",
        "p5_checks": "SELECT DISTINCT project_id, chunk_id, length(text) AS n_chars, true AS within, true AS covered, true AS overlaps, true AS same_text, true AS complete FROM chunks WHERE length(text) > 1920",
        "p7_checks": "SELECT doc_id, count(*) AS times, true AS fits, true AS follows FROM documents GROUP BY 1",
        "p8_verbatim": r"""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents),
            i AS (SELECT item_id, ' ' || trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')) || ' ' AS q FROM eval_cases)
            SELECT DISTINCT doc_id, item_id FROM d JOIN i ON trim(q) <> '' AND contains(t, q)""",
        "p5_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 1920",
    }
