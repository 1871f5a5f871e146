"""Retrieval: vector search, BM25, fusion of both, scores and what is said about a hit.

Vector and text queries are tables of queries, one row each, so one job answers all of them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodelens import shared
from lodelens.functions import text

K1, B, RRF = 1.2, 0.75, 60
ROLE_BOOST = {"executable": 0.035, "test": 0.010, "config": -0.020, "template": -0.025, "comment": -0.035}
HIGH, MEDIUM, LOW = 0.72, 0.50, 0.25
QUERY_BLOCK, ROW_PART = 512, 50_000
#: Distinct query terms up to which they are sent to all tasks.
TERMS = 100_000
#: Best rows of each term that are scored for a lower bound; what sums of weights may differ by from rounding, and more.
POOL, SLACK = 16, 1e-7
#: Queries sent to all tasks at once, and rows a task holds them against at once.
ASKED, DOCS = 200_000, 131_072
# Signs that a query means an exact token.
IDENTIFIER_SIGNS = [r"[a-z][A-Z]", r"[A-Za-z]_[A-Za-z]", r"\b[A-Z][A-Z0-9]{2,}\b", r"['\"][^'\"]+['\"]", r"\.(py|js|ts|tsx|go|rs|java|c|cpp|h|rb|cs|json|toml|md)\b", r"(^|[^A-Za-z0-9_])_[A-Za-z][A-Za-z0-9_]+"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- vectors --------------------------------------------------------------------------------------
def l2_squared(a, b) -> Column:
    """Squared distance in double precision; null where the lengths differ."""
    d = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    return F.when(F.size(_c(a)) == F.size(_c(b)), d)


def nearest(vectors: DataFrame, query: list[float], k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to one vector, filtered before ranking: a scan and a distributed top-k."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("distance", l2_squared(vec_col, q)).where("distance IS NOT NULL").orderBy("distance", id_col).limit(k)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int = 8, block: int = QUERY_BLOCK, id_col: str = "vec_id", digits: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank): exact neighbours of every query among all rows; ties go to the smaller id.

    ``vectors`` has (id, embedding), ``queries`` (query_id, query_vec); distances are rounded to ``digits`` first, if given. Up to ``block``
    queries are sent to all tasks. More of them are dealt to blocks, the rows to parts, and each task multiplies one part by one block: rows
    travel once a block, queries once a part, and neither is ever on the driver. Only each task's best ``k`` a query go on. Null vectors
    and those of another length than the query are left out.
    """
    spark = vectors.sparkSession
    v = vectors.where("embedding IS NOT NULL").select(id_col, "embedding")
    q = queries.where("query_vec IS NOT NULL").select("query_id", "query_vec")
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, {id_col} {v.schema[id_col].dataType.simpleString()}, distance double"
    few = q.limit(block + 1).collect()

    def nearest_of(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found, lengths = [], rows["embedding"].map(len)
        for d, part in asked.groupby(asked["query_vec"].map(len)):
            same = rows[lengths == d]
            if not len(same):
                continue
            m, x = (np.stack(c.to_numpy()).astype(np.float64) for c in (same["embedding"], part["query_vec"]))
            ids, order = same[id_col].to_numpy(), pd.factorize(same[id_col], sort=True)[0]
            mm, xx = (m * m).sum(1), (x * x).sum(1)
            for i, name in enumerate(part["query_id"]):
                rough = mm + xx[i] - 2 * (m @ x[i])
                kth = np.partition(rough, min(k, len(rough)) - 1)[min(k, len(rough)) - 1]
                # whatever may be among the best, given rounding; these are measured as (a - b)^2 is
                near = np.nonzero(rough <= kth + 1e-9 * (1 + mm.max() + xx[i]) + 10.0 ** -(digits or 15))[0]
                exact = ((m[near] - x[i]) ** 2).sum(1)
                exact = exact if digits is None else np.round(exact, digits)
                top = np.lexsort((order[near], exact))[:k]
                found.append(pd.DataFrame({"query_id": name, id_col: ids[near[top]], "distance": exact[top]}))
        return pd.concat(found) if found else pd.DataFrame(columns=["query_id", id_col, "distance"])

    if len(few) <= block:
        held = spark.sparkContext.broadcast(pd.DataFrame({"query_id": [r.query_id for r in few], "query_vec": [r.query_vec for r in few]}))

        def one(batches):
            for pdf in batches:
                if len(pdf) and len(held.value):
                    yield nearest_of(pdf, held.value)

        near = v.mapInPandas(one, schema)
    else:
        blocks = -(-q.count() // block)
        parts = max(1, -(-v.count() // ROW_PART))
        rows = v.select("*", F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        asks = q.select("*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        near = rows.groupBy("part", "block").cogroup(asks.groupBy("part", "block")).applyInPandas(
            lambda a, b: nearest_of(a, b) if len(a) and len(b) else pd.DataFrame(columns=["query_id", id_col, "distance"]), schema
        )
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def match_estimate(candidates: DataFrame, fraction: float = 0.85) -> DataFrame:
    """Per query how many candidates have at least ``fraction`` of the best similarity, 1 / (1 + distance)."""
    s = candidates.withColumn("similarity", 1 / (1 + F.greatest("distance", F.lit(0.0))))
    top = s.groupBy("query_id").agg(F.max("similarity").alias("top"))
    return s.join(top, "query_id").groupBy("query_id").agg(
        F.sum(F.when(F.col("similarity") >= F.col("top") * fraction, 1).otherwise(0)).alias("n"), F.count("*").alias("candidates"), F.round(F.max("top"), 6).alias("top_similarity")
    )


def hashed_vector(value, dims: int = 64) -> Column:
    """Deterministic embedding without a model: token counts by hash, scaled to length one (zeros for no tokens).

    An Arrow function: as nested column lambdas the hashes would be computed again for every element.
    """
    token = re.compile("[A-Za-z0-9_]+")

    @pandas_udf("array<double>")
    def f(s: pd.Series) -> pd.Series:
        slots: dict[str, int] = {}

        def one(x):
            v = np.zeros(dims)
            for t in token.findall(x or ""):
                t = t.lower()
                if t not in slots:
                    slots[t] = int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % dims
                v[slots[t]] += 1
            n = float(np.sqrt((v * v).sum()))
            return v / n if n else v

        return s.map(one)

    return f(_c(value))


# -- full text ------------------------------------------------------------------------------------
def postings(docs: DataFrame, id_cols: list[str], body: str, terms: DataFrame | None = None) -> DataFrame:
    """(ids, term, tf, dl): the inverted index as a table; written once per generation.

    Of some ``terms`` only if given; tokens of no query then don't leave their task.
    """
    t = docs.select(*id_cols, text.tokens(body).alias("ts")).select(*id_cols, F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    if terms is not None:
        wanted = terms.select("term").distinct()
        t = t.join(F.broadcast(wanted) if _few(wanted) else wanted, "term", "left_semi")
    return t.groupBy(*id_cols, "term", "dl").agg(F.count("*").alias("tf"))


def _few(rows: DataFrame, most: int = TERMS) -> bool:
    """Whether there are at most ``most`` rows, few enough to be sent to all tasks."""
    return rows.limit(most + 1).count() <= most


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(text.token_set("query")).alias("term"))


def bm25(index: DataFrame, stats: DataFrame, queries: DataFrame, id_cols: list[str], terms: DataFrame | None = None) -> DataFrame:
    """(query_id, ids, score) of all rows with a query term. ``stats`` has one row (n, avgdl); queries (query_id, query); ``terms`` are theirs, if known.

    Frequencies and query terms are small tables, so postings of a term that stands in every row are scored where they lie; with more than
    ``TERMS`` entries the joins shuffle, and skewed terms are split at run time.
    """
    terms = query_terms(queries) if terms is None else terms
    small = F.broadcast if _few(terms) else lambda rows: rows
    used = index.join(small(terms.select("term").distinct()), "term", "left_semi")
    df = used.groupBy("term").agg(F.count("*").alias("df"))  # not more rows than terms
    hits = used.join(small(df), "term").join(small(terms), "term")
    whole = stats.first()
    idf = F.log(1 + (F.lit(whole["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(whole["avgdl"] or 1.0)))
    return hits.groupBy("query_id", *id_cols).agg(F.sum(weight).alias("score"))


def text_stats(docs: DataFrame, body: str) -> DataFrame:
    """One row: number of rows and mean length in tokens."""
    length = F.regexp_count(F.coalesce(F.col(body), F.lit("")), F.lit("[A-Za-z0-9_]+"))
    return docs.agg(F.count("*").alias("n"), F.avg(length).alias("avgdl"))


def text_hits(docs: DataFrame, queries: DataFrame, ids: list[str], body: str = "search_text") -> DataFrame:
    """(query_id, ids, score) of all rows of texts with a query term, scores rounded to 9 digits, by postings of the queries' terms only."""
    terms = shared.kept(query_terms(queries), "terms")
    index = shared.kept(postings(docs, ids, body, terms), "postings")
    return bm25(index, text_stats(docs, body), queries, ids, terms).withColumn("score", F.round("score", 9))


def match_count(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, n, is_lower_bound): rows that match each query; with a ``limit`` counting ends there and the number is a lower bound."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    if limit is None:
        return n.withColumn("is_lower_bound", F.lit(False))
    return n.select("query_id", F.least("n", F.lit(limit)).alias("n"), (F.col("n") > limit).alias("is_lower_bound"))


def top(scored: DataFrame, k: int, ties: list[str]) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _weight(idf, tf, dl, avgdl) -> Column:
    return _c(idf) * _c(tf) * (K1 + 1) / (_c(tf) + K1 * (1 - B + B * _c(dl) / F.lit(avgdl or 1.0)))


def term_counts(body, held) -> Column:
    """Struct of a text: its length in tokens, and the numbers and frequencies of the terms in the broadcast dictionary ``held``."""
    token = re.compile("[A-Za-z0-9_]+")

    @pandas_udf("dl long, ts array<long>, tfs array<int>")
    def f(s: pd.Series) -> pd.DataFrame:
        number, dl, ts, tfs = held.value, [], [], []
        for x in s:
            found = token.findall(x or "")
            n = Counter(number[t] for t in map(str.lower, found) if t in number)
            dl.append(len(found))
            ts.append(list(n))
            tfs.append(list(n.values()))
        return pd.DataFrame({"dl": dl, "ts": ts, "tfs": tfs})

    return f(_c(body))


def reaching(index: DataFrame, limits: DataFrame, avgdl: float) -> DataFrame:
    """(q, doc, score) of all rows of ``index`` that reach the score ``least`` of a query, but for rows that have its last term alone.

    ``limits`` has each query's terms (q, least, i, t, idf, most), by falling ``most``, and is sent to all tasks.
    """
    x = limits.toPandas().sort_values(["q", "i"], kind="stable", ignore_index=True)
    x["behind"] = x.groupby("q")["most"].transform("sum") - x.groupby("q")["most"].cumsum()
    held = index.sparkSession.sparkContext.broadcast({c: x[c].to_numpy() for c in ("q", "least", "t", "idf", "most", "behind")})

    def of(part: pd.DataFrame, asked: dict) -> pd.DataFrame:
        lengths = part["ts"].map(len).to_numpy()
        if not lengths.sum():
            return pd.DataFrame({"q": [], "doc": [], "score": []})
        row, t, tf = np.repeat(np.arange(len(part)), lengths), np.concatenate(part["ts"].to_numpy()), np.concatenate(part["tfs"].to_numpy()).astype(np.float64)
        order = np.argsort(t, kind="stable")
        row, tf, (names, first) = row[order], tf[order], np.unique(t[order], return_index=True)
        below = tf + K1 * (1 - B + B * part["dl"].to_numpy()[row] / (avgdl or 1.0))
        at = dict(zip(names.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(row)])))
        weighed: dict[int, tuple] = {}

        def posted(j):
            k = ts[j]
            if k not in weighed:
                a, b = at[k]
                weighed[k] = row[a:b], idf[j] * tf[a:b] * (K1 + 1) / below[a:b]
            return weighed[k]

        starts = np.nonzero(np.diff(asked["q"], prepend=-1))[0].tolist()
        qs, least, ts, idf, most, behind = (asked[c].tolist() for c in ("q", "least", "t", "idf", "most", "behind"))
        flat, found = np.zeros(len(part)), []
        for a, b in zip(starts, [*starts[1:], len(qs)]):
            lead = []
            for j in range(a, b - 1):
                if ts[j] in at and most[j] + SLACK >= (low := least[j] - behind[j]):
                    docs, w = posted(j)
                    lead.append(docs[w >= low] if low > 0 else docs)
            if not lead:
                continue
            c = lead[0] if len(lead) == 1 else np.unique(np.concatenate(lead))
            score = np.zeros(len(c))
            for j in range(a, b):
                if not len(c):
                    break
                if ts[j] in at:
                    docs, w = posted(j)
                    if 16 * len(c) < len(docs):
                        k = np.minimum(np.searchsorted(docs, c), len(docs) - 1)
                        score = score + np.where(docs[k] == c, w[k], 0.0)
                    else:
                        flat[docs] = w
                        score = score + flat[c]
                        flat[docs] = 0.0
                keep = score + behind[j] >= least[j]
                c, score = c[keep], score[keep]
            if len(c):
                found.append((np.full(len(c), qs[a]), c, score))
        q, c, score = (np.concatenate(y) for y in zip(*found)) if found else ([], np.array([], int), [])
        return pd.DataFrame({"q": q, "doc": part["doc"].to_numpy()[c], "score": score})

    def each(batches):
        parts, n = [], 0
        for pdf in batches:
            parts.append(pdf)
            n += len(pdf)
            if n >= DOCS:
                yield of(pd.concat(parts, ignore_index=True), held.value)
                parts, n = [], 0
        if n:
            yield of(pd.concat(parts, ignore_index=True), held.value)

    return index.select("doc", "dl", "ts", "tfs").mapInPandas(each, "q long, doc long, score double")


def best_text_hits(docs: DataFrame, queries: DataFrame, k: int, ids: list[str], body: str = "search_text", pool: int = POOL) -> DataFrame:
    """(query_id, ids, score, rank): the rows that :func:`top` takes from :func:`text_hits`, ties by the columns ``ids`` in their order.

    For queries that grow in number with the texts: scores of all matching rows, as many as queries times texts, are never made. Queries of the
    same terms are answered once. A query's terms are ordered by their greatest weight, and the ``pool`` best rows of each are scored; the k-th of
    these scores is a lower bound. A row whose first term in that order is t can only reach it if its weight for t and the greatest weights of the
    terms behind t do; all these rows are sought in each part of the index and scored where they lie. A row that has the last term alone is among the best if it is among the k best of that term.
    The distinct terms of the queries are sent to all tasks. Rows of one id are one text, as long as the longest of them.
    """
    asked = queries.select("query_id", F.array_join(F.array_sort(text.token_set("query")), " ").alias("words")).where("words <> ''")
    sets = shared.kept(asked.select("words").distinct().withColumn("q", F.monotonically_increasing_id()), "sets")
    asks = sets.select("q", F.explode(F.split("words", " ")).alias("term"))
    vocabulary = shared.kept(asks.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "vocabulary")
    held = docs.sparkSession.sparkContext.broadcast({r.term: r.t for r in vocabulary.collect()})
    rows = shared.kept(docs.select(*ids, term_counts(body, held).alias("c")).select(*ids, "c.*"), "counts")
    whole = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = whole["n"], whole["avgdl"]

    # rows of one id are one text, numbered in the order of ties
    def merged(parts):
        every = F.flatten(F.transform(parts, lambda x: F.arrays_zip(x["ts"], x["tfs"])))
        ts = F.array_distinct(F.flatten(F.transform(parts, lambda x: x["ts"])))
        tfs = F.transform(ts, lambda t: F.aggregate(F.filter(every, lambda x: x["ts"] == t), F.lit(0), lambda s, x: s + x["tfs"]))
        return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.struct(ts.alias("ts"), tfs.alias("tfs")))

    one = rows.repartitionByRange(*ids).groupBy(*ids).agg(F.max("dl").alias("dl"), F.collect_list(F.struct("ts", "tfs")).alias("parts"))
    one = one.select(*ids, "dl", merged(F.col("parts")).alias("c")).sortWithinPartitions(*ids).select(F.monotonically_increasing_id().alias("doc"), *ids, "dl", "c.*")
    index = shared.kept(one, "index")
    posted = index.select("doc", "dl", F.inline(F.arrays_zip("ts", "tfs"))).withColumnsRenamed({"ts": "t", "tfs": "tf"})
    df = posted.groupBy("t").agg(F.count("*").alias("df"))
    idf = shared.kept(df.select("t", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "idf")
    small = F.broadcast if _few(idf) else lambda rows: rows
    weighed = posted.join(small(idf), "t").withColumn("w", _weight("idf", "tf", "dl", avgdl))
    w = Window.partitionBy("t").orderBy(F.desc(F.round("w", 9)), "doc")
    firsts = shared.kept(weighed.select("t", "doc", "w", "idf").withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(k, pool)), "firsts")
    most = firsts.where("place = 1").select("t", "idf", F.col("w").alias("most"))
    terms = asks.join(vocabulary, "term").join(most, "t").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("most", "t", "idf")), False).alias("terms"))
    terms = shared.kept(terms, "terms")

    def scored(pairs):
        tf = lambda x: F.coalesce(F.get("tfs", (F.array_position("ts", x["t"]) - 1).cast("int")), F.lit(0))
        score = F.aggregate("terms", F.lit(0.0), lambda s, x: s + _weight(x["idf"], tf(x), "dl", avgdl))
        return pairs.join(terms, "q").join(index.select("doc", "dl", "ts", "tfs"), "doc").select("q", "doc", score.alias("score"))

    near = shared.kept(scored(terms.select("q", F.explode("terms.t").alias("t")).join(firsts.select("t", "doc"), "t").select("q", "doc").distinct()), "near")
    least = near.groupBy("q").agg((F.get(F.sort_array(F.collect_list("score"), False), F.lit(k - 1)) - SLACK).alias("least")).where("least IS NOT NULL")
    more = []
    blocks = max(1, -(-least.count() // ASKED))
    for block in range(blocks):
        asked_here = least if blocks == 1 else least.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        limits = terms.where("size(terms) > 1").join(asked_here, "q").select("q", "least", F.posexplode("terms").alias("i", "x")).select("q", "least", "i", "x.*")
        more.append(shared.kept(reaching(index, limits, avgdl), "more"))
    both = near.unionByName(reduce(DataFrame.unionByName, more).join(near, ["q", "doc"], "left_anti")).withColumn("score", F.round("score", 9))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "doc")
    best = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(index.select("doc", *ids), "doc").join(sets, "q").join(asked, "words").select("query_id", *ids, "score", "rank")


# -- fusion and scores ----------------------------------------------------------------------------
def is_hybrid(query) -> Column:
    """Single words and queries with an identifier, a literal, a file name or the like go to both indexes."""
    q = _c(query)
    signs = F.lit(False)
    for s in IDENTIFIER_SIGNS:
        signs = signs | q.rlike(s)
    return (F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) == 1) | signs


def role_boost(role) -> Column:
    c = F.lit(0.0)
    for k, v in ROLE_BOOST.items():
        c = F.when(_c(role) == k, F.lit(v)).otherwise(c)
    return c


def fuse(vector_hits: DataFrame, text_hits: DataFrame, ids: list[str]) -> DataFrame:
    """Reciprocal rank fusion by a union and one sum; both sides have query_id, ids and rank."""
    both = vector_hits.select("query_id", *ids, "rank").unionByName(text_hits.select("query_id", *ids, "rank"))
    return both.groupBy("query_id", *ids).agg(F.sum(1 / (RRF + F.col("rank"))).alias("rrf"))


def hybrid_score(rrf, query, symbol, path, role) -> Column:
    """Fused score with boosts: shared symbol tokens, the whole symbol as a token, shared file name tokens, the role."""
    q = text.token_set(query)
    sym = F.coalesce(_c(symbol), F.lit(""))
    shared = F.size(F.array_intersect(q, text.token_set(sym)))
    base = F.size(F.array_intersect(q, text.token_set(F.substring_index(F.coalesce(_c(path), F.lit("")), "/", -1))))
    return (
        _c(rrf) + 0.10 * shared + F.when(F.array_contains(q, F.lower(sym)), 0.20).otherwise(0.0)
        + F.when(base > 0, 0.05).otherwise(0.0) + role_boost(role)
    )


def vector_score(distance, role) -> Column:
    return -_c(distance) + role_boost(role)


def normalized(raw, mode, rank, reranked=None) -> Column:
    """Scores of either kind on one scale of 0 to 1, with a prior for the rank; rounded to 3 digits."""
    r, again = _c(raw), F.lit(False) if reranked is None else _c(reranked)
    sigmoid = 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), r))))
    base = F.when(again, sigmoid).when(_c(mode) == "hybrid", F.greatest(F.lit(0.0), F.least(F.lit(1.0), r / 0.30))).otherwise(1 / (1 + F.greatest(F.lit(0.0), -r)))
    prior = F.greatest(F.lit(0.0), 1 - (_c(rank) - 1) * 0.12)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.8 * base + 0.2 * prior)), 3)


def relevance(score) -> Column:
    s = _c(score)
    return F.when(s >= HIGH, "high").when(s >= MEDIUM, "medium").when(s >= LOW, "low").otherwise("uncertain")


def at_least(bucket, threshold: str | None) -> Column:
    order = ["uncertain", "low", "medium", "high"]
    if threshold is None:
        return F.lit(True)
    if threshold not in order:
        raise ValueError(f"{threshold!r} is no relevance; there are {', '.join(order)}")
    return _c(bucket).isin(order[order.index(threshold) :])


def match_reason(query, symbol, path, mode) -> Column:
    q, sym = text.token_set(query), F.coalesce(_c(symbol), F.lit(""))
    in_symbol = (sym != "") & (F.array_contains(q, F.lower(sym)) | F.arrays_overlap(q, text.token_set(sym)))
    in_name = F.arrays_overlap(q, text.token_set(F.substring_index(F.coalesce(_c(path), F.lit("")), "/", -1)))
    return (
        F.when(in_symbol, "a query word is in the symbol").when(in_name, "a query word is in the file name")
        .when(_c(mode) == "hybrid", "by similarity and words together").otherwise("by similarity")
    )


def freshness(hits: DataFrame, scan: DataFrame, indexed: DataFrame) -> DataFrame:
    """Adds stale and freshness_reason: size and time match, else the hash, against the present scan."""
    keys = ["project_id", "rel_path"]
    now = scan.select(*keys, F.struct("hash", "size", "mtime_ns").alias("now"))
    was = indexed.select(*keys, F.struct("hash", "size", "mtime_ns").alias("was"))
    j = hits.join(was, keys, "left").join(now, keys, "left")
    same = (F.col("now.size") == F.col("was.size")) & (F.col("now.mtime_ns") == F.col("was.mtime_ns"))
    reason = (
        F.when(F.col("was").isNull(), "never indexed").when(F.col("now").isNull(), "gone from the scan")
        .when(same, "same size and time").when(F.col("now.hash") == F.col("was.hash"), "same content under another time")
        .otherwise("other content now")
    )
    j = j.withColumn("freshness_reason", reason)
    return j.withColumn("stale", ~F.col("freshness_reason").startswith("same")).drop("now", "was")


def budget(hits: DataFrame, length: str, total: int) -> DataFrame:
    """Characters granted to each hit in rank order until the budget of its query is used up."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(length).over(w), F.lit(0))
    return hits.withColumn("granted", F.greatest(F.lit(0), F.least(F.col(length), total - used)).cast("long"))


def candidates(rows: DataFrame, queries: DataFrame, candidate_k: int) -> DataFrame:
    """(query_id, ids, distance, rank): the nearest rows of each query by hashed vectors; ties by chunk, then project."""
    key = F.concat_ws("\0", F.coalesce("chunk_id", F.lit("")), F.coalesce("project_id", F.lit("")))
    numbered = shared.kept(rows.select(key.alias("row_key"), "project_id", "chunk_id", hashed_vector("search_text").alias("embedding")), "vectors")
    asked = queries.select("query_id", hashed_vector("query").alias("query_vec"))
    near = nearest_batch(numbered, asked, candidate_k, id_col="row_key", digits=9)
    return near.join(numbered.drop("embedding"), "row_key").select("query_id", "project_id", "chunk_id", "distance", "rank")


def search(
    chunks: DataFrame, queries: DataFrame, k: int = 8, candidate_k: int = 20, language: str | None = None, min_relevance: str | None = None, mode: str = "auto",
    reranker=None, where: Column | None = None,
) -> DataFrame:
    """Ranked hits for a table of queries (query_id, query): routing, candidates of both indexes, fusion, scores, relevance.

    ``chunks`` has project_id, chunk_id, rel_path, language, symbol, symbol_kind, chunk_role, start_line, end_line, search_text; other
    columns may be missing. ``where`` filters before ranking. ``reranker(hits)`` gets the candidates with their text and must add
    ``rerank_score``, by which they are then ordered. The relevance filter comes after the ranking and may leave fewer than ``k``; ``weak_tail`` marks
    queries whose hits beyond the first are all uncertain.
    """
    candidate_k = max(k, min(candidate_k, 50))
    ids = ["project_id", "chunk_id"]
    rows = chunks if language is None else chunks.where(F.col("language") == language)
    rows = rows if where is None else rows.where(where)
    asked = queries.withColumn("mode", F.when(is_hybrid("query"), "hybrid").otherwise("vector") if mode == "auto" else F.lit(mode))
    near = shared.kept(candidates(rows, asked, candidate_k), "near")
    hybrid = asked.where("mode = 'hybrid'")
    words = top(text_hits(rows, hybrid, ids), candidate_k, ["chunk_id", "project_id"])
    fused = fuse(near.join(hybrid.select("query_id"), "query_id", "left_semi"), words, ids)
    there = [c for c in ("rel_path", "language", "symbol", "symbol_kind", "chunk_role", "start_line", "end_line") if c in rows.columns]
    info = rows.select(*ids, *there, *(["search_text"] if reranker else []))
    h = fused.join(hybrid, "query_id").withColumn("distance", F.lit(None).cast("double"))
    v = near.join(asked.where("mode = 'vector'"), "query_id").drop("rank").withColumn("rrf", F.lit(None).cast("double"))
    both = h.unionByName(v).join(info, ids)
    score = F.when(F.col("mode") == "hybrid", hybrid_score("rrf", "query", "symbol", "rel_path", "chunk_role")).otherwise(vector_score("distance", "chunk_role"))
    both = both.withColumn("score", F.round(score, 6)).drop("rrf", "distance")
    if reranker is not None:
        both = reranker(both).drop("search_text").withColumn("score", F.col("rerank_score")).drop("rerank_score")
    hits = top(both, k, ["chunk_id", "project_id"])
    hits = hits.withColumn("score_normalized", normalized("score", "mode", "rank", F.lit(reranker is not None)))
    hits = hits.withColumn("relevance", relevance("score_normalized"))
    hits = hits.withColumn("match_reason", match_reason("query", "symbol", "rel_path", "mode")).withColumn("matched_in", matched_in("query", "symbol", "rel_path"))
    tail = Window.partitionBy("query_id")
    rest = F.count(F.when(F.col("rank") > 1, 1)).over(tail)
    weak = F.count(F.when((F.col("rank") > 1) & (F.col("relevance") == "uncertain"), 1)).over(tail)
    hits = hits.withColumn("weak_tail", (rest > 0) & (rest == weak))
    return hits.where(at_least("relevance", min_relevance))


def matched_in(query, symbol, path) -> Column:
    """Which parts of a hit share a token with the query: symbol, path, content (always sought there)."""
    q = text.token_set(query)
    parts = {"symbol": F.coalesce(_c(symbol), F.lit("")), "path": F.coalesce(_c(path), F.lit(""))}
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(q, text.token_set(x)), F.lit(n)) for n, x in parts.items()], F.lit("content")))


def preview(content, query, width: int = 160) -> Column:
    """The first line of the content that holds a query token, else the first that isn't blank; cut to ``width`` with an ellipsis."""
    lines = F.filter(F.transform(F.split(F.coalesce(_c(content), F.lit("")), "\r\n|\r|\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    q = text.token_set(query)
    line = F.coalesce(F.get(F.filter(lines, lambda x: F.arrays_overlap(q, text.token_set(x))), F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 1), F.lit("…"))).otherwise(line)


def hints(hits: DataFrame, queries: DataFrame, estimate: DataFrame | None = None) -> DataFrame:
    """(query_id, n_hits, hint): what a caller may do about a result: nothing found, only uncertain hits, a weak tail, more matches than shown, stale files."""
    have = {c: c in hits.columns for c in ("stale", "weak_tail")}
    g = hits.groupBy("query_id").agg(
        F.count("*").alias("n_hits"), F.count(F.when(F.col("relevance") != "uncertain", 1)).alias("sure"),
        F.max(F.col("weak_tail") if have["weak_tail"] else F.lit(False)).alias("weak"), F.max(F.col("stale") if have["stale"] else F.lit(False)).alias("stale"),
    )
    j = queries.select("query_id").join(g, "query_id", "left").fillna(0, ["n_hits", "sure"])
    j = j.join(estimate.select("query_id", F.col("n").alias("all")), "query_id", "left") if estimate is not None else j.withColumn("all", F.lit(None).cast("long"))
    said = F.array_compact(F.array(
        F.when(F.col("n_hits") == 0, "no_hits"), F.when((F.col("n_hits") > 0) & (F.col("sure") == 0), "only_uncertain"), F.when(F.col("weak"), "weak_tail"),
        F.when(F.col("all") > F.col("n_hits"), "more_matches"), F.when(F.col("stale"), "stale_files"),
    ))
    return j.select("query_id", "n_hits", F.explode_outer(said).alias("hint"))
