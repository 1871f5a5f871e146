"""The most similar vectors for every vector: an inverted multi-index with exact reranking.

Method. Unit vectors are cut into two halves, each half is quantised by its own K centroids, so the index has K x K
cells. For every vector the cells are visited in ascending order of the summed distance of its halves to the two
centroids, taken from a heap (multi-sequence traversal), until at least ``MIN_CELLS`` cells that hold at least ``candidates``
rows are visited. The entries of those cells, and no others, are reranked by their exact cosine.

Scale. K grows with the square root of the rows up to ``MAX_K``; centroids are fitted on about ``SAMPLE_ROWS`` rows of a
dimension at most, drawn by hash, but every row is indexed and every row is a query. What is broadcast is bounded by MAX_K: two
codebooks and the K x K cell sizes. Cells are packed into units, tiles of neighbouring centroids of both halves with at most
``UNIT`` rows (a larger cell is split), so that the cells of one query lie in few of them; a vector travels once to each. A unit's queries
form blocks of about ``UNIT``; one task step takes one block and one unit, and in it multiplies each cell by the queries that visit it, whatever
the skew. Above 16 * MAX_K ** 2 rows of a dimension cells hold more rows, and a query's work grows with them; results don't change.
Vectors of one direction, whatever their lengths, are one class: only a representative is indexed, and of a class's members only the
``k + 1`` smallest keys travel, so a vector that a third of all keys share costs no more than another; classes above
``HOT`` members are split when their lists go back to the members.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodelens import shared

SAMPLE_ROWS = 262_144
MAX_K = 4096
OCCUPANCY = 16
MIN_CELLS = 16
CANDIDATES = 512
UNIT = 16_384
#: Pairs whose exact cosines are computed at once.
PAIRS = 49_152
#: Members above which a class is split, and into how many parts.
HOT, HOT_PARTS = 100_000, 64


def usable(vectors: DataFrame) -> DataFrame:
    """One row (h, dim, vec) per key: length ``dim``, finite, not all zero. Of unequal vectors of a key the greatest."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.where(F.col("h").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") == F.col("dim")))
        .where(~bad & F.exists("vec", lambda x: x != 0))
        .groupBy("h", "dim")
        .agg(F.max("vec").alias("vec"))
    )


def _stack(column: pd.Series, dim: int) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(np.float64).reshape(-1, dim)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fit_halves(sample: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's k-means on each half of the sample's unit vectors; fixed starting points."""
    cut, books = sample.shape[1] // 2, []
    for x in (sample[:, :cut], sample[:, cut:]):
        x = x.astype(np.float32)
        c = x[np.random.default_rng(7).choice(len(x), k, replace=False)].copy()
        for _ in range(rounds):
            near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            order = np.argsort(near, kind="stable")
            present, at = np.unique(near[order], return_index=True)
            sums = np.add.reduceat(x[order], at, axis=0)
            c[present] = sums / np.diff([*at, len(x)])[:, None]
        books.append(c)
    return books[0], books[1]


def _distances(m: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cut = m.shape[1] // 2
    out = []
    for x, c in ((m[:, :cut], books[0]), (m[:, cut:], books[1])):
        x = x.astype(np.float32)
        out.append((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T)
    return out[0], out[1]


def traverse(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, candidates: int) -> list[int]:
    """Non-empty cells (i * K + j) in ascending order of d1[i] + d2[j]: ``MIN_CELLS`` and more, until they hold ``candidates`` rows.

    Both limits are lower ones: a crowded cell must not hide the cells beside it.

    The classic heap: (a, b) is pushed once its predecessors in both sequences have been taken.
    """
    k = len(d1)
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, taken, found, have = [(s1[0] + s2[0], 0, 0)], set(), [], 0
    while heap and (have < candidates or len(found) < MIN_CELLS):
        _, a, b = heapq.heappop(heap)
        taken.add((a, b))
        cell = o1[a] * k + o2[b]
        n = int(sizes[cell])
        if n:
            found.append(cell)
            have += n
        if a + 1 < k and (b == 0 or (a + 1, b - 1) in taken):
            heapq.heappush(heap, (s1[a + 1] + s2[b], a + 1, b))
        if b + 1 < k and (a == 0 or (a - 1, b + 1) in taken):
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
    return found


def _tiles(book: np.ndarray, groups: int) -> list[np.ndarray]:
    """The centroids of one half in groups of neighbours: halved again and again along the widest direction."""
    parts = [np.arange(len(book))]
    while len(parts) < groups:
        parts.sort(key=len)
        p = parts.pop()
        if len(p) < 2:
            parts.append(p)
            break
        x = book[p] - book[p].mean(0)
        order = np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")
        parts += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
    return parts


def pack_units(sizes: np.ndarray, books: tuple[np.ndarray, np.ndarray], unit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Give each cell a first unit and a number of units: tiles of neighbouring cells, filled up to ``unit`` rows."""
    k = len(books[0])
    first, parts, u = np.zeros(k * k, dtype=np.int32), np.ones(k * k, dtype=np.int32), 0
    groups = max(1, math.isqrt(int(sizes.sum()) // unit + 1))
    for rows in _tiles(books[0], groups):
        for columns in _tiles(books[1], groups):
            room = unit
            for cell in (rows[:, None] * k + columns).ravel().tolist():
                n = int(sizes[cell])
                if n > unit:
                    u += room < unit
                    first[cell], parts[cell] = u, -(-n // unit)
                    u, room = u + int(parts[cell]), unit
                    continue
                if n > room:
                    u, room = u + 1, unit
                first[cell] = u
                room -= n
            u += room < unit
    return first, parts, u


def most_similar(
    vectors: DataFrame, k: int = 5, min_cosine: float = 0.8, candidates: int = CANDIDATES, sample_rows: int = SAMPLE_ROWS, hot: int = HOT
) -> DataFrame:
    """(h, other, cosine, rank): for every usable key its ``k`` most similar other keys of the same ``dim``.

    Only neighbours of at least ``min_cosine`` are given. Equal cosines are ranked by key. Rows that are no
    usable vectors, empty tables and dimensions with a single vector give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    # the direction, to twelve digits: scaled copies agree in it
    unit = F.expr("aggregate(vec, 0D, (a, x) -> a + double(x) * double(x), a -> transform(vec, x -> floor(double(x) / sqrt(a) * 1e12D + 0.5D)))")
    keyed = usable(vectors).withColumn("g1", F.xxhash64("dim", unit)).withColumn("g2", F.xxhash64(F.lit(29), unit, "dim"))
    keyed = shared.kept(keyed, "vectors")
    members = keyed.select("h", "dim", "g1", "g2")
    # a class's k + 1 smallest keys: the limit on the rank is applied before the shuffle too
    w = Window.partitionBy("dim", "g1", "g2").orderBy("h")
    smallest = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("dim", "g1", "g2").agg(F.array_sort(F.collect_list("h")).alias("heads"))
    heads = shared.kept(smallest.withColumn("cls", F.col("heads")[0]), "classes")
    base = keyed.join(heads.select(F.col("cls").alias("h"), "dim"), ["h", "dim"], "left_semi").select(
        F.col("h").alias("cls"), "dim", "vec"
    )
    base = shared.kept(base, "representatives")
    sizes = {r.dim: r["count"] for r in base.groupBy("dim").count().orderBy("dim").collect()}
    found = None
    for dim, n in sizes.items():
        if dim < 2:
            raise ValueError("vectors need at least two elements")
        near = _of_one_dim(base.where(F.col("dim") == dim), dim, n, k, min_cosine, candidates, sample_rows)
        found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], "h string, other string, cosine double, rank int")

    # per class the nearest classes, then from classes to keys
    w = Window.partitionBy("dim", "cls").orderBy(F.desc("cosine"), "near")
    best = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    lists = (
        best.join(heads.select("dim", F.col("cls").alias("near"), F.col("heads").alias("others")), ["dim", "near"])
        .groupBy("dim", "cls")
        .agg(F.collect_list(F.struct("cosine", "others")).alias("near"))
    )
    lists = heads.join(lists, ["dim", "cls"], "left").select("dim", "g1", "g2", "heads", "near")
    pick = """
        slice(array_sort(flatten(array(
            transform(filter(heads, x -> x <> h), x -> struct(-1.0D as neg, x as other)),
            flatten(transform(coalesce(near, array()), y -> transform(y.others, x -> struct(-y.cosine as neg, x as other))))
        ))), 1, {k})
    """.format(k=k)
    # at most one class in ``hot`` rows is hot, so their list is small whatever the rows
    many = members.groupBy("dim", "g1", "g2").count().where(F.col("count") > hot).select("dim", "g1", "g2", F.lit(True).alias("is_hot"))
    many = F.broadcast(shared.kept(many, "hot"))
    keys = ["dim", "g1", "g2"]
    part = F.when(F.col("is_hot"), F.pmod(F.xxhash64("h"), F.lit(HOT_PARTS))).otherwise(0).cast("int")
    parts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    spread = members.join(many, keys, "left").withColumn("part", part).drop("is_hot")
    lists = lists.join(many, keys, "left").withColumn("part", F.explode(parts)).drop("is_hot")
    return (
        spread.join(lists, [*keys, "part"])
        .select("h", F.posexplode(F.expr(pick)).alias("p", "n"))
        .select("h", F.col("n.other").alias("other"), (-F.col("n.neg")).alias("cosine"), (F.col("p") + 1).alias("rank"))
    )


def _of_one_dim(base: DataFrame, dim: int, n: int, k: int, min_cosine: float, candidates: int, sample_rows: int) -> DataFrame:
    """(dim, cls, near, cosine) among the representatives of one dimension; at least each one's ``k`` best candidates."""
    spark = base.sparkSession
    size = int(min(MAX_K, max(2, round((n / OCCUPANCY) ** 0.5)), n))
    # by hash: about the wanted number of rows leaves the executors, not that number from each
    wanted = min(sample_rows, max(64 * size, 1024))
    share = min(1.0, 1.1 * wanted / n)
    drawn = base.where(F.pmod(F.xxhash64(F.lit(3), "cls"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = drawn.select(F.xxhash64("cls").alias("o"), "cls", "vec").toPandas().sort_values(["o", "cls"])
    if len(rows) < size:  # a few rows, all of them drawn unlucky
        rows = base.orderBy("cls").limit(max(size, 1024)).toPandas()
    books = fit_halves(_stack(rows["vec"], dim), size)
    model = spark.sparkContext.broadcast(books)

    def cells(batches):
        for pdf in batches:
            if len(pdf):
                d1, d2 = _distances(_stack(pdf["vec"], dim), model.value)
                c, m = np.unique(d1.argmin(1) * size + d2.argmin(1), return_counts=True)
                yield pd.DataFrame({"cell": c, "n": m})

    count = base.select("vec").mapInPandas(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros(size * size, dtype=np.int64)
    held[count["cell"].to_numpy(dtype=np.int64)] = count["n"].to_numpy(dtype=np.int64)
    first, parts, _ = pack_units(held, books, UNIT)
    layout = spark.sparkContext.broadcast((held, first, parts))

    def visit(batches):
        sizes, start, split = layout.value
        for whole in batches:
            for at in range(0, len(whole), 1024):
                pdf = whole.iloc[at : at + 1024]
                d1, d2 = _distances(_stack(pdf["vec"], dim), model.value)
                own = d1.argmin(1) * size + d2.argmin(1)
                part = pd.util.hash_array(pdf["cls"].to_numpy(dtype=object)) % split[own].astype(np.uint64)
                units = []
                for a, b in zip(d1, d2):
                    by_unit: dict[int, list[int]] = {}
                    for c in traverse(a, b, sizes, candidates):
                        for u in range(int(start[c]), int(start[c] + split[c])):
                            by_unit.setdefault(u, []).append(c)
                    units.append([{"unit": u, "cells": cs} for u, cs in by_unit.items()])
                yield pd.DataFrame({"cls": pdf["cls"], "vec": pdf["vec"], "cell": own, "own": start[own] + part.astype(np.int64), "units": units})

    schema = "cls string, vec array<float>, cell int, own int, units array<struct<unit: int, cells: array<int>>>"
    # float32 of a float64 vector would lose digits; the column keeps the type it has
    schema = schema.replace("array<float>", base.schema["vec"].dataType.simpleString())
    placed = shared.kept(base.select("cls", "vec").mapInPandas(visit, schema), f"placed{dim}")
    asks = placed.select("cls", "vec", F.inline("units"))
    blocks = asks.groupBy("unit").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("blocks"))
    asks = asks.join(blocks, "unit").select("unit", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"), "cls", "vec", "cells")
    entries = placed.select("cls", "vec", "cell", F.col("own").alias("unit")).join(blocks, "unit").select(
        "unit", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.col("cls").alias("entry"), F.col("vec").alias("evec"), "cell"
    )

    def rerank(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"cls": [], "near": [], "cosine": []})
        if not len(q) or not len(e):
            return empty
        e = e.sort_values(["cell", "entry"], kind="stable")
        mq, me = _stack(q["vec"], dim), _stack(e["evec"], dim)
        fq, fe = mq.astype(np.float32), me.astype(np.float32)
        asking, names, cells = q["cls"].to_numpy(dtype=object), e["entry"].to_numpy(dtype=object), e["cell"].to_numpy()
        # the queries of each cell
        visits = q["cells"].map(len).to_numpy()
        who, where = np.repeat(np.arange(len(q)), visits), np.concatenate(q["cells"].to_numpy())
        order = np.argsort(where, kind="stable")
        who, where = who[order], where[order]
        rank = np.empty(len(names), dtype=np.int64)
        rank[np.argsort(names, kind="stable")] = np.arange(len(names))
        least = min_cosine - 2 * (dim + 4) * 2.0**-24  # the error of a float32 product of unit vectors, twice
        found, held = [], 0
        for cell in np.unique(cells).tolist():
            a, b = np.searchsorted(cells, [cell, cell + 1])
            x, y = np.searchsorted(where, [cell, cell + 1])
            for at in range(x, y, 1024):
                mine = who[at : min(y, at + 1024)]
                r, c = np.nonzero(fq[mine] @ fe[a:b].T >= least)
                for i in range(0, len(r), PAIRS):
                    g, h = mine[r[i : i + PAIRS]], a + c[i : i + PAIRS]
                    # cosines that differ by rounding only are equal
                    exact = np.round(np.einsum("ij,ij->i", mq[g], me[h]), 14)
                    good = (exact >= min_cosine) & (asking[g] != names[h])
                    found.append((g[good], h[good], exact[good]))
                    held += len(found[-1][0])
                    if held > 16 * PAIRS:
                        found = [_best(found, rank, k)]
                        held = len(found[0][0]) - k * len(q)  # what must be kept doesn't count
        if not found:
            return empty
        g, h, exact = _best(found, rank, k)
        return pd.DataFrame({"cls": asking[g], "near": names[h], "cosine": exact})

    near = asks.groupBy("unit", "block").cogroup(entries.groupBy("unit", "block")).applyInPandas(
        rerank, "cls string, near string, cosine double"
    )
    return near.withColumn("dim", F.lit(dim))


def _best(found: list[tuple], rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query's (query, entry, cosine) the ``k`` of greatest cosine, equal ones by the rank of their keys."""
    g, h, cosine = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((rank[h], -cosine, g))
    g, h, cosine = g[order], h[order], cosine[order]
    keep = np.arange(len(g)) - np.searchsorted(g, g) < k
    return g[keep], h[keep], cosine[keep]


def similar_pairs(vectors: DataFrame, k: int = 5, min_cosine: float = 0.8) -> DataFrame:
    """(h_a, h_b), h_a < h_b: pairs where one is among the ``k`` most similar of the other."""
    near = most_similar(vectors, k, min_cosine)
    return near.select(F.least("h", "other").alias("h_a"), F.greatest("h", "other").alias("h_b")).distinct()
