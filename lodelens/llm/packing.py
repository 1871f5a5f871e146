"""Filling fixed-capacity containers (training sequences) with whole items (documents).

Method. Karmarkar-Karp differencing for many ways: every item starts as a partial partition of m windows, of which one holds it;
the two partial partitions of greatest imbalance are merged with opposing order, fullest beside emptiest, until one is
left, whose windows are nearly equal. m starts at the least possible number and rises whenever a window exceeds the capacity
and exchanging single items does not bring it back.
An item above the capacity fills windows of its own and leaves its remainder as an item.

Scale. Items are sized in one Arrow pass; only (document, size) rows travel. They are spread by hash over groups of about
``GROUP`` items, each packed by itself, so no group grows with the data or with repeated identifiers; what a group wastes is at
most the rounding to whole windows, a fraction of a percent of its some hundred windows.
"""

from __future__ import annotations

import base64
import heapq
import math
import os

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodelens import shared

GROUP = 4096
TOKENIZER = os.environ.get("LODELENS_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The published splitting rule of that vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """A byte-level BPE tokenizer from a rank file; loaded once a worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def difference(sizes: list[int], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Near-equal partition of ``sizes`` into ``m`` windows: (window of each item, window sums)."""
    n = len(sizes)
    if m <= 1:
        return np.zeros(n, dtype=np.int64), np.array([sum(sizes)], dtype=np.int64)
    # a partial partition holds only its non-zero slots above the common base, in descending order
    sums: list[np.ndarray] = [np.array([s], dtype=np.int64) for s in sizes]
    members: list[list[list[int]]] = [[[i]] for i in range(n)]
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y, p, q = sums[a], sums[b], members[a], members[b]
        if len(x) + len(y) <= m:  # no slot need hold both
            total, who = np.concatenate([x, y]), p + q
        else:
            # x in descending, y in ascending order over all m slots
            total = np.zeros(m, dtype=np.int64)
            total[: len(x)] = x
            total[m - len(y) :] += y[::-1]
            who = p + [[] for _ in range(m - len(p))]
            for k, items in enumerate(reversed(q)):
                at = m - len(q) + k
                who[at] = who[at] + items if who[at] else items
        order = np.argsort(-total, kind="stable")
        total = total[order]
        who = [who[i] for i in order]
        sums[a], members[a] = total, who
        sums[b], members[b] = np.zeros(0, dtype=np.int64), []
        spread = int(total[0] - (total[-1] if len(total) == m else 0))
        heapq.heappush(heap, (-spread, a))
    last = heap[0][1]
    window = np.zeros(n, dtype=np.int64)
    for w, items in enumerate(members[last]):
        window[items] = w
    full = np.zeros(m, dtype=np.int64)
    full[: len(sums[last])] = sums[last]
    return window, full


def relieve(window: np.ndarray, sums: np.ndarray, sizes: np.ndarray, capacity: int) -> bool:
    """Bring windows that differencing left above the capacity below it, by exchanging items; False if that fails.

    An item of such a window changes places with a smaller one of another window that has room for the difference; the
    exchange that takes most, up to the excess, is made.
    """
    stuck: set[int] = set()
    while True:
        over = [v for v in np.nonzero(sums > capacity)[0].tolist() if v not in stuck]
        if not over:
            return bool(sums.max() <= capacity)
        v = max(over, key=lambda w: (sums[w], w))
        excess, room, best = int(sums[v]) - capacity, capacity - sums[window], None
        for i in np.nonzero(window == v)[0].tolist():
            gain = sizes[i] - sizes
            gain = np.where((gain > 0) & (gain <= np.minimum(room, excess)) & (window != v), gain, 0)
            j = int(gain.argmax())
            if gain[j] and (best is None or gain[j] > best[0]):
                best = (int(gain[j]), i, j)
        if best is None:
            stuck.add(v)
            continue
        g, i, j = best
        u = int(window[j])
        window[i], window[j] = u, v
        sums[v] -= g
        sums[u] += g


def pack(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each item, none above ``capacity``; items are between 1 and the capacity."""
    if not sizes:
        return np.zeros(0, dtype=np.int64)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    ranked = [sizes[i] for i in order]
    low, step = math.ceil(sum(ranked) / capacity), 1
    m, fits, weight = low, None, np.array(ranked, dtype=np.int64)
    while fits is None:
        window, sums = difference(ranked, m)
        if relieve(window, sums, weight, capacity):
            fits = window
        else:
            low, m, step = m, min(len(ranked), m + step), step * 2
    high = m
    while high - low > 1:  # the first number above the last that failed
        mid = (low + high) // 2
        window, sums = difference(ranked, mid)
        if relieve(window, sums, weight, capacity):
            high, fits = mid, window
        else:
            low = mid
    out = np.zeros(len(sizes), dtype=np.int64)
    out[order] = fits
    return out


def sized(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, part, seq): one row per document row; (part, seq) tells repeated rows apart."""

    def run(batches):
        context = TaskContext.get()
        part, seq = context.partitionId() if context else 0, 0
        encode = tokenizer(path).encode_ordinary
        for pdf in batches:
            counts = [len(encode(t.encode("utf-8", "replace").decode("utf-8"))) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": counts, "part": part, "seq": range(seq, seq + len(pdf))})
            seq += len(pdf)

    return shared.spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id long, n_tokens long, part long, seq long")


def sequences(documents: DataFrame, capacity: int = 4096, path: str = TOKENIZER, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, window_id, at_token): where each document's tokens go.

    Documents of at most ``capacity`` tokens are one piece; a larger one fills whole windows and its last piece shares one.
    Documents without tokens (null or empty text) are one row without window. Repeated rows are packed as often as
    they occur; null identifiers are kept; other columns are ignored; an empty table gives no rows.
    """
    sizes = shared.kept(sized(documents, path), "sizes")
    groups = max(1, math.ceil(sizes.count() / group))
    schema = "doc_id long, piece int, first_token long, n_tokens long, window_id long, at_token long"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "part", "seq"], ascending=[False, True, True])
        base, rows, items = int(pdf["grp"].iloc[0]) << 24, [], []
        ids = [None if x != x else int(x) for x in pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None).map(lambda x: float("nan") if x is None else x)]
        own = 0
        for d, n in zip(ids, pdf["n_tokens"].tolist()):
            whole, rest = divmod(n, capacity)
            if n == 0:
                rows.append((d, 0, 0, 0, None, None))
            for p in range(whole):
                rows.append((d, p, p * capacity, capacity, base + (1 << 23) + own, 0))
                own += 1
            if rest:
                items.append((d, whole, whole * capacity, rest))
        window = pack([x[3] for x in items], capacity)
        used: dict[int, int] = {}
        for (d, p, first, n), w in zip(items, window.tolist()):
            rows.append((d, p, first, n, base + w, used.get(w, 0)))
            used[w] = used.get(w, 0) + n
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        for c in ("doc_id", "window_id", "at_token"):
            out[c] = pd.array([None if x is None or x != x else int(x) for x in out[c]], dtype="Int64")
        return out

    # a group costs seconds though its rows are few: one task a group, and an explicit number, which is not coalesced
    return (
        sizes.withColumn("grp", F.pmod(F.xxhash64("part", "seq"), F.lit(groups)))
        .repartition(groups, "grp")
        .groupBy("grp")
        .applyInPandas(fill, schema)
    )
