"""Splitting oversized items at natural boundaries, with overlap.

Method. Dynamic programming over boundary positions. Every possible cut has a penalty (0 before a blank line, more
at a plain line end, at a sentence end, between words, inside a word), every piece a penalty for being
far from the mean size; the DP minimises the sum subject to the length limit and the overlap. Boundaries of a finer
kind are only offered where coarser ones lie too far apart, so the number of positions stays in proportion to
the text, and each position looks back over one limit's length only: time is linear in the text.

Only rows over the limit leave the JVM.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cut penalties by kind of boundary.
BLANK, DEDENT, LINE, SENTENCE, WORD, CHAR = 0.0, 0.15, 0.4, 1.0, 2.5, 6.0
#: Weight of a piece's relative distance from the mean size, squared.
BALANCE = 0.6
_SENTENCE = re.compile(r"[.!?;:]['\")\]]*\s+")
_WORD = re.compile(r"\s+")
_EOL = re.compile(r"\r\n|\r|\n")


def _line_boundaries(text: str) -> tuple[list[int], list[float]]:
    """Positions right after line ends and what a cut there costs."""
    at, cost, ends = [], [], [m.end() for m in _EOL.finditer(text)]
    starts = [0, *ends]
    spans = [text[s:e] for s, e in zip(starts, [*ends, len(text)])]
    indent = [None if not s.strip() else len(s) - len(s.lstrip()) for s in spans]
    for i in range(1, len(starts)):
        if starts[i] >= len(text):
            break
        here, before = indent[i], indent[i - 1]
        if before is None and here is not None:
            c = BLANK if here == 0 else BLANK + 0.05 * min(here // 4, 2)
        elif here is not None and here == 0 and not spans[i].lstrip().startswith((")", "}", "]", "*")):
            c = DEDENT
        else:
            c = LINE + 0.02 * min((here or 0) // 4, 10)
        at.append(starts[i])
        cost.append(c)
    return at, cost


def _boundaries(text: str, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in ascending order with penalties; no two neighbours are more than ``gap`` apart."""
    at, cost = _line_boundaries(text)
    for pattern, c in ((_SENTENCE, SENTENCE), (_WORD, WORD), (None, CHAR)):
        fence, wide = [0, *at, len(text)], []
        for a, b in zip(fence, fence[1:]):
            if b - a > gap:
                if pattern is None:
                    wide += range(a + gap // 2, b, max(1, gap // 2))
                else:
                    wide += [m.end() for m in pattern.finditer(text, a, b) if a < m.end() < b]
        if wide:
            merged = sorted([*zip(at, cost), *((p, c) for p in wide)])
            at, cost = [p for p, _ in merged], [x for _, x in merged]
    # never between the halves of a line end
    keep = [i for i, p in enumerate(at) if not (text[p - 1] == "\r" and text[p] == "\n")]
    return np.array([at[i] for i in keep], dtype=np.int64), np.array([cost[i] for i in keep])


def split_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open character spans, each at most ``limit`` long, that cover ``text`` in order.

    Consecutive pieces share at least ``overlap`` characters, and more only to reach back to a natural boundary
    (at most ``overlap // 2`` more). A text within the limit is one span, an empty text none.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    n = len(text)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n)]
    slack = overlap // 2
    step = limit - overlap - slack
    at, penalty = _boundaries(text, max(1, min(step // 6, limit // 8)))
    at, penalty = np.append(at, n), np.append(penalty, 0.0)
    # where the piece after a cut begins: at the cheapest boundary in [cut - overlap - slack, cut - overlap]
    starts = np.maximum(at - overlap, 0)
    if overlap:
        lo, hi = np.searchsorted(at, at - overlap - slack), np.searchsorted(at, at - overlap, side="right")
        for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
            if a < b:
                j = b - 1 - int(np.argmin(penalty[a:b][::-1]))
                if penalty[j] < CHAR:
                    starts[i] = at[j]
    pieces = int(np.ceil((n - overlap) / (limit - overlap)))
    mean = (n + (pieces - 1) * overlap) / pieces
    best, back = np.full(len(at), np.inf), np.full(len(at), -1, dtype=np.int64)
    first = bisect_left(at, limit + 1)
    best[:first] = penalty[:first] + BALANCE * ((at[:first] - mean) / mean) ** 2
    low = 0
    for k in range(len(at)):
        while starts[low] < at[k] - limit:
            low += 1
        # the piece [starts[j], at[k]) must go beyond cut j, and within the limit
        if low < k:
            size = at[k] - starts[low:k]
            cost = best[low:k] + BALANCE * ((size - mean) / mean) ** 2
            j = int(np.argmin(cost))
            if cost[j] + penalty[k] < best[k]:
                best[k], back[k] = cost[j] + penalty[k], low + j
    spans, k = [], len(at) - 1
    while k >= 0:
        j = int(back[k])
        spans.append((0 if j < 0 else int(starts[j]), int(at[k])))
        k = j
    return spans[::-1]


def _pieces(text: str, start_line, end_line, limit: int, overlap: int):
    ends = [m.end() for m in _EOL.finditer(text)]
    n_lines = len(ends) + (0 if ends and ends[-1] == len(text) else 1)
    known = start_line is not None and start_line == start_line and start_line >= 1
    if known and end_line is not None and end_line == end_line:
        # a text's last line end may or may not be part of the chunk
        known = int(end_line) - int(start_line) + 1 in (n_lines, n_lines + 1)
    base = int(start_line) if known else 1
    for a, b in split_spans(text, limit, overlap):
        yield a, b, base + bisect_left(ends, a + 1), base + bisect_left(ends, b), known


def split_oversized(chunks: DataFrame, limit: int = 1920, overlap: int = 240, chars_per_token: int = 4) -> DataFrame:
    """The pieces of all chunks over ``limit`` characters.

    One row per piece: project_id, chunk_id, piece (from 0), n_pieces, start_char, end_char, start_line, end_line,
    lines_known, token_estimate, text. Line numbers count ``\\n``, ``\\r\\n`` and ``\\r``; where the chunk's own
    are missing or don't fit its text they are relative to it and ``lines_known`` is false. ``token_estimate`` is
    ``max(1, length // chars_per_token)``, whatever the chunk's own says. Repeated rows count once; null, empty and
    short texts give no rows; other columns are ignored.
    """
    long = (
        chunks.where(F.length("text") > limit)
        .select("project_id", "chunk_id", "start_line", "end_line", "text")
        .dropDuplicates()
    )
    schema = (
        "project_id string, chunk_id string, piece int, n_pieces int, start_char int, end_char int, start_line int,"
        " end_line int, lines_known boolean, token_estimate int, text string"
    )

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                found = list(_pieces(r.text, r.start_line, r.end_line, limit, overlap))
                for i, (a, b, first, last, known) in enumerate(found):
                    rows.append(
                        (r.project_id, r.chunk_id, i, len(found), a, b, first, last, known, max(1, (b - a) // chars_per_token), r.text[a:b])
                    )
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(",")])

    return long.mapInPandas(run, schema)
