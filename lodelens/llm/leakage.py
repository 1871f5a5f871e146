"""Evaluation texts leaking into training text.

Method. The test items are indexed in an inverted index with BM25 weights and block maxima; its terms are pairs of
neighbouring words, as single words of one field's jargon tell items apart too badly; only an item of one word has that word as
its term. Every document is cut into
overlapping passages, each passage is a query: block-max WAND retrieves all items whose score reaches the item's own threshold, and an
alignment of the item's words with the document's words verifies the overlap.

The threshold loses nothing: for an item it is the least score that any admissible stretch (``MIN_WORDS`` to
``2 * MIN_WORDS - 1`` words, without its heaviest terms, two for each edit allowed) can have; a longer stretch
contains such a one, and passages overlap by more than its length. Weights are divided by it, so WAND runs with threshold 1.

An item's answers (the paths and the symbol it expects) are then sought in the documents that hold its text.

Scale. Documents are never shuffled: one pass, one narrow row per verified pair. Items are cut into parts of bounded length and
indexed in blocks of bounded rows and words (``BLOCK``, ``BLOCK_WORDS``), so what is broadcast is bounded; a larger test set takes more
passes over the documents, not more memory.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodelens import shared

MIN_WORDS, WORDS_PER_EDIT = 15, 6
PASSAGE, OVERLAP = 64, 38
#: Items and words indexed at once, about; at most twice as many are broadcast.
BLOCK, BLOCK_WORDS = 8192, 1 << 20
#: Entries of a posting list under one maximum.
BM25_BLOCK = 32
MAX_ITEM_WORDS = 4096
K1, B = 1.2, 0.75

# Letters of other scripts that look like Latin ones (lower case, after compatibility decomposition).
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ь": "b",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ß": "ss", "æ": "ae", "œ": "oe",
}
_LOOK = str.maketrans(LOOKALIKES)
_UNSEEN = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿￹-￿]"
)
_TWICE_ENCODED = re.compile("[Â-ô][\u0080-¿]{1,3}")
_ESCAPED = re.compile(r"\\[nrt]|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_REMARK = re.compile(r"<!--.*?-->", re.S)
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n[\s>#*|/]*(?=[a-z])")
_QUOTE = re.compile(r"(?<=[^\W_])['’ʼ`´](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def _escape(m: re.Match) -> str:
    s = m.group()
    return " " if s[1] in "nrt" else chr(int(s[2:], 16))


def _repair(m: re.Match) -> str:
    """UTF-8 that was read as Latin-1, put right; unchanged if it is none."""
    try:
        return m.group().encode("latin-1").decode("utf-8")
    except UnicodeError:
        return m.group()


def words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, markup, layout and character variants."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPED.sub(_escape, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        if "-->" in text:
            text = _REMARK.sub(" ", text)
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _UNSEEN.sub("", _TWICE_ENCODED.sub(_repair, text)))
        text = "".join(c for c in text if not unicodedata.combining(c)).lower().translate(_LOOK)
    text = text.lower()
    if "-" in text or "‐" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(_QUOTE.sub("", text))


def allowed(n: int) -> int:
    return n // WORDS_PER_EDIT


class ItemIndex:
    """Inverted index of test items with weights scaled so that each item's threshold is 1."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = [(i, w) for i, w in items if w]
        self.vocabulary: dict[str, int] = {}
        for _, ws in self.items:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.words = [np.array([self.vocabulary[w] for w in ws], dtype=np.int64) for _, ws in self.items]
        # an item of one word has no pair: its term is the word, coded behind all pairs
        self.single_words = any(len(ids) == 1 for ids in self.words)
        raw = [self._words(ids) if len(ids) == 1 else self._pairs(ids) for ids in self.words]
        self.codes = np.unique(np.concatenate([*raw, np.zeros(0, dtype=np.int64)]))
        terms_of = [np.searchsorted(self.codes, c) for c in raw]
        n, df = len(self.items), np.zeros(len(self.codes))
        for ids in terms_of:
            df[np.unique(ids)] += 1
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = max(1.0, sum(map(len, terms_of)) / max(1, n))
        lists: dict[int, list[tuple[int, float]]] = {}
        for d, ids in enumerate(terms_of):
            terms, tf = np.unique(ids, return_counts=True)
            weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))
            scale = self._least(ids, dict(zip(terms.tolist(), weight.tolist())))
            for t, w in zip(terms.tolist(), (weight / scale).tolist()):
                lists.setdefault(t, []).append((d, w))
        self.posts = {t: ([d for d, _ in p], [w for _, w in p]) for t, p in lists.items()}
        self.block_max = {
            t: [max(w[i : i + BM25_BLOCK]) for i in range(0, len(w), BM25_BLOCK)] for t, (_, w) in self.posts.items()
        }
        self.upper = np.zeros(len(self.codes) + 1)  # the last is for unknown terms
        for t, (_, w) in self.posts.items():
            self.upper[t] = max(w)

    def _pairs(self, ids: np.ndarray) -> np.ndarray:
        """Codes of neighbouring words, -1 where one is unknown."""
        a, b = ids[:-1], ids[1:]
        return np.where((a >= 0) & (b >= 0), a * len(self.vocabulary) + b, -1)

    def _words(self, ids: np.ndarray) -> np.ndarray:
        """Codes of single words, -1 where one is unknown."""
        return np.where(ids >= 0, len(self.vocabulary) ** 2 + ids, -1)

    def _numbers(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        hit = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == codes)
        return np.where(hit, at, len(self.codes))

    def terms(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers of a document's neighbouring words and of its single words, the last number for unknown ones."""
        if not len(self.codes):
            return np.zeros(max(0, len(ids) - 1), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        single = self._numbers(self._words(ids)) if self.single_words else np.full(len(ids), len(self.codes))
        return self._numbers(self._pairs(ids)), single

    @staticmethod
    def _least(ids: np.ndarray, weight: dict[int, float]) -> float:
        """The least score of an admissible stretch of this item."""
        n, best = len(ids), math.inf
        sizes = [n] if n < MIN_WORDS - 1 else range(MIN_WORDS - 1, 2 * MIN_WORDS - 1)
        for a in range(n):
            for size in sizes:  # of terms: one less than words
                if a + size <= n:
                    w = sorted(weight[t] for t in set(ids[a : a + size].tolist()))
                    best = min(best, sum(w[: max(1, len(w) - 2 * allowed(size + 1))]))
        return max(best, 1e-9) * (1 - 1e-9)

    def retrieve(self, terms: list[int]) -> list[int]:
        """All items whose score for the distinct ``terms`` reaches 1: block-max WAND."""
        cursor = [[self.posts[t][0][0], t, 0] for t in terms if t in self.posts]
        found = []
        while cursor:
            cursor.sort()
            bound, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(cursor):
                bound += self.upper[t]
                if bound >= 1.0:
                    pivot = i
                    break
            if pivot < 0:
                return found
            d = cursor[pivot][0]
            while pivot + 1 < len(cursor) and cursor[pivot + 1][0] == d:
                pivot += 1
            ends, block = [], 0.0
            for here, t, p in cursor[: pivot + 1]:
                docs = self.posts[t][0]
                if here < d:
                    p = _seek(docs, p, d)
                if p < len(docs):
                    b = p // BM25_BLOCK
                    block += self.block_max[t][b]
                    ends.append(docs[min(len(docs), (b + 1) * BM25_BLOCK) - 1])
            if block < 1.0:  # no item up to the nearest block end can reach the threshold
                goal = min([*ends, *([cursor[pivot + 1][0] - 1] if pivot + 1 < len(cursor) else [])], default=d) + 1
                goal = max(goal, d + 1)
            else:
                goal, score = d + 1, 0.0
                for c in cursor[: pivot + 1]:
                    docs, w = self.posts[c[1]]
                    if c[0] < d:
                        c[2] = _seek(docs, c[2], d)
                        c[0] = docs[c[2]] if c[2] < len(docs) else d + (1 << 60)
                    if c[0] == d:
                        score += w[c[2]]
                if score >= 1.0:
                    found.append(d)
            rest = []
            for c in cursor:
                docs = self.posts[c[1]][0]
                if c[0] < goal:
                    c[2] = _seek(docs, c[2], goal)
                    if c[2] >= len(docs):
                        continue
                    c[0] = docs[c[2]]
                elif c[0] >= 1 << 60:
                    continue
                rest.append(c)
            cursor = rest
        return found

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, words of a stretch, its edits, the item's words) for a document; the stretch has the fewest edits."""
        ids = np.array([self.vocabulary.get(w, -1) for w in words(text)], dtype=np.int64)
        if not len(ids):
            return []
        terms, single = self.terms(ids)
        reach = np.concatenate([[0.0], np.cumsum(self.upper[terms])])
        alone = np.concatenate([[0.0], np.cumsum(self.upper[single])])
        step = PASSAGE - OVERLAP
        starts = np.arange(0, max(1, len(terms) - OVERLAP), step)
        ends = np.minimum(starts + PASSAGE, len(terms))
        regions: dict[int, list[list[int]]] = {}
        most = reach[ends] - reach[starts] + alone[ends + 1] - alone[starts]
        for a, b in zip(*(x[most >= 1.0 - 1e-9].tolist() for x in (starts, ends))):
            here = {*terms[a:b].tolist(), *single[a : b + 1].tolist()}
            here.discard(len(self.codes))
            if sum(self.upper[t] for t in here) < 1.0 - 1e-9:
                continue
            for d in self.retrieve(sorted(here)):
                span = regions.setdefault(d, [])
                margin = len(self.words[d]) * 7 // 6 + 2
                if span and a - margin <= span[-1][1]:
                    span[-1][1] = b + margin
                else:
                    span.append([max(0, a - margin), b + margin])
        out = []
        for d, spans in regions.items():
            best = max((admissible_stretch(self.words[d], ids[a:b]) for a, b in spans), default=(0, 0))
            n = len(self.words[d])
            if best[0] >= min(MIN_WORDS, n):
                out.append((self.items[d][0], best[0], best[1], n))
        return out


def _seek(docs: list[int], p: int, goal: int) -> int:
    """First position from ``p`` on whose item is at least ``goal``."""
    step = 1
    while p + step < len(docs) and docs[p + step] < goal:
        step *= 2
    lo, hi = p + step // 2, min(len(docs), p + step)
    while lo < hi:
        mid = (lo + hi) // 2
        if docs[mid] < goal:
            lo = mid + 1
        else:
            hi = mid
    return lo


def admissible_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Words and edits of a stretch of ``item`` that stands in ``text`` with at most a sixth of edits.

    Of the stretches long enough one with the fewest edits, of those the longest; without any, the longest shorter one. An edit is a changed, inserted or missing word. A stretch begins and ends with equal words, except where it is the
    whole item.
    """
    m, n = len(item), len(text)
    if not m or not n:
        return 0, 0
    equal = item[:, None] == text[None, :]
    none = -(10**6)
    before, best = None, (0, 0)
    whole = np.zeros(n + 1, dtype=np.int64)  # edits of the item's first i words, ending anywhere
    for i in range(m):
        cost = np.minimum(whole[:-1] + ~equal[i], whole[1:] + 1)
        cost = np.concatenate([[whole[0] + 1], cost])
        # an inserted word costs one: running minimum of cost - position
        whole = np.minimum.accumulate(cost - np.arange(n + 1)) + np.arange(n + 1)
    if whole.min() <= allowed(m):
        return m, int(whole.min())
    for e in range(allowed(m) + 1):
        h = np.full((m + 1, n + 1), none, dtype=np.int64)
        for i in range(1, m + 1):
            run = np.where(equal[i - 1], np.maximum(h[i - 1, :-1] + 1, 1 if e == 0 else none), none)
            if before is not None:
                run = np.maximum(run, np.where(equal[i - 1], none, before[i - 1, :-1] + 1))  # changed
                run = np.maximum(run, before[i, :-1])  # inserted
                run = np.maximum(run, before[i - 1, 1:] + 1)  # missing
            h[i, 1:] = run
        ended = np.where(equal, h[1:, 1:], none)
        top = int(ended.max())
        if top > best[0] and allowed(top) >= e:
            best = (top, e)
            if top >= MIN_WORDS:
                break
        before = h
    return best


_PARTS = "item_id long, part int, words array<string>, item_words int, answers array<string>"


def _cut_items(batches):
    """Items as parts of at most ``MAX_ITEM_WORDS`` words; all but the only part have that length, the last reaches back for it."""
    step = MAX_ITEM_WORDS - 2 * MIN_WORDS
    for pdf in batches:
        rows = []
        for item, query, answers in zip(pdf["item_id"], pdf["query"], pdf["answers"]):
            ws = words(query)
            last = max(0, len(ws) - MAX_ITEM_WORDS)
            said = sorted({a for a in (" ".join(words(x)) for x in answers) if a})
            rows += [(item, i, ws[a : a + MAX_ITEM_WORDS], len(ws), said) for i, a in enumerate([*range(0, last, step), last]) if ws]
        yield pd.DataFrame(rows, columns=["item_id", "part", "words", "item_words", "answers"])


def _blocks(parts: DataFrame, rows: int) -> int:
    """The least number of hash blocks, doubled from what an even spread needs, of which none holds more than its share of rows and words."""
    whole = parts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("w")).first()
    blocks = max(1, math.ceil(whole["n"] / rows), math.ceil(whole["w"] / BLOCK_WORDS))
    while blocks > 1:
        most = parts.groupBy(_block_of(blocks).alias("b")).agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("w")).agg(F.max("n"), F.max("w")).first()
        if most[0] <= 2 * rows and most[1] <= 2 * BLOCK_WORDS:
            break
        blocks *= 2
    return blocks


def _block_of(blocks: int):
    return F.pmod(F.xxhash64("item_id", "part", "words"), F.lit(blocks))


def leaked(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_words, n_edits, item_words, n_answers, answers_found): documents that hold a test item wholly or in part.

    At least ``MIN_WORDS`` running words of the item, or all of it if shorter, with at most one edit in
    ``WORDS_PER_EDIT`` words. Where ``items`` has the columns expected_path, expected_paths or expected_symbol, these are the item's answers:
    ``answers_found`` of ``n_answers`` different ones stand in the same document, written in whatever way. Rows with null or empty texts,
    and items without a word, have no matches; an item longer than ``MAX_ITEM_WORDS`` is indexed as several overlapping parts. Repeated
    rows count once, other columns are ignored.
    """
    spark = documents.sparkSession
    none = F.array().cast("array<string>")
    given = [F.array(c) for c in ("expected_path", "expected_symbol") if c in items.columns] + [F.coalesce("expected_paths", none)] * ("expected_paths" in items.columns)
    answers = F.array_compact(F.concat(*given, none))
    asked = items.where(F.col("query").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "query", answers.alias("answers")).distinct()
    parts = shared.kept(asked.mapInPandas(_cut_items, _PARTS), "items")
    blocks = _blocks(parts, block)
    schema = "doc_id long, item_id long, n_words int, n_edits int, item_words int, n_answers int, answers_found int"
    out = None
    for b in range(blocks):
        rows = parts.where(_block_of(blocks) == b).orderBy("item_id", "part", "words").collect()
        index = ItemIndex([(i, r.words) for i, r in enumerate(rows)])
        held = spark.sparkContext.broadcast((index, [(r.item_id, r.item_words, r.answers) for r in rows]))

        def run(batches, held=held):
            index, about = held.value
            for pdf in batches:
                got = []
                for d, t in zip(pdf["doc_id"], pdf["text"]):
                    found = index.matches(t)
                    text = f" {' '.join(words(t))} " if found else ""
                    for i, n, edits, _ in found:
                        item, length, answers = about[i]
                        got.append((d, item, n, edits, length, len(answers), sum(f" {a} " in text for a in answers)))
                yield pd.DataFrame(got, columns=[c.split()[0] for c in schema.split(", ")])

        found = shared.spread(documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")).mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    # of an item's parts and repeated rows the longest stretch, of equals the one with the fewest edits
    best = F.max(F.struct("n_words", (-F.col("n_edits")).alias("e"))).alias("x")
    rest = [F.max(c).alias(c) for c in ("item_words", "n_answers", "answers_found")]
    return out.groupBy("doc_id", "item_id").agg(best, *rest).select("doc_id", "item_id", "x.n_words", (-F.col("x.e")).alias("n_edits"), "item_words", "n_answers", "answers_found")
