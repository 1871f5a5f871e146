"""Texts as columns: tokens, hashes of identity, complexity, generated files, safe patterns."""

from __future__ import annotations

import re
import warnings
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

MAX_PATTERN = 500
# What a generated file says in its first lines.
GENERATED_MARKERS = ["@generated", "do not edit", "auto-generated", "autogenerated", "code generated by", "this file is generated", "this file was automatically generated"]
COMMENT_STARTS = ("#", "//", "/*", "*", "--", "<!--")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Runs of ASCII letters, digits and underscores, in lower case; empty for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit("([A-Za-z0-9_]+)"), F.lit(1)), F.lower)


def identifiers(text) -> Column:
    """Tokens of two characters and more, in order, with repeats."""
    return F.filter(tokens(text), lambda t: F.length(t) >= 2)


def token_set(text) -> Column:
    return F.array_distinct(tokens(text))


def jaccard(a, b) -> Column:
    """Overlap of two token sets; 0 where both are empty."""
    x, y = token_set(a), token_set(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def overlap_bucket(value) -> Column:
    v = _c(value)
    return F.when(v == 0, "zero").when(v < 0.03, "low").when(v < 0.10, "medium").otherwise("high")


def search_text(path, symbol, lang, content) -> Column:
    """The text that is indexed: path, symbol and language lines before the content; empty ones left out."""
    def line(head, x):
        v = F.coalesce(_c(x), F.lit(""))
        return F.when(v != "", F.concat(F.lit(head), v))

    head = F.concat_ws("\n", F.concat(F.lit("path: "), F.coalesce(_c(path), F.lit(""))), line("symbol: ", symbol), line("language: ", lang))
    return F.concat(head, F.lit("\n\n"), F.coalesce(_c(content), F.lit("")))


def chunk_id(path, ordinal, text) -> Column:
    return F.concat_ws(":", F.left(F.sha2(_c(path), 256), F.lit(12)), _c(ordinal).cast("string"), F.left(F.sha2(_c(text), 256), F.lit(8)))


def embedding_hash(embedder: str, chunker: str, digest: str, text) -> Column:
    """Identity of what is embedded: model, chunker version, artefact and text, separated by NUL."""
    zero = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return F.sha2(F.concat(F.lit(embedder), zero, F.lit(chunker), zero, F.lit(digest), zero, _c(text)), 256)


def looks_generated(text, lang) -> Column:
    """A marker in the first eight lines (not for rst), or one of 500 lines over 5000 characters (not for prose)."""
    lines = F.split(F.coalesce(_c(text), F.lit("")), "\n", -1)
    head = F.lower(F.array_join(F.slice(lines, 1, 8), "\n"))
    low = F.coalesce(_c(lang), F.lit(""))
    marked = F.lit(False)
    for m in GENERATED_MARKERS:
        marked = marked | head.contains(m)
    long = F.exists(F.slice(lines, 1, 500), lambda x: F.length(x) > 5000)
    return ((low != "rst") & marked) | (~low.isin("markdown", "rst", "text") & long)


#: The blanks before a line's first word, where that word opens no comment.
_LEAD = re.compile(r"^([ \t]*+)\s*+(?!" + "|".join(re.escape(c) for c in COMMENT_STARTS) + r")(?=\S)")


def indent_complexity(text, tab: int = 4, limit: int = 1_000_000) -> Column:
    """Sum of leading columns in units of ``tab`` over lines that are neither blank nor comments; tab stops are exact.

    0 for null, empty, oversized texts and such with a NUL.
    """

    def depth(t: str | None) -> float:
        if not t or len(t) > limit or "\0" in t:
            return 0.0
        leads = filter(None, map(_LEAD.match, t.splitlines()))
        return round(sum(len(m[1].expandtabs(tab)) for m in leads) / tab, 3)

    @pandas_udf("double")
    def f(s: pd.Series) -> pd.Series:
        return s.map(depth, na_action=None).astype("float64")

    return f(_c(text))


def _ambiguous(items, repeated: bool) -> bool:
    """Whether anything that is repeated without bound holds another repetition or option, or choices that begin alike: such patterns may backtrack
    without end. Stricter than need be; what it refuses is replaced by a default."""
    for op, args in items:
        name = str(op)
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = args
            if (repeated and low != high) or _ambiguous(inner, repeated or high >= 32):
                return True
        elif name == "BRANCH":
            firsts = [(str(c[0][0]), c[0][1]) if len(c) else None for c in args[1]]
            if repeated and (None in firsts or any(f[0] != "LITERAL" for f in firsts) or len(set(firsts)) < len(firsts)):
                return True
            if any(_ambiguous(c, repeated) for c in args[1]):
                return True
        elif name in ("SUBPATTERN", "ATOMIC_GROUP", "POSSESSIVE_REPEAT"):
            if _ambiguous(args[-1], repeated and name == "SUBPATTERN"):
                return True
        elif name in ("ASSERT", "ASSERT_NOT"):
            if _ambiguous(args[1], repeated):
                return True
    return False


def safe_pattern(pattern: str | None, default: str) -> str:
    """The caller's pattern, or the default with a warning: too long, not valid, or prone to endless backtracking."""
    if not pattern:
        return default
    why = None
    if len(pattern) > MAX_PATTERN:
        why = f"longer than {MAX_PATTERN} characters"
    else:
        try:
            if _ambiguous(parser.parse(pattern), False):
                why = "a repeated group that can match the same text in several ways"
        except (re.error, OverflowError, RecursionError) as e:
            why = str(e)
    if why:
        warnings.warn(f"pattern not used: {why}", stacklevel=2)
        return default
    return re.sub(r"\(\?P<", "(?<", pattern)
