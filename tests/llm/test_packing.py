import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodelens.llm import packing as P


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_windows_hold_the_capacity(sizes):
    w = P.pack(sizes, 100)
    sums = np.bincount(w, weights=sizes) if sizes else np.zeros(0)
    assert len(w) == len(sizes) and (sums <= 100).all()
    assert len(sums) <= max(1, 2 * -(-sum(sizes) // 100))


def test_little_is_wasted():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(20, 900, 1500).tolist()
    used = int(P.pack(sizes, 4096).max()) + 1
    assert sum(sizes) / (used * 4096) > 0.97


@pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="no tokenizer file")
def test_round_trip(spark):
    rows = [(1, "one two three " * 30, 0), (2, None, 0), (3, "", 0), (4, "word " * 700, 0), (4, "word " * 700, 0), (None, "tail of a text", 0), (5, "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "replace"), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = P.sequences(df, capacity=256).collect()
    tokens = {d: len(P.tokenizer(P.TOKENIZER).encode_ordinary(t)) for d, t, _ in rows if t}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert sum(r.n_tokens for r in by[4]) == 2 * tokens[4] and all(sum(r.n_tokens for r in by[d]) == tokens[d] for d in (1, None, 5))
    assert by[2][0].window_id is None and by[3][0].n_tokens == 0 and len(by[1]) == 1
    windows = {}
    for r in got:
        if r.window_id is not None:
            windows[r.window_id] = windows.get(r.window_id, 0) + r.n_tokens
    assert max(windows.values()) <= 256
    assert P.sequences(df.where("false")).count() == 0
