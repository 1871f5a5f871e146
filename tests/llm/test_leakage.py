import random

import numpy as np

from lodelens.llm import leakage as L

WORDS = [f"{a}{b}" for a in ("lum", "tar", "ves", "kor", "min", "dal", "fen", "gor") for b in ("ak", "et", "is", "on", "ul", "ya", "ep", "ir")]


def items(n=40, seed=1):
    r = random.Random(seed)
    return [(i, [r.choice(WORDS) for _ in range(r.randint(10, 40))]) for i in range(n)]


def test_variants_of_writing():
    plain = L.words("Find the whole place, where it ends!")
    for v in ("FIND **the** _whole_ place where\tit\n> ends", "Ｆｉｎｄ the who​le pla­ce where it ends", "<p>Find the&nbsp;whole</p> place where it <br>ends", "Fínd thе whole plаce whe-\nre it ends", "Find\\nthe whole place where it ends"):
        assert L.words(v) == plain, v
    assert L.words(None) == [] and L.words("don’t mÃ©mory") == ["dont", "memory"]


def test_retrieval_is_exact_against_brute_force():
    rnd, its = random.Random(2), items()
    index = L.ItemIndex(its)
    for _ in range(150):
        i, ws = rnd.choice(its)
        k = rnd.randint(5, len(ws))
        a = rnd.randint(0, len(ws) - k)
        part = list(ws[a : a + k])
        for _ in range(rnd.randint(0, 3)):
            part[rnd.randrange(len(part))] = "changed"
        doc = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 150))] + part + [rnd.choice(WORDS) for _ in range(rnd.randint(0, 150))]
        vocabulary = index.vocabulary
        ids = np.array([vocabulary.get(w, -1) for w in doc])
        want = {j for j, w in its if L.admissible_stretch(np.array([vocabulary[x] for x in w]), ids)[0] >= min(15, len(w))}
        assert {m[0] for m in index.matches(" ".join(doc))} == want


def test_operator(spark):
    q = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    its = spark.createDataFrame([(1, q, "x"), (2, "a short query of seven words here", None), (3, None, None), (4, "", None), (1, q, "x")], "item_id long, query string, text string")
    changed = q.replace("three", "3rd").replace("twelve", "dozen and")
    docs = [(1, "before " + changed + " after"), (2, " ".join(q.split()[:12])), (3, "A SHORT query, of seven; words here."), (4, None), (5, ""), (6, q + " " + q), (6, q), (7, "x" * 300_000), (8, " ".join(q.split()[2:17]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (8192, 1):
        assert {(r.doc_id, r.item_id) for r in L.leaked(df, its, block).collect()} == {(1, 1), (3, 2), (6, 1), (8, 1)}
    assert L.leaked(df.where("false"), its).count() == 0 and L.leaked(df, its.where("false")).count() == 0


def test_items_of_one_word_and_few_words():
    its = [(1, ["lumak"]), (2, ["taret"]), (3, ["lumak", "taret"]), (4, ["vesis", "koron", "minul"]), (5, ["lumak"])]
    index = L.ItemIndex(its)
    assert {m[0] for m in index.matches("lumak")} == {1, 5}
    assert {m[0] for m in index.matches("before lumak after")} == {1, 5}
    assert {m[0] for m in index.matches("x " * 500 + "taret")} == {2} and {m[0] for m in index.matches("taret" + " x" * 500)} == {2}
    assert {m[0] for m in index.matches("a lumak taret b vesis koron minul")} == {1, 2, 3, 4, 5} and index.matches("none of them") == []
    rnd = random.Random(5)
    its = [(i, [rnd.choice(WORDS) for _ in range(rnd.choice((1, 1, 2, 3, 7, 20)))]) for i in range(30)]
    index = L.ItemIndex(its)
    for _ in range(60):
        doc = [rnd.choice([*WORDS, "other"]) for _ in range(rnd.choice((1, 2, 5, 63, 64, 65, 66, 200)))] + rnd.choice(its)[1]
        ids = np.array([index.vocabulary.get(w, -1) for w in doc])
        want = {j for j, w in its if L.admissible_stretch(np.array([index.vocabulary[x] for x in w]), ids)[0] >= min(15, len(w))}
        assert {m[0] for m in index.matches(" ".join(doc))} == want


def test_long_items_leave_no_short_tail(spark):
    n = L.MAX_ITEM_WORDS
    long = [f"w{i}" for i in range(n - 30)] + [f"v{i}" for i in range(3)] + [f"z{i}" for i in range(2 * L.MIN_WORDS - 3)]
    its = spark.createDataFrame([(1, " ".join(long))], "item_id long, query string")
    tail, part = " ".join(long[-3:]), " ".join(long[-20:])
    docs = spark.createDataFrame([(1, tail), (2, f"before {part} after"), (3, " ".join(long[n - 40 : n - 15])), (4, " ".join(long[:14]))], "doc_id long, text string")
    got = {(r.doc_id, r.item_words) for r in L.leaked(docs, its).collect()}
    assert got == {(2, len(long)), (3, len(long))}


def test_answers_and_blocks_bounded_by_words(spark, monkeypatch):
    q = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    schema = "item_id long, query string, expected_path string, expected_paths array<string>, expected_symbol string"
    its = spark.createDataFrame([(1, q, "src/a_b.py", ["src/a_b.py", "lib/c.go", None], "Store.load"), (2, q + " more of it", None, None, None)], schema)
    docs = spark.createDataFrame([(1, q + " see SRC/a_b.py and store::load"), (2, q)], "doc_id long, text string")
    want = {(1, 1, 3, 2), (1, 2, 0, 0), (2, 1, 3, 0), (2, 2, 0, 0)}
    for words in (1 << 20, 16):
        monkeypatch.setattr(L, "BLOCK_WORDS", words)
        assert {(r.doc_id, r.item_id, r.n_answers, r.answers_found) for r in L.leaked(docs, its).collect()} == want
