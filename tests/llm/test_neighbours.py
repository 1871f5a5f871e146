import numpy as np

from lodelens.llm import neighbours as N

SCHEMA = "h string, dim int, vec array<float>, last_used_at double"


def test_recall_against_brute_force_with_copies_and_bad_rows(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(60, 16))
    v = np.concatenate([c + rnd.normal(scale=0.25, size=(12, 16)) for c in centres])
    v = np.concatenate([v, np.repeat(v[:1], 300, axis=0)]).astype(np.float32)  # a third are copies
    keys = [f"k{i:05d}" for i in range(len(v))]
    rows = [(k, 16, x.tolist(), 0.0) for k, x in zip(keys, v)] + [("k00003", 16, v[3].tolist(), 1.0), ("n", 16, None, 0.0), ("z", 16, [0.0] * 16, 0.0), ("s", 16, [1.0], 0.0), ("nan", 16, [float("nan")] * 16, 0.0), ("one", 4, [1.0, 0.0, 0.0, 0.0], 0.0)]
    got = {(r.h_a, r.h_b) for r in N.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    want = set()
    for i in range(len(u)):
        for j in np.argsort(-s[i], kind="stable")[:5]:
            if s[i, j] >= 0.8:
                want.add((min(keys[i], keys[j]), max(keys[i], keys[j])))
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9
    assert not {x for p in got for x in p} & {"n", "z", "s", "nan", "one"}


def test_empty_and_parts(spark):
    assert N.similar_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    sizes = np.array([3, 0, 9000, 2], dtype=np.int64)
    first, parts, n = N.pack_units(sizes, np.array([[0.0, 1.0], [1.0, 0.0]]), 4096)
    assert parts[2] == 3 and n >= 4 and first[3] not in (first[2], first[2] + 1, first[2] + 2)
    order = N.traverse(np.array([0.0, 5.0]), np.array([0.0, 1.0]), np.array([1, 1, 1, 1]), 10**6)
    assert order == [0, 1, 2, 3]


def test_hot_group_within_float32_error_is_exact(spark):
    rnd = np.random.default_rng(4)
    v = (rnd.normal(size=16) + rnd.normal(scale=3e-5, size=(1200, 16))).astype(np.float32)
    v = np.concatenate([v, v[:100] * np.float32(2), v[:100] * np.float32(0.25)])
    keys = [f"k{i:05d}" for i in rnd.permutation(len(v))]
    rows = [(k, 16, x.tolist(), 0.0) for k, x in zip(keys, v)]
    got = {}
    for r in N.most_similar(spark.createDataFrame(rows, SCHEMA), candidates=10**9).collect():
        got.setdefault(r.h, []).append((r.rank, r.other, r.cosine))
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = -np.sort(-s, axis=1)[:, :5]
    assert np.abs(np.array([[x[2] for x in sorted(got[k])] for k in keys]) - want).max() < 1e-13
    for i in range(100):  # scaled copies are equally similar, so the keys rank them
        a, b, c = keys[i], keys[1200 + i], keys[1300 + i]
        assert [x[1] for x in sorted(got[a])[:2]] == sorted((b, c)) and [x[1] for x in sorted(got[b])[:2]] == sorted((a, c))


def test_classes_above_the_limit_are_split_and_give_the_same(spark):
    rnd = np.random.default_rng(5)
    v = rnd.normal(size=(40, 8)).astype(np.float32)
    v = np.concatenate([v, np.repeat(v[:1], 80, axis=0), v[1:2] * np.float32(3)])
    df = spark.createDataFrame([(f"k{i:04d}", 8, x.tolist(), 0.0) for i, x in enumerate(v)], SCHEMA)
    whole, split = ({(r.h, r.other, r["rank"]) for r in N.most_similar(df, hot=h).collect()} for h in (N.HOT, 20))
    assert whole == split and len({h for h, _, _ in whole}) >= 82


def test_tiles_keep_neighbours_together():
    rnd = np.random.default_rng(6)
    book = np.sort(rnd.normal(size=64))[:, None] * np.ones(4)
    parts = N._tiles(book, 4)
    assert sorted(np.concatenate(parts).tolist()) == list(range(64)) and all(np.ptp(p) == len(p) - 1 for p in parts)
    g, h, c = N._best([(np.array([0, 0, 1]), np.array([1, 2, 0]), np.array([0.9, 0.9, 0.8])), (np.array([0]), np.array([0]), np.array([0.95]))], np.array([2, 1, 0]), 2)
    assert list(zip(g.tolist(), h.tolist())) == [(0, 0), (0, 2), (1, 0)]
