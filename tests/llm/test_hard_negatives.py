"""Hard negatives against an exhaustive search, and the bounds of the tree."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushline.llm import hard_negatives as H


def clip(x):
    return min(max(x, -(2**63)), 2**63 - 1)


def brute(rows, every, k, m):
    """(anchor, positive, rank, negative, scores) by scoring all rows."""
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows})
    score = lambda a, b: clip(sum(x * y for x, y in zip(a, b, strict=False)))
    out = []
    for i, lab, v in rows:
        if i % every:
            continue
        best = sorted(((-score(v, w), j, lab == other) for j, other, w in rows if j != i))
        for s, j, _ in [x for x in best if x[2]][:k]:
            window = [(n, b) for n, b, same in best if not same and -30 * s <= -100 * n <= -90 * s]
            out += [(i, j, r, b, -s, -n) for r, (n, b) in enumerate(window[:m], 1)]
    return sorted(out)


def test_mined_rows_equal_exhaustive_search(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 4), [rng.gauss(0, 1) for _ in range(6)]) for i in range(500)]
    rows += [(i, 3, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(500, 800)]  # one very common vector
    rows += [(i, i % 90, [rng.gauss(2, 0.1)] * 6) for i in range(800, 900)]
    rows += [(900, 1, [1.0, 2.0]), (901, 1, []), (902, 1, [0.0] * 6), (910, 64, [1.0] * 9)] + [(903, 2, [0.3] * 6)] * 3 + [(20, 1, [0.5] * 6)]
    odd = [(None, 1, [1.0]), (904, None, [1.0]), (905, 1, None), (906, 1, [1.0, None]), (907, 1, [float("nan")]), (908, 1, [float("inf")]), (910, 1, [float("-inf")])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "'z' AS block", "4 AS anchor")
    whole = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows]
    want = brute(whole, 10, 5, 10)
    prepared = H.prepared(frame)
    for block, anchors in ((4096, 2048), (60, 20)):
        monkeypatch.setattr(H.Cells.__init__, "__defaults__", (8, 300, block))
        monkeypatch.setattr(H.search, "__defaults__", (anchors,))
        got = sorted(map(tuple, H.mine(prepared, every=10).collect()))
        assert got == want and len(want) > 1000
    assert H.mine(H.prepared(frame.where("false"))).count() == 0


def test_numbers_beyond_64_bits(spark):
    rows = [(0, 1, [1e30, 1.0]), (1, 1, [1e30, 5.0]), (2, 2, [-1e30, 1.0]), (3, 2, [1e-3, 1e16]), (10, 1, [3e15, 1.0]), (4, 3, [0.5, 0.0])]
    top = 2**63 - 1
    whole = [(i, lab, [clip(int(np.floor(256 * x))) if abs(x) < 1e18 else (top if x > 0 else -top - 1) for x in v]) for i, lab, v in rows]
    got = sorted(map(tuple, H.mine(H.prepared(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")), every=10).collect()))
    assert got == brute(whole, 10, 5, 10)


def test_tree_covers_and_bounds():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(size=(3000, 8)) * 200 * rng.random((3000, 1))).astype(np.int64)
    tree = H.CoverTree(vectors, rng.integers(0, 5, 3000), leaf=16)
    q = rng.normal(size=8) * 100
    got = tree.vectors @ q
    low, high = tree.bounds(q, 0, len(tree.rows))
    for n, (s, e) in enumerate(tree.rows):
        assert (got[s:e] >= low[n]).all() and (got[s:e] <= high[n]).all()
        first, last = tree.child[n]
        if last > first:
            assert tree.center[first] == tree.center[n]  # a center is its own first child
            assert tree.rows[first][0] == s and tree.rows[last - 1][1] == e
    assert sorted(tree.order.tolist()) == list(range(3000))
    # far fewer rows are scored than there are, where vectors stand in clusters
    apart = np.concatenate([np.floor(rng.normal(size=(100, 8)) * 3 + c).astype(np.int64) for c in rng.normal(size=(30, 8)) * 300])
    tree, seen = H.CoverTree(apart, np.arange(3000) % 5), []
    real = H.scores
    H.scores = lambda rows, one, exact: seen.append(len(rows)) or real(rows, one, exact)
    try:
        best = tree.descend(apart[7].astype(np.int64), 2, True, [(-(2**63), 2**63 - 1)], 5, np.arange(3000)[tree.order], 7)[0]
    finally:
        H.scores = real
    exact = apart @ apart[7]
    want = sorted((-exact[i], i) for i in range(3000) if i % 5 == 2 and i != 7)[:5]
    assert list(zip((-best[0]).tolist(), best[1].tolist(), strict=True)) == want and sum(seen) < 1500


@pytest.mark.parametrize(("scale", "exact"), [(1, True), (2**20, False)])
def test_many_anchors_descend_together(monkeypatch, scale, exact):
    """One walk over each tree serves all anchors, what one tree gave bounds the next, and each window gets its exact best."""
    rng = np.random.default_rng(8)
    loose, close = rng.normal(size=(900, 8)) * 200, rng.normal(size=(300, 8)) * 3 + np.repeat(rng.normal(size=(10, 8)) * 300, 30, 0)
    rows = np.concatenate([np.floor(loose), np.floor(close), np.tile(np.floor(loose[:1]), (200, 1))]).astype(np.int64) * scale
    labels, ids = rng.integers(0, 70, len(rows)), np.arange(len(rows)) // 2 * 2  # two rows share an id
    asking, k = rng.choice(len(rows), 150, replace=False), 4
    product = [[clip(sum(int(x) * int(y) for x, y in zip(rows[a], r, strict=True))) for r in rows] for a in asking]
    lows, highs = (np.array([[clip(int(f * s)) for f in fs] for s in map(max, product)], np.int64) for fs in ((0.1, -0.9, 1), (0.5, 0.9, 0)))  # the last one holds nothing
    for same in (True, False):
        calls, real = [], H.scores
        monkeypatch.setattr(H, "scores", lambda *x: calls.append(len(x[0])) or real(*x))  # noqa: B023
        best = H.Best(rows[asking], labels[asking], ids[asking], lows, highs, k, exact)
        for part in (slice(0, 700), slice(700, None)):
            tree = H.CoverTree(rows[part], labels[part])
            tree.search(best, same, ids[part][tree.order])
        monkeypatch.setattr(H, "scores", real)
        got, want = [x.tolist() for x in best.found()], []
        for q, a in enumerate(asking):
            for w in range(3):
                fit = [(-s, i) for s, i, other in zip(product[q], ids.tolist(), labels, strict=True) if i != ids[a] and (other == labels[a]) == same and lows[q, w] <= s <= highs[q, w]]
                want += [(q, w, -s, i) for s, i in sorted(fit)[:k]]
        assert list(zip(*got, strict=True)) == want and len(want) > 150
        assert len(calls) < 10 * len(asking)  # not one for each anchor and leaf


def test_neighbouring_blocks_share_a_task(spark, monkeypatch):
    """A task hands on the best of all its trees, not of each; blocks of more numbers than a task holds stay alone."""
    rng = np.random.default_rng(2)
    frame = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate((rng.normal(size=(400, 5))).tolist())], "vec_id long, label int, embedding array<double>")
    prepared, sizes, got = H.prepared(frame), [], []
    for components in (H.COMPONENTS, 1):
        monkeypatch.setattr(H, "COMPONENTS", components)
        cells = H.Cells(prepared, 4, 400, 40)
        sizes.append((cells.together, int(cells.blocks.sum())))
        monkeypatch.setattr(H.Cells.__init__, "__defaults__", (4, 400, 40))
        got.append(sorted(map(tuple, H.mine(prepared, every=10).collect())))
    assert sizes[0][0] > sizes[0][1] > 8 and sizes[1] == (1, sizes[0][1])
    assert got[0] == got[1] and len(got[0]) > 500


def test_label_of_the_query_is_moved(spark):
    from hushline.llm.queries import op12_hard_negatives

    assert op12_hard_negatives(spark, "/root/testdata/sf0.001").select(F.max("rank")).first()[0] == 10
