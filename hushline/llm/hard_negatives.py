"""Hard negatives by maximum inner product, searched in cover trees over norm-augmented vectors.

Every vector gets one more coordinate that brings all vectors of a tree to the same norm ``M``; an anchor gets a zero there,
so that inner products stay what they are and nearness on the sphere is a large inner product.  A cover tree is built from
the top: a node picks centers by farthest-first traversal until all its rows lie within half its radius of one (or ``FAN``
centers are found), so that the centers of a level are at least as far apart as its radius, its own center is its first
child, and each child keeps the radius that covers its rows.  A center's inner product and its radius bound the inner
products of all rows below it.

An anchor asks for the best rows of a window of scores.  Many anchors descend together: each goes to its most promising leaf
first, then to all other nodes, those of the greatest bounds first, that its bounds allow; left out are nodes whose bounds lie
outside all of its windows or cannot better what it found.  The rows of a leaf are scored exactly, for all anchors that reach
it at once; so are those of a small node whose leaves most of its anchors would reach.  All windows of an anchor share one descent.

On Spark: ``PIVOTS`` centers, picked by farthest-first traversal from the ``SAMPLE`` rows of the lowest hashes, deal all rows
into cells, and large cells into blocks of about ``BLOCK`` rows.  The radius of a cell tells which anchors need it.  An anchor
meets every block that may answer it, in tasks of a few neighbouring blocks (``COMPONENTS`` numbers in all, one tree for each
block) and at most about ``ANCHORS`` anchors.  What an anchor found in one tree bounds its search of the next; the best of each
task are then merged by a window that keeps only as many rows for each map task.  Nothing is left out: an index only skips
what its bounds exclude.

Scores are exact: vectors are whole numbers, ``floor(scale * x)``.  Components and scores beyond 64 bits become the largest or
smallest number of 64 bits.

Edge cases: rows with a null id, label or vector, or with a null or not finite component, take no part; of equal rows (id,
label, vector) one counts; rows of one id that differ are rows of their own, and an anchor's others are the rows of other
ids; of vectors of different lengths the shorter is filled up with zeros; equal scores are ordered by id (rows
of one id and score look alike in the result); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from hushline.llm.common import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score in percent of the positive's.
LOW, HIGH = 30, 90
PIVOTS = 64
SAMPLE = 4_096
BLOCK = 4_096
ANCHORS = 2_048
#: Components of the vectors that a task holds, unless one block has more.
COMPONENTS = 2**21
FAN = 16
LEAF = 64
#: Rows that are scored at once, of a leaf or, where bounds leave out little, of a larger node.
STRIP = 512
_MIN, _MAX = -(2**63), 2**63 - 1


# --- exact scores ---

def matrix(vectors: list) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to the longest."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def scores(rows: np.ndarray, many: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products, one line for each of many vectors; ``exact`` tells that doubles hold them, and then they are doubles."""
    if exact:
        return many @ rows.T
    whole = many.astype(object) @ rows.astype(object).T if rows.shape[1] else np.zeros((len(many), len(rows)), object)
    return np.clip(whole, _MIN, _MAX).astype(np.int64)


def fitted(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows cut or filled up with zeros to a width; what is cut meets zeros alone."""
    return np.pad(rows[:, :width], ((0, 0), (0, max(0, width - rows.shape[1]))))


def largest_of(rows: np.ndarray) -> np.ndarray:
    """The greatest absolute component of each row."""
    return np.abs(rows.astype(np.float64)).max(1, initial=0)


def _fits(largest: float, other: np.ndarray, width: int) -> np.ndarray:
    return width * float(largest) * other < 2**53


# --- what was found ---

class Best:
    """Many anchors that search together: for each window of each the best ``k`` (score, id) so far.

    ``least`` and ``high`` have a line for each anchor: what a score must reach, and may reach, to count in a window.
    """

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, own: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int, exact: bool):
        kind = np.float64 if exact else np.int64
        self.whole, self.labels, self.own, self.k, self.exact = vectors, labels, own, k, exact
        self.plain = vectors.astype(np.float64)
        self.least, self.high = lows.astype(kind), highs.astype(kind)
        self.full = lows > highs  # windows that hold ``k``, or can hold none
        self.reach = np.sqrt((self.plain * self.plain).sum(1))
        self.bit = np.left_shift(np.uint64(1), (labels % 64).astype(np.uint64))
        self.pair, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)
        self.waiting, self.n_waiting = [], 0

    def alive(self, who: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which of the anchors ``who`` may still find something between two bounds each."""
        return ((high[:, None] >= self.least[who]) & (low[:, None] <= self.high[who])).any(1)

    def offer(self, who: np.ndarray, got: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some rows, a line for each of the anchors ``who``; ``fits`` tells which of them may count."""
        least, high = self.least[who], self.high[who]
        fits &= got >= least.min(1)[:, None]
        fits &= got <= high.max(1)[:, None]
        at = np.flatnonzero(fits)
        q, r = np.divmod(at, got.shape[1])
        score, named, windows = got.reshape(-1)[at], ids[r], least.shape[1]
        other = named != self.own[who[q]]
        for w in range(windows):
            take = np.flatnonzero((score >= least[q, w]) & (score <= high[q, w]) & other)
            if len(take):
                self.waiting.append((who[q[take]] * windows + w, score[take], named[take]))
                self.n_waiting += len(take)
        # sorting seldom is cheaper than the few more scores that wait for it
        if self.n_waiting > self.least.size * self.k // 2:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        pair, score, named = (np.concatenate(c) for c in zip((self.pair, self.score, self.id), *self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        turn = np.lexsort((named, -score if self.exact else ~score, pair))  # ~s falls as s grows, without overflow
        pair, score, named = pair[turn], score[turn], named[turn]
        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        rank = np.arange(len(pair)) - np.repeat(starts, np.diff(np.append(starts, len(pair))))
        last, kept = rank == self.k - 1, rank < self.k
        self.least.reshape(-1)[pair[last]] = score[last]
        self.full.reshape(-1)[pair[last]] = True
        self.pair, self.score, self.id = pair[kept], score[kept], named[kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, window, score, id) in order, the best of a window first."""
        self.settle()
        windows = max(1, self.least.shape[1])
        return self.pair // windows, self.pair % windows, self.score.astype(np.int64), self.id


# --- the tree ---

class CoverTree:
    """Nodes in the order of their making; the children of a node, and the rows of a leaf, follow each other."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, fan: int = FAN, leaf: int = LEAF):
        plain = vectors.astype(np.float64)
        norms = (plain * plain).sum(1)
        self.norm = float(np.sqrt(norms.max(initial=0))) or 1.0
        raised = np.concatenate([plain, np.sqrt(np.maximum(self.norm**2 - norms, 0))[:, None]], 1)
        order, center, rows, radius, child = np.arange(len(plain)), [0], [(0, len(plain))], [0.0], [(0, 0)]
        radius[0] = float(np.sqrt(((raised - raised[0]) ** 2).sum(1).max(initial=0)))
        node = 0
        while node < len(rows):
            start, end = rows[node]
            if end - start > leaf and radius[node] > 1e-6 * self.norm:
                points = raised[order[start:end]]
                away = np.sqrt(((points - raised[center[node]]) ** 2).sum(1))
                near, picked = np.zeros(end - start, np.int64), [center[node]]
                while len(picked) < fan and away.max() > radius[node] / 2:
                    far = int(away.argmax())
                    new = np.sqrt(((points - points[far]) ** 2).sum(1))
                    closer = new < away
                    near[closer], away[closer] = len(picked), new[closer]
                    picked.append(order[start + far])
                if len(picked) > 1:
                    turn = np.argsort(near, kind="stable")
                    order[start:end], away = order[start:end][turn], away[turn]
                    at, child[node] = start, (len(rows), len(rows) + len(picked))
                    for c, n in zip(picked, np.bincount(near, minlength=len(picked)), strict=True):
                        center.append(c)
                        rows.append((at, at + n))
                        radius.append(float(away[at - start:at - start + n].max(initial=0)))
                        child.append((0, 0))
                        at += n
            node += 1
        self.order, self.rows, self.child, self.radius = order, rows, child, np.array(radius)
        self.center = center
        self.vectors, self.labels = plain[order], labels[order]
        self.whole = vectors[order]
        self.largest = int(np.abs(plain).max(initial=0))
        self.centers = plain[center] if len(plain) else np.zeros((1, plain.shape[1]))
        angle = 2 * np.arcsin(np.minimum(self.radius / (2 * self.norm), 1)) + 1e-7
        self.cos, self.sin = np.cos(np.minimum(angle, np.pi)), np.sin(np.minimum(angle, np.pi))
        bits = np.left_shift(np.uint64(1), (self.labels % 64).astype(np.uint64))
        self.mask = np.array([np.bitwise_or.reduce(bits[s:e], initial=np.uint64(0)) for s, e in rows], np.uint64)
        # the label of a node's rows, where all have the same
        self.alone = np.array([e > s and bool((self.labels[s:e] == self.labels[s]).all()) for s, e in rows], bool)
        self.only = np.array([self.labels[s] if e > s else 0 for s, e in rows], np.int64)

    def bounds(self, many: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of the rows below some nodes with a vector, or with each of many (a line each)."""
        reach = self.norm * np.sqrt((many * many).sum(-1, keepdims=True))
        s, cos, sin = many @ self.centers[first:last].T, self.cos[first:last], self.sin[first:last]
        side, slack = np.sqrt(np.maximum(reach**2 - s * s, 0)) * sin, 1e-7 * reach + 1e-6
        high = np.where(s >= reach * cos, reach, s * cos + side) + slack
        low = np.where(s <= -reach * cos, -reach, s * cos - side) - slack
        return low, high

    def _may_fit(self, best: Best, who: np.ndarray, same: bool, first: int, last: int) -> np.ndarray:
        """Whether some nodes hold rows of an anchor's label, or of others."""
        if same:
            return (best.bit[who, None] & self.mask[None, first:last]) != 0
        return ~(self.alone[first:last] & (self.only[first:last] == best.labels[who, None]))

    def _score(self, best: Best, who: np.ndarray, same: bool, node: int, ids: np.ndarray, seen: np.ndarray | None = None) -> None:
        """Offer all rows below a node; ``seen`` names the leaf that each anchor has looked at before."""
        start, end = self.rows[node]
        rows, many = (self.vectors, best.plain) if best.exact else (self.whole, best.whole)
        many, labels = (many, best.labels) if len(who) == len(many) else (many[who], best.labels[who])
        for s in range(start, end, STRIP):
            e = min(end, s + STRIP)
            fits = (self.labels[None, s:e] == labels[:, None]) == same
            if seen is not None:
                for leaf in np.unique(seen[who]).tolist():
                    a, b = self.rows[leaf] if leaf >= 0 else (0, 0)
                    if a < e and b > s:
                        fits[seen[who] == leaf, max(a, s) - s:min(b, e) - s] = False
            best.offer(who, scores(rows[s:e], many, best.exact), fits, ids[s:e])

    def _promising(self, best: Best, who: np.ndarray, same: bool) -> np.ndarray:
        """For each anchor the leaf at the end of the greatest bounds, cut to its windows; -1 for none and for those not in ``who``."""
        top, out = best.high.max(1), np.full(len(best.plain), -1)
        todo = [(0, who[self._may_fit(best, who, same, 0, 1)[:, 0]])]
        while todo:
            node, who = todo.pop()
            first, last = self.child[node]
            if last == first:
                out[who] = node
                continue
            low, high = self.bounds(best.plain[who], first, last)
            able = self._may_fit(best, who, same, first, last) & (low <= top[who, None])
            high = np.where(able, np.minimum(high, top[who, None]), -np.inf)
            to, some = high.argmax(1), able.any(1)
            todo += [(first + c, who[some & (to == c)]) for c in np.unique(to[some]).tolist()]
        return out

    def search(self, best: Best, same: bool, ids: np.ndarray, who: np.ndarray | None = None) -> None:
        """Look among rows of the anchors' labels, or of others, for what betters their best; ``who`` names those that ask."""
        who = np.arange(len(best.plain)) if who is None else who
        if not len(self.vectors) or not len(who) or not best.least.shape[1]:
            return
        # an anchor that has found enough is bounded by that already
        seen = self._promising(best, who[~best.full[who].all(1)], same)
        for leaf in np.unique(seen[seen >= 0]).tolist():
            self._score(best, np.flatnonzero(seen == leaf), same, leaf, ids)
        best.settle()
        todo = [(0, who, np.full(len(who), -np.inf), np.full(len(who), np.inf))]
        while todo:
            node, who, low, high = todo.pop()
            who = who[best.alive(who, low, high)]  # more was found since the node was put down
            if not len(who):
                continue
            first, last = self.child[node]
            if last == first:
                who = who[seen[who] != node]
                if len(who):
                    self._score(best, who, same, node, ids)
                continue
            lows, highs = self.bounds(best.plain[who], first, last)
            able = self._may_fit(best, who, same, first, last)
            sizes = np.array([e - s for s, e in self.rows[first:last]])
            if sizes.sum() <= STRIP:
                for c in range(last - first):
                    able[:, c] &= best.alive(who, lows[:, c], highs[:, c])
                # where bounds leave out little, one product of all rows is cheaper than many of few
                if 2 * (able @ sizes).sum() > len(who) * sizes.sum():
                    self._score(best, who, same, node, ids, seen)
                    continue
            for c in np.argsort(np.minimum(highs, best.high[who].max(1)[:, None]).mean(0), kind="stable").tolist():
                if able[:, c].any():
                    todo.append((first + c, who[able[:, c]], lows[able[:, c], c], highs[able[:, c], c]))

    def descend(self, one: np.ndarray, label: int, same: bool, windows: list[tuple[int, int]], k: int, ids: np.ndarray, own: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores the best ``k`` (scores, ids) among rows of the same label, or of others; ``own`` is left out."""
        lows, highs = ([np.array([[w[side] for w in windows]], np.int64).reshape(1, -1) for side in (0, 1)])
        vector = fitted(one[None, :], self.vectors.shape[1])
        exact = bool(_fits(self.largest, largest_of(vector), self.vectors.shape[1])[0])
        best = Best(vector, np.array([label]), np.array([own]), lows, highs, k, exact)
        self.search(best, same, ids)
        _, window, score, named = best.found()
        return [(score[window == w], named[window == w]) for w in range(len(windows))]


# --- tables ---

def prepared(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = SCALE) -> DataFrame:
    """Stored (id, label, v): the rows that take part, their vectors as whole numbers."""
    x = F.transform(rows[vector], lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    named = label if isinstance(label, Column) else rows[label]
    out = rows.where(rows[id].isNotNull() & rows[vector].isNotNull() & finite).select(
        rows[id].cast("bigint").alias("id"), named.cast("bigint").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    return stored(out.where("label is not null"), "vectors")


class Cells:
    """All rows, dealt by nearest pivot; one entry per cell on the driver, ``PIVOTS`` at most."""

    def __init__(self, rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK):
        some = matrix([r.v for r in rows.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample).select("v").collect()]).astype(float)
        picked, away = [], np.full(len(some), np.inf)
        while len(some) and len(picked) < pivots and away.max() > 0:
            picked.append(int(away.argmax()))
            away = np.minimum(away, np.sqrt(((some - some[picked[-1]]) ** 2).sum(1)))
        self.pivots = some[picked]
        centers = self.pivots

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                m = matrix(b["v"].tolist()).astype(float)
                width = max(m.shape[1], centers.shape[1])
                m, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (m, centers))
                near = ((c * c).sum(1) - 2 * m @ c.T).argmin(1) if len(c) else np.zeros(len(m), np.int64)
                yield b.assign(cell=near, away=np.sqrt(((m - c[near]) ** 2).sum(1)))

        self.rows = stored(rows.mapInPandas(nearest, "id bigint, label bigint, v array<bigint>, cell int, away double"), "cells")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("label", F.lit(64)).cast("int"))
        sizes = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away"), F.bit_or(bit).alias("mask"), F.max(F.size("v")).alias("width")).collect()
        self.radius, self.blocks, self.mask = np.zeros(len(picked)), np.zeros(len(picked), np.int64), [0] * len(picked)
        for r in sizes:
            self.radius[r.cell], self.blocks[r.cell], self.mask[r.cell] = r.away, -(-r.n // block), r.mask & (2**64 - 1)
        self.first = np.cumsum(self.blocks) - self.blocks
        #: blocks that go to one task
        self.together = max(1, COMPONENTS // (block * max((r.width for r in sizes), default=1) or 1))

    def dealt(self) -> DataFrame:
        """(block, id, label, v): large cells are cut by a hash of the id, which keeps equal rows together."""
        if not len(self.blocks):
            return self.rows.select(F.lit(0).cast("bigint").alias("block"), "id", "label", "v")
        of = lambda numbers: F.element_at(F.array(*[F.lit(int(x)) for x in numbers]), F.col("cell") + 1).cast("bigint")
        return self.rows.select((of(self.first) + F.pmod(F.xxhash64("id"), F.greatest(of(self.blocks), F.lit(1)))).alias("block"), "id", "label", "v")


_ASKED = "anchor bigint, id bigint, label bigint, v array<bigint>, ids array<bigint>, lows array<bigint>, highs array<bigint>"


def _padded(lists: list, value: int) -> np.ndarray:
    out = np.full((len(lists), max((len(x) for x in lists), default=0)), value, np.int64)
    for k, x in enumerate(lists):
        out[k, :len(x)] = x
    return out


def search(cells: Cells, asked: DataFrame, same: bool, k: int, anchors: int = ANCHORS) -> DataFrame:
    """(anchor, id, window, found, score, rank): for each window of each anchor its best ``k`` rows, ``rank`` from 1.

    ``asked`` is stored and has one row per anchor: its number, id, label and vector, and the windows' ids, least and greatest scores.
    """
    pivots, radius, first, blocks, masks, together = cells.pivots, cells.radius, cells.first, cells.blocks, cells.mask, cells.together

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell_of = np.repeat(np.arange(len(blocks)), blocks)
        for b in batches:
            m = matrix(b["v"].tolist()).astype(float)
            width = max(m.shape[1], pivots.shape[1])
            m, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (m, pivots))
            mid, reach = m @ c.T, np.sqrt((m * m).sum(1))[:, None] * radius[None, :] * (1 + 1e-9) + 1e-6
            lows, highs = _padded(b["lows"].tolist(), _MAX), _padded(b["highs"].tolist(), _MIN)
            able = np.zeros(mid.shape, bool)
            for w in range(lows.shape[1]):
                able |= (mid - reach <= highs[:, w, None]) & (mid + reach >= lows[:, w, None]) & (lows[:, w, None] <= highs[:, w, None])
            if same:
                bits = np.left_shift(np.uint64(1), (b["label"].to_numpy(np.int64) % 64).astype(np.uint64))
                able &= (bits[:, None] & np.array(masks, np.uint64)[None, :]) != 0
            wanted = able[:, cell_of]
            for task in range(-(-len(cell_of) // together)):
                mine = wanted[:, task * together:(task + 1) * together]
                some = np.flatnonzero(mine.any(1))
                if len(some):
                    yield b.iloc[some].assign(task=task, wanted=[(np.flatnonzero(row) + task * together).tolist() for row in mine[some]])

    tasks = max(1, -(-asked.count() // anchors))
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(tasks)).cast("int")
    sent = asked.mapInPandas(route, f"{_ASKED}, task bigint, wanted array<bigint>").withColumn("share", share("anchor"))
    held = cells.dealt().withColumn("task", F.floor(F.col("block") / together)).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def answer(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            vectors, block, label, id = matrix(rows["v"].tolist()), rows["block"].to_numpy(), rows["label"].to_numpy(np.int64), rows["id"].to_numpy(np.int64)
            key = pd.DataFrame({"id": id, "label": label, "v": [v.tobytes() for v in vectors]})
            once = ~key.duplicated().to_numpy()
            vectors, block, label, id = vectors[once], block[once], label[once], id[once]
            asking = fitted(matrix(queries["v"].tolist()), vectors.shape[1])
            fits = _fits(largest_of(vectors).max(initial=0), largest_of(asking), vectors.shape[1])
            anchor, own, of = (queries[c].to_numpy(np.int64) for c in ("anchor", "id", "label"))
            names, lows, highs = _padded(queries["ids"].tolist(), 0), _padded(queries["lows"].tolist(), _MAX), _padded(queries["highs"].tolist(), _MIN)
            needs = {}
            for q, wanted in enumerate(queries["wanted"]):
                for n in wanted:
                    needs.setdefault(int(n), []).append(q)
            parts = [(p, Best(asking[p], of[p], own[p], lows[p], highs[p], k, exact)) for exact in (True, False) if len(p := np.flatnonzero(fits == exact))]
            for n in np.unique(block).tolist():
                if n not in needs:
                    continue
                tree, ids = CoverTree(vectors[block == n], label[block == n]), id[block == n]
                for part, best in parts:
                    tree.search(best, same, ids[tree.order], np.flatnonzero(np.isin(part, needs[n])))
            for part, best in parts:
                q, w, score, named = best.found()
                q = part[q]
                out.append(pd.DataFrame({"anchor": anchor[q], "id": own[q], "window": names[q, w], "found": named, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor", "id", "window", "found", "score")})

    # few large groups: left to sizes in bytes, many of them would share a partition
    groups = max(1, -(-int(blocks.sum()) // together) * tasks)
    held, sent = (side.repartition(groups, "task", "share") for side in (held, sent))
    best = held.groupBy("task", "share").cogroup(sent.groupBy("task", "share")).applyInPandas(answer, "anchor bigint, id bigint, window bigint, found bigint, score bigint")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "found")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for prepared rows.

    Anchors are the rows whose id is divisible by ``every``.  A positive is one of the anchor's best rows of its label; its
    negatives are the best rows of other labels that score from ``low`` to ``high`` percent of it.
    """
    cells = Cells(rows)
    anchors = stored(rows.where(F.col("id") % every == 0).dropDuplicates(["id", "label", "v"]).select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "v"), "anchors")
    whole = anchors.select("anchor", "id", "label", "v", F.array(F.lit(0).cast("bigint")).alias("ids"), F.array(F.lit(_MIN)).alias("lows"), F.array(F.lit(_MAX)).alias("highs"))
    good = search(cells, stored(whole, "asked"), True, positives).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "found", "score"))).alias("best"))
    exact = lambda s, percent: s.cast("decimal(38,0)") * percent
    # a score below zero has no window
    windows = F.transform(F.filter("best", lambda p: p["score"] >= 0), lambda p: F.struct(
        p["found"].alias("found"), p["score"].alias("score"), F.ceil(exact(p["score"], low) / 100).cast("bigint").alias("low"),
        F.floor(exact(p["score"], high) / 100).cast("bigint").alias("high"), p["rank"].cast("bigint").alias("rank")))
    asked = stored(anchors.join(good, "anchor").withColumn("w", windows).where(F.size("w") > 0), "windows")
    bad = search(cells, asked.select("anchor", "id", "label", "v", F.col("w.rank").alias("ids"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs")), False, negatives)
    named = asked.select("anchor", F.explode("w").alias("w")).select("anchor", F.col("w.rank").alias("window"), F.col("w.found").alias("positive_id"), F.col("w.score").alias("positive_score"))
    return bad.join(named, ["anchor", "window"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
