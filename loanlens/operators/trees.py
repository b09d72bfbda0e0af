"""Batched histogram training of trees, forests and boosting (TUN1-TUN3, MOD1-MOD6).

All models of a search (folds x grid points x trees) are grown together, level by level.
Features are cut into at most ``BINS`` bins, once; a row is then one byte per feature, its
target, its fold and a hash of its key. A level needs, for every open node, the number of
rows and the sum of targets per (feature, bin): the best split (largest variance gain, the
first feature and lowest cut on ties) follows from these histograms alone. Their size depends on
models, nodes and bins, never on rows.

What is shared between grid points is grown once: a tree of depth 3 is the top of the tree of
depth 5, 100 trees are the first 100 of 200, 100 boosting stages the first 100 of 200, and trees
that see equal rows and all features (no bootstrap) are one tree. A further "fold" that leaves
no row out gives the model refitted with the best parameters.

Two ways to the same models:

* ``rows``: the binned rows stay where they are, as blocks of arrays. One job per level sums the histograms of all
  models of the level (partial sums per task, added up per model); the splits follow from the sums. Only the smaller
  child of a split node is counted, its sibling is the parent's histogram less the child's.
  Boosting keeps every row's sums of all chains, renewed every ``KEEP`` stages.
* ``models``: binned rows of at most ``REPLICATE`` bytes go to every executor (a broadcast of
  checked size) and the models are dealt over the tasks, so that a boosting chain costs no
  job per level.

Bootstrap weights (Poisson with mean 1) are functions of the row's key hash and the tree,
random feature subsets of tree and node: neither depends on partitioning.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import compiled as X

#: Bins of a feature, rows whose values place the cuts (all rows, or those with the smallest key hashes).
BINS, CUT_ROWS = 256, 65_536
#: Rows of a stored block.
BLOCK = 8192
#: Bytes of binned rows that may go to every executor.
REPLICATE = 16 << 20
#: Histogram numbers of a pass over the rows; stages after which the rows' sums are renewed.
CELLS, KEEP = 8_000_000, 3
#: Bytes of a kept partition of blocks; bytes of the tasks' sums up to which the driver adds them up itself.
PART, FEW = 256 << 20, 16 << 20
MEAN, LOGISTIC, SQUARED = "mean", "logistic", "squared"


# ------------------------------------------------------------------ bins

def cut_points(rows: DataFrame, features: list[str], key: str, bins: int = BINS, limit: int = CUT_ROWS) -> list[np.ndarray]:
    """Ascending cuts of every feature: a value belongs to the first cut that is not smaller. All distinct values
    but the largest where they are at most ``bins``; the values at ranks ceil(i n / bins) otherwise."""
    n = rows.count()
    at = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 20))
    some = rows.where(at < math.ceil(min(1.0, 2.0 * limit / max(n, 1)) * (1 << 20))) if n > limit else rows
    taken = (some.orderBy(F.xxhash64(F.col(key), F.lit(7)), key).limit(limit) if n > limit else some).select(*features).toArrow()
    cuts = []
    for f in features:
        x = np.sort(taken.column(f).to_numpy().astype(float))
        values = np.unique(x)
        if len(values) > bins:
            values = np.unique(x[np.ceil(np.arange(1, bins + 1) * len(x) / bins).astype(int) - 1])
        cuts.append(values[:-1])
    return cuts


def to_bins(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, x, side="left") for x, c in zip(columns, cuts)]).astype(np.uint8)


def binned_blocks(rows: DataFrame, features: list[str], label: str, fold: str, key: str, cuts: list[np.ndarray]) -> DataFrame:
    """Blocks of at most BLOCK rows: n, bins, y, fold, hash (raw bytes), written once."""
    k = len(features)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                x = to_bins([part.column(i).to_numpy().astype(float) for i in range(k)], cuts)
                y = part.column(k).to_numpy().astype(float)
                f = part.column(k + 1).fill_null(-2).to_numpy(zero_copy_only=False).astype(np.int8)
                h = part.column(k + 2).to_numpy().astype(np.int64)
                # a feature's bins side by side, as trees read them
                yield pa.record_batch([pa.array([len(y)], pa.int32()), *[pa.array([v.tobytes()]) for v in (x.T, y, f, h)]],
                                      ["n", "bins", "y", "fold", "hash"])

    chosen = rows.select(*features, F.col(label).cast("double").alias("y_"), F.col(fold).cast("int").alias("f_"),
                         F.xxhash64(F.col(key)).alias("h_"))
    return stored(chosen.mapInArrow(run, "n int, bins binary, y binary, fold binary, hash binary"), "bins")


def _block(width: int, n: int, x: bytes, y: bytes, f: bytes, h: bytes):
    """(bins, y, fold, hash) of a stored block."""
    return np.frombuffer(x, np.uint8).reshape(width, n).T, np.frombuffer(y), np.frombuffer(f, np.int8), np.frombuffer(h, np.int64)


def _blocks(batches, width: int):
    """(bins, y, fold, hash) of each block of Arrow batches."""
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5))):
            yield _block(width, *row)


# ------------------------------------------------------------------ models

@dataclass(frozen=True)
class Chain:
    """``stages`` trees grown one after the other on what is left of the target (one stage: a plain tree)."""

    fold: int = -1              # rows of this fold are left out; -1: none
    depth: int = 5
    least: int = 1              # rows of a leaf
    bag: int | None = None      # bootstrap of this number; None: all rows once
    subset: int = 0             # features tried at a node; 0: all
    loss: str = MEAN
    step: float = 1.0
    stages: int = 1
    seed: int = 1


class Trees:
    """Trees of one chain as heaps: feature (-1: leaf), cut (bins up to it go left), value, gain, rows."""

    def __init__(self, stages: int, depth: int):
        size = (2 << depth) - 1
        self.feature = np.full((stages, size), -1, np.int16)
        self.cut = np.zeros((stages, size), np.int16)
        self.value, self.gain, self.rows = (np.zeros((stages, size)) for _ in range(3))

    def descend(self, x: np.ndarray, stage: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """Path of each row from the root (a bit a level, at most 8; it goes on to the left below a leaf) and the node
        that ends each path. All nodes of a level are compared with all rows, a byte each: no look-up per row."""
        feature, cut = self.feature[stage], self.cut[stage]
        path, ends = np.zeros(len(x), np.uint8), [0]
        for level in range(levels):
            right = np.zeros(len(x), bool)
            below = []
            for j, node in enumerate(ends):
                inner = feature[node] >= 0
                below += [2 * node + 1, 2 * node + 2] if inner else [node, node]
                if inner:
                    more = x[:, feature[node]] > int(cut[node])
                    if level:
                        more &= path == j
                    right |= more
            path, ends = path * np.uint8(2) + right, below
        return path, np.array(ends)

    def values(self, x: np.ndarray, stage: int, levels: int) -> np.ndarray:
        """The value of each row's leaf."""
        if levels > 8:
            return self.value[stage][self.leaf(x, stage, levels)]
        path, ends = self.descend(x, stage, levels)
        return self.value[stage][ends][path]

    def leaf(self, x: np.ndarray, stage: int, levels: int, node: np.ndarray | None = None) -> np.ndarray:
        if node is None and levels <= 8:
            path, ends = self.descend(x, stage, levels)
            return ends[path]
        feature, cut = self.feature[stage], self.cut[stage]
        node = np.zeros(len(x), np.int64) if node is None else node
        at = np.arange(len(x))
        for _ in range(levels):
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = x[at, np.maximum(f, 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node

    def part(self, first: int, last: int) -> Trees:
        """The stages ``first`` to ``last``."""
        out = Trees.__new__(Trees)
        for k, v in self.pack().items():
            setattr(out, k, v[first:last + 1])
        return out

    def smaller(self, stage: int, level: int):
        """Of the split nodes above ``level``: places of the child with fewer rows, of its sibling and of the node, each in its level."""
        low = (1 << level - 1) - 1
        node = np.flatnonzero(self.feature[stage, low:2 * low + 1] >= 0)
        rows = self.rows[stage, 2 * low + 1:]
        small = 2 * node + (rows[2 * node + 1] < rows[2 * node])
        return small, small ^ 1, node

    def pack(self) -> dict:
        return {k: getattr(self, k) for k in ("feature", "cut", "value", "gain", "rows")}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Cumulative probabilities of the Poisson distribution with mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def bag_weights(hashes: np.ndarray, bag: int, seed: int) -> np.ndarray:
    """Poisson weights of a bootstrap, from the rows' key hashes."""
    salt = _mix(np.array([seed * 1_000_003 + bag + 1], np.uint64))
    u = (_mix(hashes.view(np.uint64) ^ salt) >> np.uint64(11)).astype(float) / float(1 << 53)
    w = np.zeros(len(u), np.uint8)
    for p in _POISSON:          # few rows pass the fifth: cheaper than a search per row
        more = u >= p
        if not more.any():
            break
        w += more
    return w.astype(float)


def _target(loss: str, y: np.ndarray, total: np.ndarray | None) -> np.ndarray:
    """What the next tree is grown on, given the sum of the trees before it (None: the first)."""
    if loss == LOGISTIC:
        s = 2.0 * y - 1.0
        return s if total is None else 4.0 * s / (1.0 + np.exp(2.0 * s * total))
    if loss == SQUARED and total is not None:
        return 2.0 * (y - total)
    return y


def _weights(c: Chain, fold: np.ndarray, hashes: np.ndarray, bags: dict | None = None) -> np.ndarray | None:
    """Row weights of a chain; None: every row once. ``bags``: bootstraps of these rows drawn so far (folds share them)."""
    w, at = None, (c.bag, c.seed)
    if c.bag is not None:
        w = bag_weights(hashes, *at) if bags is None or at not in bags else bags[at]
        if bags is not None:
            bags[at] = w
    if c.fold >= 0:
        keep = (fold != c.fold).astype(float)
        w = keep if w is None else w * keep
    return w


class _Layout:
    """Cells of the histograms: the bins of all features one behind the other.

    Features of few bins are counted together: a group of them is one code of at most JOINT values, whose
    histogram gives each feature's by sums over the others."""

    JOINT = 512

    def __init__(self, widths: list[int]):
        self.widths = np.array(widths)
        self.first = np.concatenate([[0], np.cumsum(self.widths)[:-1]])
        self.cells = int(self.widths.sum())
        self.feature = np.repeat(np.arange(len(widths)), self.widths)
        self.bin = np.arange(self.cells) - self.first[self.feature]
        self.inner = self.bin < self.widths[self.feature] - 1       # a cut behind the last bin parts nothing

        self.groups: list[list[int]] = []
        size = self.JOINT + 1
        for f in np.argsort(self.widths, kind="stable"):
            if size * self.widths[f] > self.JOINT:
                self.groups.append([])
                size = 1
            self.groups[-1].append(int(f))
            size *= self.widths[f]
        #: codes of each group, of all
        self.sizes = [math.prod(int(self.widths[f]) for f in members) for members in self.groups]
        self.joint_cells = sum(self.sizes)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One code per group and row."""
        out = np.zeros((len(self.groups), len(x)), np.uint16)       # at most JOINT values
        for g, members in enumerate(self.groups):
            for f in members:
                out[g] *= np.uint16(self.widths[f])
                out[g] += x[:, f]
        return out

    def joint(self, codes: np.ndarray, node: np.ndarray, nodes: int, w: np.ndarray | None, t: np.ndarray) -> np.ndarray:
        """[rows, target sums] x nodes and codes of all groups, of rows with ``node`` below ``nodes``. Sums of
        several blocks add up."""
        out = np.empty((2, nodes * self.joint_cells))
        t, at = t if w is None else t * w, 0
        for size, code in zip(self.sizes, codes):
            cell = code.astype(np.int64) if nodes == 1 else node * size + code
            for k, weight in enumerate((w, t)):
                out[k, at:at + nodes * size] = np.bincount(cell, weight, nodes * size)
            at += nodes * size
        return out

    def spread(self, joint: np.ndarray, nodes: int) -> np.ndarray:
        """[rows, target sums] x nodes x cells from the groups' sums."""
        out, at = np.zeros((2, nodes, self.cells)), 0
        for size, members in zip(self.sizes, self.groups):
            part = joint[:, at:at + nodes * size].reshape(2, nodes, *(int(self.widths[f]) for f in members))
            for axis, f in enumerate(members, 2):
                others = tuple(i for i in range(2, len(members) + 2) if i != axis)
                out[:, :, self.first[f]:self.first[f] + self.widths[f]] = part.sum(axis=others) if others else part
            at += nodes * size
        return out

    def histogram(self, codes: np.ndarray, node: np.ndarray, nodes: int, w: np.ndarray | None, t: np.ndarray) -> np.ndarray:
        """[rows, target sums] x nodes x cells of rows with ``node`` below ``nodes``."""
        return self.spread(self.joint(codes, node, nodes, w, t), nodes)

    @staticmethod
    def siblings(h: np.ndarray, above: np.ndarray, smaller, nodes: int) -> np.ndarray:
        """[rows, target sums] x nodes x cells of a level from its ``smaller`` children and the level above."""
        small, other, node = smaller
        out = np.zeros((2, nodes, h.shape[2]))
        out[:, small] = h
        out[:, other] = above[:, node] - h
        return out

    def best(self, h: np.ndarray, c: Chain, stage: int, heap: np.ndarray):
        """Of each node: feature (-1: none), cut, gain, rows and sum, rows and sum of the left part."""
        n, s = h[0], h[1]
        nt, st = n[:, :self.widths[0]].sum(1), s[:, :self.widths[0]].sum(1)
        low = np.zeros((2, len(n), 1))
        run = np.concatenate([low, np.cumsum(h, axis=2)], axis=2)
        left = run[:, :, 1:] - run[:, :, self.first[self.feature]]
        nl, sl = left
        nr, sr = nt[:, None] - nl, st[:, None] - sl
        ok = self.inner[None, :] & (nl >= max(c.least, 1)) & (nr >= max(c.least, 1))
        if c.subset and c.subset < len(self.widths):
            for i, at in enumerate(heap):
                rng = np.random.default_rng([c.seed, 0 if c.bag is None else c.bag + 1, stage, int(at)])
                ok[i] &= np.isin(self.feature, rng.choice(len(self.widths), c.subset, replace=False))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(nt > 0, st / nt, 0.0)
            # gain of the means' distance: no difference of large squares
            gain = np.where(ok, nl * nr / np.maximum(nt, 1)[:, None] * (sl / nl - sr / nr) ** 2, -1.0)
        gain = np.where(gain > 1e-12 * np.maximum(1.0, mean[:, None] ** 2) * np.maximum(nt, 1)[:, None], gain, -1.0)
        at = self._first_best(gain)
        rows = np.arange(len(n))
        g = gain[rows, at]
        return np.where(g > 0, self.feature[at], -1), self.bin[at], np.maximum(g, 0.0), nt, st, nl[rows, at], sl[rows, at]

    @staticmethod
    def _first_best(gain: np.ndarray) -> np.ndarray:
        """The first cell whose gain is the largest, up to rounding of the sums."""
        top = gain.max(axis=1)
        return (gain >= (top - np.abs(top) * 1e-10)[:, None]).argmax(axis=1)

    def apply(self, trees: Trees, stage: int, level: int, found):
        """Write the splits of a level and the values of its children."""
        heap = np.arange((1 << level) - 1, (2 << level) - 1)
        feature, cut, gain, rows, total, left, left_sum = found
        trees.rows[stage, heap] = np.where(rows > 0, rows, trees.rows[stage, heap])
        trees.value[stage, heap] = np.divide(total, rows, out=trees.value[stage, heap].copy(), where=rows > 0)
        open_ = (rows > 0) & (feature >= 0)
        at = heap[open_]
        trees.feature[stage, at], trees.cut[stage, at], trees.gain[stage, at] = feature[open_], cut[open_], gain[open_]
        n, s, ln, ls = rows[open_], total[open_], left[open_], left_sum[open_]
        # from sums: targets of 0 and 1 give exact means
        for child, count, part in ((2 * at + 1, ln, ls), (2 * at + 2, n - ln, s - ls)):
            trees.rows[stage, child], trees.value[stage, child] = count, part / count


def _grow_alone(x, y, fold, hashes, c: Chain, layout: _Layout) -> Trees:
    """All stages of one chain on rows held here."""
    trees, w = Trees(c.stages, c.depth), _weights(c, fold, hashes)
    if w is not None:                   # rows without weight add nothing
        keep = w > 0
        x, y, w = x[keep], y[keep], w[keep]
        if c.bag is None:
            w = None
    total, codes = None, layout.codes(x)
    for stage in range(c.stages):
        t, node = _target(c.loss, y, total), np.zeros(len(x), np.int64)
        for level in range(c.depth):
            nodes, low = 1 << level, (1 << level) - 1
            if not level:
                h = layout.histogram(codes, node, 1, w, t)
            else:
                smaller = trees.smaller(stage, level)
                if not len(smaller[0]):
                    break
                place = np.full(len(trees.feature[stage]), -1)
                place[low + smaller[0]] = np.arange(len(smaller[0]))
                at = place[node]
                some = np.flatnonzero(at >= 0)
                h = layout.siblings(layout.histogram(codes[:, some], at[some], len(smaller[0]), None if w is None else w[some], t[some]),
                                    h, smaller, nodes)
            layout.apply(trees, stage, level, layout.best(h, c, stage, np.arange(low, low + nodes)))
            node = trees.leaf(x, stage, level + 1)
        if c.stages > 1:
            got = trees.value[stage][node]
            total = got if total is None else total + c.step * got
    return trees


# ------------------------------------------------------------------ training

@dataclass
class Binned:
    """Binned rows of one task, written once for all models."""

    features: list[str]
    label: str
    cuts: list[np.ndarray]
    blocks: DataFrame


def bin_rows(rows: DataFrame, features: list[str], label: str, fold: str = "fold", key: str = "k", bins: int = BINS) -> Binned:
    cuts = cut_points(rows, features, key, bins)
    return Binned(list(features), label, cuts, binned_blocks(rows, features, label, fold, key, cuts))


@dataclass
class Forest:
    """Trained chains of one search, with the bins that their trees speak of."""

    rows: Binned
    chains: list[Chain]
    trees: list[Trees]


def grow(rows: Binned, chains: list[Chain], way: str | None = None) -> Forest:
    """Grow all chains. ``way``: "rows" or "models" (None: models where the binned rows hold at most REPLICATE bytes)."""
    layout = _Layout([len(c) + 1 for c in rows.cuts])
    if way is None:
        n = rows.blocks.agg(F.sum("n")).first()[0] or 0
        way = "models" if n * (len(rows.features) + 17) <= REPLICATE else "rows"
    return Forest(rows, chains, (_by_models if way == "models" else _by_rows)(rows.blocks, chains, layout))


def _by_models(blocks: DataFrame, chains: list[Chain], layout: _Layout) -> list[Trees]:
    spark, width = blocks.sparkSession, len(layout.widths)
    parts = list(_blocks(blocks.toArrow().combine_chunks().to_batches(), width))        # at most REPLICATE bytes
    parts = [np.concatenate(p) for p in zip(*parts)]
    held = spark.sparkContext.broadcast((parts, chains, layout))

    def run(batches):
        (x, y, fold, hashes), every, lay = held.value
        for b in batches:
            for i in b.column(0).to_pylist():
                t = _grow_alone(x, y, fold, hashes, every[i], lay).pack()
                yield pa.record_batch([pa.array([i], pa.int64()), *[pa.array([v.tobytes()]) for v in t.values()]],
                                      ["id", *t])

    # the longest chains first, dealt one by one
    cost = np.array([c.stages * (2 ** c.depth + 8) for c in chains])
    order = [(int(i),) for i in np.argsort(-cost, kind="stable")]
    tasks = min(len(chains), 4 * spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame([(i, n % tasks) for n, (i,) in enumerate(order)], "id long, task int")
    # repartitionByRange: exactly one task number a task
    got = (dealt.repartitionByRange(tasks, "task").select("id")
           .mapInArrow(run, "id long, feature binary, cut binary, value binary, gain binary, rows binary").toArrow().to_pylist())
    out: list[Trees] = [None] * len(chains)
    for r in got:
        c = chains[r["id"]]
        out[r["id"]] = t = Trees(c.stages, c.depth)
        for k, v in t.pack().items():
            setattr(t, k, np.frombuffer(r[k], v.dtype).reshape(v.shape).copy())
    held.unpersist()
    return out


def _by_rows(blocks: DataFrame, chains: list[Chain], layout: _Layout) -> list[Trees]:
    """One job per level (and group of chains whose histograms fit CELLS); chains of several stages keep sums per row."""
    trees = [Trees(c.stages, c.depth) for c in chains]
    long = [i for i, c in enumerate(chains) if c.stages > 1]
    at = {i: k for k, i in enumerate(long)}         # place of a chain among the rows' sums
    state, base, old = _kept(blocks, len(layout.widths), len(long), any(c.bag is not None for c in chains)), 0, None
    for stage in range(max((c.stages for c in chains), default=0)):
        if stage and stage - base >= KEEP:
            old, state = state, _add_up(state, chains, trees, long, base, stage)
            base = stage
        # chains of one bootstrap in one pass
        live = sorted((i for i, c in enumerate(chains) if stage < c.stages), key=lambda i: chains[i].bag or 0)
        depth = max(chains[i].depth for i in live)
        per = max(1, CELLS // (2 * (1 << max(depth - 2, 0)) * layout.joint_cells))
        for lo in range(0, len(live), per):
            above: dict[int, np.ndarray] = {}
            for level in range(depth):
                todo = [i for i in live[lo:lo + per] if level < chains[i].depth
                        and (not level or (trees[i].rows[stage][(1 << level) - 1:(2 << level) - 1] > 0).any())]
                if todo:
                    _pass(state, chains, trees, todo, at, base, stage, level, layout, above)
                if old is not None:             # the pass has kept the new sums
                    old.unpersist()
                    old = None
    state.unpersist()
    return trees


def _kept(blocks: DataFrame, width: int, chains: int, hashes: bool) -> RDD:
    """The blocks as arrays, kept: bins (a feature a row), y, fold, hash (None where no chain asks for it), sums (None)."""
    def arrays(r):
        x, y, f, h = _block(width, r[0], *(bytes(v) for v in r[1:]))
        return x.T, y, f, h if hashes else None, None

    rows = blocks.agg(F.sum("n")).first()[0] or 0
    parts = max(2 * blocks.sparkSession.sparkContext.defaultParallelism, -(-rows * (width + 17 + 8 * chains) // PART))
    return blocks.select("n", "bins", "y", "fold", "hash").rdd.map(arrays).coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)


def _sum_of(c: Chain, t: Trees, x: np.ndarray, before: np.ndarray | None, base: int, stage: int) -> np.ndarray | None:
    """Sum of a chain's trees up to ``stage``, given that up to ``base``; ``t`` holds the trees from ``base`` on."""
    total = before if base else None
    for s in range(stage - base):
        got = t.values(x, s, c.depth)
        total = got if total is None else total + c.step * got
    return total


def _add_up(state: RDD, chains, trees, long, base: int, stage: int) -> RDD:
    """The blocks with the sums of the trees up to ``stage``, kept as they are first read."""
    # not released: a lost block is made again from the blocks before it
    need = state.context.broadcast([(chains[i], trees[i].part(base, stage - 1), min(stage, chains[i].stages)) for i in long])

    def run(blocks):
        for x, y, f, h, s in blocks:
            yield x, y, f, h, np.stack([_sum_of(c, t, x.T, None if s is None else s[k], base, max(last, base))
                                        for k, (c, t, last) in enumerate(need.value)])

    return state.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)


def _pass(state: RDD, chains, trees, todo: list[int], at: dict, base: int, stage: int, level: int, layout: _Layout, above: dict):
    """Histograms of one level of the chains ``todo``, summed over all rows; their splits go into ``trees``. ``above``:
    the chains' histograms of the level above, then those of this one."""
    nodes, low = 1 << level, (1 << level) - 1
    # the trees since the rows' sums were renewed; earlier ones are in the sums
    halves = {i: trees[i].smaller(stage, level) if level else None for i in todo}
    counted = {i: len(halves[i][0]) if level else 1 for i in todo}
    models = []
    for i in todo:
        place = np.full(nodes + 1, -1)              # the last: rows that stopped above
        place[halves[i][0] if level else [0]] = np.arange(counted[i])
        models.append((i, chains[i], trees[i].part(base, stage) if chains[i].stages > 1 else trees[i], at.get(i), place, counted[i]))
    need = state.context.broadcast((layout, base, models))

    def histograms(blocks):
        lay, first, every = need.value
        sums = [np.zeros((2, n * lay.joint_cells)) for *_, n in every]
        for xt, y, fold, hashes, s in blocks:
            x, bags = xt.T, {}
            codes = lay.codes(x)
            for k, (_, c, t, kept, place, n) in enumerate(every):
                if (c.bag, c.seed) not in bags:
                    bags.clear()        # one bootstrap at a time
                w = _weights(replace(c, fold=-1), fold, hashes, bags)
                node, keep = np.zeros(len(y), np.int64), None
                if level:
                    node = _places(t, x, stage - first if c.stages > 1 else 0, level, place)
                    keep = node >= 0
                for more in ([fold != c.fold] if c.fold >= 0 else []) + ([w > 0] if w is not None else []):
                    keep = more if keep is None else keep & more
                some = slice(None) if keep is None else np.flatnonzero(keep)
                total = None
                if c.stages > 1:
                    total = _sum_of(c, t, x if keep is None else xt[:, some].T, None if s is None else s[kept][some], first, stage)
                sums[k] += lay.joint(codes[:, some], node[some], n, None if w is None else w[some], _target(c.loss, y[some], total))
        for (i, *_, n), h in zip(every, sums):
            yield i, lay.spread(h, n)

    found = state.mapPartitions(histograms)
    if state.getNumPartitions() * sum(counted.values()) * 16 * layout.cells > FEW:
        found = found.reduceByKey(operator.add, min(len(todo), state.context.defaultParallelism))
    got: dict[int, np.ndarray] = {}
    for i, h in found.collect():
        got[i] = got[i] + h if i in got else h
    for i, h in got.items():
        above[i] = layout.siblings(h, above[i], halves[i], nodes) if level else h
        layout.apply(trees[i], stage, level, layout.best(above[i], chains[i], stage, np.arange(low, low + nodes)))
    need.unpersist()


def _places(t: Trees, x: np.ndarray, stage: int, level: int, place: np.ndarray) -> np.ndarray:
    """``place`` of each row's node in its level (the last of ``place`` for rows that stopped above)."""
    low = (1 << level) - 1
    if level > 8:
        return place[np.maximum(t.leaf(x, stage, level) - low, -1)]
    path, ends = t.descend(x, stage, level)
    return place[np.maximum(ends - low, -1)][path]


# ------------------------------------------------------------------ scoring

@dataclass
class HistModel:
    """One fitted model: the mean of its trees (trees, forests) or their weighted sum (boosting)."""

    kind: str
    task: str
    features: list[str]
    label: str
    cuts: list[np.ndarray]
    chains: list[Chain]
    trees: list[Trees]
    depth: int
    stages: int

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.task}"

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Score of binned rows: probability of class 1 or the amount."""
        out, x = np.zeros(len(x)), np.asfortranarray(x)
        for c, t in zip(self.chains, self.trees):
            for s in range(self.stages):
                got = t.values(x, s, self.depth)
                out += got if s == 0 else c.step * got
        if self.kind == "boost":
            return 1.0 / (1.0 + np.exp(-2.0 * out)) if self.chains[0].loss == LOGISTIC else out
        return out / len(self.chains)

    def heap(self, chain: int, stage: int) -> dict:
        """Nodes of one tree as ``compiled.tree_text`` takes them."""
        t, inner, out, todo = self.trees[chain], (1 << self.depth) - 1, {}, [0]
        while todo:
            i = todo.pop()
            f = int(t.feature[stage, i]) if i < inner else -1
            out[i] = float(t.value[stage, i])
            if f >= 0:
                out[i] = (self.features[f], float(self.cuts[f][t.cut[stage, i]]), 2 * i + 1, 2 * i + 2)
                todo += [2 * i + 1, 2 * i + 2]
        return out

    def score_column(self):
        """The score as a column expression; None beyond ``compiled.NODES`` nodes."""
        trees, weights = [], []
        for k, c in enumerate(self.chains):
            trees += [self.heap(k, s) for s in range(self.stages)]
            weights += [1.0] + [c.step] * (self.stages - 1)
        if sum(map(len, trees)) > X.NODES:
            return None
        text = X.weighted_text(trees, weights)
        if self.kind != "boost":
            text = f"{text} / {len(self.chains)}D"
        elif self.chains[0].loss == LOGISTIC:
            text = X.logistic_text(text, 2)
        return X.refuse(self.features, text, nan=False)

    def score(self, df: DataFrame) -> DataFrame:
        """MOD12: ``df`` with ``score`` and, for classifiers, ``pred`` (ties to 0). A null feature is an error."""
        column = self.score_column()
        if column is None:
            return self.score_batches(df)
        out = df.withColumn("score", column)
        return out.withColumn("pred", (F.col("score") > 0.5).cast("int")) if self.task == "classifier" else out

    def score_batches(self, df: DataFrame) -> DataFrame:
        """``score`` by Arrow batches, for ensembles of any size."""
        k, cuts, model, cls = len(self.features), self.cuts, self, self.task == "classifier"
        schema = df.select("*", F.lit(0.0).alias("score"), *([F.lit(0).alias("pred")] if cls else [])).schema

        def run(batches):
            for b in batches:
                x = to_bins([b.column(b.num_columns - k + i).to_numpy().astype(float) for i in range(k)], cuts)
                s = model.predict(x)
                more = [pa.array(s)] + ([pa.array((s > 0.5).astype(np.int32))] if cls else [])
                yield pa.record_batch([*b.columns[:-k], *more], names=schema.names)

        inputs = [F.col(f).cast("double").alias(f"tree_input_{i}") for i, f in enumerate(self.features)]
        return df.select("*", *inputs).mapInArrow(run, schema)

    def importances(self) -> np.ndarray:
        """Gain of each feature, normalised per tree, averaged over trees, normalised (boosting: weighted trees)."""
        out = np.zeros(len(self.features))
        inner = (1 << self.depth) - 1
        for c, t in zip(self.chains, self.trees):
            for s in range(self.stages):
                f, g = t.feature[s][:inner], t.gain[s][:inner]
                one = np.bincount(f[f >= 0], g[f >= 0], len(out))
                if one.sum() > 0:
                    out += one / one.sum() * (c.step if s else 1.0)
        return out / out.sum() if out.sum() > 0 else out


def node_table(spark, model: HistModel) -> DataFrame:
    """EVA8: the nodes of a single tree by heap number (children of i: 2 i + 1 and 2 i + 2); rows up to the
    threshold go left."""
    t, inner = model.trees[0], (1 << model.depth) - 1
    out = []
    for i in np.flatnonzero(t.rows[0][:2 * inner + 1] > 0).tolist():
        f = int(t.feature[0, i]) if i < inner else -1
        out.append((i, model.features[f] if f >= 0 else None, float(model.cuts[f][t.cut[0, i]]) if f >= 0 else None,
                    int(t.rows[0, i]), float(t.value[0, i]), float(t.gain[0, i]) if f >= 0 else None))
    return spark.createDataFrame(out, "id long, feature string, threshold double, samples long, value double, gain double")


def member(forest: Forest, kind: str, task: str, ids: list[int], depth: int, stages: int) -> HistModel:
    """The model of a grid point and fold, from its chains."""
    b = forest.rows
    return HistModel(kind, task, b.features, b.label, b.cuts, [forest.chains[i] for i in ids],
                     [forest.trees[i] for i in ids], depth, stages)


def held_out(forest: Forest, models: list[dict[int, HistModel]]) -> DataFrame:
    """model, fold, y, score: every row scored by the models that left its fold out."""
    width, blocks = len(forest.rows.features), forest.rows.blocks
    held = blocks.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for x, y, fold, _ in _blocks(batches, width):
            for k, by_fold in enumerate(held.value):
                for f, m in by_fold.items():
                    mine = fold == f
                    if mine.any():
                        n = int(mine.sum())
                        yield pa.record_batch([pa.array(np.full(n, k), pa.int32()), pa.array(np.full(n, f), pa.int32()),
                                               pa.array(y[mine]), pa.array(m.predict(x[mine]))], ["model", "fold", "y", "score"])

    return blocks.mapInArrow(run, "model int, fold int, y double, score double")


# ------------------------------------------------------------------ grids and cross-validation

def grid_points(grid: dict) -> list[dict]:
    """All combinations, names in alphabetical order."""
    out = [{}]
    for name in sorted(grid):
        out = [{**p, name: v} for p in out for v in grid[name]]
    return out


def plan(points: list[dict], kind: str, task: str, folds: list[int], p: int, seed: int):
    """Chains that hold every grid point of every fold, and (point, fold) -> (chain numbers, depth, stages).

    Points that differ in depth (trees, forests), trees or stages share their chains."""
    chains: dict[Chain, int] = {}
    used = {}
    top = {k: max(pt[k] for pt in points) for k in ("maxDepth", "numTrees", "maxIter") if k in points[0]}

    def put(c: Chain) -> int:
        return chains.setdefault(c, len(chains))

    for f in folds:
        for n, pt in enumerate(points):
            if kind == "tree":
                ids = [put(Chain(f, top["maxDepth"], pt.get("minInstancesPerNode", 1), seed=seed))]
                stages = 1
            elif kind == "forest":
                subset = math.ceil(math.sqrt(p)) if task == "classifier" else 0
                boot = pt.get("bootstrap", True)
                one = Chain(f, top["maxDepth"], 1, None, subset, seed=seed)
                # without bootstrap the trees differ in their feature subsets only
                ids = ([put(replace(one, bag=t)) for t in range(pt["numTrees"])] if boot else
                       [put(replace(one, seed=seed + 7919 * (t + 1))) for t in range(pt["numTrees"])] if subset else [put(one)])
                stages = 1
            else:
                loss = LOGISTIC if task == "classifier" else SQUARED
                ids = [put(Chain(f, pt["maxDepth"], 1, None, 0, loss, pt["stepSize"], top["maxIter"], seed))]
                stages = pt["maxIter"]
            used[n, f] = (ids, pt["maxDepth"], stages)
    return list(chains), used


@dataclass
class Search:
    """Result of a grid search: the best parameters, every point's score, the refitted model and the models that left each fold out."""

    best: dict
    table: list[dict]
    model: HistModel
    forest: Forest
    by_fold: dict[int, HistModel]

    def cv(self, metric: str) -> float:
        """TUN2 / TUN3: mean over folds of AUC or RMSE of the best point's held-out scores."""
        return cv_metric(held_out(self.forest, [self.by_fold]), metric)[0]


def cv_metric(scored: DataFrame, metric: str) -> dict[int, float]:
    """Per model the mean over folds of accuracy, r2, rmse or auc."""
    by = ["model", "fold"]
    if metric == "auc":
        from .evaluate import auc
        rows = auc(scored.withColumn("y", F.col("y").cast("int")), "y", "score", by=by).select(*by, F.col("auc").alias("v")).collect()
    else:
        err = F.sum((F.col("y") - F.col("score")) ** 2)
        value = {"accuracy": F.avg(((F.col("score") > 0.5) == (F.col("y") == 1)).cast("double")),
                 "rmse": F.sqrt(err / F.count("*")), "r2": 1 - err / (F.var_pop("y") * F.count("*"))}[metric]
        rows = scored.groupBy(*by).agg(value.alias("v")).collect()
    out: dict[int, list[float]] = {}
    for r in sorted(rows, key=lambda r: (r["model"], r["fold"])):
        out.setdefault(r["model"], []).append(r["v"])
    return {k: float(np.mean(v)) for k, v in out.items()}


def search(rows: Binned, kind: str, task: str, points: list[dict], folds: int = 5, seed: int = 1, way: str | None = None,
           refit: bool = True) -> Search:
    """TUN1: all points and folds (and the models of all rows) in one training; best by mean accuracy or R2, the first on
    ties. One point alone is not scored."""
    chains, used = plan(points, kind, task, [*range(folds), *([-1] if refit else [])], len(rows.features), seed)
    forest = grow(rows, chains, way)
    models = [{f: member(forest, kind, task, *used[n, f]) for f in range(folds)} for n in range(len(points))]
    score, best = {0: float("nan")}, 0
    if len(points) > 1:
        score = cv_metric(held_out(forest, models), "accuracy" if task == "classifier" else "r2")
        best = max(range(len(points)), key=lambda n: (score[n], -n))
    table = [{**pt, "score": score[n]} for n, pt in enumerate(points)]
    return Search(points[best], table, member(forest, kind, task, *used[best, -1]) if refit else None, forest, models[best])
