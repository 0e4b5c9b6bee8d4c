"""Random forests of many targets, candidates and refreshes, grown in the same passes over binned rows (H2, H4, H9).

A row is kept as one byte a feature (its bin, at most ``BINS`` of them) and one byte a label.  Each
level of all trees is one pass: every task counts the classes of its rows by tree, node, drawn
feature and bin, the counts of a tree's nodes are summed in a shuffle, and only the best split of
each node comes back.  A pass holds at most ``PASS_CELLS`` counts a task, so its memory depends
neither on the rows nor on the number of trees; levels of more nodes take several passes.

The forest is that of MLlib's ``RandomForestClassifier``: Poisson(1) bags, the root of the number of
features drawn for each node, Gini gain over class counts times class weights, split candidates
at the features' quantiles (midpoints of all values where there are few), leaves of equal
prediction merged, probability the mean of the leaves' class shares.  All rows are read for the
quantiles (MLlib samples; a block of rows is described by ``SKETCH`` points), and a row's bag weight is
a hash of its number, the seed and the tree, so of the same split candidates the same forest grows
however rows are dealt to tasks.  Defined cases: a row without a label is left
out of that target's trees; a target without any rows raises.
"""

from __future__ import annotations

import sys
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import store_by

# workers get this module's functions with their tasks, so they need not find the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a feature (MLlib's ``maxBins``).
BINS = 32
#: Counts that a task holds in one pass (8 bytes each).
PASS_CELLS = 8 << 20
#: Rows that a worker works on at a time, nodes whose counts are summed together.
BLOCK_ROWS, NODE_BLOCK = 65536, 16
#: Points by which a worker describes a feature's values in a block of rows, unless it has fewer values.
SKETCH = 256


# -- rows of bytes ------------------------------------------------------------

def _matrix(column) -> np.ndarray:
    """A column of arrays or byte strings of one length as rows of a matrix."""
    n = len(column)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        at = np.frombuffer(column.buffers()[1], wide)[column.offset:column.offset + n + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(n, -1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _by_series(batch):
    """(series, places of its rows) in a batch."""
    names = batch.column("lottery").dictionary_encode()
    codes = names.indices.to_numpy()
    for i, name in enumerate(names.dictionary.to_pylist()):
        yield name, np.flatnonzero(codes == i)


def _describe(batches):
    """For each series and feature, values and how many rows they stand for; a block of rows at a time."""
    def rows():
        held: dict[str, list] = {}
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                for name, at in _by_series(batch):
                    parts = held.setdefault(name, [])
                    parts.append(x[at])
                    if sum(map(len, parts)) >= BLOCK_ROWS:
                        yield name, np.concatenate(held.pop(name))
        for name, parts in held.items():
            yield name, np.concatenate(parts)

    for name, x in rows():
        out = []
        for f in range(x.shape[1]):
            v, n = np.unique(x[:, f], return_counts=True)
            if len(v) > SKETCH:                      # points of equal weight instead
                at = ((np.arange(SKETCH) + 0.5) * len(x) / SKETCH).astype(int)
                v, n = np.unique(np.repeat(v, n)[at], return_counts=True)
                n = n * (len(x) / SKETCH)
            out.append((f, v.astype(float).tobytes(), n.astype(float).tobytes()))
        yield pa.RecordBatch.from_pydict({"lottery": [name] * len(out), "feature": pa.array([o[0] for o in out], pa.int32()),
                                          "v": pa.array([o[1] for o in out], pa.binary()), "n": pa.array([o[2] for o in out], pa.binary())})


def _thresholds(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """At most ``BINS`` - 1 split candidates of values that stand for ``n`` rows each, as MLlib picks them."""
    v, at = np.unique(v, return_inverse=True)
    n = np.bincount(at, weights=n)
    mid = (v[1:] + v[:-1]) / 2
    if len(mid) < BINS:
        return mid
    stride, below = n.sum() / BINS, n.cumsum()
    out, target = [], stride
    for i in range(1, len(v)):
        if abs(below[i - 1] - target) < abs(below[i] - target):
            out.append(mid[i - 1])
            target += stride
    return np.array(out[:BINS - 1])


def _edges(batches):
    """Split candidates of a (series, feature), whose descriptions lie one after the other."""
    def done(key, v, n):
        return pa.RecordBatch.from_pydict({"lottery": [key[0]], "feature": pa.array([key[1]], pa.int32()),
                                           "edges": pa.array([_thresholds(np.concatenate(v), np.concatenate(n))], pa.list_(pa.float64()))})
    now, vs, ns = None, [], []
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["lottery"], r["feature"])
            if key != now and now is not None:
                yield done(now, vs, ns)
                vs, ns = [], []
            now = key
            vs.append(np.frombuffer(r["v"]))
            ns.append(np.frombuffer(r["n"]))
    if now is not None:
        yield done(now, vs, ns)


def split_candidates(rows: DataFrame) -> dict[str, list[np.ndarray]]:
    """The split candidates of every series' features, from all its rows."""
    x = rows.select("lottery", vector_to_array("features").alias("x"))
    found = x.mapInArrow(_describe, "lottery string, feature int, v binary, n binary") \
        .repartition("lottery", "feature").sortWithinPartitions("lottery", "feature") \
        .mapInArrow(_edges, "lottery string, feature int, edges array<double>")
    out: dict[str, dict] = {}
    for r in found.collect():
        out.setdefault(r.lottery, {})[r.feature] = np.array(r.edges, float)
    return {lot: [by[f] for f in range(len(by))] for lot, by in out.items()}


def binned_rows(rows: DataFrame, targets: list[str], edges: dict[str, list[np.ndarray]]) -> DataFrame:
    """(seq, blk, bins, labels, lottery) of the rows of series with split candidates, stored by lottery."""
    blk = F.col("blk") if "blk" in rows.columns else F.lit(0)

    def to_bins(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, keep = _matrix(batch.column("x")), np.zeros(batch.num_rows, bool)
            bins = np.zeros(x.shape, np.uint8)
            for name, at in _by_series(batch):
                if name in edges:
                    keep[at] = True
                    for f, e in enumerate(edges[name]):
                        bins[at, f] = np.searchsorted(e, x[at, f], side="left")
            y = np.stack([batch.column(t).fill_null(-1).to_numpy().astype(np.int8) for t in targets], axis=1)

            def bytes_of(m):
                ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
                return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(m))])
            out = pa.RecordBatch.from_arrays(
                [batch.column("seq"), batch.column("blk"), bytes_of(bins), bytes_of(y), batch.column("lottery")],
                ["seq", "blk", "bins", "labels", "lottery"])
            yield out.filter(pa.array(keep)) if not keep.all() else out

    # rows without a number of their own are known by a hash of their features
    seq = F.col("seq").cast("long") if "seq" in rows.columns else F.xxhash64(vector_to_array("features"))
    plain = rows.select(seq.alias("seq"), blk.cast("int").alias("blk"), *targets, "lottery",
                        vector_to_array("features").alias("x"))
    return store_by(plain.mapInArrow(to_bins, "seq long, blk int, bins binary, labels binary, lottery string"), ["lottery"], "binned")


def label_counts(frame: DataFrame, targets: list[str]) -> dict[str, dict[int, dict[str, dict[int, int]]]]:
    """Rows of each class, by series, block and target (classes are few)."""
    blk = F.col("blk") if "blk" in frame.columns else F.lit(0)
    long = frame.select("lottery", blk.alias("blk"), F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col(t).cast("int").alias("v")) for t in targets])).alias("e"))
    out: dict = {}
    for r in long.groupBy("lottery", "blk", "e.t", "e.v").count().where("v is not null").collect():
        out.setdefault(r.lottery, {}).setdefault(r.blk, {}).setdefault(r.t, {})[r.v] = r["count"]
    return out


def classes_below(counts: dict[int, dict[str, dict[int, int]]], limit: int | None, target: str) -> dict[int, int]:
    """Rows of each class of a target in a series' blocks below ``limit`` (all without one)."""
    out: dict[int, int] = {}
    for blk, by in counts.items():
        if limit is None or blk < limit:
            for v, n in by.get(target, {}).items():
                out[v] = out.get(v, 0) + n
    return out


def balanced(classes: dict[int, int]) -> np.ndarray:
    """A6 as an array by class."""
    n, out = sum(classes.values()), np.zeros(max(classes) + 1)
    for v, n_c in classes.items():
        out[v] = n / (len(classes) * n_c)
    return out


# -- trees --------------------------------------------------------------------

@dataclass
class Plan:
    """A forest to grow: label (its place among the targets), class weights, and the blocks its rows are of."""
    target: int
    weights: np.ndarray
    n_trees: int
    depth: int
    min_rows: int
    seed: int
    limit: int | None = None


class Tree:
    """A tree while it grows: nodes by number, a leaf's children are itself; ``slot`` is a node's place in the frontier."""

    def __init__(self, n_classes: int):
        self.feature, self.bin, self.child = np.zeros(1, np.int32), np.full(1, 255, np.uint8), np.zeros(2, np.int32)
        self.slot, self.counts = np.zeros(1, np.int32), np.zeros((1, n_classes))
        self.drawn = None


def _hash(seq: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """48 zero bits and 16 of a hash of row, seed and tree."""
    salt = np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) % 2**64)
    h = seq.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(times)
    h ^= h >> np.uint64(31)
    return (h >> np.uint64(48)).astype(np.intp)


def bag_weights(seq: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Poisson(1) of every row: the inverse distribution at a hash of row, seed and tree."""
    return _POISSON[_hash(seq, seed, tree)]


def unit(seq: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) of every row, by a hash of row, seed and tree."""
    return _hash(seq, seed, tree) / 65536


def _poisson_table() -> np.ndarray:
    p, below, out = np.exp(-1.0), 0.0, np.zeros(65536, np.uint8)
    at = (np.arange(65536) + 0.5) / 65536
    for k in range(1, 10):
        below += p
        out[at >= below] = k
        p /= k
    return out


_POISSON = _poisson_table()


def _blocks(batches):
    """(seq, blk, bins by feature, labels by target) of about ``BLOCK_ROWS`` rows."""
    held, n = [], 0

    def whole():
        cols = [np.concatenate(c) for c in zip(*held)]
        return cols[0], cols[1], np.ascontiguousarray(cols[2].T), np.ascontiguousarray(cols[3].T).astype(np.int8)
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("seq").to_numpy(), batch.column("blk").to_numpy(), _matrix(batch.column("bins")),
                         _matrix(batch.column("labels"))))
            n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield whole()
            held, n = [], 0
    if n:
        yield whole()


def _count(plans: list[Plan], todo: dict[tuple[int, int], Tree], level: int):
    """The pass of one level: a worker's counts of the trees ``todo``, in parts of ``NODE_BLOCK`` nodes."""
    def run(batches):
        sums: dict = {}
        for seq, blk, bins, labels in _blocks(batches):
            flat, n, bags = bins.ravel(), len(seq), {}
            for (p, t), tree in todo.items():
                plan = plans[p]
                key = (plan.seed, t, plan.limit)
                if key not in bags:
                    bag = bag_weights(seq, plan.seed, t) if plan.n_trees > 1 else np.ones(n, np.uint8)
                    if plan.limit is not None:
                        bag = np.where(blk < plan.limit, bag, 0)
                    rows = np.flatnonzero(bag)
                    bags[key] = rows, bag[rows].astype(float)
                rows, bag = bags[key]
                y = labels[plan.target][rows]
                if len(y) and y.min() < 0:
                    rows, bag, y = rows[y >= 0], bag[y >= 0], y[y >= 0]
                node = np.zeros(len(rows), np.int32)
                for _ in range(level):
                    right = flat[tree.feature[node] * n + rows] > tree.bin[node]
                    node = tree.child[node * 2 + right]
                slot = tree.slot[node]
                if level:
                    live = np.flatnonzero(slot >= 0)
                    rows, bag, y, slot = rows[live], bag[live], y[live], slot[live]
                n_classes = len(plan.weights)
                size = len(tree.drawn) * BINS * n_classes
                if (p, t) not in sums:
                    sums[p, t] = np.zeros((tree.drawn.shape[1], size))
                base = slot.astype(np.int64) * (BINS * n_classes) + y
                for j, total in enumerate(sums[p, t]):
                    found = flat[tree.drawn[:, j][slot] * n + rows]
                    total += np.bincount(base + found.astype(np.int64) * n_classes, weights=bag, minlength=size)
        for (p, t), h in sums.items():
            n_classes = len(plans[p].weights)
            h = h.astype(np.int32).reshape(len(h), -1, BINS * n_classes)
            out = []
            for part in range(0, h.shape[1], NODE_BLOCK):
                cells = np.ascontiguousarray(h[:, part:part + NODE_BLOCK]).ravel()
                at = np.flatnonzero(cells).astype(np.int32)
                few = 2 * len(at) < len(cells)
                out.append((part, few, (np.concatenate([at, cells[at]]) if few else cells).tobytes()))
            yield pa.RecordBatch.from_pydict({
                "plan": pa.array([p] * len(out), pa.int32()), "tree": pa.array([t] * len(out), pa.int32()),
                "part": pa.array([o[0] for o in out], pa.int32()), "few": [o[1] for o in out], "cells": pa.array([o[2] for o in out], pa.binary())})
    return run


def best_splits(cells: np.ndarray, weights: np.ndarray, min_rows: int):
    """Of counts by (drawn feature, node, bin, class): gain, place of feature, bin, and the classes on both sides, by node."""
    left = cells.cumsum(axis=2)
    total = left[0, :, -1]
    left = left[:, :, :-1]
    right = total[None, :, None] - left
    valid = (left.sum(-1) >= min_rows) & (right.sum(-1) >= min_rows)

    def purity(c):
        c = c * weights
        s = c.sum(-1)
        return np.divide((c * c).sum(-1), s, out=np.zeros_like(s), where=s > 0)
    whole = total @ weights
    score = (purity(left) + purity(right) - purity(total)[None, :, None]) / np.where(whole > 0, whole, 1)[None, :, None]
    score = np.where(valid, score, -1.0).transpose(1, 0, 2).reshape(len(total), -1)
    at = score.argmax(axis=1)
    j, b = np.divmod(at, cells.shape[2] - 1)
    k = np.arange(len(at))
    return score[k, at], j, b, left[j, k, b], right[j, k, b]


def _split(plans: list[Plan], todo: dict[tuple[int, int], Tree]):
    """Sums the counts of each part of a tree's frontier, which lie one after the other, and picks the splits."""
    def run(batches):
        def done(key, cells):
            plan, drawn = plans[key[0]], todo[key[:2]].drawn
            c = cells.reshape(drawn.shape[1], -1, BINS, len(plan.weights)).astype(float)
            gain, j, b, left, right = best_splits(c, plan.weights, plan.min_rows)
            columns = {"plan": pa.array([key[0]], pa.int32()), "tree": pa.array([key[1]], pa.int32()), "part": pa.array([key[2]], pa.int32())}
            for name, v in (("gain", gain), ("j", j.astype(np.int32)), ("bin", b.astype(np.int32)), ("lefts", left), ("rights", right)):
                columns[name] = pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
            return pa.RecordBatch.from_pydict(columns)
        now, total = None, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("plan", "tree", "part", "few")]
            for *key, few, cells in zip(*cols, batch.column("cells")):
                key, data = tuple(key), np.frombuffer(cells.as_buffer(), np.int32)
                if key != now:
                    if now is not None:
                        yield done(now, total)
                    plan, drawn = plans[key[0]], todo[key[:2]].drawn
                    nodes = min(NODE_BLOCK, len(drawn) - key[2])
                    now, total = key, np.zeros(drawn.shape[1] * nodes * BINS * len(plan.weights), np.int64)
                if few:
                    half = len(data) // 2
                    total[data[:half]] += data[half:]
                else:
                    total += data
        if now is not None:
            yield done(now, total)
    return run


def _grow(tree: Tree, found: list, level: int, plan: Plan):
    """Puts the splits of a level into a tree; its frontier is then the new nodes that may be split."""
    frontier = np.flatnonzero(tree.slot >= 0)                      # in the order of their slots
    gain, j, b = [np.concatenate([np.frombuffer(r[c], d) for r in found]) for c, d in (("gain", float), ("j", np.int32), ("bin", np.int32))]
    sides = [np.concatenate([np.frombuffer(r[c]) for r in found]).reshape(len(gain), -1) for c in ("lefts", "rights")]
    if level == 0:
        tree.counts[0] = sides[0][0] + sides[1][0]
    good = np.flatnonzero(gain > 0)
    nodes, first = frontier[good], len(tree.feature)
    tree.feature[nodes], tree.bin[nodes] = tree.drawn[good, j[good]], b[good]
    tree.child = tree.child.reshape(-1, 2)
    tree.child[nodes] = first + np.arange(2 * len(good), dtype=np.int32).reshape(-1, 2)
    n = 2 * len(good)
    counts = np.stack([s[good] for s in sides], axis=1).reshape(n, -1)
    itself = np.repeat(first + np.arange(n, dtype=np.int32), 2)
    tree.child = np.concatenate([tree.child.ravel(), itself]).astype(np.int32)
    tree.feature = np.concatenate([tree.feature, np.zeros(n, np.int32)])
    tree.bin = np.concatenate([tree.bin, np.full(n, 255, np.uint8)])
    tree.counts = np.concatenate([tree.counts, counts])
    open_ = ((counts > 0).sum(axis=1) > 1) & (level + 1 < plan.depth)
    tree.slot = np.concatenate([np.full(first, -1), np.where(open_, open_.cumsum() - 1, -1)]).astype(np.int32)


class Forest:
    """A grown forest: nodes of all trees one after the other, a leaf's children are itself."""

    def __init__(self, trees: list[Tree], edges: list[np.ndarray], weights: np.ndarray, depth: int):
        self.numFeatures, self.numClasses, self.depth = len(edges), len(weights), depth
        table = np.full((len(edges), BINS), np.inf)
        for f, e in enumerate(edges):
            table[f, :len(e)] = e
        feature, threshold, child, share, roots, at = [], [], [], [], [], 0
        for t in trees:
            kids, w = self._merged(t, weights), t.counts * weights
            inner = kids[:, 0] != np.arange(len(kids))
            total = w.sum(axis=1, keepdims=True)
            feature.append(np.where(inner, t.feature, 0))
            threshold.append(np.where(inner, table[t.feature, np.minimum(t.bin, BINS - 1)], np.inf))
            child.append(kids + at)
            share.append(np.divide(w, total, out=np.zeros_like(w), where=total > 0))
            roots.append(at)
            at += len(kids)
        self.feature, self.threshold = np.concatenate(feature).astype(np.int32), np.concatenate(threshold)
        self.child, self.share = np.concatenate(child).astype(np.int32).ravel(), np.concatenate(share)
        self.roots = np.array(roots, np.int32)

    @staticmethod
    def _merged(tree: Tree, weights: np.ndarray) -> np.ndarray:
        """Children by node; two leaves of one prediction are merged into their parent, from below."""
        kids, says = tree.child.reshape(-1, 2).copy(), (tree.counts * weights).argmax(axis=1)
        own = np.arange(len(kids))
        while True:
            leaf = kids[:, 0] == own
            merge = np.flatnonzero(~leaf & leaf[kids[:, 0]] & leaf[kids[:, 1]] & (says[kids[:, 0]] == says[kids[:, 1]]))
            if not len(merge):
                return kids
            kids[merge] = own[merge, None]
            says[merge] = (tree.counts[merge] * weights).argmax(axis=1)

    @property
    def getNumTrees(self) -> int:
        return len(self.roots)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of rows of features."""
        flat, n = np.ascontiguousarray(x.T).ravel(), len(x)
        rows, out = np.arange(n), np.zeros((n, self.numClasses))
        for root in self.roots:
            node = np.full(n, root, np.int32)
            for _ in range(self.depth):
                node = self.child[node * 2 + (flat[self.feature[node] * n + rows] > self.threshold[node])]
            out += self.share[node]
        total = out.sum(axis=1, keepdims=True)
        return np.divide(out, total, out=out, where=total > 0)


#: Least rows worth a task of their own: a pass's counts are made anew in every task.
TASK_ROWS = 2048


def in_few_tasks(rows: DataFrame) -> DataFrame:
    """Kept rows, dealt to as many tasks as run at once and have ``TASK_ROWS`` rows; long input keeps its own parts if they are fewer."""
    blocks = -(-rows.count() // TASK_ROWS)
    return rows.coalesce(max(1, min(blocks, rows.sparkSession.sparkContext.defaultParallelism)))


def grow_forests(rows: DataFrame, plans: list[Plan], edges: list[np.ndarray]) -> list[Forest]:
    """All forests ``plans`` of one series' binned rows."""
    n_features = len(edges)
    trees = {(p, t): Tree(len(plan.weights)) for p, plan in enumerate(plans) for t in range(plan.n_trees)}
    narrow = in_few_tasks(rows.select("seq", "blk", "bins", "labels"))
    for level in range(max(plan.depth for plan in plans)):
        open_ = [k for k, tree in trees.items() if level < plans[k[0]].depth and (tree.slot >= 0).any()]
        for k in open_:
            plan, n = plans[k[0]], int((trees[k].slot >= 0).sum())
            # of one tree every feature is tried, of several the root of their number
            take = n_features if plan.n_trees == 1 else int(np.ceil(np.sqrt(n_features)))
            rng = np.random.default_rng([plan.seed, plan.target, k[1], level])
            trees[k].drawn = rng.random((n, n_features)).argsort(axis=1)[:, :take].astype(np.int32)
        while open_:
            todo, cells = {}, 0
            while open_ and (not todo or cells + trees[open_[0]].drawn.size * BINS * len(plans[open_[0][0]].weights) <= PASS_CELLS):
                k = open_.pop(0)
                todo[k] = trees[k]
                cells += trees[k].drawn.size * BINS * len(plans[k[0]].weights)
            found = narrow.mapInArrow(_count(plans, todo, level), "plan int, tree int, part int, few boolean, cells binary") \
                .repartition("plan", "tree", "part").sortWithinPartitions("plan", "tree", "part") \
                .mapInArrow(_split(plans, todo), "plan int, tree int, part int, gain binary, j binary, bin binary, lefts binary, rights binary")
            by: dict = {}
            for r in found.collect():
                by.setdefault((r.plan, r.tree), []).append(r)
            for k, tree in todo.items():
                if k not in by:
                    raise ValueError("a forest has no rows to grow from")
                _grow(tree, sorted(by[k], key=lambda r: r.part), level, plans[k[0]])
    return [Forest([trees[p, t] for t in range(plan.n_trees)], edges, plan.weights, plan.depth) for p, plan in enumerate(plans)]


def fit_series(binned: DataFrame, edges: dict[str, list[np.ndarray]], plans: dict[str, list[Plan]], parallelism: int = 5) -> dict[str, list[Forest]]:
    """The forests of every series; a series' rows (some 60 bytes each) are kept while its trees grow."""
    def fit(lot):
        rows = binned.filter(F.col("lottery") == lot).persist()
        try:
            return grow_forests(rows, plans[lot], edges[lot])
        finally:
            rows.unpersist()
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as series:
        return dict(zip(plans, series.map(fit, plans)))


def apply_forests(df: DataFrame, models: dict[str, Forest]) -> DataFrame:
    """``df`` without its features but with ``pred_*`` and ``prob_*`` (arrays) of each target's forest."""
    rest = [c for c in df.columns if c != "features"]
    plain = df.select(*rest, vector_to_array("features").alias("_x"))
    schema = df.select(*rest).schema
    for t in models:
        schema = schema.add(f"pred_{t[2:]}", DoubleType()).add(f"prob_{t[2:]}", ArrayType(DoubleType()))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cols = _matrix(batch.column("_x")), [batch.column(c) for c in rest]
            for m in models.values():
                p = m.probabilities(x)
                ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
                cols += [pa.array(p.argmax(axis=1).astype(float)), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))]
            yield pa.RecordBatch.from_arrays(cols, schema.names)
    return plain.mapInArrow(run, schema)
