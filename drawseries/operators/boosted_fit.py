"""One-vs-rest boosted trees of all series, targets and classes, grown in the same passes over binned rows.

A level of one round's trees, one for each series, target and class, is one pass over the rows of
:mod:`forest_fit`: tasks sum residuals and rows by tree, node, feature and bin, a shuffle adds them up and
picks the best split of each node.  A row carries its margins of all classes; they are brought up to date
every ``KEEP`` rounds, and in between the rounds since are added on the fly.

The model is that of MLlib's ``OneVsRest(GBTClassifier)``: the first tree fits labels of 1 and -1, each later
one the residual 4 y / (1 + exp(2 y F)) of log loss with the learning rate as its weight, all features
are tried, gain is that of variance.  Residuals are summed in steps of 2**-20, so sums are
exact and a fit does not depend on how rows are dealt to tasks; split candidates are
those of :func:`forest_fit.split_candidates`.  ``subsample`` picks rows by a hash of their number, seed and round.
Defined cases: a row without a label is left out of that target's trees; a class without rows is
among the classes up to the greatest one and gets a tree of one leaf; a target without any rows raises.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forest_fit as FF
from .forest_fit import BINS, NODE_BLOCK, _by_series, _matrix, unit

# as in forest_fit; what runs in workers names that module's functions, not the module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rounds between two updates of the stored margins.
KEEP = 5
#: Rows of a block, steps of a residual to 1, and what a row adds to the sum of steps: both are read back from one number.
BLOCK_ROWS, STEPS, ROW = 16384, float(1 << 20), float(1 << 37)


@dataclass
class Plan:
    """Boosted trees to grow for each series: ``classes`` of every target."""
    rounds: int
    depth: int
    min_rows: int
    seed: int
    rate: float
    subsample: float
    classes: dict[str, list[int]] = field(default_factory=dict)

    def offsets(self, lot: str) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.classes[lot])]).astype(int)


class Tree:
    """A regression tree while it grows; a leaf's children are itself."""

    def __init__(self):
        self.feature, self.bin, self.child = np.zeros(1, np.int32), np.full(1, 255, np.uint8), np.zeros(2, np.int32)
        self.slot, self.value, self.levels = np.zeros(1, np.int32), np.zeros(1), 0

    def walk(self, flat: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int32)
        for _ in range(self.levels):
            node = self.child[node * 2 + (flat[self.feature[node] * n + rows] > self.bin[node])]
        return node


def _blocks(batches, plan: Plan):
    """(series, seq, bins by feature, labels by target, margins by class) of at most ``BLOCK_ROWS`` rows of a series."""
    def whole(name, parts):
        seq, bins, labels, margins = [np.concatenate(c) for c in zip(*parts)]
        return name, seq, np.ascontiguousarray(bins.T), np.ascontiguousarray(labels.T).astype(np.int8), np.ascontiguousarray(margins.T)
    held: dict[str, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        seq, bins, labels = batch.column("seq").to_numpy(), _matrix(batch.column("bins")), _matrix(batch.column("labels"))
        for name, at in _by_series(batch):
            if "margins" in batch.schema.names:
                own = batch.column("margins").filter(pa.array(np.isin(np.arange(batch.num_rows), at)))
                margins = _matrix(own).view(np.float64)
            else:
                margins = np.zeros((len(at), plan.offsets(name)[-1]))
            for a in range(0, len(at), BLOCK_ROWS):
                some = at[a:a + BLOCK_ROWS]
                parts = held.setdefault(name, [])
                if parts and sum(len(p[0]) for p in parts) + len(some) > BLOCK_ROWS:
                    yield whole(name, held.pop(name))
                    parts = held.setdefault(name, [])
                parts.append((seq[some], bins[some], labels[some], margins[a:a + BLOCK_ROWS]))
    for name, parts in held.items():
        yield whole(name, parts)


def _add(margins: np.ndarray, flat: np.ndarray, n: int, recent: dict, name: str, k: int):
    """The margins of class ``k`` with the rounds that are not in them yet."""
    rows = np.arange(n)
    for tree, weight in recent.get((name, k), ()):
        margins = margins + weight * tree.value[tree.walk(flat, n, rows)]
    return margins


def _update(plan: Plan, recent: dict):
    """The rows with margins that hold the rounds ``recent`` too."""
    def run(batches):
        for name, seq, bins, labels, margins in _blocks(batches, plan):
            flat, n = bins.ravel(), len(seq)
            m = np.stack([_add(margins[k], flat, n, recent, name, k) for k in range(len(margins))], axis=1)

            def bytes_of(x):
                x = np.ascontiguousarray(x)
                ends = np.arange(n + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
                return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(seq), bytes_of(bins.T), bytes_of(labels.T), bytes_of(m)],
                                             ["lottery", "seq", "bins", "labels", "margins"])
    return run


def residuals(y: np.ndarray, margins: np.ndarray, first: bool) -> np.ndarray:
    """What a class's next tree fits; ``y`` is 1 for its rows and -1 for the others."""
    return y if first else 4 * y / (1 + np.exp(2 * y * margins))


def _sum(plan: Plan, todo: dict, recent: dict, round_: int):
    """The pass of one level of a round's trees ``todo``, by (series, class): a worker's sums of steps and rows."""
    def run(batches):
        sums: dict = {}
        for name, seq, bins, labels, margins in _blocks(batches, plan):
            flat, n, wide = bins.ravel(), len(seq), bins.astype(np.int64)
            inside = np.ones(n, bool)
            if plan.subsample < 1:
                inside = unit(seq, plan.seed, round_) < plan.subsample
            ends = plan.offsets(name)
            for t in range(len(ends) - 1):
                has = labels[t] >= 0
                use = np.flatnonzero(has & inside)
                every = len(use) == n
                for k in range(ends[t], ends[t + 1]):
                    tree = todo.get((name, k))
                    if tree is None or not len(use):
                        continue
                    y = np.where(labels[t] == k - ends[t], 1.0, -1.0)
                    r = residuals(y, _add(margins[k], flat, n, recent, name, k), round_ == 0)[use]
                    w = np.rint(r * STEPS) + ROW
                    slot = tree.slot[tree.walk(flat, n, use)]
                    live = np.flatnonzero(slot >= 0)
                    all_live = len(live) == len(use)
                    if not all_live:
                        w, slot = w[live], slot[live]
                    at = use if all_live else use[live]
                    size = (int(tree.slot.max()) + 1) * BINS
                    if (name, k) not in sums:
                        sums[name, k] = np.zeros((2, len(bins), size), np.int64)
                    base, total = slot.astype(np.int64) * BINS, np.empty((len(bins), size))
                    for f in range(len(bins)):
                        found = wide[f] if every and all_live else wide[f][at]
                        total[f] = np.bincount(base + found, weights=w, minlength=size)
                    count = np.rint(total / ROW)
                    sums[name, k][0] += (total - count * ROW).astype(np.int64)
                    sums[name, k][1] += count.astype(np.int64)
        for (name, k), h in sums.items():
            h = h.reshape(2, h.shape[1], -1, BINS)
            parts = range(0, h.shape[2], NODE_BLOCK)
            yield pa.RecordBatch.from_pydict({
                "lottery": [name] * len(parts), "k": pa.array([k] * len(parts), pa.int32()), "part": pa.array(list(parts), pa.int32()),
                "cells": pa.array([np.ascontiguousarray(h[:, :, p:p + NODE_BLOCK]).tobytes() for p in parts], pa.binary())})
    return run


def best_splits(steps: np.ndarray, rows: np.ndarray, min_rows: int):
    """Of sums by (feature, node, bin): gain, feature, bin, and the means of the node and of both sides, by node."""
    s, n = steps / STEPS, rows.astype(float)
    left_s, left_n = s.cumsum(axis=2), n.cumsum(axis=2)
    all_s, all_n = left_s[0, :, -1], left_n[0, :, -1]
    left_s, left_n = left_s[:, :, :-1], left_n[:, :, :-1]
    right_s, right_n = all_s[None, :, None] - left_s, all_n[None, :, None] - left_n

    def part(s, n):
        return np.divide(s * s, n, out=np.zeros_like(s), where=n > 0)

    def mean(s, n):
        return np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    gain = part(left_s, left_n) + part(right_s, right_n) - part(all_s, all_n)[None, :, None]
    gain = np.where((left_n >= min_rows) & (right_n >= min_rows), gain / np.where(all_n > 0, all_n, 1)[None, :, None], -1.0)
    flat = gain.transpose(1, 0, 2).reshape(len(all_n), -1)
    at, k = flat.argmax(axis=1), np.arange(len(all_n))
    f, b = np.divmod(at, BINS - 1)
    return flat[k, at], f, b, mean(all_s, all_n), mean(left_s, left_n)[f, k, b], mean(right_s, right_n)[f, k, b]


def _split(n_features: int, min_rows: int):
    """Adds up the sums of each part of a tree's frontier, which lie one after the other, and picks the splits."""
    names = ("gain", "f", "b", "own", "lefts", "rights")

    def done(key, total):
        steps, rows = total.reshape(2, n_features, -1, BINS)
        row = {"lottery": [key[0]], "k": pa.array([key[1]], pa.int32()), "part": pa.array([key[2]], pa.int32())}
        for name, v in zip(names, best_splits(steps, rows, min_rows)):
            row[name] = pa.array([v.astype(float).tolist()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_pydict(row)

    def run(batches):
        now, total = None, None
        for batch in batches:
            for *key, cells in zip(*[batch.column(c).to_pylist() for c in ("lottery", "k", "part")], batch.column("cells")):
                key, data = tuple(key), np.frombuffer(cells.as_buffer(), np.int64)
                if key != now:
                    if now is not None:
                        yield done(now, total)
                    now, total = key, np.zeros(len(data), np.int64)
                total += data
        if now is not None:
            yield done(now, total)
    return run


def _grow(tree: Tree, found: list, level: int, depth: int):
    """Puts the splits of a level into a tree; its frontier is then the new nodes, unless they are of the last level."""
    frontier = np.flatnonzero(tree.slot >= 0)
    gain, f, b, own, left, right = [np.concatenate([r[c] for r in found]) for c in ("gain", "f", "b", "own", "lefts", "rights")]
    if level == 0:
        tree.value[0] = own[0]
    good = np.flatnonzero(gain > 0)
    nodes, first, n = frontier[good], len(tree.feature), 2 * len(good)
    tree.feature[nodes], tree.bin[nodes] = f[good], b[good]
    kids = tree.child.reshape(-1, 2)
    kids[nodes] = first + np.arange(n, dtype=np.int32).reshape(-1, 2)
    tree.child = np.concatenate([kids.ravel(), np.repeat(first + np.arange(n), 2)]).astype(np.int32)
    tree.feature = np.concatenate([tree.feature, np.zeros(n, np.int32)])
    tree.bin = np.concatenate([tree.bin, np.full(n, 255, np.uint8)])
    tree.value = np.concatenate([tree.value, np.stack([left[good], right[good]], axis=1).ravel()])
    new = np.arange(n) if level + 1 < depth else np.full(n, -1)
    tree.slot = np.concatenate([np.full(first, -1), new]).astype(np.int32)
    tree.levels = level + 1


class Boosted:
    """One target's boosted trees: for each class (tree, weight), on a series' split candidates."""

    def __init__(self, trees: list[list[tuple[Tree, float]]], edges: list[np.ndarray], depth: int):
        self.trees, self.edges, self.depth = trees, edges, depth
        self.numFeatures, self.numClasses = len(edges), len(trees)

    @property
    def rounds(self) -> int:
        return min(len(t) for t in self.trees)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Each class's chance 1 / (1 + exp(-2 m)) of its margin m, divided by their sum."""
        bins = np.stack([np.searchsorted(e, x[:, f], side="left").astype(np.uint8) for f, e in enumerate(self.edges)])
        flat, n, rows = bins.ravel(), len(x), np.arange(len(x))
        margins = np.zeros((n, self.numClasses))
        for k, trees in enumerate(self.trees):
            for tree, weight in trees:
                margins[:, k] += weight * tree.value[tree.walk(flat, n, rows)]
        chances = 1 / (1 + np.exp(-2 * margins))
        return chances / chances.sum(axis=1, keepdims=True)


def grow_boosted(binned: DataFrame, plan: Plan, n_features: int) -> dict[tuple[str, int], list[tuple[Tree, float]]]:
    """The trees of every (series, class), with their weights."""
    done = {(lot, k): [] for lot in plan.classes for k in range(plan.offsets(lot)[-1])}
    state, recent = binned.select("lottery", "seq", "bins", "labels").persist(), {}
    try:
        rows = FF.in_few_tasks(state)
        for round_ in range(plan.rounds):
            trees = {key: Tree() for key in done}
            for level in range(plan.depth):
                todo = {key: tree for key, tree in trees.items() if (tree.slot >= 0).any()}
                if not todo:
                    break
                found = rows.mapInArrow(_sum(plan, todo, recent, round_), "lottery string, k int, part int, cells binary") \
                    .repartition("lottery", "k", "part").sortWithinPartitions("lottery", "k", "part").mapInArrow(
                        _split(n_features, plan.min_rows), "lottery string, k int, part int, gain array<double>, f array<double>, "
                        "b array<double>, own array<double>, lefts array<double>, rights array<double>")
                by: dict = {}
                for r in found.collect():
                    by.setdefault((r.lottery, r.k), []).append(r)
                for key, tree in todo.items():
                    if key in by:
                        _grow(tree, sorted(by[key], key=lambda r: r.part), level, plan.depth)
                    else:                                # no row of this target is in the sample
                        tree.slot[:] = -1
            for key, tree in trees.items():
                tree.slot = np.full(len(tree.slot), -1, np.int32)
                done[key].append((tree, 1.0 if round_ == 0 else plan.rate))
                recent.setdefault(key, []).append(done[key][-1])
            if (round_ + 1) % KEEP == 0 and round_ + 1 < plan.rounds:
                newer = rows.mapInArrow(_update(plan, recent), "lottery string, seq long, bins binary, labels binary, margins binary").persist()
                newer.count()
                state.unpersist()
                state, rows, recent = newer, newer, {}
    finally:
        state.unpersist()
    return done


def fit_boosted(train: DataFrame, cand, lotteries: list[str], targets: list[str], depth: int, min_rows: int) -> dict[str, dict[str, Boosted]]:
    """The five boosted models of every series on its own rows."""
    mine = train.filter(F.col("lottery").isin(lotteries))
    edges, counts = FF.split_candidates(mine), FF.label_counts(mine, targets)
    classes = {}
    for lot in lotteries:
        sizes = [FF.classes_below(counts.get(lot, {}), None, t) for t in targets]
        if not all(sizes):
            raise ValueError(f"a target of {lot} has no rows to grow from")
        classes[lot] = [max(s) + 1 for s in sizes]
    plan = Plan(cand.n_estimators, depth, min_rows, cand.seed, cand.learning_rate, cand.subsample, classes)
    grown = grow_boosted(FF.binned_rows(mine, targets, edges), plan, len(next(iter(edges.values()))))
    out = {}
    for lot in lotteries:
        ends = plan.offsets(lot)
        out[lot] = {t: Boosted([grown[lot, k] for k in range(ends[i], ends[i + 1])], edges[lot], depth) for i, t in enumerate(targets)}
    return out
