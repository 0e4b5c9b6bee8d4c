"""Embedding near-duplicates: an exact metric range join around pivots.

Cosine at least t is Euclidean distance at most r = sqrt(2 - 2t) between unit
vectors.  Vectors of one label and length go to the cell of their nearest pivot.
By the triangle inequality a vector x can only have a partner in the cell of
pivot q if d(x, q) <= d(x, p) + 2r, and, as cells are divided by planes, only if
x lies within r of the plane between p and q: those cells get a copy of x.  Cells
are then joined independently; each finds all partners of its own vectors.

Equal vectors are merged first and counted.  A cell of any size is cut into a
grid of ``OWN`` own by ``OTHER`` candidate rows, each compared in a task of its
own; a task returns counts and one edge per linked row, never pairs.  Pivots are
about ``PIVOTS`` at most, chosen by a hash of the id, so that what reaches the
driver is bounded.  All dot products are in double precision.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite
component, or whose label is null, links with nothing; vectors of different
lengths never link; rows that share an id are nodes of their own.  Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, staged
from .graph import components

THRESHOLD = 0.98
PIVOTS, PER_PIVOT = 1024, 512
OWN, OTHER = 1024, 2048
#: Rounding of distances must never lose a copy.
MARGIN = 1e-9


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _to_bytes(vec: str, names: list[str]):
    at = names.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, dims = [], []
            for v in b.column(at).to_pylist():
                raw = None
                if v and None not in v:
                    x = np.array(v, dtype="<f8")
                    if np.isfinite(x).all() and 0 < (x * x).sum() < math.inf:
                        raw = x.tobytes()
                out.append(raw)
                dims.append(len(v) if raw else None)
            cols = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
                                             names=[*[n for n in names if n != vec], "dim", "v"])
    return run


def _cells(pivots: dict[tuple[str, int], np.ndarray], radius: float):
    """Own cell of each vector, and the cells that need a copy."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, dim, rep, copies, raw = [b.column(i) for i in range(5)]
            labels, dims, vecs = label.to_pylist(), dim.to_pylist(), raw.to_pylist()
            rows, cells, own = [], [], []
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels, dims)):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                p = pivots.get(key)
                if p is None:
                    rows += at
                    cells += [0] * len(at)
                    own += [True] * len(at)
                    continue
                x = _units([vecs[i] for i in at])
                dots = x @ p.T
                home = np.argmax(dots, axis=1)
                gap = dots[np.arange(len(at)), home][:, None] - dots
                between = np.sqrt(np.maximum(0.0, ((p[home][:, None, :] - p[None, :, :]) ** 2).sum(2))) \
                    if len(p) <= 64 else np.stack([np.sqrt(((p - p[h]) ** 2).sum(1)) for h in home])
                far = np.sqrt(np.maximum(0.0, 2 - 2 * dots))
                near = far[np.arange(len(at)), home][:, None]
                need = (gap <= radius * between + MARGIN) & (far <= near + 2 * radius + MARGIN)
                need[np.arange(len(at)), home] = True
                i, j = np.nonzero(need)
                rows += [at[k] for k in i]
                cells += j.tolist()
                own += (home[i] == j).tolist()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [label.take(take), dim.take(take), pa.array(cells, pa.int32()), pa.array(own, pa.bool_()),
                 rep.take(take), copies.take(take), raw.take(take)],
                names=["label", "dim", "cell", "own", "rep", "copies", "v"])
    return run


def _join(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        own, other = group[group["own"]], group[~group["own"]]
        if not len(own) or not len(other):
            return pd.DataFrame({"rep": [], "links": [], "lead": []}).astype("int64")
        a, c = own["rep"].to_numpy(), other["rep"].to_numpy()
        linked = _units(own["v"].tolist()) @ _units(other["v"].tolist()).T >= threshold
        same = a[:, None] == c[None, :]
        linked |= same                                  # a vector is its own partner, whatever rounding says
        links = linked @ other["copies"].to_numpy()
        # least id among the linked, passed on until nothing changes: one lead per connected part
        lead_a, lead_c = a.copy(), c.copy()
        while True:
            new_a = np.minimum(lead_a, np.where(linked, lead_c[None, :], np.iinfo(np.int64).max).min(1))
            new_c = np.minimum(lead_c, np.where(linked, new_a[:, None], np.iinfo(np.int64).max).min(0))
            if (new_a == lead_a).all() and (new_c == lead_c).all():
                break
            lead_a, lead_c = new_a, new_c
        moved = lead_c != c
        return pd.DataFrame({"rep": np.concatenate([a, c[moved]]),
                             "links": np.concatenate([links, np.zeros(moved.sum(), np.int64)]),
                             "lead": np.concatenate([lead_a, lead_c[moved]])}).astype("int64")
    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vec: str = "embedding",
                 label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    spark = vectors.sparkSession
    short_batches(spark)
    if not 0 < threshold < 1:
        raise ValueError("the threshold is a cosine between 0 and 1")
    radius = math.sqrt(2 - 2 * threshold)
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[label].cast("string").alias("label"),
                          vectors[vec].alias("vec"))
    rows = staged(rows.mapInArrow(_to_bytes("vec", ["id", "label", "vec"]), "id long, label string, dim int, v binary"),
                  "vectors")
    valid = rows.where("v is not null and label is not null and id is not null")
    # a class goes by a number of its own: one id may have rows in several
    classes = staged(valid.groupBy("label", "dim", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
                     .withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    named = classes.select("rep", "least")
    classes = classes.select("label", "dim", "rep", "copies", "v")
    n = classes.count()
    share = min(1.0 / PER_PIVOT, PIVOTS / max(1, n))
    chosen = classes.where(F.pmod(F.xxhash64("v", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    pivots: dict[tuple, list[bytes]] = {}
    for r in chosen.select("label", "dim", "rep", "v").collect():
        pivots.setdefault((r.label, r.dim), []).append(bytes(r.v))
    units = {k: _units(sorted(v)) for k, v in pivots.items()}
    placed = staged(classes.mapInArrow(
        _cells(units, radius), "label string, dim int, cell int, own boolean, rep long, copies long, v binary"), "cells")
    cell = ["label", "dim", "cell"]
    grid = placed.groupBy(*cell).agg(
        F.ceil(F.sum(F.col("own").cast("int")) / OWN).cast("int").alias("n_own"),
        F.ceil(F.count("*") / OTHER).cast("int").alias("n_other")).where("n_own > 0")
    # cells are at most the pivots and the labels; the planner broadcasts the table while it is small
    sized = placed.join(staged(grid, "grid"), cell)
    first = F.explode(F.sequence(F.lit(0), F.col("n_other") - 1))
    own = sized.where("own").select(*cell, F.pmod(F.xxhash64("rep"), "n_own").cast("int").alias("i"), first.alias("j"),
                                    F.lit(True).alias("own"), "rep", "copies", "v")
    second = F.explode(F.sequence(F.lit(0), F.col("n_own") - 1))
    other = sized.select(*cell, second.alias("i"), F.pmod(F.xxhash64("rep", F.lit(1)), "n_other").cast("int").alias("j"),
                         F.lit(False).alias("own"), "rep", "copies", "v")
    found = staged(own.unionByName(other).groupBy(*cell, "i", "j").applyInPandas(
        _join(threshold), "rep long, links long, lead long"), "links")
    links = found.groupBy("rep").agg((F.sum("links") - 1).alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("lead").alias("b")))
    # a component goes by the least id of its classes
    parts = staged(parts.withColumnRenamed("node", "rep").join(named, "rep"), "parts")
    least = parts.groupBy("component").agg(F.min("least").alias("name"))
    parts = parts.join(least, "component").select("rep", "name")
    by_class = (classes.join(named, "rep").join(links, "rep", "left").join(parts, "rep", "left")
                .select("label", "dim", "v", F.coalesce("links", F.col("copies") - 1).alias("links"),
                        F.coalesce("name", "least").alias("component")))
    out = rows.join(by_class, ["label", "dim", "v"], "left")
    comp = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
