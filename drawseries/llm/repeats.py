"""Periodic runs of words, by recompression.

The words of a batch of documents, with a mark of its own between two documents,
are compressed level by level into a run-length grammar.  A block level replaces
each stretch of one symbol by a symbol for (symbol, length); a pair level deals all
symbols into left and right ones and replaces each left one followed by a right one
by a symbol for the pair.  Equal stretches are so cut alike but for their ends, and
equal symbols stand for equal words.

The longest common extension (LCE) of two places climbs the levels while both are
at symbols' edges, steps over equal symbols, and at the first unlike ones comes down
again, a few steps a level; many queries go through the levels together.

Runs: a run of period p and at least max(12, 2p) words holds two places of the grid
0, g, 2g, ... with g = max(p, 12 - p) and p words further that both lie in it, so
candidates are the grid places i whose word equals that at i + p.  The extension of
(i, i + p) to either side gives the whole stretch of period p, exactly; it is a run
if long enough.  A stretch found with several periods keeps the smallest.

Work is about n log n grid places and n symbols for n words; a batch is cut at
``WORDS`` words, and no document is divided.  Nothing is shuffled or collected.

Defined cases: null texts and texts without words have no run and collapse to the
empty string; a null id edits no text; repeated rows are handled each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

LEAST, TIMES = 12, 2
#: Words of a batch that go through the grammar together.
WORDS = 1 << 17


class Level:
    """A sequence of symbols; ``up`` has for each symbol's start the next level's symbol that starts there, or -1."""

    __slots__ = ("sym", "ahead", "behind", "up", "first")

    def __init__(self, sym: np.ndarray, first: np.ndarray | None):
        self.sym, self.first = sym, first                # first: place in the level below where each symbol starts
        self.ahead = self.behind = None                  # symbols of the own block from here on, and up to here
        self.up = None

    def closed(self, first: np.ndarray) -> None:
        self.up = np.full(len(self.sym), -1, dtype=np.int32)
        self.up[first] = np.arange(len(first), dtype=np.int32)


def _left(sym: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (sym.astype(np.uint64) + np.uint64(salt + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(63)).astype(bool)


class Grammar:
    """Levels over ``words``; symbols from ``marks`` on are marks between documents, each unlike all others."""

    def __init__(self, words: np.ndarray, marks: int):
        self.levels = [Level(words, None)]
        names = int(words.max(initial=0)) + 1
        salt, mark = 0, words >= marks
        while True:
            now = self.levels[-1]
            sym = now.sym
            same = sym[1:] == sym[:-1]
            if same.any():                               # block level
                first = np.nonzero(np.concatenate([[True], ~same]))[0]
                count = np.diff(np.concatenate([first, [len(sym)]]))
                at = np.arange(len(sym))
                now.behind = (at - np.repeat(first, count) + 1).astype(np.int32)
                now.ahead = (np.repeat(first + count, count) - at).astype(np.int32)
                new = sym[first].copy()
                many = count > 1
                _, name = np.unique(new[many] * (len(sym) + 1) + count[many], return_inverse=True)
                new[many] = names + name
                names += int(name.max()) + 1
            else:                                        # pair level
                free = ~(mark[:-1] | mark[1:])
                if not free.any():
                    return
                left = _left(sym, salt)
                salt += 1
                one, other = left[:-1] & ~left[1:] & free, ~left[:-1] & left[1:] & free
                pair = one if one.sum() >= other.sum() else other
                if not pair.any():
                    continue
                first = np.nonzero(np.concatenate([[True], ~pair]))[0]
                new = sym[first].copy()
                joined = np.concatenate([pair, [False]])[first]
                at = first[joined]
                _, name = np.unique(sym[at] * names + sym[at + 1], return_inverse=True)
                new[joined] = names + name
                names += int(name.max()) + 1
            now.closed(first)
            mark = mark[first]
            self.levels.append(Level(new, first.astype(np.int32)))

    def extend(self, a: np.ndarray, b: np.ndarray, ahead: bool) -> np.ndarray:
        """How many words from ``a`` and from ``b`` on (or, not ``ahead``, before them) are equal."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        back, way = (0, 1) if ahead else (1, -1)

        def step(level: Level, q: np.ndarray) -> np.ndarray:
            """Moves the queries ``q`` over equal symbols; the ones that moved."""
            i, j = x[q] - back, y[q] - back
            equal = level.sym[i] == level.sym[j]
            q, i, j = q[equal], i[equal], j[equal]
            runs = level.ahead if ahead else level.behind
            by = 1 if runs is None else np.minimum(runs[i], runs[j])
            x[q] += way * by
            y[q] += way * by
            return q

        turned: list[np.ndarray] = []                    # by level: queries that met unlike symbols there
        act = np.arange(len(x))
        for level in self.levels:
            passed, met, todo = [], [], act
            while len(todo):
                if level.up is not None:
                    i, j = level.up[x[todo]], level.up[y[todo]]
                    edge = (i >= 0) & (j >= 0)
                    q = todo[edge]
                    x[q], y[q] = i[edge], j[edge]
                    passed.append(q)
                    todo = todo[~edge]
                moved = step(level, todo)
                if len(moved) < len(todo):
                    met.append(np.setdiff1d(todo, moved, assume_unique=True))
                todo = moved
            turned.append(np.concatenate(met) if met else act[:0])
            act = np.concatenate(passed) if passed else act[:0]
            if not len(act):
                break
        down = turned[-1]
        for n in range(len(turned) - 1, 0, -1):
            first = self.levels[n].first
            x[down], y[down] = first[x[down]], first[y[down]]
            todo = down
            while len(todo):
                todo = step(self.levels[n - 1], todo)
            down = np.concatenate([down, turned[n - 1]])
        return np.abs(x - a)


def candidates(word: np.ndarray, start: np.ndarray, size: np.ndarray, least: int = LEAST,
               times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Grid places i and periods p with equal words at i and i + p, over documents of ``size`` words from ``start``."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(1, int(size.max(initial=0)) // times + 1):
        long = int(np.searchsorted(-size, -max(least, times * p), side="right"))
        if not long:
            break
        grid = max((times - 1) * p, least - p)
        count = (size[:long] - p - 1) // grid + 1
        ends = np.cumsum(count)
        at = (np.arange(ends[-1]) - np.repeat(ends - count, count)) * grid + np.repeat(start[:long], count)
        at = at[word[at] == word[at + p]]
        if len(at):
            places.append(at)
            periods.append(np.full(len(at), p))
    return np.concatenate(places), np.concatenate(periods)


def runs(docs: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each document its runs as rows (start, length, period), by start, then period."""
    if not docs:
        return []
    names: dict[bytes, int] = {}
    size = np.array([len(d) for d in docs], dtype=np.int64)
    start = np.cumsum(size + 1) - size                   # a mark before each document and after the last
    word = np.empty(int((size + 1).sum()) + 1, dtype=np.int64)
    for s, d in zip(start.tolist(), docs):
        word[s:s + len(d)] = [names.setdefault(w, len(names)) for w in d]
    marks = np.concatenate([start - 1, [len(word) - 1]])
    word[marks] = len(names) + np.arange(len(marks))
    at, p = candidates(word, start, size, least, times)
    found = np.zeros((0, 3), dtype=np.int64)
    if len(at):
        grammar = Grammar(word, len(names))
        after = grammar.extend(at, at + p, True)
        before = grammar.extend(at, at + p, False)
        length = before + after + p
        ok = length >= np.maximum(least, times * p)
        found = np.stack([at[ok] - before[ok], length[ok], p[ok]], axis=1)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        if len(found):                                   # of one stretch the smallest period
            found = found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])]
            found = found[np.lexsort((found[:, 2], found[:, 0]))]
    cut = np.searchsorted(found[:, 0], start[1:])
    out = np.split(found, cut)
    for rows, s in zip(out, start.tolist()):
        rows[:, 0] -= s
    return out


def kept_words(n: int, rows: np.ndarray) -> np.ndarray:
    """False for words that a run holds beyond its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edge, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def with_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One document in ten, as its id decides, with its later words made periodic."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


OUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find_runs(docs: DataFrame, text: str = "text", key: str | None = None, edited: bool = False) -> DataFrame:
    """``docs`` with n_words, runs and the collapsed text (words beyond a run's first period left out).

    With ``edited`` the texts are first edited as ``with_period`` says for the id ``key``.
    """
    short_batches(docs.sparkSession)
    new = [c.split()[0] for c in OUT.split(", ")]
    base = docs.select(*[docs[c] for c in docs.columns if c not in new or c == text])
    names = base.columns
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(names.index(text)).to_pylist()
            ids = b.column(names.index(key)).to_pylist() if key else [None] * len(texts)
            lo, held, total = 0, [], 0
            for i, t in enumerate(texts):
                held.append(with_period(words_of(t), ids[i]) if edited else words_of(t))
                total += len(held[-1])
                if total >= WORDS or i == len(texts) - 1:
                    found = runs(held)
                    left = [b" ".join([w for w, k in zip(d, kept_words(len(d), r)) if k] if len(r) else d).decode("utf-8", "surrogatepass")
                            for d, r in zip(held, found)]
                    flat = np.concatenate(found)
                    structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(run_type.value_type))
                    ends = np.concatenate([[0], np.cumsum([len(r) for r in found])])
                    yield pa.RecordBatch.from_arrays(
                        [*[c.slice(lo, len(held)) for c in b.columns], pa.array([len(d) for d in held], pa.int64()),
                         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs), pa.array(left, pa.string())],
                        names=[*names, *new])
                    lo, held, total = i + 1, [], 0

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields], OUT])
    return base.mapInArrow(run, schema)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the longest run and digests of all."""
    # the longest; ties: smallest start, then period
    top = F.get(F.sort_array(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    row = found.withColumn("top", top)
    length = -F.col("top.less")
    return row.select(F.col(key), F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"),
                      F.col("top.period").alias("period"), F.expr("1000 * -top.less div top.period").alias("exponent_milli"),
                      F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                      F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), F.col("n_words"))
