"""N-gram Jaccard join by prefix trees, exact, to connected components.

A document's set holds the 64-bit hashes of its distinct n-word shingles.  All
sets are ordered alike: by how common a shingle is in the whole corpus (classes
of a fixed-size count table over all documents, rare first), then by hash.

Finding who may link.  The order's range is cut into equal intervals in each
class, their number by the set's size (a level).  Two sets of similarity t differ
in at most ``slack(n)`` = n (1 - t) / t shingles and each differing shingle spoils
one interval.  Rank a set's filled intervals by anything that depends on their
content alone; then of the intervals that both sets fill alike, the first is among
the first slack + 1 of either, as only spoilt ones come before it.  So a set emits
one key, the hash of an interval's shingles, for each of its first slack + 1:
those of rare shingles first, then those of most shingles, which chance or a
shared passage seldom fills alike.  A set also emits the keys of the next lower
level if a smaller partner may use it, and of higher ones while it fills too few
intervals; the smaller set of a pair decides the level, so both share one at which
the argument holds.  Nothing is missed, whatever the data.

Documents with equal keys are joined into candidate groups: stars around the
least id, first in each task, then in each key's partition, then components.

Verifying.  A group's sets go to blocks of at most ``BLOCK`` sets.  In a block
the ordered sets form a radix trie; a probe walks it breadth first, adds a node's
overlap once for all sets below it and leaves a subtree when the overlap so far
plus what remains of probe and subtree cannot reach the threshold.  The first
round compares each block with itself and with block 0.  Groups that then still
hold several components get a second round, in which all sets outside the largest
component are compared with the whole group.  Only edges of spanning stars leave
a block, never pairs.

Equal sets are merged before all this.  What reaches the driver is the count
table (``CELLS`` numbers) at every size of input.

Defined cases: texts are lower-cased A-Z and split at ASCII white space; a text
with fewer than n words is one shingle; null texts and texts without words have
no shingles and link with nothing; rows that share an id are one document; a null
id is a document of its own name and comes before all; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, id_filter, parts, short_batches, staged
from .graph import components

WORDS, PERCENT = 3, 90
BLOCK = 512
CELLS, SLICES = 1 << 20, 1024
WORD_MEMO = 50_000
#: Keys that a task puts together before it passes them on.
KEYS_HELD = 500_000
LEAST = -(2 ** 63)

_P1, _P2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)
_word_hash = Memo(xxhash.xxh3_64_intdigest, WORD_MEMO)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _P2
        x = (x ^ (x >> np.uint64(29))) * _P1
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, n_words: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.array([_word_hash[x] for x in words], dtype=np.uint64)
    n = min(n_words, len(w))
    out = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        with np.errstate(over="ignore"):
            out = _mix(out * _P1 + w[i:len(w) - n + 1 + i])
    return np.unique(out)


def slack(n: int, percent: int) -> int:
    """Most shingles in which a set of ``n`` may differ, both ways together, from one it links with."""
    return n * (100 - percent) // percent


def needed(a, b, percent: int):
    """Least overlap with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


#: Levels of interval counts grow by this factor.
STEP = 1.5


@lru_cache
def _density(percent: int) -> float:
    """Most shingles to an interval, on average, at which intervals of two or more still outnumber the slack."""
    want = 1.07 * (100 - percent) / percent
    dense = [x / 20 for x in range(20, 2000) if (1 - math.exp(-x / 20) * (1 + x / 20)) / (x / 20) >= want]
    return max(dense, default=1.0)


@lru_cache(maxsize=1 << 16)
def _level(n: int, percent: int) -> int:
    level, most = 0, _density(percent)
    while n / intervals(level) > most:
        level += 1
    return level


def intervals(level: int) -> int:
    return int(STEP ** level)


def keys(s: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The keys under which a set meets every set it links with."""
    n = len(s)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    kind = classes[(s >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)]
    order = np.argsort(kind, kind="stable")            # s is sorted, so this orders by (class, hash)
    kind, s = kind[order].astype(np.uint64), s[order]
    mixed = _mix(s)
    most, out = slack(n, percent), []
    own, level = _level(n, percent), _level(max(1, n * percent // 100), percent)
    while True:
        place = (kind << np.uint64(40)) | ((s >> np.uint64(32)) * np.uint64(intervals(level)) >> np.uint64(32))
        first = np.nonzero(np.concatenate([[True], place[1:] != place[:-1]]))[0]
        count = np.diff(np.concatenate([first, [n]]))
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mixed, first)
            key = _mix(total * _P1 + (place[first] << np.uint64(8)) + np.uint64(level)) ^ _mix(count.astype(np.uint64))
        if len(first) > most + 1:                      # rare shingles first, then full intervals
            key = key[np.lexsort((key, -count, kind[first]))[:most + 1]]
        out.append(key)
        if level >= own and len(first) > most:
            return np.unique(np.concatenate(out))
        level += 1


class Trie:
    """Radix trie of ordered sets, as arrays; nodes of one level are contiguous."""

    def __init__(self, seqs: list[np.ndarray]):
        order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())
        sizes = np.array([len(seqs[i]) for i in order], dtype=np.int64)
        self.members, self.sizes = np.array(order), sizes
        tokens, rows, todo = [], [], [(0, len(order), 0)]
        at = 0
        # each entry: sorted sets lo to hi that agree on their first ``depth`` tokens
        levels, self.level_of = [0], []
        children = []
        while todo:
            nxt = []
            for lo, hi, depth in todo:
                here = []
                i = lo
                while i < hi and sizes[i] == depth:
                    i += 1
                while i < hi:
                    j = i + 1
                    head = seqs[order[i]][depth]
                    while j < hi and seqs[order[j]][depth] == head:
                        j += 1
                    a, z = seqs[order[i]], seqs[order[j - 1]]
                    m = min(len(a), len(z))
                    diff = np.nonzero(a[depth:m] != z[depth:m])[0]
                    end = depth + int(diff[0]) if len(diff) else m
                    here.append(len(rows))
                    k = i
                    while k < j and sizes[k] == end:
                        k += 1
                    rows.append((at, end - depth, end, i, k, sizes[i:j].min(), sizes[i:j].max(), i, j))
                    tokens.append(a[depth:end])
                    at += end - depth
                    nxt.append((k, j, end))
                    i = j
                children.append(here)
            todo = nxt
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
        cols = np.array(rows, dtype=np.int64).reshape(-1, 9).T
        self.start, self.length, self.depth, self.own_lo, self.own_hi, self.least, self.most, self.lo, self.hi = cols
        self.roots = np.array(children[0], dtype=np.int64)
        kids = children[1:]
        self.kid_count = np.array([len(k) for k in kids], dtype=np.int64)
        self.kid_start = np.concatenate([[0], np.cumsum(self.kid_count)[:-1]]).astype(np.int64) if kids else self.kid_count
        self.kids = np.array([c for k in kids for c in k], dtype=np.int64)

    def links(self, mark: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Sets that link with the probe whose tokens are marked and number ``n``."""
        at, over, found = self.roots, np.zeros(len(self.roots), dtype=np.int64), []
        while len(at):
            size = self.length[at]
            first = np.cumsum(size) - size
            place = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(self.start[at], size)
            over = over + np.add.reduceat(mark[self.tokens[place]], first)
            ends = np.nonzero(self.own_hi[at] > self.own_lo[at])[0]
            for e in ends[over[ends] >= needed(n, self.depth[at[ends]], percent)]:
                found.append(self.members[self.own_lo[at[e]]:self.own_hi[at[e]]])
            rest = np.minimum(self.most[at] - self.depth[at], n - over)
            small = np.maximum(self.least[at], -(-n * percent // 100))
            go = (over + rest >= needed(n, small, percent)) & (self.kid_count[at] > 0) & (self.most[at] >= small)
            at, over = at[go], over[go]
            count = self.kid_count[at]
            first = np.cumsum(count) - count
            place = np.arange(count.sum()) - np.repeat(first, count) + np.repeat(self.kid_start[at], count)
            at, over = self.kids[place], np.repeat(over, count)
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def join_block(sets: list[np.ndarray], probes: list[int], percent: int, parts_of: list[int] | None = None) -> list[int]:
    """For each set the least index of its part, joining the linked probes; ``parts_of`` are parts known before."""
    lead = list(range(len(sets)))

    def root(i: int) -> int:
        while lead[i] != i:
            lead[i] = lead[lead[i]]
            i = lead[i]
        return i

    left = len(sets)

    def unite(i: int, j: int) -> None:
        nonlocal left
        a, b = root(i), root(j)
        if a != b:
            lead[max(a, b)] = min(a, b)
            left -= 1

    if parts_of is not None:
        seen: dict[int, int] = {}
        for i, p in enumerate(parts_of):
            unite(i, seen.setdefault(p, i))
    if left > 1 and probes:
        pool, where = np.unique(np.concatenate(sets), return_inverse=True)
        # most common first: sets that are alike then share long paths
        rank = np.empty(len(pool), dtype=np.int64)
        rank[np.argsort(-np.bincount(where, minlength=len(pool)), kind="stable")] = np.arange(len(pool))
        ends = np.cumsum([len(s) for s in sets])
        seqs = [np.sort(r) for r in np.split(rank[where], ends[:-1])]
        trie = Trie(seqs)
        mark = np.zeros(len(pool), dtype=np.int64)
        for i in probes:
            if left == 1:
                break
            mark[seqs[i]] = 1
            for j in trie.links(mark, len(seqs[i]), percent).tolist():
                unite(i, j)
            mark[seqs[i]] = 0
    return [root(i) for i in range(len(sets))]


def set_name(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves of a hash of a set; equal sets have equal ones."""
    digest = xxhash.xxh3_128_intdigest(s.tobytes())
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


_LIGHT = "id long, n int, h1 long, h2 long, slice int, counts binary"


def _first_pass(n_words: int):
    """One row for each document with its set's size and hash, and the task's shingle counts by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.uint32)
        shift = np.uint64(64 - CELLS.bit_length() + 1)
        names = [f.split()[0] for f in _LIGHT.split(", ")]
        any_row = False
        for b in batches:
            cells, size, h1, h2 = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, n_words)
                a, b2 = set_name(s)
                size.append(len(s))
                h1.append(a)
                h2.append(b2)
                cells.append((s >> shift).astype(np.int64))
            got = np.concatenate(cells) if cells else np.zeros(0, np.int64)
            total += np.bincount(got, minlength=CELLS).astype(np.uint32)
            any_row = any_row or len(got) > 0
            m = len(size)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if any_row:
            cut = total.reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int32()), pa.nulls(SLICES, pa.int64()),
                 pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()),
                 pa.array([c.astype("<u4").tobytes() for c in cut], pa.binary())], names=names)
    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got = np.frombuffer(raw, "<u4").astype(np.int64)
            sums[i] = sums[i] + got if i in sums else got
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                          pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())],
                                         names=["slice", "counts"])


def rarity(light: DataFrame) -> np.ndarray:
    """Class of each cell: 0 unless its shingles are much more common than the mean, then by powers of 4."""
    spark = light.sparkSession
    got = (light.where("slice is not null").select("slice", "counts").repartition(parts(spark), "slice")
           .mapInArrow(_add_slices, "slice int, counts binary").collect())
    counts = np.zeros((SLICES, CELLS // SLICES), dtype=np.int64)
    for r in got:
        counts[r.slice] += np.frombuffer(bytes(r.counts), "<i8")
    mean = counts.sum() / CELLS
    over = np.maximum(counts.reshape(-1) - mean - 6 * np.sqrt(mean), 0) / 32
    return np.where(over > 1, 1 + np.floor(np.log2(np.maximum(over, 1)) / 2), 0).astype(np.uint8)


def _emit_keys(n_words: int, percent: int, classes: np.ndarray, n_buckets: int):
    """Keys with the names of their sets, packed by bucket; keys that repeat in the task are joined there.

    A set goes by the first half of its hash, so that every text of an id is a node of its own.
    """
    schema = ["bucket", "keys", "ids"]

    def packed(ks: list[np.ndarray], ids: list[int]) -> Iterator[pa.RecordBatch]:
        k = np.concatenate(ks)
        d = np.repeat(np.array(ids, dtype=np.int64), [len(x) for x in ks])
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        head = np.concatenate([[True], k[1:] != k[:-1]])
        least = d[head][np.cumsum(head) - 1]
        rows = []
        star = ~head & (d != least)
        if star.any():                                 # bucket -1: candidate edges
            pairs = np.unique(np.stack([d[star], least[star]]), axis=1)
            rows.append((-1, pairs[0].astype("<i8").tobytes(), pairs[1].astype("<i8").tobytes()))
        k, d = k[head], d[head]
        bucket = (_mix(k) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        k, d, bucket = k[order], d[order], bucket[order]
        cut = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0]
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(k)]):
            rows.append((int(bucket[a]), k[a:z].astype("<u8").tobytes(), d[a:z].astype("<i8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                         names=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, ids, held = [], [], 0
        for b in batches:
            for t in b.column(1).to_pylist():
                s = shingles(t, n_words)
                k = keys(s, classes, percent)
                if len(k):
                    ks.append(k)
                    ids.append(set_name(s)[0])
                    held += len(k)
                if held > KEYS_HELD:
                    yield from packed(ks, ids)
                    ks, ids, held = [], [], 0
        if ids:
            yield from packed(ks, ids)
    return run


def _bucket_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for each set and the least one with a key of the same value, in one partition of buckets."""
    ks, ds = [], []
    for b in batches:
        for bucket, k, d in zip(*[b.column(i).to_pylist() for i in range(3)]):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, "<i8")), pa.array(np.frombuffer(d, "<i8"))],
                                                 names=["a", "b"])
            else:
                ks.append(np.frombuffer(k, "<u8"))
                ds.append(np.frombuffer(d, "<i8"))
    if ks:
        k, d = np.concatenate(ks), np.concatenate(ds)
        del ks, ds
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        head = np.concatenate([[True], k[1:] != k[:-1]])
        start = np.nonzero(head)[0]
        least = np.minimum.reduceat(d, start)[np.cumsum(head) - 1]
        star = d != least
        if star.any():
            pairs = np.unique(np.stack([d[star], least[star]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _blocks(n_words: int, percent: int):
    """Joins block after block of a partition sorted by block; emits an edge for each joined set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sets, probes, known = None, {}, [], [], []

        def close():
            lead = join_block(sets, probes, percent, known if known and known[0] is not None else None)
            names = [doc for doc, _ in ids]
            out = [(names[i], names[j]) for i, j in enumerate(lead) if i != j]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()),
                                               pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

        for b in batches:
            for g, i, j, doc, probe, part, text in zip(*[b.column(c).to_pylist() for c in range(7)]):
                if (g, i, j) != block:
                    if len(sets) > 1:
                        yield close()
                    block, ids, sets, probes, known = (g, i, j), {}, [], [], []
                if (doc, text) in ids:                  # a repeated row
                    continue
                ids[doc, text] = len(sets)
                if probe:
                    probes.append(len(sets))
                sets.append(shingles(text, n_words))
                known.append(part)
        if len(sets) > 1:
            yield close()
    return run


_BLOCK_ROW = "g long, i int, j int, id long, probe boolean, part long, text string"


def _compare(tasks: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Edges (a, b) of the blocks ``tasks``: (g, i, j, id, probe, part, text)."""
    cols = [f.split()[0] for f in _BLOCK_ROW.split(", ")]
    dealt = (tasks.select(*cols).repartition(parts(tasks.sparkSession), "g", "i", "j")
             .sortWithinPartitions("g", "i", "j", "id", F.desc("probe")))
    return dealt.mapInArrow(_blocks(n_words, percent), "a long, b long")


def near_duplicates(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT, key: str = "doc_id",
                    text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets.
    """
    spark = docs.sparkSession
    short_batches(spark)
    if not 0 < percent < 100:
        raise ValueError("percent lies between 0 and 100")
    rows = docs.select(F.coalesce(docs[key].cast("long"), F.lit(LEAST)).alias("id"), docs[text].alias("text"))
    light = staged(rows.mapInArrow(_first_pass(n_words), _LIGHT), "sets")
    classes = rarity(light)
    sets = light.where("slice is null").select("id", "n", "h1", "h2")
    # equal sets are one: the least id stands for all
    merged = staged(sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep")), "merged")
    member = staged(sets.join(merged, ["n", "h1", "h2"], "left")
                    .select("id", "n", F.coalesce("rep", "id").alias("rep")), "members")

    emitted = rows.mapInArrow(_emit_keys(n_words, percent, classes, _buckets(spark)), "bucket int, keys binary, ids binary")
    where = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("keys"), F.lit(_buckets(spark))).cast("int"))
    stars = emitted.repartitionById(_buckets(spark), where).mapInArrow(_bucket_stars, "a long, b long").distinct()
    sets_of = components(stars).toDF("h1", "g")
    # from sets to the ids that stand for them; an id comes with all its texts
    groups = staged(sets_of.join(merged.select("h1", F.col("rep").alias("id")), "h1").select("id", "g").distinct(), "groups")

    size = groups.groupBy("g").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("nb"))
    placed = (groups.join(size, "g")
              .withColumn("i", F.pmod(F.xxhash64("id"), "nb").cast("int")))
    # only texts that may be in a group enter the join
    placed = staged(placed, "places")
    texts = rows.where(id_filter(placed, "id")(F.col("id")))
    placed = staged(placed.join(texts, "id").select("id", "g", "nb", "i", "text"), "placed")
    none = F.lit(None).cast("long").alias("part")
    # block i with itself, and as probes against block 0
    own = placed.select("g", "i", F.col("i").alias("j"), "id", F.lit(True).alias("probe"), none, "text")
    many = placed.where("nb > 1")
    against = many.where("i > 0").select("g", F.lit(0).alias("i"), F.col("i").alias("j"), "id", F.lit(True).alias("probe"), none, "text")
    zero = many.where("i = 0").select("g", F.lit(0).alias("i"), F.explode(F.sequence(F.lit(1), F.col("nb") - 1)).alias("j"),
                                      "id", F.lit(False).alias("probe"), none, "text")
    edges = staged(_compare(own.unionByName(against).unionByName(zero), n_words, percent), "links")
    found = staged(components(edges).toDF("id", "part"), "parts")

    # second round: large groups that still hold several parts
    large = many.select("id", "g").join(found, "id", "left").select("id", "g", F.coalesce("part", "id").alias("part"))
    counts = large.groupBy("g", "part").agg(F.count("*").alias("n"))
    main = counts.groupBy("g").agg(F.count("*").alias("n_parts"), F.sum("n").alias("n_all"),
                                   F.max(F.struct("n", "part")).alias("top")).where("n_parts > 1")
    open_groups = staged(main.select("g", F.col("top.part").alias("top"), F.col("n_all"),
                                     F.ceil((F.col("n_all") - F.col("top.n")) / F.lit(block)).cast("int").alias("np")), "open")
    if not open_groups.isEmpty():
        rest = many.join(open_groups, "g").join(large.distinct(), ["id", "g"])
        probes = rest.where("part <> top").select(
            "g", F.pmod(F.xxhash64("id", F.lit(3)), "np").cast("int").alias("i"),
            F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), "id", F.lit(True).alias("probe"), "part", "text")
        others = rest.select("g", F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("i"), F.col("i").alias("j"), "id",
                             F.lit(False).alias("probe"), "part", "text")
        more = _compare(probes.unionByName(others), n_words, percent)
        edges = staged(edges.unionByName(more), "links")
        found = staged(components(edges).toDF("id", "part"), "parts")

    # an id whose rows have several sets ties their stand-ins together
    several = staged(member.where("n > 0").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z"), "several")
    if not several.isEmpty():
        ties = member.where("n > 0").join(several, "id").select("a", F.col("rep").alias("b")).where("a <> b")
        # a text's edges go by its id, which all its stand-ins are tied to as well
        own = several.select(F.col("a"), F.col("id").alias("b")).where("a <> b")
        edges = edges.unionByName(ties).unionByName(own)
        found = staged(components(edges).toDF("id", "part"), "parts")
    out = member.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    name = F.coalesce("part", "rep")
    return out.select(F.nullif(F.col("id"), F.lit(LEAST)).alias(key), F.col("n").cast("long").alias("n_shingles"),
                      F.nullif(name, F.lit(LEAST)).alias("component_id"))


def _buckets(spark) -> int:
    return max(1, parts(spark))
