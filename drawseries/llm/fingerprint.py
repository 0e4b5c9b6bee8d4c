"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed left to right into phrases: the shortest string from here on
that is not yet in the document's dictionary, which it then joins.  The set of
phrase hashes is signed by one-permutation minimum hashing: each hash falls into
one of ``BINS`` bins and each bin keeps its least hash, so that the share of
equal bins estimates how much of their dictionaries two texts have in common,
much as compressing them together would.

A fingerprint is a string of 4 hexadecimal digits for each bin; ``----`` marks a
bin without a phrase.

Defined cases: a null text is empty; the empty text has only empty bins and is
like another empty text (1) and like no other (0); equal texts have equal
fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches
from .ordered import block_bounds, deal, sorted_blocks

BINS = 128
EMPTY = "----"

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(1099511628211)
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of ``_BASE``, kept for later texts."""
    global _POWERS
    while len(_POWERS) < n:
        with np.errstate(over="ignore"):
            more = _POWERS * (_POWERS[-1] * _BASE)
        _POWERS = np.concatenate([_POWERS, more])
    return _POWERS[:n]


class Parse:
    """A parse that can be continued, and continued again from a marked place.

    The dictionary is a trie of dicts by character; a node keeps its phrase's length
    under the empty string.  Phrases follow each other in the text, so their lengths
    name them; what is left unfinished at the text's end is already a phrase.
    """

    __slots__ = ("root", "node", "lengths", "text", "undo")

    def __init__(self):
        self.root = {"": 0}
        self.node = self.root
        self.lengths: list[int] = []
        self.text: list[str] = []
        self.undo = None                                 # after a mark: (node, character) of each new phrase

    def feed(self, text: str) -> None:
        root, node, add = self.root, self.node, self.lengths.append
        self.text.append(text)
        if self.undo is None:
            for c in text:
                child = node.get(c)
                if child is None:
                    n = node[""] + 1
                    node[c] = {"": n}
                    add(n)
                    node = root
                else:
                    node = child
        else:
            made = self.undo.append
            for c in text:
                child = node.get(c)
                if child is None:
                    n = node[""] + 1
                    node[c] = {"": n}
                    add(n)
                    made((node, c))
                    node = root
                else:
                    node = child
        self.node = node

    def mark(self) -> tuple:
        self.undo = []
        return len(self.lengths), self.node, len(self.text)

    def back(self, mark: tuple) -> None:
        size, self.node, texts = mark
        for node, c in reversed(self.undo):
            del node[c]
        self.undo = []
        del self.lengths[size:], self.text[texts:]

    def hashes(self) -> np.ndarray:
        """One hash for each phrase: the sum of its code points times powers by their place in it, mixed."""
        n = len(self.lengths)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        size = np.array(self.lengths)
        total = int(size.sum())
        code = np.frombuffer("".join(self.text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)[:total].astype(np.uint64)
        first = np.cumsum(size) - size
        place = np.arange(total) - np.repeat(first, size)
        with np.errstate(over="ignore"):
            return _mixed(np.add.reduceat((code + np.uint64(1)) * _powers(int(size.max()))[place], first))


def signature(hashes: np.ndarray) -> np.ndarray:
    """For each bin the low 16 bits of its least hash, or -1."""
    out = np.full(BINS, -1, dtype=np.int64)
    if len(hashes):
        order = np.sort(hashes)                       # bins are the top bits, so a bin's least comes first
        bins = (order >> np.uint64(57)).astype(np.int64)
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        out[bins[first]] = (order[first] & np.uint64(0xFFFF)).astype(np.int64)
    return out


def as_text(sig: np.ndarray) -> str:
    return "".join([EMPTY if v < 0 else f"{v:04x}" for v in sig.tolist()])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either fills; 1 for two empty signatures."""
    used = (a >= 0) | (b >= 0)
    n = int(used.sum())
    return 1.0 if n == 0 else float(((a == b) & used).sum()) / n


def fingerprint(text: str) -> str:
    p = Parse()
    p.feed(text)
    return as_text(signature(p.hashes()))


OUT = ("doc_id long, n_chars long, text string, edited string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block in order, each beside the next; a block ends with the next block's first row."""
    names = [f.split()[0] for f in OUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None                                        # (block, doc_id, text, parse state)
    ended = None
    for b in batches:
        out = []
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("block", "after", "k", "text")]
        for block, after, doc, text in zip(*cols):
            if block == ended:                          # more rows of the next block's first key
                continue
            text = text or ""
            q = len(text) // 4
            p = Parse()
            p.feed(text[:len(text) - q])
            cut = p.mark()
            p.feed(text[len(text) - q:])
            sig = signature(p.hashes())
            if held is not None:
                _, d, t, hp, hcut, hsig = held
                part = text[:len(t) // 4]
                hp.back(hcut)
                hp.feed(part)
                esig = signature(hp.hashes())
                out.append((d, len(t), t, t[:len(t) - len(t) // 4] + part, as_text(hsig), as_text(esig),
                            likeness(hsig, esig), likeness(hsig, sig)))
            held, ended = (None, block) if after else ((block, doc, text, p, cut, sig), None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its edited text, both fingerprints and their likeness to it and to the next document.

    The edited text has the last floor(n/4) code points replaced by the first as
    many (or all) of the next document in ascending key order; after the last comes
    the first.  Null keys come first; documents that share a key are in the order
    of their text's hash.  Rows are dealt once into blocks of ascending keys, and
    each block also gets the first row of the next, so every text is shuffled once.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("text"))
    bounds = block_bounds(rows, "k")
    rows = deal(rows.withColumn("h", F.xxhash64("text")), "k", bounds)
    # the blocks that have rows, with their first key: one entry a block
    firsts = sorted((r.block, r.first[0], r.first[1]) for r in rows.select("block", "k", "h").groupBy("block")
                    .agg(F.min(F.struct(F.coalesce("k", F.lit(-(2 ** 63))).alias("k"), "h")).alias("first")).collect())
    before = {(b, k, h): firsts[i - 1][0] for i, (b, k, h) in enumerate(firsts)}
    lookup = docs.sparkSession.createDataFrame(
        [(b, k, h, to) for (b, k, h), to in before.items()], "fb int, fk long, fh long, to int")
    first = F.broadcast(lookup)                        # one row a block
    copies = (rows.join(first, (rows["block"] == F.col("fb")) & (rows["h"] == F.col("fh"))
                        & (F.coalesce(rows["k"], F.lit(-(2 ** 63))) == F.col("fk")))
              .select(F.col("to").alias("block"), "k", "text", "h", F.lit(True).alias("after")))
    # copies of the very same first row are alike, so one for each block is enough
    copies = copies.dropDuplicates(["block"])
    dealt = rows.select("block", "k", "text", "h", F.lit(False).alias("after")).unionByName(copies)
    return sorted_blocks(dealt, len(bounds) + 1, "after", "k", "h").mapInArrow(_pairs, OUT)
