"""Byte-level BPE encoding and decoding with a rank file, without merging bytes.

A piece of text is encoded from longest matches found by an Aho-Corasick
automaton over the vocabulary (bytes mapped one to one to Latin-1 characters).
Tokens are laid from the left, longest first; a token is kept only beside a
neighbour it is compatible with, that is, if byte pair merging would never have
joined bytes across the seam.  On a dead end the last token is taken back and a
shorter one tried; ends found dead are marked, so each position is left at most
once and the work is linear in the piece.  Compatibility of a pair of tokens
depends on nothing else and is memoised.

A worker keeps the tables and two bounded memos (pieces, and chunks between
single spaces) over its tasks; clearing a memo changes no result.  Nothing is
shuffled or collected.

Defined cases: null and empty texts have no ids and decode to no bytes; any
string is ordinary text (no special tokens); repeated rows are encoded alike;
other columns pass through unchanged, and one named like an output column is
replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StructField, StructType

from .common import Memo, short_batches

#: Fixed value: the pattern of the public byte-level vocabulary, whose texts may be cut at single spaces.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that either half of a worker's memo may hold.
MEMO = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from lines of base64 bytes and rank."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class Encoder:
    """Encodes pieces and whole texts; one per worker process and vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.text = {rank: token for token, rank in self.ids.items()}
        self.pieces = regex.compile(pattern)
        #: with this pattern a match starts at each single space, and letters, or one mark behind them, are one match
        self.shortcuts = pattern == BYTE_LEVEL
        self.marks = frozenset(".,;:!?")
        self.finder = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.finder.add_word(token, (rank, len(token) - 1))
        self.finder.make_automaton()
        self.width = {rank: len(token) for token, rank in self.ids.items()}
        self.shorter = {rank: self._prefix(token) for token, rank in self.ids.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits_memo = Memo(self._fits, MEMO)
        self.piece_memo = Memo(lambda p: self._raw(self.piece(p)), MEMO)
        self.chunk_memo = Memo(self._by_pattern, MEMO)
        self.line_feed = self._raw([self.ids["\n"]]) if "\n" in self.ids else b""
        #: white space besides the two characters that texts are cut at
        self.odd_space = regex.compile(r"[^\S \n]")

    @staticmethod
    def _raw(ids) -> bytes:
        return array("i", ids).tobytes()

    def _prefix(self, token: str) -> int | None:
        """The longest token that is a proper prefix."""
        for n in range(len(token) - 1, 0, -1):
            if (got := self.ids.get(token[:n])) is not None:
                return got
        return None

    def halves_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            part = list(self.text[token])
            while len(part) > 2:
                joins = [self.ids.get(a + b, 1 << 62) for a, b in zip(part, part[1:])]
                at = joins.index(min(joins))
                part[at:at + 2] = [part[at] + part[at + 1]]
            self.halves[token] = (self.ids[part[0]], self.ids[part[1]]) if len(part) == 2 else None
        return self.halves[token]

    def _fits(self, seam: tuple[int, int]) -> bool:
        """Whether the two tokens stay two when their bytes meet.

        Undoes merges on either side of the seam, latest first, and looks at each
        step for a merge over the seam that would have come before the merge just
        undone.
        """
        left, right = seam
        undone = 1 << 62
        while True:
            over = self.ids.get(self.text[left] + self.text[right])
            if over is not None and over < undone:
                return False
            a, b = self.halves_of(left), self.halves_of(right)
            if a and (left > right or not b):
                # merges left of the seam come first among equals
                undone, left = left, a[1]
            elif b:
                undone, right = right + 1, b[0]
            else:
                return True

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        raw = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ids.get(raw)
        if whole is not None:
            return (whole,)
        n = len(raw)
        # matches come by their ends, so the last one from a start is its longest
        match = [0] * n
        for end, (token, before) in self.finder.iter(raw):
            match[end - before] = token
        width, fits, shorter = self.width, self.fits_memo, self.shorter
        alive = [True] * (n + 1)
        out: list[int] = []
        pos, last = 0, -1
        token: int | None = match[0]
        while True:
            while token is not None:
                end = pos + width[token]
                if alive[end] and (last < 0 or fits[last, token]):
                    break
                token = shorter[token]
            if token is None:                            # a dead end: take the last token back
                alive[pos] = False
                token = out.pop()
                pos -= width[token]
                last = out[-1] if out else -1
                token = shorter[token]
                continue
            out.append(token)
            if end == n:
                return tuple(out)
            pos, last, token = end, token, match[end]

    def _by_pattern(self, text: str) -> bytes:
        if self.shortcuts and (text.isascii() or max(text) < "\u0250"):
            if text.isalpha() or (text[:1] == " " and text[1:].isalpha()):
                return self._raw(self.piece(text))       # one match
            if text[-1:] in self.marks and text[:-1].strip(" ").isalpha() and text[:2] != "  ":
                return self.chunk_memo[text[:-1]] + self.piece_memo[text[-1]]
        memo = self.piece_memo
        return b"".join([memo[p] for p in self.pieces.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers, each match of the pattern encoded separately.

        With the public byte-level pattern the text is first cut before single spaces and
        around single line feeds that stand between other characters: a match always
        starts there, so the cut parts can be memoised.
        """
        if not self.shortcuts or self.odd_space.search(text):
            return self._by_pattern(text)
        memo, out = self.chunk_memo, []
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if not line or line[0] == " " or line[-1] == " ":
                if len(lines) > 1:                      # runs of white space across lines
                    return self._by_pattern(text)
            if i:
                out.append(self.line_feed)
            words = line.replace(" ", "\0 ").split("\0") if "\0" not in line else ["  "]
            if "  " in line or "  " in words:           # runs of spaces
                out.append(self._by_pattern(line))
                continue
            out += [memo[w] for w in words]
        return b"".join(out)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def _coded(enc: Encoder, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's end)."""
    raw = [enc.encode(t) if t else b"" for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.int32), np.cumsum([0, *map(len, raw)]) // 4


_TABLES: dict[str, pa.Array] = {}


def token_table(path: str) -> pa.Array:
    """Token bytes by id."""
    if path not in _TABLES:
        ranks = read_ranks(path)
        tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for raw, rank in ranks.items():
            tokens[rank] = raw
        _TABLES[path] = pa.array(tokens, pa.binary())
    return _TABLES[path]


def _decoded(table: pa.Array, ids: pa.Array, ends: np.ndarray) -> pa.Array:
    """The bytes of the ids between each two ``ends``: tokens are gathered as one run of bytes, which the texts divide."""
    got = table.take(ids)
    if got.null_count:
        raise KeyError("an id that the vocabulary does not have")
    offsets = np.frombuffer(got.buffers()[1], dtype=np.int32) if len(got) else np.zeros(1, np.int32)
    at = pa.py_buffer(offsets[ends].astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, at, got.buffers()[2] if len(got) else pa.py_buffer(b"")])


def _mapped(df: DataFrame, source: str, new: dict[str, DataType], make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
            drop: bool = False) -> DataFrame:
    """All columns of ``df`` (``source`` unless dropped) and new ones made of column ``source``."""
    kept = [c for c in df.columns if c not in new or c == source]
    base = df.select(*[df[c] for c in kept])
    at = base.columns.index(source)
    fields = [f for i, f in enumerate(base.schema.fields) if not (drop and i == at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for b in batches:
            cols = [c for i, c in enumerate(b.columns) if not (drop and i == at)]
            yield pa.RecordBatch.from_arrays([*cols, *one(b.column(at))], names=[*[f.name for f in fields], *new])

    return base.mapInArrow(run, StructType([*fields, *[StructField(c, t) for c, t in new.items()]]))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the token ids of every whole text (array<int>)."""
    short_batches(df.sparkSession)

    def make():
        enc = encoder(path, pattern)

        def one(texts: pa.Array) -> list[pa.Array]:
            ids, ends = _coded(enc, texts.to_pylist())
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
        return one
    return _mapped(df, text, {out: ArrayType(IntegerType())}, make)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for (null ids: none)."""
    short_batches(df.sparkSession)

    def make():
        table = token_table(path)

        def one(rows: pa.Array) -> list[pa.Array]:
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False))])
            return [_decoded(table, rows.flatten(), ends)]
        return one
    return _mapped(df, ids, {out: BinaryType()}, make)


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ids instead of the text, and the bytes that those ids decode to: both ways in one pass."""
    short_batches(df.sparkSession)

    def make():
        enc, table = encoder(path, pattern), token_table(path)

        def one(texts: pa.Array) -> list[pa.Array]:
            ids, ends = _coded(enc, texts.to_pylist())
            ids = pa.array(ids)
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), _decoded(table, ids, ends)]
        return one
    return _mapped(df, text, {"ids": ArrayType(IntegerType()), "decoded": BinaryType()}, make, drop=True)
