"""Token ids in Simple-8b words: a word-aligned, block-wise binary format.

A 64-bit word holds a selector in its top 4 bits and, in the other 60, as many
ids of one bit width as fit.  Selector 0 is the escape for an id of more than 60
bits: its payload is a place in the block's list of raw 64-bit values, so that a
word never has to be read to know what the next one is.

A file is a Parquet table in the shared folder with a row for each block; a
block holds whole documents in ascending order of their ids, about ``IDS`` ids:

    block, first       place among the blocks; ids in all blocks before it in its deal
    doc_ids, counts    the documents and their numbers of ids
    words              little-endian 64-bit words, frames of ``FRAME`` ids coded apart
    frame_words        little-endian 32-bit word offset of each frame
    escapes            little-endian 64-bit raw values

Decoding takes a block's words at once, selector by selector, and may start at
any frame.

Defined cases: a null text is empty; a document without ids has count 0 (or 1
with an end id); null doc_ids come first; documents that share an id are in the
order of their text's hash; an empty table makes an empty file.  Other columns
are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import partial
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import Memo, short_batches
from .ordered import block_bounds, deal, sorted_blocks

#: (ids in a word, bits of each), by selector 1 to 14.
WIDTHS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
          (2, 30), (1, 60)]
ESCAPE = 0
#: Ids in a word by selector; the first id that each of the selectors 1 to 14 does not hold.
COUNTS = np.array([1] + [c for c, _ in WIDTHS], dtype=np.uint8)
BOUNDS = np.array([1 << b for _, b in WIDTHS], dtype=np.uint64)
FRAME = 1024
#: Narrower widths than one that starts at fewer places than this share are not tried.
RARE = 0.02
IDS = 1 << 16

FILE = ("deal int, block long, first long, doc_ids array<long>, counts array<int>, words binary, "
        "frame_words binary, escapes binary")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, frame offsets, escaped values) of an array of unsigned 64-bit ids."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    # an id's class: the first selector that holds it, 15 for none; behind a frame's end is nothing to hold
    rows = -(-n // FRAME)
    grid = np.zeros((rows, FRAME + WIDTHS[0][0]), dtype=np.uint64)
    grid[:n // FRAME, :FRAME] = ids[:n // FRAME * FRAME].reshape(-1, FRAME)
    grid[n // FRAME:, :n % FRAME] = ids[n // FRAME * FRAME:]
    top = ids.max()
    small = grid.astype(np.min_scalar_type(top))
    least = np.zeros(grid.shape, dtype=np.int8)
    for bound in BOUNDS[BOUNDS <= top]:
        least += small >= bound.astype(small.dtype)
    # for each place of a frame the selector that packs most ids from there on
    choice = np.full((rows, FRAME), ESCAPE, dtype=np.int8)
    most, seen = least[:, :FRAME].copy(), 1
    for s in range(len(WIDTHS), 0, -1):
        for seen in range(seen, WIDTHS[s - 1][0]):
            np.maximum(most, least[:, seen:seen + FRAME], out=most)
        seen = WIDTHS[s - 1][0]
        ok = most < s
        if ok.mean() < RARE:
            break
        np.putmask(choice, ok, s)
    starts = _starts(COUNTS[choice], n)
    sel = choice.reshape(-1)[starts]
    words = sel.astype(np.uint64) << np.uint64(60)
    flat, places = grid.reshape(-1), starts + starts // FRAME * WIDTHS[0][0]
    for s in range(1, len(WIDTHS) + 1):
        count, bits = WIDTHS[s - 1]
        mine = np.nonzero(sel == s)[0]
        if len(mine):
            at = places[mine]
            held = words[mine]
            for j in range(count):
                held |= flat[at + j] << np.uint64(bits * j)
            words[mine] = held
    raw = np.nonzero(sel == ESCAPE)[0]
    words[raw] |= np.arange(len(raw), dtype=np.uint64)
    frames = np.searchsorted(starts, np.arange(0, n, FRAME)).astype(np.uint32)
    return words, frames, ids[starts[raw]]


def _starts(counts: np.ndarray, n: int) -> np.ndarray:
    """Places under ``n`` at which words begin, if one at a place of a frame (row) takes so many ids, none behind the frame.

    All frames go on by a word at once.
    """
    rows = len(counts)
    steps = np.zeros((rows, FRAME + 1), dtype=np.uint8)              # none at a frame's end
    np.minimum(counts, np.minimum(FRAME - np.arange(FRAME), WIDTHS[0][0]).astype(np.uint8), out=steps[:, :-1])
    begins = np.zeros((rows, FRAME + 1), dtype=bool)
    flat, mark, at = steps.reshape(-1), begins.reshape(-1), np.arange(rows) * (FRAME + 1)
    for k in range(FRAME):
        if k % 16 == 0 and not flat[at].any():
            break
        mark[at] = True
        at += flat[at]
    return np.flatnonzero(begins[:, :-1].reshape(-1)[:n])


def unpack(words: np.ndarray, frames: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block: whole arrays of words at a time, by selector.

    Only a frame's last word may hold fewer ids than its selector allows, so the
    frame offsets place every word.
    """
    sel = (words >> np.uint64(60)).astype(np.int64)
    full = np.array([1] + [c for c, _ in WIDTHS], dtype=np.int64)[sel]
    before = np.cumsum(full) - full
    frame = np.searchsorted(frames, np.arange(len(words)), side="right") - 1
    starts = before - before[frames[frame]] + frame * FRAME if len(words) else before
    out = np.zeros(n, dtype=np.uint64)
    ends = np.concatenate([starts[1:], [n]]) if len(starts) else starts
    num = ends - starts
    body = words & np.uint64((1 << 60) - 1)
    for s in range(1, len(WIDTHS) + 1):
        count, bits = WIDTHS[s - 1]
        mine = np.nonzero(sel == s)[0]
        mask = np.uint64((1 << bits) - 1)
        for j in range(count):
            mine = mine[num[mine] > j]
            if not len(mine):
                break
            out[starts[mine] + j] = (body[mine] >> np.uint64(bits * j)) & mask
    raw = np.nonzero(sel == ESCAPE)[0]
    if len(raw):
        out[starts[raw]] = escapes[body[raw].astype(np.int64)]
    return out


def _blocks(encode: Callable[[], Callable[[list[str]], list[np.ndarray]]], end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encode()
        names = [f.split()[0] for f in FILE.split(", ")]
        deal_no, made, before = None, 0, 0
        doc_ids, counts, held, size = [], [], [], 0
        end = np.array([] if end_id is None else [end_id], np.uint64)

        def close():
            nonlocal doc_ids, counts, held, size, made, before
            ids = np.concatenate(held)
            words, frames, raw = pack(ids)
            row = [deal_no, made, before, doc_ids, counts, words.astype("<u8").tobytes(),
                   frames.astype("<u4").tobytes(), raw.astype("<u8").tobytes()]
            made, before = made + 1, before + len(ids)
            doc_ids, counts, held, size = [], [], [], 0
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(),
                     pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for b in batches:
            texts = ["" if t is None else t for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            rows = zip(b.column(b.schema.get_field_index("block")).to_pylist(),
                       b.column(b.schema.get_field_index("k")).to_pylist(), coder(texts))
            for block, doc, ids in rows:
                if block != deal_no:
                    if doc_ids:
                        yield close()
                    deal_no, made, before = block, 0, 0
                doc_ids.append(doc)
                counts.append(len(ids) + len(end))
                held += [ids, end]
                size += counts[-1]
                if size >= IDS:
                    yield close()
        if doc_ids:
            yield close()
    return run


def write_tokens(docs: DataFrame, encode: Callable[[], Callable[[list[str]], list[np.ndarray]]],
                 path: str | None = None, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Encode every whole text, write the file and return its path.

    ``encode()`` is called once in a task and returns a function from texts to arrays of ids.
    """
    spark = docs.sparkSession
    short_batches(spark)
    path = path or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("text"))
    bounds = block_bounds(rows, "k")
    rows = sorted_blocks(deal(rows, "k", bounds).withColumn("h", F.xxhash64("text")), len(bounds) + 1, "k", "h")
    rows.mapInArrow(_blocks(encode, end_id), FILE).write.parquet(path)
    return path


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The file's rows with ``start``: ids of all documents before the block.

    Only the blocks' totals are windowed: by deal and, within a deal, as written.
    """
    rows = spark.read.schema(FILE).parquet(path)
    totals = rows.groupBy("deal").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"))
    before = Window.orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("deal", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    # deals are bounded by the shuffle partitions the file was written with
    return rows.join(F.broadcast(offsets), "deal").withColumn("start", F.col("offset") + F.col("first")).drop("offset", "first")


def decode_tokens(blocks: DataFrame, as_u32: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents read back from the file's blocks.

    ``ids`` is array<long>, or with ``as_u32`` binary: little-endian 32-bit values.
    """
    short_batches(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                get = {name: b.column(i)[r].as_py() for i, name in enumerate(b.schema.names)}
                counts = np.array(get["counts"], dtype=np.int64)
                ids = unpack(np.frombuffer(get["words"], "<u8"), np.frombuffer(get["frame_words"], "<u4"),
                             np.frombuffer(get["escapes"], "<u8"), int(counts.sum()))
                ends = np.concatenate([[0], np.cumsum(counts)])
                if as_u32:
                    raw = ids.astype("<u4").tobytes()
                    col = pa.array([raw[4 * a:4 * e] for a, e in zip(ends[:-1], ends[1:])], pa.binary())
                else:
                    col = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(get["doc_ids"], pa.int64()), pa.array(get["start"] + ends[:-1], pa.int64()),
                     pa.array(counts, pa.int64()), col], names=["doc_id", "start", "n_tokens", "ids"])
    return blocks.select("start", "doc_ids", "counts", "words", "frame_words", "escapes").mapInArrow(
        run, f"doc_id long, start long, n_tokens long, ids {'binary' if as_u32 else 'array<long>'}")


#: Words that a worker remembers with their ids, up to twice as many for a while; the same for other parts of texts.
REMEMBERED = 150_000
#: Characters cut at a time, if no single text has more.
CUT_CHARS = 1 << 21
ID = attrgetter("id")
#: A run of marks behind letters is a piece of its own.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Parts between ASCII white space that have a character outside Latin-1 each.
OTHER = re.compile(r"(?<![^ \t-\r])PART(?:[ \t-\r]++PART)*+".replace("PART", r"[\x00-\x08\x0e-\x1f!-\xff]*+[^\x00-\xff][^ \t-\r]*+"))
#: Fixed value: the pattern that words and runs of marks are cut by.
WORDS_OR_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def library_encoder(tokenizer_path: str, remembered: int = REMEMBERED) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """Encoding with a file of the ``tokenizers`` library, without special tokens added.

    Each distinct word or run of marks is encoded once while it is remembered.  Latin-1
    is cut in arrays; parts between ASCII white space, which no token of these files
    crosses, with other characters are cut by the library.  A text that holds the string
    of an added token goes to the library whole.  Only for files whose pre-tokenizer
    drops white space.
    """
    return partial(_encoder, tokenizer_path, remembered)


def _encoder(tokenizer_path: str, remembered: int) -> Callable[[list[str]], list[np.ndarray]]:
    # an inner function would reach the workers with its own copy of _CODERS, new and empty in each task
    if tokenizer_path not in _CODERS:
        _CODERS[tokenizer_path] = Parts(tokenizer_path, remembered)
    return _CODERS[tokenizer_path].encode


class Parts(Memo):
    """Part of a text (bytes without white space) -> its ids as 32-bit integers; one per worker process and file."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__(self._part, remembered)
        import os

        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.added_normalized = [t["content"] for t in spec["added_tokens"] if t["normalized"]]
        #: lower-case letters, a digit or a run of marks, in Latin-1 -> ids; pieces as the library cuts them -> ids
        self.words, self.pieces = Memo(self._word, remembered), Memo(self._piece, remembered)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        # letter runs, and marks behind them, are their own pieces; the normalizer changes but their case
        self.plain = ([x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed"
                      and steps[0]["pattern"] == {"Regex": WORDS_OR_MARKS} and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
                      and {k["type"] for k in (spec["normalizer"] or {}).get("normalizers", [])} == {"NFC", "Replace", "Lowercase"})
        self.tokenize, self.letters = self.whole.model.tokenize, _byte_letters()
        if self.plain:
            self.normalize, self.cut = self.whole.normalizer.normalize_str, self.whole.pre_tokenizer.pre_tokenize_str

    def _part(self, part: bytes) -> bytes:
        s = part.decode("utf-8", "surrogatepass")
        if not self.plain:
            return array("I", self.whole.encode(s, add_special_tokens=False).ids).tobytes()
        # below this no letter has a mark that normalizing could join to it, and all have the one lower case
        if max(s) < "\u0250":
            low = s.lower()
            stem = low.rstrip(MARKS)
            if stem.isalpha():                           # letters with nothing but marks behind them
                mark = low[len(stem):]
                return self.pieces[stem.encode().decode("latin-1").translate(self.letters)] + (self.pieces[mark] if mark else b"")
        return b"".join([self.pieces[p] for p, _ in self.cut(self.normalize(s))])

    def _piece(self, piece: str) -> bytes:
        return array("I", map(ID, self.tokenize(piece))).tobytes()

    def _word(self, low: bytes) -> bytes:
        """Ids of lower-case letters, a digit or a run of marks, whose bytes the byte-level letters may spell anew."""
        shown = low.decode("latin-1")
        if not (low.isascii() and shown.isprintable()):
            shown = shown.encode().decode("latin-1").translate(self.letters)
        return array("I", map(ID, self.tokenize(shown))).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # for each text its ids, or places among the stretches of Latin-1 between the ids of other parts
        lows, out = [], []
        for t in texts:
            if self.has_added(t):
                out.append([np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()])
            elif not self.plain:
                out.append(list(map(self.__getitem__, t.encode("utf-8", "surrogatepass").split())))
            else:
                out.append([])
                for low, parts in _stretches(t):
                    if low:
                        out[-1].append(len(lows))
                        lows.append(low)
                    out[-1].extend(map(self.__getitem__, parts.split()))
        ids = [got for group in _groups(lows) for got in self._latin(group)]
        return [ids[x[0]] if len(x) == 1 and isinstance(x[0], int) else
                np.frombuffer(b"".join([ids[i].tobytes() if isinstance(i, int) else i for i in x]), "<u4") for x in out]

    def _latin(self, lows: list[bytes]) -> list[np.ndarray]:
        """Ids of texts of ``latin_lower``: their distinct pieces are looked up, all others copied by Arrow."""
        # a line feed, which is none of their characters, parts the texts
        pieces, begins = cut_latin(b"\n".join(lows))
        if not len(pieces):
            return [np.zeros(0, "<u4") for _ in lows]
        upto = np.searchsorted(begins, np.cumsum([len(low) + 1 for low in lows])).tolist()
        coded = pieces.dictionary_encode()
        _, places, chars = coded.dictionary.buffers()
        places = np.frombuffer(places, np.int32)[:len(coded.dictionary) + 1]
        distinct = np.insert(np.frombuffer(chars, np.uint8)[:places[-1]], places[1:-1], 32).tobytes().split(b" ")
        ids = pa.array(list(map(self.words.__getitem__, distinct)), pa.large_binary()).take(coded.indices)
        _, places, values = ids.buffers()
        places = np.frombuffer(places, np.int64)[:len(ids) + 1] // 4
        values = np.frombuffer(values, "<u4", places[-1])
        return [values[places[a]:places[b]] for a, b in zip([0, *upto], upto)]

    def has_added(self, text: str) -> bool:
        for a in self.added:
            if a in text:
                return True
        return bool(self.added_normalized) and any(a in self.whole.normalizer.normalize_str(text) for a in self.added_normalized)


def _byte_letters() -> str:
    """The printable character that byte-level tokenizers write for each byte: itself, or the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return "".join([chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)])


BLANK, LETTER, MARK, DIGIT = range(4)


def _latin_tables() -> tuple[bytes, bytes, bytes]:
    """Latin-1 characters in lower case, blanks for white space; their kinds; whether a piece begins between two kinds (4 * first + second)."""
    low, kinds = bytearray(range(256)), bytearray(256)
    for i in range(256):
        c = chr(i)
        white = c in "\t\n\v\f\r \x85\xa0"
        low[i] = 32 if white else ord(c.lower())
        kinds[i] = BLANK if white else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(c)[0], MARK)
    begins = bytes(bool(b and (a != b or b == DIGIT)) for a in range(4) for b in range(4))
    return bytes(low), bytes(kinds), begins.ljust(256, b"\0")


LOWER, KINDS, BEGINS = _latin_tables()
#: Letters that are a piece with the apostrophe before them, alone or with the second.
ALONE, FIRST = b"stmd", [b"re", b"ve", b"ll"]


def latin_lower(text: str) -> bytes | None:
    """A text of Latin-1 characters in lower case, blanks for white space; None for other texts."""
    try:
        return text.encode("latin-1").translate(LOWER)
    except UnicodeEncodeError:
        return None


def _stretches(text: str) -> Iterator[tuple[bytes, bytes]]:
    """A text as stretches of ``latin_lower`` and the parts in UTF-8, with characters outside Latin-1, behind each."""
    if (low := latin_lower(text)) is not None:
        yield low, b""
        return
    at = 0
    for m in OTHER.finditer(text):
        yield latin_lower(text[at:m.start()]).strip(), m[0].encode("utf-8", "surrogatepass")
        at = m.end()
    yield latin_lower(text[at:]).strip(), b""


def _groups(lows: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for low in lows:
        group.append(low)
        size += len(low)
        if size >= CUT_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def cut_latin(low: bytes) -> tuple[pa.Array, np.ndarray]:
    """The pieces of ``WORDS_OR_MARKS`` in ``low`` and the places where they begin."""
    n = len(low)
    chars = np.frombuffer(low, np.uint8)
    kind = np.frombuffer(low.translate(KINDS), np.uint8)
    solid = kind != BLANK
    begins = np.zeros(n + 3, dtype=bool)
    begins[:1] = True
    begins[1:n] = np.frombuffer((kind[:-1] * np.uint8(4) + kind[1:]).tobytes().translate(BEGINS), bool)
    marks = np.flatnonzero(chars == ord("'"))
    if len(marks):
        # an apostrophe that begins a piece takes the letters of a short form with it
        marks = marks[(marks == 0) | (kind[marks - 1] != MARK)]
        after = np.frombuffer(low + b"  ", np.uint8)
        one, two = after[marks + 1], after[marks + 2]
        alone = np.isin(one, np.frombuffer(ALONE, np.uint8))
        both = np.any([(one == a) & (two == b) for a, b in FIRST], axis=0)
        for its, size in ((marks[alone], 2), (marks[both], 3)):
            begins[its + 1] = False
            begins[its + size] = True
    begins = begins[:n] & solid
    chars, places = chars[solid], np.flatnonzero(begins[solid])
    places = np.append(places, len(chars)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(chars)])
    return pieces, np.flatnonzero(begins)


_CODERS: dict[str, Parts] = {}
