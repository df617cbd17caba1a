"""Token counts that survive edits.

The pre-tokens of a text are grouped into segments of ``LEAF`` of them. A binary tree over the segments
has the pieces, characters and tokens of every subtree, so a place is found, and a count brought up to date, along one
path. The tree is kept with all its sums; an edit puts new pieces into the segments it touches, which may hold up to
``FULL`` on average before the tree is built anew.

An edit re-encodes only what it can change. The split pattern looks at most three characters past a
match and never behind, so splitting from any old border gives the old pieces up to a few characters before the edit,
and is back in step as soon as a new border falls on an old segment's border after it. What lies
between is dealt out to the touched segments; all others keep their counts.

Defined results: null and empty texts have no segments and no tokens; texts of any length have one tree; repeated rows
and rows of equal or null ids are rows of their own; an empty table gives an empty result; edits beyond the end are cut off at
it; edits are given in characters of the text as it was, ascending and not overlapping; null edits
are none; a null replacement is empty; other columns are passed on, but those named like added columns give way to
them.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _text
from ._spark import without
from .bpe import LONG_PIECE, PATTERN, Classes, Remembered, Splitter, library_classes, read_ranks

LEAF = 64
#: Pieces of a segment from which on its tree is built anew, with segments of LEAF again.
FULL = 4 * LEAF
#: Characters before an edit from which on pieces may change.
CONTEXT = 8
#: Bytes, about, of a worker's memo of pieces.
PIECE_BYTES = 64 << 20
#: Bytes of texts that are worked on at once.
_AT_ONCE = 1 << 20


class Counter:
    """Splits texts and counts tokens with a rank file's vocabulary."""

    def __init__(self, path: str, pattern: str = PATTERN, classes: Classes | None = None):
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        self.split = Splitter(pattern, classes)
        self.pieces = Remembered(self.count, PIECE_BYTES)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def sizes(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """Characters and tokens of each piece, encoded alone: two runs of white space that part because of what follows
        would be one piece at the end of a segment."""
        if pieces and max(map(len, pieces)) > LONG_PIECE:
            tokens = [self.count(p) if len(p) > LONG_PIECE else self.pieces[p] for p in pieces]
        else:
            tokens = list(map(self.pieces.__getitem__, pieces))
        return list(map(len, pieces)), tokens


@functools.lru_cache(maxsize=1)
def counter(path: str, classes: Classes | None = None) -> Counter:
    return Counter(path, classes=classes)


_PIECES, _CHARS, _TOKENS = range(3)


class SegmentTree:
    """Sums of pieces, characters and tokens: node 1 is the root, node k has children 2k and 2k + 1, segments are the last level."""

    def __init__(self, sums: np.ndarray, leaves: int):
        self.sums, self.leaves, self.width = sums, leaves, sums.shape[1] // 2
        self.touched = 0  # nodes whose sums were brought up to date

    @classmethod
    def of(cls, segments: np.ndarray) -> SegmentTree:
        """The tree of segments (pieces, characters, tokens by row)."""
        leaves = segments.shape[1]
        width = 1 << max(0, (leaves - 1).bit_length())
        sums = np.zeros((3, 2 * width), np.int64)
        sums[:, width : width + leaves] = segments
        half = width
        while half > 1:
            sums[:, half // 2 : half] = sums[:, half : 2 * half : 2] + sums[:, half + 1 : 2 * half : 2]
            half //= 2
        return cls(sums, leaves)

    @classmethod
    def of_pieces(cls, chars: list[int], tokens: list[int]) -> SegmentTree:
        if not chars:
            return cls.of(np.zeros((3, 0), np.int64))
        at = np.arange(0, len(chars), LEAF)
        return cls.of(np.stack([np.diff(np.append(at, len(chars))), np.add.reduceat(chars, at), np.add.reduceat(tokens, at)]))

    @property
    def chars(self) -> int:
        return int(self.sums[_CHARS, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[_TOKENS, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The segment that holds a character, and where it begins; the end of the text is in the last one."""
        if place >= self.chars:
            last = max(0, self.leaves - 1)
            return last, self.chars - int(self.sums[_CHARS, self.width + last])
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place - start >= self.sums[_CHARS, node]:
                start += int(self.sums[_CHARS, node])
                node += 1
        return node - self.width, start

    def replace(self, a: int, b: int, chars: list[int], tokens: list[int]) -> SegmentTree:
        """The tree with the pieces of segments ``a:b`` replaced. The new pieces are dealt out to the same segments, so only
        the sums above these change; a segment that gets too full has the tree built anew, which so many pieces pay for."""
        if not self.leaves:
            return SegmentTree.of_pieces(chars, tokens)
        if len(chars) > FULL * (b - a):
            old = self.sums[:, self.width : self.width + self.leaves]
            middle = SegmentTree.of_pieces(chars, tokens)
            return SegmentTree.of(np.concatenate((old[:, :a], middle.sums[:, middle.width : middle.width + middle.leaves], old[:, b:]), axis=1))
        ends = np.arange(1, b - a + 1) * len(chars) // (b - a)
        total = np.zeros((3, len(chars) + 1), np.int64)
        total[_PIECES, 1:] = 1
        total[_CHARS, 1:], total[_TOKENS, 1:] = chars, tokens
        np.cumsum(total, axis=1, out=total)
        lo, hi = self.width + a, self.width + b
        self.sums[:, lo:hi] = np.diff(total[:, np.append(0, ends)], axis=1)
        self.touched += hi - lo
        while lo > 1:
            lo, hi = lo // 2, (hi - 1) // 2 + 1
            self.sums[:, lo:hi] = self.sums[:, 2 * lo : 2 * hi : 2] + self.sums[:, 2 * lo + 1 : 2 * hi : 2]
            self.touched += hi - lo
        return self

    def pack(self) -> bytes:
        return struct.pack("<I", self.leaves) + self.sums.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: bytes | None) -> SegmentTree:
        if not data:
            return cls.of(np.zeros((3, 0), np.int64))
        return cls(np.frombuffer(data, "<u4", offset=4).reshape(3, -1).astype(np.int64), *struct.unpack_from("<I", data))


def build(text: str, c: Counter) -> SegmentTree:
    return SegmentTree.of_pieces(*c.sizes(c.split(text)))


def edit(text: str, tree: SegmentTree, start: int, end: int, new: str, c: Counter) -> tuple[str, SegmentTree, int]:
    """The text with ``text[start:end]`` replaced, its tree, and how many characters were encoded again."""
    start = min(start, len(text))
    end = min(max(start, end), len(text))
    after = text[:start] + new + text[end:]
    shift = len(new) - (end - start)
    size = lambda k: int(tree.sums[_CHARS, tree.width + k])
    leaf, begin = tree.leaf_at(max(0, start - CONTEXT))
    stop, border = tree.leaf_at(end) if tree.leaves else (0, 0)
    while stop < tree.leaves and (border < end or stop <= leaf):
        stop, border = stop + 1, border + size(stop)
    pieces, at = [], begin
    for piece in c.split.walk(after, begin):
        while stop < tree.leaves and border + shift < at:
            stop, border = stop + 1, border + size(stop)
        if stop < tree.leaves and at == border + shift and at > begin and at >= start + len(new):
            break
        pieces.append(piece)
        at += len(piece)
    else:
        stop = tree.leaves
    return after, tree.replace(leaf, stop, *c.sizes(pieces)), at - begin


def build_trees(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``tree`` (the segments and all sums above them, packed) and ``n_tokens``."""
    docs = without(docs, "tree", "n_tokens")
    schema = T.StructType([*docs.schema.fields, T.StructField("tree", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    at = docs.columns.index(text_col)
    classes = library_classes()

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, classes)
        for batch in batches:
            for part in _text.parts(batch, at, _AT_ONCE):
                trees = [build(t or "", c) for t in part.column(at).to_pylist()]
                made = [pa.array([t.pack() for t in trees], pa.binary()), pa.array([t.tokens for t in trees], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "tree", "n_tokens"])

    return docs.mapInArrow(run, schema)


def apply_edits(docs: DataFrame, path: str, *, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Rows of ``build_trees`` with a column ``edits`` (array of start, end, text) after their edits: text, tree and
    n_tokens are the new ones, ``n_encoded`` counts the characters that were encoded again."""
    docs = without(docs, "n_encoded")
    schema = T.StructType([*docs.drop(edits_col).schema.fields, T.StructField("n_encoded", T.LongType())])
    names = docs.columns
    text_at, edits_at, tree_at, count_at = (names.index(x) for x in (text_col, edits_col, "tree", "n_tokens"))

    classes = library_classes()

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, classes)
        for batch in batches:
            for part in _text.parts(batch, text_at, _AT_ONCE):
                texts, trees, encoded = [], [], []
                for text, edits, packed in zip(*(part.column(i).to_pylist() for i in (text_at, edits_at, tree_at))):
                    tree, n, now = SegmentTree.unpack(packed), 0, text or ""
                    for e in reversed(edits or []):  # from the end, so that places before keep their numbers
                        now, tree, m = edit(now, tree, e["start"], e["end"], e["text"] or "", c)
                        n += m
                    texts.append(now if edits else text)
                    trees.append(tree)
                    encoded.append(n)
                columns = list(part.columns)
                columns[text_at] = pa.array(texts, columns[text_at].type)
                columns[tree_at] = pa.array([t.pack() for t in trees], pa.binary())
                columns[count_at] = pa.array([t.tokens for t in trees], pa.int64())
                kept = [i for i in range(len(names)) if i != edits_at]
                yield pa.RecordBatch.from_arrays([*(columns[i] for i in kept), pa.array(encoded, pa.int64())], names=[*(names[i] for i in kept), "n_encoded"])

    return docs.mapInArrow(run, schema)
