"""Byte-level BPE by longest matches and backtracking.

A text is cut by the vocabulary's pattern; each piece is encoded alone. An Aho-Corasick automaton over
the tokens' bytes (as Latin-1 characters) gives the longest token at every place of a piece. Starting from
the left, the longest token is taken that may follow its predecessor; where none may, the last token is
given up for its next shorter prefix and the place is marked as dead, so every place is tried once. Two
tokens may stand next to each other if merging their joined bytes gives just these two, which is
remembered. The result is that of the merges in order of rank, found in linear time.

The pattern's classes (letters, digits, white space) are those of the library's engine: they are read from it, not
from Python's Unicode tables, which are of another version.

Defined results: null and empty texts have no ids; texts of any length are encoded whole; special tokens are
ordinary text; a piece that is a token as a whole is that token, also where merges don't lead to it; ids that the
vocabulary lacks raise an error in decoding; repeated rows and rows of equal or null ids are rows of their own; an
empty table gives an empty result; other columns are passed on, but one named like an added column gives way to it.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _text
from ._spark import without

#: Bytes, about, of a worker's memo of pieces, and of that of token pairs: all that a worker keeps beside the vocabulary.
PIECE_BYTES = 96 << 20
PAIR_BYTES = 80 << 20
#: Longer pieces are encoded but not remembered.
LONG_PIECE = 64
#: Characters below this one have a pattern of their own, which is faster.
_LATIN = 0x250

Classes = tuple[tuple[tuple[int, int], ...], ...]


@functools.lru_cache(maxsize=1)
def library_classes() -> Classes:
    """Ranges of the letters, digits and spaces of the library's own engine, whose Unicode version may differ from Python's:
    an encoder of single bytes that matches a class alone returns the members of the class."""
    bytes_only = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    found = []
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        members = bytes(tiktoken.Encoding("class", pat_str=kind + "{1,16}", mergeable_ranks=bytes_only, special_tokens={}).encode_ordinary(every)).decode()
        codes = np.fromiter(map(ord, members), np.int64, len(members))
        edges = np.flatnonzero(np.diff(codes) != 1)
        found.append(tuple(zip(codes[np.append(0, edges + 1)].tolist(), codes[np.append(edges, len(codes) - 1)].tolist())))
    return tuple(found)


def _written(pattern: str, classes: Classes, below: int = 0x110000) -> re.Pattern:
    """A pattern with its classes as ranges of characters below a limit, for ``re``."""
    letter, digit, space = ("".join(f"\\U{a:08x}-\\U{min(b, below - 1):08x}" for a, b in c if a < below) for c in classes)
    written = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{digit}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{digit}]")
    return re.compile(written.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


class Splitter:
    """All matches of PATTERN in a text, with the classes of the library's engine. Other patterns are left to ``regex``."""

    def __init__(self, pattern: str = PATTERN, classes: Classes | None = None):
        self.beyond = re.compile("[^\x00-\u024f]").search
        if pattern == PATTERN:
            classes = classes or library_classes()
            self.whole, self.latin = _written(pattern, classes), _written(pattern, classes, _LATIN).findall
        else:
            self.whole, self.latin = regex.compile(pattern), None
        self.any = self.whole.findall

    def __call__(self, text: str) -> list[str]:
        return self.any(text) if self.latin is None or self.beyond(text) else self.latin(text)

    def walk(self, text: str, start: int) -> Iterator[str]:
        """The matches from a border on, one by one."""
        return (m[0] for m in self.whole.finditer(text, start))


#: Bytes, about, that an entry of a memo takes besides the bytes of its key and value.
_ENTRY = 200


class Remembered(dict):
    """A memo of ``make`` of at most about ``limit`` bytes: two generations, of which the older one is dropped when the
    younger has half of them. ``sized`` says that keys and values have lengths."""

    def __init__(self, make, limit: int, sized: bool = False):
        super().__init__()
        self.make, self.half, self.sized, self.old, self.held = make, limit // 2, sized, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.held > self.half:
            self._turn()
        self.held += _ENTRY + len(key) + len(value) if self.sized else _ENTRY
        self[key] = value
        return value

    def _turn(self) -> None:
        self.old = dict(self)
        self.clear()
        self.held = 0

    def put_all(self, found: dict) -> None:
        """Entries that are needed together stay together."""
        if self.held > self.half:
            self._turn()
        self.held += _ENTRY * len(found) + (sum(map(len, found)) + sum(map(len, found.values())) if self.sized else 0)
        self.update(found)

    def forget(self) -> None:
        self._turn()
        self.old = {}


@functools.lru_cache(maxsize=1)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a line for each token, base64 and id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=1)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id, all that decoding needs."""
    return {i: b for b, i in read_ranks(path).items()}


def decode(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, memoryview(ids).cast("I")))


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, classes: Classes | None = None, tokens: dict[int, bytes] | None = None):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = tokens or {i: b for b, i in ranks.items()}
        self.split = Splitter(pattern, classes)
        self.automaton = ahocorasick.Automaton()
        made = {i for b, i in ranks.items() if len(b) == 1 or self.merged(b) == [i]}  # the others are whole pieces only
        for i in made:
            self.automaton.add_word(self.tokens[i].decode("latin-1"), (i, len(self.tokens[i])))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for i in made:
            b = self.tokens[i]
            self.shorter[i] = next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if ranks.get(b[:n]) in made), -1)
        self.may_follow = Remembered(self._may_follow, PAIR_BYTES)
        self.pieces = Remembered(self._piece, PIECE_BYTES, True)

    def _may_follow(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        return self.merged(self.tokens[a] + self.tokens[b]) == [a, b]

    def merged(self, piece: bytes) -> list[int]:
        """The plain definition: join the adjacent pair of least rank, leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def backtracked(self, piece: bytes) -> list[int]:
        """Ids of a piece by longest matches with backtracking."""
        n = len(piece)
        longest = [-1] * n
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size] = token  # later ends are longer
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        tokens, shorter, may_follow = self.tokens, self.shorter, self.may_follow
        while at < n:
            end = at + len(tokens[token])
            if alive[end] and (not out or may_follow[out[-1] << 32 | token]):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= len(tokens[token])
        return out

    def _piece(self, piece: str) -> bytes:
        b = piece.encode()
        whole = self.ranks.get(b)
        ids = self.backtracked(b) if whole is None else [whole]
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        pieces = self.split(text)
        if len(text) > LONG_PIECE and max(map(len, pieces)) > LONG_PIECE:
            return b"".join([self.pieces[p] if len(p) <= LONG_PIECE else self._piece(p) for p in pieces])
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return decode(ids, self.tokens)

    def forget(self) -> None:
        """Empty the memos."""
        self.may_follow.forget()
        self.pieces.forget()


@functools.lru_cache(maxsize=1)
def vocabulary(path: str, pattern: str = PATTERN, classes: Classes | None = None) -> Vocabulary:
    """The vocabulary of a rank file; a worker holds one."""
    return Vocabulary(read_ranks(path), pattern, classes, token_bytes(path))


#: Bytes of texts or ids that are worked on at once.
_AT_ONCE = 1 << 20


def _map_column(df: DataFrame, column: str, added: list[tuple[str, T.DataType, pa.DataType]], work) -> DataFrame:
    """``df`` with columns that ``work(list of values) -> lists`` makes from ``column``."""
    df = without(df, *(name for name, _, _ in added))
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind, _ in added)])
    at = df.columns.index(column)
    names = [name for name, _, _ in added]

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.parts(batch, at, _AT_ONCE):
                made = [pa.array(x, arrow) for x, (_, _, arrow) in zip(work(part.column(at).to_pylist()), added)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids", pattern: str = PATTERN, decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of the texts, as binary little-endian unsigned 32-bit integers, in ``ids_col``; with
    ``decoded_col`` also with the bytes that these ids decode to (in the same task, by the same table)."""
    classes = library_classes() if pattern == PATTERN else None

    def work(texts: list[str | None]) -> list[list[bytes]]:
        v = vocabulary(path, pattern, classes)
        ids = [v.encode(t) if t else b"" for t in texts]
        return [ids, [v.decode(x) for x in ids]] if decoded_col else [ids]

    added = [(c, T.BinaryType(), pa.binary()) for c in (ids_col, decoded_col) if c]
    return _map_column(docs, text_col, added, work)


def decode_documents(docs: DataFrame, path: str, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the ids stand for. Null ids decode to no bytes."""

    def work(ids: list[bytes | None]) -> list[list[bytes]]:
        tokens = token_bytes(path)
        return [[decode(x, tokens) if x else b"" for x in ids]]

    return _map_column(docs, ids_col, [(bytes_col, T.BinaryType(), pa.binary())], work)
