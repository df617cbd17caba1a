"""Token-id files with shuffled planes.

A file holds the ids of consecutive documents, cut into blocks of ``BLOCK`` ids. A block is transposed
into planes: four byte planes, or 32 bit planes (plane ``k`` has bit ``k`` of every id), and each plane is
one zstandard frame. Planes that are all zero take no bytes. Layout, integers little-endian:

    "PLN2"  mode u8 (1 byte planes, 2 bit planes)  3 zero bytes
    planes of block 0, planes of block 1, ...
    lengths of the documents, u64 each, as one zstandard frame
    ids of the documents, an Arrow stream of one column, as one zstandard frame
    chunk index, a row for each block: offset u64, ids u64, crc32 u32, size of every plane u32
    footer: lengths offset u64, lengths size u64, names size u64, documents u64, blocks u64, ids u64, "PLN2"

So the footer leads to the index, and the index to any id without reading what stands before it.

``write_ids`` writes a table as files in ascending order of the id column (then of the text's hash): rows are
range-partitioned by both, so a repeated or null id makes no large task, and a file is closed after ``FILE_IDS`` ids.
Its result is the manifest, a row for each file. ``read_ids`` reads the files back, a file for each task at least.

Defined results: null and empty texts have the end id only; texts of any length are encoded whole, a single one in
memory at a time; rows with the same id, or a null one (these come first), are documents of their own; the end id may
also occur inside a text; columns other than id and text aren't read; an empty table makes no file and an empty result.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, filterfalse, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _files, _text
from ._spark import fresh_dir, written
from .bpe import _ENTRY, LONG_PIECE, Classes, Splitter, library_classes

BLOCK = 1 << 16
LEVEL = 3
#: Ids after which a new file is begun.
FILE_IDS = 1 << 26
#: Bytes, about, of a worker's memo of pieces.
PIECE_BYTES = 160 << 20
#: Bytes of texts that are encoded at once.
_AT_ONCE = 2 << 20
_MAGIC = b"PLN2"
_FOOT = struct.Struct("<QQQQQQ4s")
BYTE, BIT = 1, 2


def to_planes(ids: np.ndarray, mode: int) -> list[bytes]:
    """The planes of a block of 32-bit ids, least significant first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if mode == BYTE:
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes | None], n: int, mode: int) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if mode == BYTE:
        for k, p in enumerate(planes):
            if p:
                raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


class Writer:
    """Writes one file; ids are held for one block at most."""

    def __init__(self, out, mode: int = BYTE, block: int = BLOCK, level: int = LEVEL):
        self.out, self.mode, self.block = out, mode, block
        self.z = zstandard.ZstdCompressor(level=level)
        self.at = 0
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0
        self.lengths: list[int] = []
        self.names: list[pa.Array] = []
        self.index: list[bytes] = []
        self._put(_MAGIC + bytes((mode, 0, 0, 0)))

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)

    def add(self, ids: np.ndarray) -> None:
        """The ids of the next document."""
        self.lengths.append(len(ids))
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            full = len(flat) // self.block * self.block
            for k in range(0, full, self.block):
                self._flush(flat[k : k + self.block])
            self.held, self.n_held = [flat[full:].copy()], len(flat) - full

    def _flush(self, ids: np.ndarray) -> None:
        start, sizes = self.at, []
        for plane in to_planes(ids, self.mode):
            frame = b"" if plane.count(0) == len(plane) else self.z.compress(plane)
            sizes.append(len(frame))
            self._put(frame)
        self.index.append(struct.pack(f"<QQI{len(sizes)}I", start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *sizes))

    def name(self, names: pa.Array) -> None:
        """The ids of the documents added since."""
        self.names.append(names)

    def close(self) -> None:
        if self.n_held:
            self._flush(np.concatenate(self.held))
        start = self.at
        self._put(self.z.compress(np.array(self.lengths, "<u8").tobytes()))
        size = self.at - start
        sink = pa.BufferOutputStream()
        if self.names:
            with pa.ipc.new_stream(sink, pa.schema([("id", self.names[0].type)])) as stream:
                for x in self.names:
                    stream.write_batch(pa.RecordBatch.from_arrays([x], ["id"]))
        self._put(self.z.compress(sink.getvalue().to_pybytes()) if self.names else b"")
        names = self.at - start - size
        self._put(b"".join(self.index))
        self._put(_FOOT.pack(start, size, names, len(self.lengths), len(self.index), self.total, _MAGIC))


class Reader:
    """Reads a file by ranges; ``uri`` as in ``_files``."""

    def __init__(self, uri: str):
        self.uri = uri
        end = _files.size_of(uri)
        at, size, named, self.documents, blocks, self.total, magic = _FOOT.unpack(_files.read_range(uri, end - _FOOT.size, _FOOT.size))
        if magic != _MAGIC:
            raise ValueError(f"not a plane file: {uri}")
        self.mode = _files.read_range(uri, 4, 1)[0]
        self.z = zstandard.ZstdDecompressor()
        self.lengths = np.frombuffer(self.z.decompress(_files.read_range(uri, at, size)), "<u8").astype(np.int64)
        self._names = (at + size, named)
        planes = 4 if self.mode == BYTE else 32
        row = struct.Struct(f"<QQI{planes}I")
        self.blocks = list(row.iter_unpack(_files.read_range(uri, at + size + named, blocks * row.size)))
        self.starts = np.cumsum([0, *(b[1] for b in self.blocks)])

    def names(self) -> pa.Array | None:
        """The ids of the documents, if the file has them."""
        at, size = self._names
        return pa.ipc.open_stream(self.z.decompress(_files.read_range(self.uri, at, size))).read_all().column(0).combine_chunks() if size else None

    def block(self, k: int) -> np.ndarray:
        at, n, crc, *sizes = self.blocks[k]
        data, pos, planes = _files.read_range(self.uri, at, sum(sizes)), 0, []
        for s in sizes:
            planes.append(self.z.decompress(data[pos : pos + s]) if s else None)
            pos += s
        ids = from_planes(planes, n, self.mode)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} of {self.uri} is damaged")
        return ids

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` on: only the blocks that hold them are read."""
        if not n:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(self.starts, start, "right") - 1, np.searchsorted(self.starts, start + n, "left")
        return np.concatenate([self.block(k) for k in range(a, b)])[start - self.starts[a] :][:n]

    def texts(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn; a block is read once and held while documents need it."""
        rest, k = np.zeros(0, "<u4"), 0
        for n in self.lengths:
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            flat = np.concatenate(parts) if len(parts) > 1 else rest
            yield flat[:n]
            rest = flat[n:]


#: Scripts in which the split pattern and the library agree on every character; texts with others are encoded whole.
_OTHER_SCRIPTS = regex.compile(r"[^\x00-ԯऀ-ॿ฀-๛‐-⁞　-ヾ一-龥가-힣！-～]")


#: A space and Latin letters: a text of such pieces is cut into them, and takes the library less time than the pieces alone.
_PLAIN = re.compile("[ ][A-Za-zªµºÀ-ÖØ-öø-ɏ]+").fullmatch
_JOINED = 100


class _Pieces(defaultdict):
    """A memo of the ids of pieces, of two generations like ``bpe.Remembered``. What it lacks it takes up with no ids, by
    the interpreter's own code alone; ``lacked`` gives these, the last ones, to be filled in."""

    def __init__(self, limit: int):
        super().__init__(bytes)
        self.half, self.old, self.held = limit // 2, {}, 0

    def all_of(self, pieces: list[str]) -> list[bytes]:
        """The entries of all pieces, one pass of the interpreter's own code."""
        return list(itemgetter(*pieces)(self)) if len(pieces) > 1 else [self[p] for p in pieces]

    def lacked(self, known: int) -> list[str]:
        """The pieces taken up since there were ``known``."""
        return list(islice(reversed(self), len(self) - known))

    def fill(self, found: dict[str, bytes]) -> None:
        self.update(found)
        self.held += _ENTRY * len(found) + sum(map(len, found)) + sum(map(len, found.values()))

    def turn(self) -> None:
        """Drop the older generation if the younger one has half of the bytes."""
        if self.held > self.half:
            self.old = dict(self)
            self.forget()

    def forget(self) -> None:
        self.clear()
        self.held = 0


class LibraryEncoder:
    """The tokenizers library behind a memo of pieces. The vocabulary's pre-tokenizer cuts texts by PATTERN and
    encodes the pieces alone, so a piece's ids are the same in every text; the library encodes the new ones in a batch."""

    def __init__(self, path: str, classes: Classes | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = Splitter(classes=classes)
        self.pieces = _Pieces(PIECE_BYTES)
        words = self.tokenizer.get_vocab()
        self.size = np.zeros(max(words.values()) + 1, np.int64)  # bytes of a token: it is written with one character for each
        self.size[list(words.values())] = [len(w) for w in words]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, pieces: list[str], ids: np.ndarray) -> dict[str, bytes] | None:
        """The ids of each piece, of those of all: a piece ends where its bytes are used up. None if some id has bytes of two."""
        have, want = np.cumsum(self.size[ids]), np.cumsum(list(map(len, map(str.encode, pieces))))
        ends = np.searchsorted(have, want)
        if ends[-1] != len(ids) - 1 or (have[ends] != want).any():
            return None
        at, raw = [0, *(4 * ends + 4).tolist()], ids.tobytes()
        return dict(zip(pieces, map(raw.__getitem__, map(slice, at, at[1:]))))

    def _learn(self, pieces: list[str]) -> None:
        """Fill in the ids of pieces that the memo lacks: a call of the library for plain ones and one for the others."""
        old = self.pieces.old
        found = {p: old[p] for p in pieces if p in old} if old else {}
        new = [p for p in pieces if p not in found] if found else pieces
        long = [p for p in new if len(p) > LONG_PIECE]
        if long:
            found.update(zip(long, self._ids(long)))
            new = [p for p in new if len(p) <= LONG_PIECE]
        plain, rest = list(filter(_PLAIN, new)), list(filterfalse(_PLAIN, new))
        if plain:
            joined = ["".join(plain[k : k + _JOINED]) for k in range(0, len(plain), _JOINED)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
            cut = self._cut(plain, np.fromiter(chain.from_iterable(ids), "<u4", sum(map(len, ids))))
            if cut is None:
                rest = new
            else:
                found.update(cut)
        if rest:
            (e,) = self.tokenizer.encode_batch_fast([rest], is_pretokenized=True, add_special_tokens=False)
            found.update(self._cut(rest, np.array(e.ids, "<u4")))
        self.pieces.fill(found)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        try:
            return self._encode(texts)
        except BaseException:
            self.pieces.forget()  # else pieces without ids would stay, and the worker may run another task
            raise

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        parts: list[list[bytes]] = []
        open_: list[tuple[list[bytes], list[int], list[str]]] = []
        self.pieces.turn()
        known = len(self.pieces)
        for t in texts:
            t = t or ""
            latin = not self.split.beyond(t)
            if not latin and _OTHER_SCRIPTS.search(t) or any(s in t for s in self.special):
                parts.append(self._ids([t]))
                continue
            cut = self.split.latin(t) if latin else self.split.any(t)
            ids = self.pieces.all_of(cut)
            parts.append(ids)
            if not all(ids):
                i, holes = -1, []
                for _ in range(ids.count(b"")):
                    i = ids.index(b"", i + 1)
                    holes.append(i)
                open_.append((ids, holes, [cut[i] for i in holes]))
        if open_:
            new = self.pieces.lacked(known)
            self._learn(new)
            for ids, holes, pieces in open_:
                for i, x in zip(holes, self.pieces.all_of(pieces)):
                    ids[i] = x
            for p in new:
                if len(p) > LONG_PIECE:  # not remembered
                    self.pieces.held -= _ENTRY + len(p) + len(self.pieces.pop(p))
        return [b"".join(x) for x in parts]


@functools.lru_cache(maxsize=1)
def library_encoder(path: str, classes: Classes | None = None) -> LibraryEncoder:
    return LibraryEncoder(path, classes)


def write_ids(
    docs: DataFrame, path: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, mode: int = BYTE, block: int = BLOCK, level: int = LEVEL, file_ids: int = FILE_IDS
) -> DataFrame:
    """Encode the texts by the library and write files in ascending order of ``id_col``; the manifest as a table:
    (file, number, first_id, documents, ids, start), ``start`` being the ids in all files before."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "token-files")
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    classes = library_classes()

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, end, number = library_encoder(path, classes), None, end_id.to_bytes(4, "little"), 0

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"file": [uri], "first_id": first, "nth": pa.array([number], pa.int64()), "documents": [len(writer.lengths)], "ids": [writer.total]})

        for batch in batches:
            for part in _text.parts(batch, 1, _AT_ONCE):
                if writer is None:
                    uri = _files.new_name(folder, "ids", ".pln")
                    out = _files.open_output(uri)
                    writer, first = Writer(out, mode, block, level), part.column(0).slice(0, 1)
                writer.name(part.column(0))
                for ids_of in encoder.encode(part.column(1).to_pylist()):
                    writer.add(np.frombuffer(ids_of + end, "<u4"))
                if writer.total >= file_ids:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()

    # (a task's number, and a file's within its task, order the files; a batch has rows of one task)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    sorted_rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    made = sorted_rows.mapInArrow(run, f"file string, first_id {kind}, nth bigint, documents bigint, ids bigint")
    made = written(made.withColumn("task", F.spark_partition_id()), "manifest")
    order = Window.orderBy("task", "nth")  # a row for each file
    numbered = made.select("file", "first_id", "documents", "ids", F.row_number().over(order).alias("number"), F.sum("ids").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("start"))
    return numbered.withColumn("start", F.coalesce("start", F.lit(0)))


def read_ids(manifest: DataFrame) -> DataFrame:
    """The documents in the files of a manifest: (id, start, n_tokens, ids); ``start`` counts the ids of all documents before."""
    kind = manifest.schema["first_id"].dataType.simpleString()
    files = manifest.count()

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(uri)
                names = reader.names()
                held, starts, size, done = [], [], 0, 0
                for ids in reader.texts():
                    held.append(ids.tobytes())
                    starts.append(at)
                    at += len(ids)
                    size += len(held[-1])
                    if size >= 2 << 20:
                        yield rows(names.slice(done, len(held)), starts, held)
                        done += len(held)
                        held, starts, size = [], [], 0
                if held:
                    yield rows(names.slice(done, len(held)), starts, held)

    def rows(names: pa.Array, starts: list[int], held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names, pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in held], pa.int64()), pa.array(held, pa.binary())], ["id", "start", "n_tokens", "ids"])

    # a given number of partitions is not coalesced: the rows are small, the files they name are not
    return manifest.select("file", "start").repartition(max(1, files)).mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids binary")
