"""Benchmark decontamination by an FM-index per shard of training documents.

Words are runs of ``[a-z0-9]`` and non-ASCII characters after lowering A-Z. A window is ``size``
consecutive words of a benchmark item; an item with fewer words, but not none, is one window. Each
task indexes its documents in shards of a few megabytes, backward-searches all windows at once
through wavelet-tree ranks, locates what it found by sampled suffix positions, and merges the found
ranges of every document. Documents are neither shuffled nor grouped, so a hot source or a passage
that many documents share costs no task more than its own text.

The benchmark is written as block files of about ``BENCH_BLOCK`` bytes of item text to the shared folder; nothing of it is
broadcast or passes the driver but the files' names. A task holds the indexes of ``GROUP`` bytes of documents, loads
one block after another and searches its windows in all of them; a benchmark of one block stays loaded.

Defined results: a null or empty text has no words and no hits; texts of any length are searched whole; an item without
words has no window; an item without id contaminates like any other but is not among the named items; repeated items
count once by id, and repeated documents are rows of their own; an empty benchmark contaminates nothing; input columns
are passed on, but one named like an added column gives way to it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _files, _text
from ._spark import fresh_dir, put_back, set_aside, without
from .fm_index import FMIndex

WINDOW = 13
#: A document is contaminated if one word in this many is hit.
ONE_IN = 20
BENCH_BLOCK = 1 << 20
#: Bytes of documents whose indexes a task holds while blocks of the benchmark go by.
GROUP = 16 << 20
_ROWS = 1 << 19

ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


@dataclass
class Phrases:
    """Windows of some items. ``by_size``: window length -> distinct windows as word hashes, with the
    items of window ``w`` at ``owners[at[w]:at[w + 1]]``."""

    names: list[str | None]
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def phrases(names: list[str | None], texts: pa.Array, size: int = WINDOW) -> Phrases:
    """The windows of items."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for block in _text.blocks(texts):
        w = _text.words(block, "alnum")
        h = w.hashes()
        n = np.diff(w.off)
        for m in np.unique(np.minimum(n, size)).tolist():
            if not m:
                continue
            item = np.flatnonzero(np.minimum(n, size) == m)
            count = n[item] - m + 1
            owner = np.repeat(item, count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + w.off[owner]
            found.setdefault(m, []).append((h[at[:, None] + np.arange(m)], owner + block.first))
    by_size = {}
    for m, held in found.items():
        keys, owner = np.concatenate([k for k, _ in held]), np.concatenate([o for _, o in held])
        flat = np.ascontiguousarray(keys).view(f"V{8 * m}").ravel()
        _, first, which = np.unique(flat, return_index=True, return_inverse=True)
        both = np.unique(np.stack([which, owner], 1), axis=0)
        by_size[m] = (keys[first], np.searchsorted(both[:, 0], np.arange(len(first) + 1)), both[:, 1])
    return Phrases(names, by_size)


class Shard:
    """The index of a block of documents, its hits and the items found in each row."""

    def __init__(self, block: _text.Block):
        self.block = block
        self.words = w = _text.words(block, "alnum")
        self.index = FMIndex(w.hashes(), w.off) if len(w.start) else None
        self.edges = np.zeros(len(w.start) + 1, np.int32)
        self.items: dict[int, set[str]] = {}

    def search(self, p: Phrases) -> None:
        """Add what occurs here of the windows."""
        if self.index is None:
            return
        off = self.words.off
        for m, (keys, at, owners) in p.by_size.items():
            lo, hi = self.index.search(self.index.symbols(keys.ravel()).reshape(keys.shape))
            some = np.flatnonzero(lo < hi)
            count = (hi - lo)[some]
            for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(np.cumsum(count) // _ROWS)) + 1):
                window = np.repeat(some[part], count[part])
                if not len(window):
                    continue
                begin = np.cumsum(count[part]) - count[part]
                rows = np.arange(len(window)) - np.repeat(begin, count[part]) + np.repeat(lo[some[part]], count[part])
                place = self.index.locate(rows)
                np.add.at(self.edges, place, 1)
                np.add.at(self.edges, place + m, -1)
                doc = np.searchsorted(off, place, side="right") - 1
                for d, v in np.unique(np.stack([doc, window], 1), axis=0).tolist():
                    self.items.setdefault(d, set()).update(name for i in owners[at[v] : at[v + 1]] if (name := p.names[i]) is not None)

    def hit(self) -> np.ndarray:
        """Which words lie in a window."""
        return np.cumsum(self.edges[:-1]) > 0


def _rows(shard: Shard, one_in: int) -> dict[str, list]:
    block, w, hit = shard.block, shard.words, shard.hit()
    n_words = np.diff(w.off)
    n_hit = _text.counts_in_rows(hit, w.off)
    spans: list[list] = [[] for _ in range(len(block))]
    if hit.any():
        change = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
        first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        doc = np.searchsorted(w.off, first, side="right") - 1
        for a, b, d in zip(first, last, doc):
            while a < b:  # a run of hits may go on into the next document
                stop = min(b, w.off[d + 1])
                if stop > a:
                    spans[d].append({"start": int(w.start[a] - block.off[d]), "end": int(w.end[stop - 1] - block.off[d])})
                a, d = stop, d + 1
    return {
        "n_words": n_words.tolist(),
        "n_hit": n_hit.tolist(),
        "items": [sorted(shard.items.get(d, ())) for d in range(len(block))],
        "spans": spans,
        "contaminated": ((n_hit > 0) & (one_in * n_hit >= n_words)).tolist(),
    }


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[tuple[str, int]]:
    """Write the items as block files of about BENCH_BLOCK bytes of text; their names and sizes."""
    folder, limit = fresh_dir(benchmark.sparkSession, "benchmark"), BENCH_BLOCK

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def put() -> pa.RecordBatch:
            uri = _files.new_name(folder, "items", ".arrow")
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as stream:
                for x in held:
                    stream.write_batch(x)
            data = sink.getvalue()
            with _files.open_output(uri) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"file": [uri], "size": [data.size]})

        for batch in batches:
            for part in _text.parts(batch, 1, limit):
                held.append(part)
                size += part.get_total_buffer_size() if part.num_rows == batch.num_rows else limit
                if size >= limit:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return [(r.file, r["size"]) for r in rows.mapInArrow(run, "file string, size bigint").collect()]


@functools.lru_cache(maxsize=1)
def load_block(uri: str, nbytes: int, size: int) -> Phrases:
    """The windows of a block file; a worker holds one block's."""
    items = pa.ipc.open_stream(_files.read_range(uri, 0, nbytes)).read_all()
    return phrases(items.column(0).to_pylist(), items.column(1).combine_chunks(), size)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, one_in: int = ONE_IN, group: int = GROUP
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids of the items with occurring windows, sorted as text),
    spans (hit byte ranges of the text, merged) and contaminated (n_hit > 0 and one_in * n_hit >= n_words)."""
    docs = without(docs, *ADDED.names)
    files = benchmark_blocks(benchmark, item_id_col, item_text_col)
    schema = T.StructType([*docs.schema.fields, *ADDED.fields])
    arrow = to_arrow_schema(ADDED)
    text_at = docs.columns.index(text_col)

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, Shard]] = []
        count = 0

        def searched() -> Iterator[pa.RecordBatch]:
            for uri, nbytes in files:
                p = load_block(uri, nbytes, size)
                for _, shard in held:
                    shard.search(p)
            for own, shard in held:
                out = _rows(shard, one_in)
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(out[f.name], f.type) for f in arrow)], schema=pa.schema([*own.schema, *arrow]))

        for batch in batches:
            for block in _text.blocks(batch.column(text_at)):
                held.append((batch.slice(block.first, len(block)), Shard(block)))
                count += len(block.buf)
                if len(files) <= 1 or count >= group:  # one block of the benchmark stays loaded: nothing is won by waiting
                    yield from searched()
                    held, count = [], 0
        if held:
            yield from searched()

    return docs.mapInArrow(run, schema)


def items_digest(ids: list[str] | None) -> str:
    return hashlib.sha256(",".join(ids or []).encode()).hexdigest()


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, whole and with their own columns."""
    own, names = set_aside(docs)
    found = find_contamination(own, benchmark, text_col=names[options.pop("text_col", "text")], **options)
    return put_back(found.where(~F.col("contaminated")), names)
