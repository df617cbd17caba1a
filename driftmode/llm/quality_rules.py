"""Quality rules by compression bands.

A text is rejected if zstandard shrinks it too well (it repeats itself) or too badly (noise), as a
whole or in any fixed chunk. The limits depend on the length, since short texts compress badly and
long ones well whatever they say. The compressed size is that of one frame without checksum; ratio =
bytes / compressed bytes.

The fixed rules of the base (few words, repeated 3-word windows) reject on their own; word counts use
runs of characters other than white space (0x20, 0x09-0x0D).

Defined results: null text counts as empty; texts of any length are judged whole; repeated rows and null ids are rows of
their own; an empty table gives an empty result; a text of fewer than 50 words always fails the base; the last
chunk of a text longer than one is its last ``CHUNK`` bytes and overlaps the one before; other columns are
passed on, but one named like an added column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _text
from ._spark import put_back, set_aside, without

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CHUNK = 4096
LEVEL = 3
#: (bytes below which the band holds, least ratio, greatest ratio) of whole texts, and the band of chunks.
#: Fitted to the documents of sf0.1 that pass the base rules (3243 labelled quality 1, 291 labelled 0): greatest ratio
#: = that of label 1 and about 0.03, least ratio = that of label 1 less about 0.05. From 8192 bytes on few are labelled
#: (167) and none with label 0 lies below, so the least ratio is that of 4096 to 8192 bytes; from 65536 bytes on none is
#: labelled, so the limits are wide there and the chunks decide. Chunks of label 1: 2.07 to 2.26, of label 0 up to 2.59.
BANDS = (
    (512, 1.33, 1.87),
    (768, 1.42, 1.93),
    (1024, 1.56, 2.0),
    (1536, 1.67, 2.08),
    (2048, 1.79, 2.18),
    (3072, 1.87, 2.19),
    (4096, 1.95, 2.25),
    (6144, 2.05, 2.33),
    (8192, 2.05, 2.38),
    (16384, 2.05, 2.44),
    (65536, 2.05, 2.52),
    (1 << 62, 1.6, 3.6),
)
CHUNK_BAND = (1.95, 2.29)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

ADDED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType())]
    + [T.StructField(c, T.DoubleType()) for c in ("ratio", "chunk_ratio_min", "chunk_ratio_max")]
    + [T.StructField("kept", T.BooleanType())]
)


def _dup_lines(block: _text.Block, w: _text.Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    out = np.zeros(len(block), np.int64)
    if not len(block.buf):
        return out
    breaks = np.flatnonzero(block.buf == 0x0A)
    start = np.sort(np.concatenate((block.off[:-1][np.diff(block.off) > 0], breaks + 1)))
    start = np.unique(start[start < len(block.buf)])
    end = np.append(start[1:], len(block.buf))
    filled = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[filled], end[filled]
    end = end - (block.buf[end - 1] == 0x0A)  # the line break is no part of a line
    row = np.searchsorted(block.off, start, side="right") - 1
    h = _text.Words(block.buf, start, end, block.off).hashes()
    order = np.lexsort((h, row))
    same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    np.add.at(out, row[order][1:][same], 1)
    return out


def _repeat_words(w: _text.Words) -> np.ndarray:
    """Words inside 3-word windows that stand twice or more in their text."""
    h, at = _text.windows(w.hashes(), w.off, 3)
    flags = np.zeros(len(w.start), bool)
    if len(h):
        row = np.searchsorted(w.off, at, side="right")
        key = _text.mix(h + _text.mix(row.astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        many = np.zeros(len(h), bool)
        many[order[1:][same]] = many[order[:-1][same]] = True
        for k in range(3):
            flags[at[many] + k] = True
    return _text.counts_in_rows(flags, w.off)


def base_counts(block: _text.Block) -> dict[str, np.ndarray]:
    """The counts of every row of a block."""
    w = _text.words(block)
    inside = np.zeros(len(block.buf) + 1, np.int8)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8) > 0
    return {
        "n_words": np.diff(w.off),
        "word_chars": _text.counts_in_rows(in_word & _text.code_points(block.buf), block.off),
        "n_symbols": _text.counts_in_rows(_SYMBOL[block.buf], block.off),
        "n_dup_lines": _dup_lines(block, w),
        "n_repeat_words": _repeat_words(w),
    }


def band_of(size: int, bands=BANDS) -> tuple[float, float]:
    return next((lo, hi) for below, lo, hi in bands if size < below)


def ratios(text: bytes, compressor: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple[float, float, float]:
    """Ratio of the whole text, and the least and greatest of its chunks (those of the whole if it has one chunk)."""
    if not text:
        return 1.0, 1.0, 1.0
    whole = len(text) / len(compressor.compress(text))
    if len(text) <= chunk:
        return whole, whole, whole
    parts = [text[i : i + chunk] for i in (*range(0, len(text) - chunk, chunk), len(text) - chunk)]
    each = [len(p) / len(compressor.compress(p)) for p in parts]
    return whole, min(each), max(each)


def score_rules(docs: DataFrame, *, text_col: str = "text", bands=BANDS, chunk_band=CHUNK_BAND, chunk: int = CHUNK, level: int = LEVEL) -> DataFrame:
    """``docs`` with the base counts, base_failed, the ratios and kept."""
    docs = without(docs, *ADDED.names)
    schema = T.StructType([*docs.schema.fields, *ADDED.fields])
    arrow = to_arrow_schema(ADDED)
    at = docs.columns.index(text_col)

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=level, write_checksum=False)
        for batch in batches:
            for block in _text.blocks(batch.column(at)):
                out = base_counts(block)
                failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
                r = np.array([ratios(block.text(i), z, chunk) for i in range(len(block))])
                band = np.array([band_of(n, bands) for n in np.diff(block.off)])
                fits = (r[:, 0] >= band[:, 0]) & (r[:, 0] <= band[:, 1])
                chunked = np.diff(block.off) > chunk
                fits &= ~chunked | ((r[:, 1] >= chunk_band[0]) & (r[:, 2] <= chunk_band[1]))
                out |= {"base_failed": failed, "ratio": r[:, 0], "chunk_ratio_min": r[:, 1], "chunk_ratio_max": r[:, 2], "kept": ~failed & fits}
                own = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(out[f.name], f.type) for f in arrow)], schema=pa.schema([*own.schema, *arrow]))

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns."""
    own, names = set_aside(docs)
    return put_back(score_rules(own, text_col=names[options.pop("text_col", "text")], **options).where("kept"), names)
