"""Quality classifier: a generalised additive model with pairwise interactions.

Features are shape statistics of the whole text (``FEATURES``); labels, language, source and id are
never inputs. Every feature is cut into quantile bins. Boosting goes round the features: each step fits a shallow
tree to one feature's bins on the current residuals and adds it to that feature's lookup table. The
strongest pairs of features then get tables of their own on the residuals, in the same way. A
text's score is the logistic of the intercept plus one entry of each table, so scoring is array lookups
and additions.

The fit uses at most ``MAX_ROWS`` labelled rows, those of the least hash of their id (rows beyond are cut off by a threshold
before anything is sorted); features are computed for all documents by their partitions, and only these rows'
features reach the driver.

Defined results: null text counts as empty and has a score; texts of any length are scored whole; repeated documents
have equal scores; an empty table gives an empty result; an id that is labelled twice counts twice; null labels
are left out; without labels, or with one class only, the score is the smoothed share of label 1; other columns are passed on, but one named
like an added column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._spark import without
from .quality_rules import base_counts

FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "stops", "exclaims", "commas",
    "bars", "line_words", "ratio", "distinct_words", "top_word", "high_bytes", "long_words", "capital_words",
)
MAX_ROWS = 50_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
LEAVES = 3
CUT = 0.3


def features(block: _text.Block, z: zstandard.ZstdCompressor) -> np.ndarray:
    """A row of FEATURES for each text of a block."""
    buf, off = block.buf, block.off
    c = base_counts(block)
    w = _text.words(block)
    size = np.maximum(np.diff(off), 1)
    n = np.maximum(c["n_words"], 1)
    count = lambda flags: _text.counts_in_rows(flags, off)
    upper, lower = (buf >= 0x41) & (buf <= 0x5A), (buf >= 0x61) & (buf <= 0x7A)
    length = w.end - w.start
    h = w.hashes()
    row = w.row_of()
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(h)))
    top = np.zeros(len(block))
    np.maximum.at(top, row[order][first], runs)
    lines = count(buf == 0x0A) + 1
    ratio = np.array([(off[i + 1] - off[i]) / len(z.compress(block.text(i))) for i in range(len(block))])
    return np.column_stack(
        (
            np.log1p(c["n_words"]),
            c["word_chars"] / n,
            c["n_symbols"] / n,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / n,
            count(upper) / np.maximum(count(upper | lower), 1),
            count((buf >= 0x30) & (buf <= 0x39)) / size,
            count(buf == 0x2E) / n,
            count((buf == 0x21) | (buf == 0x3F)) / n,
            count(buf == 0x2C) / n,
            count(buf == 0x7C) / n,
            c["n_words"] / lines,
            ratio / np.log2(size + 16),
            np.bincount(row[order][first], minlength=len(block)) / n,
            top / n,
            count(buf >= 0x80) / size,
            _text.counts_in_rows(length > 12, w.off) / n,
            _text.counts_in_rows((buf[w.start] >= 0x41) & (buf[w.start] <= 0x5A), w.off) / n,
        )
    ).astype(np.float64)


def add_features(docs: DataFrame, *, text_col: str = "text", out: str = "features") -> DataFrame:
    """``docs`` without the text, with an array of FEATURES."""
    docs = without(docs, out)
    rest = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(out, T.ArrayType(T.DoubleType()))])
    at = docs.columns.index(text_col)

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for block in _text.blocks(batch.column(at)):
                values = features(block, z)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)), pa.array(values.ravel()))
                own = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([*(x for i, x in enumerate(own.columns) if i != at), lists], names=[*rest, out])

    return docs.mapInArrow(run, schema)


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables. ``pairs``: (feature, feature, edges of either, table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total = np.full(len(x), self.intercept)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, k], side="right")]
        for i, j, a, b, t in self.pairs:
            total += t[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < least) | (hr < least)] = 0
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """The step of a tree of few leaves on a row of bins, for each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, cut, k = max((*_best_cut(g[a:b], h[a:b], least), k) for k, (a, b) in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """A tree of four leaves on a grid: one feature is cut, then the other one in each half. Gain and step for each cell."""
    best = (0.0, np.zeros_like(g))
    total = g.sum() ** 2 / (h.sum() + 1)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(a)):
            step, gain = np.zeros_like(a), -total
            for rows in (slice(0, cut), slice(cut, len(a))):
                gg, hh = a[rows].sum(axis=0), b[rows].sum(axis=0)
                _, at = _best_cut(gg, hh, least)
                for cols in (slice(0, at), slice(at, len(gg))):
                    u, v = gg[cols].sum(), hh[cols].sum()
                    step[rows, cols] = u / (v + 1)
                    gain += u**2 / (v + 1)
            if gain > best[0]:
                best = (gain, step.T if turn else step)
    return best


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = BINS, pairs: int = PAIRS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, rate: float = RATE, leaves: int = LEAVES) -> AdditiveModel:
    """Cyclic boosting of one table for each feature, then of tables for the strongest pairs."""
    n = len(y)
    p = (y.sum() + 1) / (n + 2)
    start = float(np.log(p / (1 - p)))
    if n == 0 or y.min() == y.max():
        return AdditiveModel(start, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [])
    edges = [_edges(x[:, k], bins) for k in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(n, start)
    least = max(1.0, 0.0005 * n)
    for _ in range(rounds):
        for k, b in enumerate(binned):
            q = 1 / (1 + np.exp(-total))
            g = np.bincount(b, y - q, minlength=len(tables[k]))
            h = np.bincount(b, q * (1 - q), minlength=len(tables[k]))
            step = rate * np.clip(_tree(g, h, leaves, least * 0.01), -4, 4)
            tables[k] += step
            total += step[b]
    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(cells[i] * shape[1] + cells[j], values, minlength=shape[0] * shape[1]).reshape(shape)

    q = 1 / (1 + np.exp(-total))
    ranked = sorted(((_pair_tree(grid(i, j, y - q), grid(i, j, q * (1 - q)), 0.1)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    chosen = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in ranked[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, _, _, t in chosen:
            q = 1 / (1 + np.exp(-total))
            step = rate * np.clip(_pair_tree(grid(i, j, y - q), grid(i, j, q * (1 - q)), 0.1)[1], -4, 4)
            t += step
            total += step[cells[i], cells[j]]
    return AdditiveModel(start, edges, tables, chosen)


def held_out(id_col: str) -> Column:
    """Rows that are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(featured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", features_col: str = "features", max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Fit on labelled rows that are not held out, at most ``max_rows`` of them (a bounded sample, by hash of the id)."""
    known = labels.where(F.col(label_col).isNotNull()).where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    both = known.join(featured.select(F.col(id_col).alias("id"), F.col(features_col).alias("x")), "id")
    # (the hash cuts off all rows but a few more than are wanted, so no task sorts more than these)
    both = both.withColumn("h", F.xxhash64("id"))
    n = known.count()
    if n > max_rows:
        share = (max_rows + 10 * max_rows**0.5) / n
        both = both.where(F.col("h") < int(-(1 << 63) + min(1.0, share) * ((1 << 64) - 1024)))
    rows = both.orderBy("h", "id", "y", "x").limit(max_rows).select("y", "x").toArrow()
    y = rows.column("y").to_numpy().astype(np.float64)
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(FEATURES))
    return fit(x, y)


def score_features(featured: DataFrame, model: AdditiveModel, *, features_col: str = "features", cut: float = CUT) -> DataFrame:
    """``featured`` without the features, with score and predicted."""
    featured = without(featured, "score", "predicted")
    rest = [c for c in featured.columns if c != features_col]
    schema = T.StructType([*(featured.schema[c] for c in rest), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = featured.columns.index(features_col)

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(batch.columns)) if i != at), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=[*rest, "score", "predicted"])

    return featured.mapInArrow(run, schema)
