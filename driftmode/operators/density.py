"""Kernel density estimates, general mean-shift steps, and speedup tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .components import _saved, drop_table

#: Bytes of query rows that may travel to every task.
QUERY_BYTES = 64 << 20
#: Queries and points that a task compares at once.
TILE = 1024
#: Points of two dimensions that a task puts in order at once, and the most strips that it cuts a bandwidth into.
CHUNK, STRIPS = 1 << 19, 512
#: Strips to a bandwidth, of the root of the points to a square of it: more take more sums, fewer more comparisons.
SHARE = 0.45
#: Pairs of a query and a strip, about, that are looked up at once.
LOOKUPS = 1 << 16
#: Queries whose sums travel as one row.
PARCEL = 1 << 12
#: Bits of the fixed-point unit of a point's place within its strip: sums of ``CHUNK`` of them, and of their products, are
#: exact. Points that count for more than twice as many in all get a unit of fewer bits: 36 at least, as a point counts for
#: less than ``DIGIT`` in a sum.
_UNIT_BITS, DIGIT = 41, 1 << 7
#: Weights of a mean-shift step by the squared distance in bandwidths: the shadow of the kernel that is climbed.
STEP_WEIGHTS = {
    "uniform": lambda d: (d < 1).astype(np.float64),
    "gaussian": lambda d: np.exp(-0.5 * d),
    "epanechnikov": lambda d: np.maximum(1.0 - d, 0.0),
}


def profile(kernel: str, q: Column) -> Column:
    """Kernel of one dimension as a function of the squared distance in bandwidths."""
    if kernel == "gaussian":
        return F.exp(F.lit(-0.5) * q) / F.lit(math.sqrt(2 * math.pi))
    if kernel == "epanechnikov":
        return F.when(q < 1.0, F.lit(0.75) * (F.lit(1.0) - q)).otherwise(F.lit(0.0))
    if kernel == "uniform":
        return F.when(q < 1.0, F.lit(0.5)).otherwise(F.lit(0.0))
    raise ValueError(f"unknown kernel {kernel!r}")


def kernel_sum(points: DataFrame, column: str, grid: list[float], h: float, kernel: str = "gaussian") -> DataFrame:
    """(x, total, n): the sum of kernels of all non-null points at each grid value. A point meets the grid in its own row;
    sums are combined before the shuffle."""
    places = points.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("p")).withColumn("x", F.explode(F.array(*map(F.lit, grid))))
    d = (F.col("x") - F.col("p")) / F.lit(h)
    return places.withColumn("k", profile(kernel, d * d)).groupBy("x").agg(F.sum("k").alias("total"), F.count("*").alias("n"))


def density(points: DataFrame, column: str, grid: list[float], h: float, kernel: str = "gaussian") -> DataFrame:
    """(x, density): the estimate sum / (n h)."""
    return kernel_sum(points, column, grid, h, kernel).select("x", (F.col("total") / (F.col("n") * F.lit(h))).alias("density"))


def joint_density(points: DataFrame, a: str, b: str, grid: list[tuple[float, float]], h: tuple[float, float], kernels: tuple[str, str]) -> DataFrame:
    """(x, y, density) of the product kernel of two domains."""
    spots = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in grid))
    rows = points.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("p"), F.col(b).cast("double").alias("q"), F.explode(spots).alias("s"))
    d, e = (F.col("s.x") - F.col("p")) / F.lit(h[0]), (F.col("s.y") - F.col("q")) / F.lit(h[1])
    k = profile(kernels[0], d * d) * profile(kernels[1], e * e)
    out = rows.select("s.x", "s.y", k.alias("k")).groupBy("x", "y").agg(F.sum("k").alias("t"), F.count("*").alias("n"))
    return out.select("x", "y", (F.col("t") / (F.col("n") * F.lit(h[0]) * F.lit(h[1]))).alias("density"))


class Strips:
    """Points of two dimensions in order, whose uniform or epanechnikov weights add up without a look at each.

    The plane is cut into strips along the first axis, ``m`` to a bandwidth, and points are sorted by strip and, in it, by
    bins of the first coordinate. A query's disc covers a run of each strip. What is surely inside is a difference of running
    sums: of the coordinates within the strip, their squares and products, as integers, so that nothing is lost. Points in
    the bins that the circle may cross are compared one by one. A point counts ``times`` over, or once.
    """

    def __init__(self, x: np.ndarray, h: float, kernel: str, times: np.ndarray | None = None):
        self.h, self.cubic = h, kernel == "epanechnikov"
        u = x / h
        self.low = np.floor(u.min(axis=0))
        wide = u.max(axis=0) - self.low
        area = len(np.unique(np.floor(8 * (u - self.low)).astype(np.int64) @ np.array([1 << 31, 1]))) / 64
        # (a power of two: the middles of strips are short binary numbers, so sums of such numbers stay what they are)
        self.m = m = 1 << int(np.clip(np.rint(np.log2(SHARE * np.sqrt(len(x) / area))), 0, STRIPS.bit_length() - 1))
        self.bins = 8 * m
        self.n_strips, self.n_bins = int(wide[1] * m) + 1, int(wide[0] * self.bins) + 1
        # places are known to a few units in the last digit
        self.slack = 1e-9 + 1e-14 * float(np.abs(u).max())
        strip, at = np.floor((u[:, 1] - self.low[1]) * m).astype(np.int64), np.floor((u[:, 0] - self.low[0]) * self.bins).astype(np.int64)
        key = strip * (self.n_bins + 1) + at
        order = np.argsort(key, kind="stable")
        self.key, at, strip = key[order], at[order], strip[order]
        self.columns = [x[order, c] for c in range(2)]
        # where each bin begins, if there are not many more bins than points; else it is searched
        cells = self.n_strips * (self.n_bins + 1)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.key, minlength=cells), dtype=np.int32)], dtype=np.int32) if cells < 12 * len(x) + 1024 else None
        # places within a strip and a stretch of two bandwidths of it
        a = u[order, 0] - (self.low[0] + 2 * (at // (2 * self.bins)) + 1)
        b = u[order, 1] - (self.low[1] + (strip + 0.5) / m)
        sums = [a, b]
        if self.cubic:
            r = a * a + b * b
            sums += [r, a * a, a * b, b * b, a * r, b * r]
        self.times = None if times is None else times[order]
        self.counts = None if times is None else np.concatenate([[0], np.cumsum(self.times)])
        self.unit = 2.0 ** min(_UNIT_BITS, 62 - int(len(x) if times is None else self.counts[-1]).bit_length())
        self.sums = np.zeros((len(x) + 1, len(sums)), np.int64)
        for k, s in enumerate(sums):
            whole = np.rint(s * self.unit).astype(np.int64)
            np.cumsum(whole if times is None else whole * self.times, out=self.sums[1:, k])

    @staticmethod
    def fit(x: np.ndarray, h: float) -> bool:
        """Whether bins of these points can be numbered."""
        return x.shape[1] == 2 and float(np.abs(x).max()) / h < 2.0**20

    def _find(self, strip: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = strip * (self.n_bins + 1) + np.clip(at, 0, self.n_bins).astype(np.int64)
        return np.searchsorted(self.key, key) if self.starts is None else self.starts[key]

    def add(self, y: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        """Add the weights of all points, and the weighted points, for each query."""
        near = np.flatnonzero(np.isfinite(y).all(axis=1) & (np.abs(y) / self.h < 2.0**21).all(axis=1))
        near = near[np.lexsort((y[near, 0], np.floor(y[near, 1] / self.h * self.m)))]
        step = max(1, LOOKUPS // (2 * self.m + 3))
        for k in range(0, len(near), step):
            some = near[k : k + step]
            w, t = self._block(y[some])
            weight[some] += w
            total[some] += t

    def _block(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, n, slack = self.m, len(y), self.slack
        c = y / self.h - self.low
        first = np.floor((c[:, 1] - 1) * m).astype(np.int64) - 1
        strip = first[:, None] + np.arange(2 * m + 4)
        who, _ = np.nonzero((strip >= 0) & (strip < self.n_strips))
        strip = strip[(strip >= 0) & (strip < self.n_strips)]
        a, off = c[who, 0], c[who, 1] - (strip + 0.5) / m
        far, close = np.abs(off) + 0.5 / m + slack, np.maximum(np.abs(off) - 0.5 / m - slack, 0)
        some = close < 1
        who, strip, a, off, far, close = (z[some] for z in (who, strip, a, off, far, close))
        outer = np.sqrt(1 - close * close) + slack
        inner = np.sqrt(np.maximum(1 - far * far, 0)) - slack
        begin, end = np.floor((a - outer) * self.bins), np.floor((a + outer) * self.bins) + 1
        left, right = np.ceil((a - inner) * self.bins), np.floor((a + inner) * self.bins)
        left = np.where(left < right, left, end)
        right = np.maximum(left, right)
        turn = 2 * self.bins * (np.floor(left / (2 * self.bins)) + 1)  # where the next stretch begins
        turn = np.clip(turn, left, right)
        p0, p1, p2, p3, p4 = (self._find(strip, z) for z in (begin, left, turn, right, end))
        weight, total = np.zeros(n), np.zeros((n, 2))
        stretch = np.floor(left / (2 * self.bins))
        for x, z, number in ((p1, p2, stretch), (p2, p3, stretch + 1)):
            has = np.flatnonzero(z > x)
            self._inside(who[has], x[has], z[has], a[has] - (2 * number[has] + 1), off[has], 2 * number[has] + 1, (strip[has] + 0.5) / m, weight, total)
        for x, z in ((p0, p1), (p3, p4)):
            has = np.flatnonzero(z > x)
            size = (z - x)[has]
            at = np.arange(size.sum()) + np.repeat(x[has] - (np.cumsum(size) - size), size)
            self._compared(y, (who[has], size), at, weight, total)
        return weight, total

    def _inside(self, who, x, z, a, b, at, row, weight, total) -> None:
        """Runs of points: queries are at (a, b) from the middle of the runs, which is at (at, row)."""
        count = (z - x if self.counts is None else self.counts[z] - self.counts[x]).astype(np.float64)
        s = ((self.sums[z] - self.sums[x]) / self.unit).T
        if self.cubic:
            sa, sb, sr, saa, sab, sbb, sar, sbr = s
            rest = 1 - (a * a + b * b)
            w = rest * count + 2 * (a * sa + b * sb) - sr
            ta = rest * sa + 2 * (a * saa + b * sab) - sar
            tb = rest * sb + 2 * (a * sab + b * sbb) - sbr
        else:
            w, ta, tb = count, s[0], s[1]
        n = len(weight)
        weight += np.bincount(who, w, n)
        total[:, 0] += np.bincount(who, (ta + (self.low[0] + at) * w) * self.h, n)
        total[:, 1] += np.bincount(who, (tb + (self.low[1] + row) * w) * self.h, n)

    def _compared(self, y, runs, at, weight, total) -> None:
        """Runs of points, one by one: ``runs`` has the query and the number of points of each, ``at`` all points."""
        who, size = runs
        if not len(at):
            return
        near, d = [x[at] for x in self.columns], np.zeros(len(at))
        for c in range(2):
            diff = np.repeat(y[who, c], size)
            diff -= near[c]
            diff /= self.h
            diff *= diff
            d += diff
        w = STEP_WEIGHTS["epanechnikov" if self.cubic else "uniform"](d)
        if self.times is not None:
            w *= self.times[at]
        n, begin = len(weight), np.cumsum(size) - size
        weight += np.bincount(who, np.add.reduceat(w, begin), n)
        for c in range(2):
            near[c] *= w
            total[:, c] += np.bincount(who, np.add.reduceat(near[c], begin), n)


def _compare_all(x: np.ndarray, y: np.ndarray, h: float, kernel: str, weight: np.ndarray, total: np.ndarray, times: np.ndarray | None = None) -> None:
    for i in range(0, len(y), TILE):
        some = y[i : i + TILE]
        for k in range(0, len(x), TILE):
            near = x[k : k + TILE]
            d = np.zeros((len(some), len(near)))
            for c in range(y.shape[1]):
                diff = (some[:, c, None] - near[None, :, c]) / h
                d += diff * diff
            w = STEP_WEIGHTS[kernel](d)
            if times is not None:
                w *= times[k : k + TILE]
            total[i : i + TILE] += w @ near
            weight[i : i + TILE] += w.sum(axis=1)


def _ordered(dimensions: int, kernel: str) -> bool:
    return dimensions == 2 and kernel != "gaussian"


def _weigh(x: np.ndarray, y: np.ndarray, h: float, kernel: str, weight: np.ndarray, total: np.ndarray, times: np.ndarray | None = None) -> None:
    """Add the weights of all points, and the weighted points, for each query."""
    if not (_ordered(y.shape[1], kernel) and Strips.fit(x, h)):
        _compare_all(x, y, h, kernel, weight, total, times)
        return
    scale = 1.0
    times = np.ones(len(x), np.int64) if times is None else times
    while len(x):  # a digit of the numbers at a time: sums of greater ones would lose places
        low = times % DIGIT
        has = low > 0
        if has.any():
            w, t = np.zeros_like(weight), np.zeros_like(total)
            Strips(x[has], h, kernel, None if (low[has] == 1).all() else low[has]).add(y, w, t)
            weight += scale * w
            total += scale * t
        more = times >= DIGIT
        x, times, scale = x[more], times[more] // DIGIT, scale * DIGIT


def mean_shift_points(points: DataFrame, queries: DataFrame, h: float, kernel: str = "uniform", *, id_col: str, vector_col: str) -> DataFrame:
    """One mean-shift step of query vectors among all points, in any dimension: (id, weight, shifted).

    Queries are a stated set against all rows: their rows travel to every task in blocks of ``QUERY_BYTES``. A
    task adds up its weights and weighted vectors for each query, so what is shuffled is a row for each query and task. In
    two dimensions a task puts its points in order (``Strips``), unless the weights are gaussian, which have no end.
    The weight is 1 inside the bandwidth (uniform), 1 - d^2 / h^2 there (epanechnikov), or exp(-d^2 / 2h^2) (gaussian). A
    query without weight stays put. Ids are of any type, unique and not null; null points, and those with
    a coordinate that is null or not finite, weigh nothing.
    """
    sc = points.sparkSession.sparkContext
    out, ids, rows, held = None, [], [], 0

    if kernel not in STEP_WEIGHTS:
        raise ValueError(f"no such kernel for a mean-shift step: {kernel}")
    id_type = queries.schema[id_col].dataType
    names_of = to_arrow_type(id_type)

    def block() -> DataFrame:
        q = np.array(rows, np.float64)
        sent = sc.broadcast((list(ids), q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, y = sent.value
            total, weight = np.zeros_like(y), np.zeros(len(y))
            strips, held, n_held = _ordered(y.shape[1], kernel), [], 0
            for batch in batches:
                flat = batch.column(0).drop_null()
                if not len(flat):
                    continue
                x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
                x = x[np.isfinite(x).all(axis=1)]
                if not strips:
                    _compare_all(x, y, h, kernel, weight, total)
                    continue
                for k in range(0, len(x), CHUNK):
                    held.append(x[k : k + CHUNK])
                    n_held += len(held[-1])
                    if n_held + len(held[-1]) > CHUNK:
                        _weigh(np.concatenate(held), y, h, kernel, weight, total)
                        held, n_held = [], 0
            if n_held:
                _weigh(np.concatenate(held), y, h, kernel, weight, total)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(names, names_of), pa.array(weight), vectors], ["id", "weight", "total"])

        # files may be fewer than the tasks that could run; tasks of neighbouring strips have the more points in each
        vectors = points.select(F.col(vector_col).alias("v"))
        n = sc.defaultParallelism
        if _ordered(q.shape[1], kernel):
            dealt = vectors.repartitionByRange(n, F.get("v", F.lit(1)), F.get("v", F.lit(0)), F.monotonically_increasing_id()).select("v")
        else:
            dealt = vectors.repartition(n)
        sums = dealt.mapInArrow(run, f"id {id_type.simpleString()}, weight double, total array<double>")
        flat_sums = sums.select("id", "weight", F.posexplode("total").alias("c", "t")).groupBy("id", "c").agg(F.sum("weight").alias("weight"), F.sum("t").alias("t"))
        start = queries.select(F.col(id_col).alias("id"), F.posexplode(vector_col).alias("c", "y"))
        moved = flat_sums.join(start, ["id", "c"]).select("id", "c", "weight", F.when(F.col("weight") > 0, F.col("t") / F.col("weight")).otherwise(F.col("y").cast("double")).alias("z"))
        vector = F.transform(F.sort_array(F.collect_list(F.struct("c", "z"))), lambda s: s["z"])
        return moved.groupBy("id").agg(F.first("weight").alias("weight"), vector.alias("shifted"))

    for name, vector in queries.select(id_col, vector_col).toLocalIterator():
        ids.append(name)
        rows.append(vector)
        held += 8 * len(vector)
        if held >= QUERY_BYTES:
            out = block() if out is None else out.unionByName(block())
            ids, rows, held = [], [], 0
    if rows or out is None:
        if not rows:
            return queries.select(F.col(id_col).alias("id"), F.lit(0.0).alias("weight"), F.col(vector_col).cast("array<double>").alias("shifted")).limit(0)
        out = block() if out is None else out.unionByName(block())
    return out


def _chunks(points: DataFrame, vector_col: str, ordered: bool) -> DataFrame:
    """The points as a table of chunks, (x, times) as bytes. If ``ordered``, equal points are one with their number, and
    chunks are stretches of the points in order; else points are dealt as they come and count once."""
    vectors, n = points.select(F.col(vector_col).alias("v")), points.sparkSession.sparkContext.defaultParallelism
    if ordered:
        spots = vectors.select(F.get("v", F.lit(0)).cast("double").alias("a"), F.get("v", F.lit(1)).cast("double").alias("b")).groupBy("a", "b").agg(F.count("*").alias("times"))
        dealt = spots.repartitionByRange(3 * n, "b", "a").sortWithinPartitions("b", "a")
    else:
        dealt = vectors.repartition(n)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def packed() -> pa.RecordBatch:
            x, times = (np.concatenate(z).tobytes() for z in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()), pa.array([times], pa.binary())], ["x", "times"])

        for batch in batches:
            if ordered:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[:2]])
                times = batch.column(2).to_numpy()
            else:
                flat = batch.column(0).drop_null()
                if not len(flat):
                    continue
                x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
                times = np.ones(len(x), np.int64)
            good = np.isfinite(x).all(axis=1)
            x, times = x[good], times[good]
            most = max(1, 2 * CHUNK // max(2, x.shape[1]))
            for k in range(0, len(x), most):
                if n_held + len(x[k : k + most]) > most:
                    yield packed()
                    held, n_held = [], 0
                held.append((x[k : k + most], times[k : k + most]))
                n_held += len(held[-1][0])
        if n_held:
            yield packed()

    return _saved(dealt.mapInArrow(pack, "x binary, times binary"), "chunks")


def _added(chunks: DataFrame, y: np.ndarray, h: float, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """The weight of all points, and the weighted points, for each query. A task sends sums of the queries that it has
    points for, a row for each ``PARCEL`` of them."""
    order = np.lexsort(y.T)
    sent = chunks.sparkSession.sparkContext.broadcast(y[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = sent.value
        weight, total = np.zeros(len(y)), np.zeros_like(y)
        for batch in batches:
            for x, times in zip(*(c.to_pylist() for c in batch.columns)):
                x, times = np.frombuffer(x).reshape(-1, y.shape[1]), np.frombuffer(times, np.int64)
                a, b = 0, len(y)
                if kernel != "gaussian":  # (queries are in order of the last coordinate; with some slack)
                    low, high = x[:, -1].min(), x[:, -1].max()
                    slack = h + 1e-6 * (h + abs(low) + abs(high))
                    a, b = np.searchsorted(y[:, -1], [low - slack, high + slack])
                if a < b:
                    _weigh(x, y[a:b], h, kernel, weight[a:b], total[a:b], times)
        for k in range(0, len(y), PARCEL):
            if weight[k : k + PARCEL].any():
                sums = np.column_stack([weight[k : k + PARCEL], total[k : k + PARCEL]])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["k", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(*(c.to_pylist() for c in batch.columns)):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(raw)
        for k, raw in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([raw.tobytes()], pa.binary())], ["k", "sums"])

    kind = "k bigint, sums binary"
    found = np.zeros((len(y), 1 + y.shape[1]))
    for k, raw in zip(*(c.to_pylist() for c in chunks.mapInArrow(run, kind).repartition("k").mapInArrow(add, kind).toArrow().columns)):
        found[order[k : k + PARCEL]] = np.frombuffer(raw).reshape(-1, 1 + y.shape[1])
    sent.destroy()
    return found[:, 0], found[:, 1:]


def _climbed(chunks: DataFrame, y: np.ndarray, h: float, kernel: str, epsilon: float, limit: int) -> DataFrame:
    """(start, steps, mode, settled) of each query."""
    mode, steps, settled = y.copy(), np.full(len(y), limit, np.int32), np.zeros(len(y), bool)
    rest = np.flatnonzero(np.isfinite(y).all(axis=1))  # others are near nothing and never settle
    for k in range(1, limit + 1):
        if not len(rest):
            break
        weight, total = _added(chunks, mode[rest], h, kernel)
        before, has = mode[rest], weight > 0
        mode[rest[has]] = total[has] / weight[has, None]
        done = ((before - mode[rest]) ** 2).sum(axis=1) < epsilon
        steps[rest[done]], settled[rest[done]] = k, True
        rest = rest[~done]

    def vectors(z: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))

    made = pa.table({"start": vectors(y), "steps": pa.array(steps), "mode": vectors(mode), "settled": pa.array(settled)})
    return _saved(chunks.sparkSession.createDataFrame(made), "modes")


def mean_shift_modes(points: DataFrame, queries: DataFrame, h: float, kernel: str = "uniform", *, id_col: str, vector_col: str, epsilon: float = 1e-6, limit: int = 100) -> DataFrame:
    """Mean-shift steps until a query moves by less than ``epsilon`` (squared length), ``limit`` of them at most: (id, steps,
    mode, settled). Points are dealt once, to a table in the shared folder (``_chunks``). Equal queries climb as one, in
    blocks of ``QUERY_BYTES`` that the driver holds; a step sends it to all tasks and adds up their sums, and queries that
    have settled leave it. Weights and points are those of ``mean_shift_points``; queries with a null coordinate have no row.
    """
    if kernel not in STEP_WEIGHTS:
        raise ValueError(f"no such kernel for a mean-shift step: {kernel}")
    starts = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("start"))
    chunks, out, rows, held = None, None, [], 0

    def climb() -> None:
        nonlocal chunks, out
        y = np.array(rows, np.float64)
        if chunks is None:
            chunks = _chunks(points, vector_col, _ordered(y.shape[1], kernel))
        block = _climbed(chunks, y, h, kernel, epsilon, limit)
        out = block if out is None else out.unionByName(block)

    for (vector,) in starts.where("start is not null and not exists(start, c -> c is null)").select("start").distinct().toLocalIterator():
        rows.append(vector)
        held += 8 * len(vector)
        if held >= QUERY_BYTES:
            climb()
            rows, held = [], 0
    if rows:
        climb()
    if out is None:
        return starts.select("id", F.lit(0).alias("steps"), F.col("start").alias("mode"), F.lit(False).alias("settled")).limit(0)
    drop_table(chunks)
    return starts.join(out, "start").select("id", "steps", "mode", "settled")


def speedups(times: DataFrame) -> DataFrame:
    """From (pixels, fast_ms, slow_ms): speedup, pixels per ms, and that ratio over its greatest value."""
    ratio = F.col("pixels") / F.col("fast_ms")
    best = times.agg(F.max(ratio).alias("best"))
    return times.crossJoin(F.broadcast(best)).select("pixels", "fast_ms", "slow_ms", (F.col("slow_ms") / F.col("fast_ms")).alias("speedup"), ratio.alias("pixels_per_ms"), (ratio / F.col("best")).alias("normalised"))


def amdahl(p: Column, n: Column) -> Column:
    """Speedup bound for a share ``p`` of parallel work on ``n`` processors."""
    return F.lit(1.0) / ((F.lit(1.0) - p) + p / n)


def gustafson(serial: Column, n: Column) -> Column:
    """Scaled speedup for a serial share on ``n`` processors."""
    return n + (F.lit(1.0) - n) * serial
