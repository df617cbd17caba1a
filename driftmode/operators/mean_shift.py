"""Mean-shift filtering of pixel tables.

Three forms of the window mean: a range join (``window_mean``), an equi join on pixel offsets for
centres that are pixels (``window_mean_by_offsets``), and a vectorised kernel over bands of rows
(``filter_image``), which is the one for large images. The relational loop (``filter_relational``) joins centres and
pixels by tiles and gives the same rows as the kernel bit for bit, since window sums of quantised values are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..params import DEFAULT, Params
from .components import _saved

START = 12345678.0
#: Side of the square tiles by which centres meet pixels. Tile 0 begins a quarter before the origin, so small images lie in one.
SIDE = 128
#: Centres of a tile that are compared at once.
_STEP = 1024


def in_window(p: Params, x: Column, y: Column, l: Column, u: Column, v: Column, c: list[Column]) -> Column:  # noqa: E741
    """Whether a pixel is in the window of a centre: inside the disc, and inside the ball of colours, in which L counts
    fourfold for bright centres."""
    s, r = F.lit(p.sigma_s), F.lit(p.sigma_r)
    dx, dy = (x - c[0]) / s, (y - c[1]) / s
    dl, du, dv = (l - c[2]) / r, (u - c[3]) / r, (v - c[4]) / r
    k = F.when(c[2] > p.bright, F.lit(4.0)).otherwise(F.lit(1.0))
    return (dx * dx + dy * dy < 1.0) & (k * dl * dl + du * du + dv * dv < 1.0)


def _bounds(p: Params, x: Column, y: Column, c: list[Column]) -> Column:
    lo = lambda q: F.greatest((q - p.sigma_s).cast("int"), F.lit(0))
    hi = lambda q: (q + p.sigma_s).cast("int")
    return (x >= lo(c[0])) & (x <= hi(c[0])) & (y >= lo(c[1])) & (y <= hi(c[1]))


def _means(joined: DataFrame, keys: list[str], state: list[str]) -> DataFrame:
    sums = joined.groupBy(*keys, *state).agg(
        F.count("px").alias("n"), F.sum("px").alias("s0"), F.sum("py").alias("s1"), F.sum("pl").alias("s2"), F.sum("pu").alias("s3"), F.sum("pv").alias("s4")
    )
    shift = [F.when(F.col("n") > 0, F.col(f"s{k}") / F.col("n") - F.col(f"y{k}")).otherwise(F.lit(0.0)).alias(f"m{k}") for k in range(5)]
    out = sums.select(*keys, *state, "n", *shift)
    m = [F.col(f"m{k}") for k in range(5)]
    return out.withColumn("mag", m[0] * m[0] + m[1] * m[1] + m[2] * m[2] + m[3] * m[3] + m[4] * m[4])


def _samples(luv: DataFrame) -> DataFrame:
    return luv.select(F.col("image_id").alias("pi"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), F.col("l").alias("pl"), F.col("u").alias("pu"), F.col("v").alias("pv"))


def centres(luv: DataFrame) -> DataFrame:
    """The start of every pixel: its own place and colour as y0..y4."""
    return luv.select("image_id", "idx", F.col("x").cast("double").alias("y0"), F.col("y").cast("double").alias("y1"), F.col("l").alias("y2"), F.col("u").alias("y3"), F.col("v").alias("y4"))


def window_mean(state: DataFrame, luv: DataFrame, p: Params = DEFAULT, cell: int = 8) -> DataFrame:
    """Window means of centres: n, the shifts m0..m4 and their squared length mag, beside all columns of ``state``.

    The range join is an equi join on grid cells of the size of the bandwidth, with the exact test on top: every centre
    looks up the cells that its window touches. A centre without pixels in its window stands still.
    """
    cell = max(cell, math.ceil(p.sigma_s))
    s = _samples(luv)
    s = s.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    keys = state.columns
    near = lambda c: F.sequence(F.floor((F.col(c) - p.sigma_s) / cell), F.floor((F.col(c) + p.sigma_s) / cell))
    c = state.withColumn("cx", F.explode(near("y0"))).withColumn("cy", F.explode(near("y1")))
    ys = [F.col(f"y{k}") for k in range(5)]
    test = in_window(p, F.col("px"), F.col("py"), F.col("pl"), F.col("pu"), F.col("pv"), ys) & _bounds(p, F.col("px"), F.col("py"), ys)
    joined = c.join(s, (F.col("image_id") == F.col("pi")) & (c["cx"] == s["cx"]) & (c["cy"] == s["cy"]) & test, "left")
    return _means(joined, ["image_id", "idx"], [k for k in keys if k not in ("image_id", "idx")])


def offsets(p: Params = DEFAULT) -> list[tuple[int, int]]:
    """Whole offsets inside the disc."""
    n = math.ceil(p.sigma_s)
    return [(dx, dy) for dy in range(-n, n + 1) for dx in range(-n, n + 1) if (dx / p.sigma_s) ** 2 + (dy / p.sigma_s) ** 2 < 1]


def _tile_of(c: Column) -> Column:
    return F.floor((c + F.lit(SIDE // 4)) / F.lit(SIDE))


def _tiles(luv: DataFrame, halo: int) -> DataFrame:
    """Pixels dealt to tiles and, as far as the halo reaches, to their neighbours: (image_id, tx, ty, idx, x, y, l, u, v, own)."""
    reach = lambda c: F.explode(F.sequence(_tile_of(F.col(c) - halo), _tile_of(F.col(c) + halo)))
    rows = luv.select("image_id", "idx", "x", "y", "l", "u", "v").withColumn("tx", reach("x")).withColumn("ty", reach("y"))
    return rows.withColumn("own", (F.col("tx") == _tile_of(F.col("x"))) & (F.col("ty") == _tile_of(F.col("y"))))


def _by_tile(rows: DataFrame):
    """Groups of a tile. Tiles are small but take long, so they are dealt to a given number of tasks, which stay as they are."""
    spark, by = rows.sparkSession, ["image_id", "tx", "ty"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *by).groupBy(*by)


def _no_place() -> Column:
    """Whether a pixel lacks a place or a colour: it is in no window, its own included."""
    return F.expr(" or ".join(f"{c} is null" for c in ("image_id", "x", "y", "l", "u", "v")))


class _Tile:
    """The pixels of a tile in order of their places; a place can have none, one, or several."""

    def __init__(self, table: pa.Table):
        x, y = (table.column(c).to_numpy().astype(np.int64) for c in "xy")
        self.left, self.top = int(x.min()), int(y.min())
        self.wide, self.high = int(x.max()) + 1 - self.left, int(y.max()) + 1 - self.top
        place = (y - self.top) * self.wide + x - self.left
        order = np.argsort(place, kind="stable")
        self.start = np.zeros(self.wide * self.high + 1, np.int64)
        np.cumsum(np.bincount(place, minlength=self.wide * self.high), out=self.start[1:])
        self.x, self.y = x[order].astype(np.float64), y[order].astype(np.float64)
        self.colour = [table.column(c).to_numpy()[order] for c in "luv"]

    def near(self, c: np.ndarray, who: np.ndarray, at: np.ndarray, p: Params) -> np.ndarray:
        """Which of the pixels ``at`` have a colour within the ball of the centres ``who``."""
        dl, du, dv = ((z[at] - c[who, k]) / p.sigma_r for k, z in zip((2, 3, 4), self.colour))
        k = np.where(c[who, 2] > p.bright, 4.0, 1.0)
        return k * dl * dl + du * du + dv * dv < 1.0

    def add(self, who: np.ndarray, at: np.ndarray, count: np.ndarray, sums: np.ndarray) -> None:
        count += np.bincount(who, minlength=len(count))
        for k, z in enumerate((self.x, self.y, *self.colour)):
            sums[k] += np.bincount(who, z[at], len(count))

    def by_range(self, c: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
        """Counts and shifts of centres (rows of x, y, L, u, v): each row of a window is a run of pixels."""
        first = np.maximum(np.trunc(c[:, :2] - p.sigma_s), 0).astype(np.int64)
        last = np.trunc(c[:, :2] + p.sigma_s).astype(np.int64)
        row = first[:, 1, None] + np.arange(2 * math.ceil(p.sigma_s) + 2)
        who, _ = np.nonzero((row <= last[:, 1, None]) & (row >= self.top) & (row < self.top + self.high))
        row = row[(row <= last[:, 1, None]) & (row >= self.top) & (row < self.top + self.high)]
        half = np.sqrt(np.maximum(p.sigma_s**2 - (row - c[who, 1]) ** 2, 0)) + 1e-6
        x0 = np.maximum(np.maximum(first[who, 0], np.floor(c[who, 0] - half).astype(np.int64)) - self.left, 0)
        x1 = np.minimum(np.minimum(last[who, 0], np.ceil(c[who, 0] + half).astype(np.int64)) - self.left, self.wide - 1)
        some = x0 <= x1
        who, line, x0, x1 = who[some], (row[some] - self.top) * self.wide, x0[some], x1[some]
        begin, end = self.start[line + x0], self.start[line + x1 + 1]
        size = end - begin
        who = np.repeat(who, size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)
        dx, dy = (self.x[at] - c[who, 0]) / p.sigma_s, (self.y[at] - c[who, 1]) / p.sigma_s
        inside = dx * dx + dy * dy < 1.0
        who, at = who[inside], at[inside]
        hit = self.near(c, who, at, p)
        count, sums = np.zeros(len(c), np.int64), np.zeros((5, len(c)))
        self.add(who[hit], at[hit], count, sums)
        return count, _shifts(c, count, sums)

    def by_offsets(self, c: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
        """The same for centres that are pixels, an offset of the disc after the other."""
        count, sums = np.zeros(len(c), np.int64), np.zeros((5, len(c)))
        x, y = c[:, 0].astype(np.int64) - self.left, c[:, 1].astype(np.int64) - self.top
        found, n_found = [], 0
        for dx, dy in offsets(p):
            ox, oy = x + dx, y + dy
            who = np.flatnonzero((ox >= 0) & (ox < self.wide) & (oy >= 0) & (oy < self.high))
            place = oy[who] * self.wide + ox[who]
            at, end = self.start[place], self.start[place + 1]
            while True:
                has = at < end
                who, at, end = who[has], at[has], end[has]
                if not len(who):
                    break
                hit = self.near(c, who, at, p)
                found.append((who[hit], at[hit]))
                n_found += len(found[-1][0])
                at = at + 1
            if n_found > 1 << 18:
                self.add(*map(np.concatenate, zip(*found)), count, sums)
                found, n_found = [], 0
        if found:
            self.add(*map(np.concatenate, zip(*found)), count, sums)
        return count, _shifts(c, count, sums)


def _shifts(c: np.ndarray, count: np.ndarray, sums: np.ndarray) -> np.ndarray:
    out, some = np.zeros_like(c), count > 0
    out[some] = (sums[:, some] / count[some]).T - c[some]
    return out


def _length(m: np.ndarray) -> np.ndarray:
    return m[:, 0] * m[:, 0] + m[:, 1] * m[:, 1] + m[:, 2] * m[:, 2] + m[:, 3] * m[:, 3] + m[:, 4] * m[:, 4]


def _distinct(table: pa.Table, columns: list[str]) -> tuple[pa.Table, np.ndarray]:
    """The rows that differ in some column, and how often each is there."""
    table = table.combine_chunks()
    keys = [table.column(c).to_numpy().view(np.int64) for c in columns]
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return table.take(pa.array(order[at])), np.diff(np.append(at, len(order)))


def window_mean_by_offsets(luv: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The first step only, whose centres are pixels: an equi join on (x, y) for every offset of the disc. Pixels are shuffled
    once, to tiles with a halo, and the offsets of a tile are joined there by the pixels' places."""
    kind = luv.schema["image_id"].dataType.simpleString()
    state = ["idx", "y0", "y1", "y2", "y3", "y4"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tile = _Tile(table)
        own, times = _distinct(table.filter(table.column("own")).select(state), state)
        c = np.column_stack([own.column(f"y{k}").to_numpy() for k in range(5)])
        count, m = tile.by_offsets(c, p)
        ids = pa.array([key[0].as_py()] * len(c), table.schema.field("image_id").type)
        shifts = {f"m{k}": m[:, k] for k in range(5)}
        return pa.table({"image_id": ids, **{s: own.column(s) for s in state}, "n": count * times, **shifts, "mag": _length(m)})

    doubles = lambda names: ", ".join(f"{c} double" for c in names)
    numbers = f"{doubles(state[1:])}, n bigint, {doubles(['m0', 'm1', 'm2', 'm3', 'm4', 'mag'])}"
    # (colours are long expressions, which every test and copy would compute anew)
    luv = _saved(luv.select("image_id", "idx", "x", "y", "l", "u", "v"), "luv")
    rows = _tiles(luv.where(~_no_place()), math.ceil(p.sigma_s))
    places = [F.col("x").cast("double").alias("y0"), F.col("y").cast("double").alias("y1"), F.col("l").alias("y2"), F.col("u").alias("y3"), F.col("v").alias("y4")]
    found = _by_tile(rows.select("*", *places)).applyInArrow(run, f"image_id {kind}, idx bigint, {numbers}")
    alone = centres(luv.where(_no_place())).distinct()
    return found.unionByName(alone.select("*", F.lit(0).cast("bigint").alias("n"), *(F.lit(0.0).alias(c) for c in ("m0", "m1", "m2", "m3", "m4", "mag"))))


def filter_relational(luv: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The filter as a loop of joins: (image_id, idx, l, u, v, iters).

    A round joins the live centres with the pixels of the tiles that they stand in. A centre shifts there until it ends or
    leaves the tile; its place, iterations and past lengths then go to the next round. The window of a centre in a tile is
    within the tile's halo.
    """
    kind = luv.schema["image_id"].dataType.simpleString()
    halo = math.ceil(p.sigma_s) + 1
    ys = [f"y{k}" for k in range(5)]
    schema = f"image_id {kind}, idx bigint, {', '.join(f'{c} double' for c in ys)}, it int, lc array<double>, done boolean"
    types = [to_arrow_type(luv.schema["image_id"].dataType), pa.int64(), *[pa.float64()] * 5, pa.int32(), pa.list_(pa.float64()), pa.bool_()]
    empty = pa.schema(list(zip(("image_id", "idx", *ys, "it", "lc", "done"), types))).empty_table()

    def run(key: tuple, live: pa.Table, pixels: pa.Table) -> pa.Table:
        if not live.num_rows:
            return empty
        tile, corner = _Tile(pixels), np.array([key[1].as_py(), key[2].as_py()], np.float64)
        if not live.column("it")[0].as_py():  # the first round: equal pixels are one centre
            live = _distinct(live, ["idx", *ys])[0]
        pos = np.column_stack([live.column(c).to_numpy() for c in ys])
        it, done = live.column("it").to_numpy().astype(np.int32), np.zeros(len(pos), bool)
        ring = live.column("lc").combine_chunks().flatten().to_numpy().reshape(len(pos), p.cycle_slots).copy()
        for begin in range(0, len(pos), _STEP):
            at = np.arange(begin, min(len(pos), begin + _STEP))
            while len(at):
                _, m = tile.by_range(pos[at], p)
                mag, first = _length(m), it[at] == 0
                cycle = ~first & (ring[at] == mag[:, None]).any(axis=1)
                later = at[~first]
                if p.cycle_slots:
                    ring[later] = np.column_stack((ring[later, 1:], mag[~first]))
                it[at] += ~cycle
                done[at] = cycle | (mag < p.epsilon) | (it[at] >= p.limit)
                pos[at] += m
                stays = (np.floor((pos[at, :2] + SIDE // 4) / SIDE) == corner).all(axis=1)
                at = at[~done[at] & stays]
        rings = pa.ListArray.from_arrays(pa.array(np.arange(len(pos) + 1, dtype=np.int32) * p.cycle_slots), pa.array(ring.ravel()))
        return pa.table({"image_id": live.column("image_id"), "idx": live.column("idx"), **{c: pos[:, k] for k, c in enumerate(ys)}, "it": it, "lc": rings, "done": done})

    luv = _saved(luv.select("image_id", "idx", "x", "y", "l", "u", "v"), "luv")
    alone = luv.where(_no_place()).select("image_id", "idx", "x", "y", "l", "u", "v", F.lit(1).alias("iters")).distinct().drop("x", "y")
    luv = luv.where(~_no_place())
    tiles = _tiles(luv, halo).drop("own", "idx")
    live = centres(luv).withColumn("it", F.lit(0)).withColumn("lc", F.array_repeat(F.lit(START), p.cycle_slots))
    ends = []
    while True:
        dealt = live.withColumn("tx", _tile_of(F.col("y0"))).withColumn("ty", _tile_of(F.col("y1")))
        by = ["image_id", "tx", "ty"]
        wanted = tiles.join(dealt.select(by).distinct(), by, "left_semi") if ends else tiles
        state = _saved(_by_tile(dealt).cogroup(_by_tile(wanted)).applyInArrow(run, schema), "filter")
        ends.append(state.where("done"))
        live = state.where("not done").drop("done")
        if live.isEmpty():
            break
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out.select("image_id", "idx", F.col("y2").alias("l"), F.col("y3").alias("u"), F.col("y4").alias("v"), F.col("it").alias("iters")).unionByName(alone)


def shift_windows(y: np.ndarray, image: np.ndarray, top: int, p: Params) -> np.ndarray:
    """Shifts of centres ``y`` (rows of x, y, L, u, v) in an image band whose first row is ``top``. Missing pixels are NaN."""
    h, w, _ = image.shape
    n = 2 * math.ceil(p.sigma_s) + 1
    step = np.arange(n)
    x0 = np.maximum(np.trunc(y[:, 0] - p.sigma_s).astype(np.int64), 0)
    y0 = np.maximum(np.trunc(y[:, 1] - p.sigma_s).astype(np.int64), 0)
    xs, ys = x0[:, None] + step, y0[:, None] + step
    fx = (xs - y[:, :1]) / p.sigma_s
    fy = (ys - y[:, 1:2]) / p.sigma_s
    ix, iy = np.minimum(xs, w - 1), np.clip(ys - top, 0, h - 1)
    inside = (fx * fx)[:, None, :] + (fy * fy)[:, :, None] < 1
    inside &= (xs < w)[:, None, :] & ((ys - top >= 0) & (ys - top < h))[:, :, None]
    who, row, col = np.nonzero(inside)
    colour = image[iy[who, row], ix[who, col]]
    d = (colour - y[who, 2:]) / p.sigma_r
    k = np.where(y[who, 2] > p.bright, 4.0, 1.0)
    near = k * d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] < 1
    who, row, col, colour = who[near], row[near], col[near], colour[near]
    count = np.bincount(who, minlength=len(y)).astype(np.float64)
    sums = [np.bincount(who, xs[who, col], len(y)), np.bincount(who, ys[who, row], len(y)), *(np.bincount(who, colour[:, c], len(y)) for c in range(3))]
    out = np.zeros_like(y)
    some = count > 0
    for c, s in enumerate(sums):
        out[some, c] = s[some] / count[some] - y[some, c]
    return out


def run_kernel(y: np.ndarray, image: np.ndarray, top: int, open_top: bool, open_bottom: bool, p: Params, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filter centres to their ends: (colour, iterations, finished). A centre whose window leaves the band at an end where
    the image goes on (one that isn't ``open``) is given up."""
    colour, iters, finished = np.empty((len(y), 3)), np.zeros(len(y), np.int32), np.zeros(len(y), bool)
    bottom = top + image.shape[0] - 1
    for begin in range(0, len(y), step):
        at = np.arange(begin, min(len(y), begin + step))
        pos = y[at].copy()
        ring = np.full((len(at), max(1, p.cycle_slots)), START)
        it = np.zeros(len(at), np.int32)
        first = True
        while len(at):
            if not (open_top and open_bottom):
                stay = (open_top | (pos[:, 1] - p.sigma_s >= top)) & (open_bottom | (pos[:, 1] + p.sigma_s <= bottom))
                at, pos, ring, it = at[stay], pos[stay], ring[stay], it[stay]
                if not len(at):
                    break
            m = shift_windows(pos, image, top, p)
            mag = m[:, 0] * m[:, 0] + m[:, 1] * m[:, 1] + m[:, 2] * m[:, 2] + m[:, 3] * m[:, 3] + m[:, 4] * m[:, 4]
            cycle = np.zeros(len(at), bool)
            if not first and p.cycle_slots:
                cycle = (ring == mag[:, None]).any(axis=1)
                ring = np.concatenate((ring[:, 1:], mag[:, None]), axis=1)
            it = it + ~cycle
            first = False
            end = cycle | (mag < p.epsilon) | (it >= p.limit)
            pos = pos + m
            colour[at[end]], iters[at[end]], finished[at[end]] = pos[end, 2:], it[end], True
            at, pos, ring, it = at[~end], pos[~end], ring[~end], it[~end]
    return colour, iters, finished


def _bands(luv: DataFrame, wanted: DataFrame | None, band: int, halo: int) -> DataFrame:
    """Pixels dealt to bands of rows with a halo: (image_id, band, idx, x, y, l, u, v, own)."""
    first = F.floor(F.greatest(F.col("y") - halo, F.lit(0)) / band)
    last = F.floor((F.col("y") + halo) / band)
    rows = luv.withColumn("own", F.lit(True)) if wanted is None else luv.join(wanted.withColumn("own", F.lit(True)), ["image_id", "idx"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    rows = rows.withColumn("band", F.explode(F.sequence(first, last)))
    return rows.withColumn("own", F.col("own") & (F.col("band") == F.floor(F.col("y") / band)))


def _by_band(rows: DataFrame, band: int, halo: int, whole: bool, p: Params) -> DataFrame:
    kind = rows.schema["image_id"].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, y, idx, own = (table.column(c).to_numpy() for c in ("x", "y", "idx", "own"))
        own = own.astype(bool)
        top = 0 if whole else max(0, int(key[1].as_py()) * band - halo)
        image = np.full((int(y.max()) + 1 - top, int(x.max()) + 1, 3), np.nan)
        colours = np.column_stack([table.column(c).to_numpy() for c in "luv"])
        image[y - top, x] = colours
        start = np.column_stack((x[own], y[own], colours[own])).astype(np.float64)
        ends = whole or int(y.max()) + 1 < (int(key[1].as_py()) + 1) * band + halo
        out, iters, done = run_kernel(start, image, top, top == 0, ends, p)
        return pa.table({"image_id": pa.array([key[0].as_py()] * len(iters), table.schema.field("image_id").type), "idx": idx[own], "l": out[:, 0], "u": out[:, 1], "v": out[:, 2], "iters": iters, "finished": done})

    cols = ["image_id", "band", "idx", "x", "y", "l", "u", "v", "own"]
    return rows.select(*cols).groupBy("image_id", "band").applyInArrow(run, f"image_id {kind}, idx bigint, l double, u double, v double, iters int, finished boolean")


def filter_image(luv: DataFrame, p: Params = DEFAULT, *, band: int = 64, halo: int = 32) -> DataFrame:
    """The filter by bands of rows: (image_id, idx, l, u, v, iters).

    A band and its halo are all that a task holds. Centres that leave them come back unfinished and are tried again in
    bands twice as high with a halo twice as wide, until none is left, so results don't depend on the bands.
    """
    halo = max(halo, math.ceil(p.sigma_s) + 1)
    wanted, finished = None, []
    while True:
        done = _saved(_by_band(_bands(luv, wanted, band, halo), band, halo, False, p), "bands")
        finished.append(done.where("finished"))
        wanted = done.where("not finished").select("image_id", "idx")
        if wanted.isEmpty():
            break
        band, halo = 2 * band, 2 * halo
        top = luv.agg(F.max("y")).first()[0]
        if halo > top:  # every band is its whole image
            rest = luv.join(wanted.withColumn("own", F.lit(True)), ["image_id", "idx"], "left").withColumn("own", F.coalesce("own", F.lit(False))).withColumn("band", F.lit(0).cast("bigint"))
            finished.append(_by_band(rest, 0, 0, True, p))
            break
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.drop("finished")

