"""Bands of labels, general mean shift, densities, region checks, the command line and the stream."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmode.operators import density as D
from driftmode.operators import regions as R
from driftmode.params import Params
from driftmode.plans import cli
from driftmode.sources import sinks
from driftmode.sources.images import parse_pnm, read_images, read_matrix
from driftmode.streaming.images import filter_stream

LUV = "image_id string, idx bigint, x int, y int, l double, u double, v double"


def twin_labels(values, width, wrap):
    """Flood fill by index arithmetic, as the labels are defined."""
    out, n = {}, 0
    for seed in sorted(values):
        if seed in out:
            continue
        out[seed], todo = n, [seed]
        while todo:
            i = todo.pop()
            for d in {1, width - 1, width, width + 1} - {0}:
                for a, b in ((i, i + d), (i - d, i)):
                    k = b if a == i else a
                    if k not in values or k in out or not (wrap or abs(a % width - b % width) <= 1):
                        continue
                    if all(abs(x - y) < 1 for x, y in zip(values[a], values[b])):
                        out[k] = n
                        todo.append(k)
        n += 1
    return out


@pytest.mark.parametrize("wrap", [True, False])
@pytest.mark.parametrize("width", [1, 2, 7])
def test_bands_join_to_whole_regions(spark, monkeypatch, width, wrap):
    monkeypatch.setattr(R, "BAND_PIXELS", 14)
    rng = np.random.default_rng(width)
    values = {i: (float(rng.integers(0, 3)), 0.0, 0.0) for i in range(84) if rng.random() < 0.95}
    rows = [("a", i, i % width, i // width, *v) for i, v in values.items()]
    rows += [("b", i, i % width, i // width, 1.0, 1.0, 1.0) for i in range(40)] + rows[:3] + [("a", None, 0, 0, 1.0, 1.0, 1.0)]
    got = R.label_regions(spark.createDataFrame(rows, LUV), width, Params(wrap_rows=wrap)).distinct().collect()
    assert {r.idx: r.label for r in got if r.image_id == "a"} == twin_labels(values, width, wrap)
    assert {r.label for r in got if r.image_id == "b"} == {0}


def test_labels_of_nothing_and_of_null_colours(spark):
    assert R.label_regions(spark.createDataFrame([], LUV), 4).count() == 0
    rows = [("a", 0, 0, 0, 1.0, 1.0, 1.0), ("a", 1, 1, 0, None, 1.0, 1.0), ("a", 2, 2, 0, None, 1.0, 1.0)]
    assert sorted(r.label for r in R.label_regions(spark.createDataFrame(rows, LUV), 3).collect()) == [0, 1, 2]


def test_strong_edges_part_regions(spark):
    regions = spark.createDataFrame([("a", 0, 40.0, 0.0, 0.0, 5), ("a", 1, 40.0, 0.0, 0.0, 5), ("a", 2, 40.0, 0.0, 0.0, 5)], "image_id string, label int, l double, u double, v double, n bigint")
    edges = spark.createDataFrame([("a", 0, 1, 0.5), ("a", 0, 2, 1.0), ("a", 1, 2, None)], "image_id string, a int, b int, strength double")
    assert [(r.a, r.b) for r in R.fusion_edges(edges, regions).collect()] == [(0, 1)]
    assert R.fusion_edges(edges.drop("strength"), regions).count() == 3


@pytest.mark.parametrize("label,n,good", [(0, 1, True), (-1, 1, False), (0, 0, False), (None, 1, False), (0, None, False)])
def test_bad_regions_are_refused(spark, label, n, good):
    found = R.checked_regions(spark.createDataFrame([("a", label, n)], "image_id string, label int, n bigint"))
    if good:
        assert found.count() == found.where("n = 1").count() == 1
    else:
        with pytest.raises(Exception, match="region .* has .* pixels"):
            found.collect()


#: Sums of the five Gaussian kernels at some places, for bandwidth 2.
GOLDEN = {2.0: {-0.4: 0.811339879684203, -0.2: 0.803088057498328, 0.0: 0.793178221028924, 0.2: 0.781455838704079, 0.4: 0.767864314229541}}


@pytest.mark.parametrize("h", [0.7, 1.0, 2.0])
def test_density_table_of_five_points(spark, h):
    points = [5.0, 1.0, -1.0, -4.0, -5.0]
    xs = [round(-10 + 0.2 * k, 1) for k in range(101)]
    got = {r.x: r.total for r in D.kernel_sum(spark.createDataFrame([(p,) for p in points], "p double"), "p", xs, h).collect()}
    assert len(got) == 101
    for x, total in got.items():
        assert total == pytest.approx(sum(np.exp(-(((x - p) / h) ** 2) / 2) / np.sqrt(2 * np.pi) for p in points), abs=1e-14)
    for x, total in GOLDEN.get(h, {}).items():
        assert got[x] == pytest.approx(total, abs=6e-15)


def test_step_follows_the_gradient(spark):
    """The step of the shadow weights is h^2 c / 2 times the gradient over the density of the weights: c = 2 / 3 here."""
    rng, h = np.random.default_rng(5), 1.3
    data = rng.normal(size=60).tolist()
    points = spark.createDataFrame([(i, [p], p) for i, p in enumerate(data)], "id long, v array<double>, p double")
    at = [-0.81, 0.07, 0.93]
    seeds = spark.createDataFrame([(str(x), [x]) for x in at], "id string, v array<double>")
    moved = {float(r.id): r.shifted[0] - float(r.id) for r in D.mean_shift_points(points, seeds, h, id_col="id", vector_col="v").collect()}
    eps = 1e-6
    f = {r.x: r.density for r in D.density(points, "p", [x + d for x in at for d in (-eps, eps)], h, "epanechnikov").collect()}
    g = {r.x: r.density for r in D.density(points, "p", at, h, "uniform").collect()}
    for x in at:
        gradient = (f[x + eps] - f[x - eps]) / (2 * eps)
        assert moved[x] == pytest.approx(h * h / 3 * gradient / g[x], rel=1e-5, abs=1e-7)


@pytest.mark.parametrize("kernel", ["uniform", "epanechnikov"])
@pytest.mark.parametrize("h,low,wide,grid", [(1.0, 0.0, 8.0, 64.0), (0.37, 100.0, 3.0, None), (25.0, -60.0, 50.0, 4.0), (1.0, 3.0, 0.0, None)])
def test_strips_compare_few_and_weigh_all(monkeypatch, kernel, h, low, wide, grid):
    x = np.random.default_rng(3).random((20000, 2)) * wide + low
    x = np.floor(x * grid) / grid if grid else x
    y = np.concatenate([x[::100], x[:3] + [0.5 * h, 40 * h], [[np.nan, low]]])
    weight, total = np.zeros(len(y)), np.zeros_like(y)
    D._compare_all(x, y, h, kernel, weight, total)
    compared, one_by_one = [], D.Strips._compared
    monkeypatch.setattr(D.Strips, "_compared", lambda self, y, who, at, w, t: (compared.append(len(at)), one_by_one(self, y, who, at, w, t)))
    w, t = np.zeros(len(y)), np.zeros_like(y)
    D.Strips(x, h, kernel).add(y, w, t)
    assert np.allclose(w[:-1], weight[:-1], rtol=1e-11) and w[-1] == 0 and np.allclose(t[:-1], total[:-1], rtol=1e-11)
    assert sum(compared) < 0.05 * len(x) * len(y)


def test_steps_over_nulls_and_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 64)
    data = np.random.default_rng(4).random((900, 2)) * 5
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(-1, None), (-2, [None, 1.0]), (-3, [float("nan"), 1.0]), (-4, [float("inf"), 1.0])]
    points = spark.createDataFrame(rows, "id long, v array<double>")
    found = {r.id: r for r in D.mean_shift_points(points, points.where("id % 9 = 0"), 1.0, id_col="id", vector_col="v").collect()}
    assert len(found) == 100
    for i, r in found.items():
        near = ((data - data[i]) ** 2).sum(axis=1) < 1
        assert r.weight == near.sum() and np.allclose(r.shifted, data[near].mean(axis=0), atol=1e-12)


@pytest.mark.parametrize("kernel", ["uniform", "gaussian", "epanechnikov"])
def test_modes_of_two_heaps(spark, monkeypatch, kernel):
    monkeypatch.setattr(D, "TILE", 16)
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal((0, 0), 0.2, (50, 2)), rng.normal((9, 9), 0.2, (50, 2))])
    points = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(data)] + [("none", None)], "id string, v array<double>")
    found = D.mean_shift_modes(points, points.where("v is not null"), 2.0, kernel, id_col="id", vector_col="v").collect()
    assert len(found) == 100 and all(r.settled for r in found)
    weigh = {"uniform": lambda d: d < 1, "gaussian": lambda d: np.exp(-d / 2), "epanechnikov": lambda d: np.maximum(1 - d, 0)}[kernel]
    for r in found:
        y, steps = data[int(r.id[1:])], 0
        while True:
            w = weigh((((data - y) / 2.0) ** 2).sum(axis=1)).astype(float)
            new, steps = w @ data / w.sum(), steps + 1
            y, far = new, ((new - y) ** 2).sum()
            if far < 1e-6:
                break
        assert steps == r.steps and np.allclose(y, r.mode, atol=1e-9)
    cut = D.mean_shift_modes(points, points.where("id in ('p0', 'p1')"), 2.0, kernel, id_col="id", vector_col="v", epsilon=0.0, limit=2).collect()
    assert [(r.steps, r.settled) for r in cut] == [(2, False)] * 2
    assert D.mean_shift_modes(points, points.limit(0), 2.0, kernel, id_col="id", vector_col="v").count() == 0


@pytest.mark.parametrize("kernel", ["uniform", "epanechnikov", "gaussian"])
def test_modes_read_points_once_and_count_copies(spark, kernel):
    """The rows of the points are made once, whatever the number of steps, and a copy weighs as much as another point."""
    data = np.random.default_rng(6).random((400, 2)) * 4
    copies = np.arange(400) % 7 + 1
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(i, v.tolist()) for i, v in enumerate(data) for _ in range(copies[i])] + [(-1, None), (-2, [None, 1.0]), (-3, [float("nan"), 1.0])]
    points = spark.createDataFrame(rows, "id long, v array<double>").mapInArrow(counted, "id long, v array<double>")
    starts = [(i, data[i % 20].tolist()) for i in range(60)] + [(60, [99.0, 99.0]), (61, [float("nan"), 0.0]), (62, [None, 0.0]), (63, None)]
    found = {r.id: r for r in D.mean_shift_modes(points, spark.createDataFrame(starts, "id long, v array<double>"), 1.0, kernel, id_col="id", vector_col="v", epsilon=0.0, limit=4).collect()}
    assert seen.value == len(rows)
    assert sorted(found) == list(range(62)) and (found[61].steps, found[61].settled) == (4, False)
    weigh = {"uniform": lambda d: d < 1, "epanechnikov": lambda d: np.maximum(1 - d, 0), "gaussian": lambda d: np.exp(-d / 2)}[kernel]
    for i, r in found.items():
        if i < 60:
            y = data[i % 20]
            for _ in range(4):
                w = weigh(((data - y) ** 2).sum(axis=1)) * copies
                y = w @ data / w.sum()
            assert (r.steps, r.settled) == (4, False) and np.allclose(r.mode, y, atol=1e-9)


@pytest.mark.parametrize("kernel", ["uniform", "epanechnikov"])
@pytest.mark.parametrize("most", [3, 1 << 40])
def test_strips_count_points_many_times(kernel, most):
    """Also so often that sums of whole numbers would not fit."""
    rng = np.random.default_rng(7)
    x, times = rng.random((5000, 2)) * [6, 0.3], rng.integers(1, most, 5000)
    x[-1] = [3.0, 900.0]  # alone, so that bins are far more than points and are searched
    y = x[::50]
    sums = []
    for f in (lambda w, t: D._compare_all(x, y, 1.0, kernel, w, t, times), lambda w, t: D._weigh(x, y, 1.0, kernel, w, t, times)):
        sums.append((np.zeros(len(y)), np.zeros_like(y)))
        f(*sums[-1])
    (weight, total), (w, t) = sums
    assert np.allclose(w, weight, rtol=1e-9) and np.allclose(t / w[:, None], total / weight[:, None], rtol=0, atol=1e-9)


@pytest.mark.parametrize("side", [64, 128])
def test_square_matrices(spark, tmp_path, side):
    values = np.random.default_rng(side).integers(0, 256, (side, side))
    (tmp_path / "m.txt").write_text("\n".join(" ".join(map(str, row)) for row in values) + "\n")
    got = read_matrix(spark, str(tmp_path / "m.txt"), side).toPandas().sort_values("idx")
    assert np.array_equal(got["value"].to_numpy().reshape(side, side), values)
    assert np.array_equal(got["y"] * side + got["x"], got["idx"])


def _image(seed, h, w):
    rng = np.random.default_rng(seed)
    return np.where(np.arange(w)[None, :, None] < w // 2, 60, 190).astype(np.uint8) + rng.integers(0, 4, (h, w, 3)).astype(np.uint8)


def test_command_line(spark, tmp_path, capfd):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ppm").write_bytes(sinks.encode_pnm(_image(1, 8, 10)))
    (tmp_path / "in/b.ppm").write_bytes(sinks.encode_pnm(_image(2, 6, 8)))
    (tmp_path / "in/c.txt").write_text("not an image")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    cli.main([str(tmp_path / "in"), str(tmp_path / "out"), "--glob", "*.ppm", "--sigma-s", "2", "--min-region", "5"])
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == sorted(f"{i}_{s}" for i in "ab" for s in ("filt.ppm", "segm.ppm", "bndy.pgm", "itr.ppm", "out.ppm"))
    assert parse_pnm((tmp_path / "out/a_out.ppm").read_bytes()).shape == (8, 30, 3)
    painted = parse_pnm((tmp_path / "out/a_segm.ppm").read_bytes())
    assert len(np.unique(painted.reshape(-1, 3), axis=0)) == 2


def test_stream_filters_every_file_once(spark, tmp_path):
    for folder in ("in", "out"):
        (tmp_path / folder).mkdir()
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.read.format("binaryFile").load(source).schema
    start = lambda: filter_stream(
        spark,
        spark.readStream.format("binaryFile").schema(schema).load(source).select("path"),
        lambda files: read_images(spark, source).join(files.select(F.col("path").alias("image_id")), "image_id"),
        target,
        str(tmp_path / "state"),
        Params(sigma_s=2.0),
    ).awaitTermination(120)
    for name, rows in (("a", 48), ("b", 96)):
        (tmp_path / f"in/{name}.ppm").write_bytes(sinks.encode_pnm(_image(3, 6, 8)))
        start()
        assert spark.read.parquet(target).count() == rows
    start()
    assert spark.read.parquet(target).count() == 96
