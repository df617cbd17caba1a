"""Edge images and a sequential twin of the whole chain."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmode.functions import color as C
from driftmode.operators import density as D
from driftmode.operators import mean_shift as M
from driftmode.operators import regions as R
from driftmode.operators.components import connected_components
from driftmode.params import Params
from driftmode.plans.segmentation import labelled, segment
from driftmode.sources import sinks
from driftmode.sources.images import parse_pnm, read_images, read_matrix, read_plot_table

LUV = "image_id string, idx bigint, x int, y int, l double, u double, v double"


def grid(v):
    return np.floor(v * 1048576.0 + 0.5) / 1048576.0


def luv_frame(spark, values, width, name="a"):
    return spark.createDataFrame([(name, i, i % width, i // width, *map(float, v)) for i, v in enumerate(values)], LUV)


# --- a sequential twin, pixel by pixel ---


def twin_filter(values, width, p):
    values = [tuple(map(float, v)) for v in values]
    out = []
    height = len(values) // width

    def shift(c):
        n, s = 0, [0.0] * 5
        for y in range(max(0, int(c[1] - p.sigma_s)), min(height - 1, int(c[1] + p.sigma_s)) + 1):
            for x in range(max(0, int(c[0] - p.sigma_s)), min(width - 1, int(c[0] + p.sigma_s)) + 1):
                if ((x - c[0]) / p.sigma_s) ** 2 + ((y - c[1]) / p.sigma_s) ** 2 >= 1:
                    continue
                q = values[y * width + x]
                d = [(q[k] - c[k + 2]) / p.sigma_r for k in range(3)]
                if (4.0 if c[2] > 80 else 1.0) * d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < 1:
                    n += 1
                    s = [a + b for a, b in zip(s, (x, y, *q))]
        return [s[k] / n - c[k] if n else 0.0 for k in range(5)]

    for i, v in enumerate(values):
        c = [float(i % width), float(i // width), *v]
        m, it, ring = shift(c), 1, [M.START] * p.cycle_slots
        mag = sum(a * a for a in m)
        while mag >= p.epsilon and it < p.limit:
            c = [a + b for a, b in zip(c, m)]
            m = shift(c)
            mag = m[0] * m[0] + m[1] * m[1] + m[2] * m[2] + m[3] * m[3] + m[4] * m[4]
            if mag in ring:
                break
            ring = ring[1:] + [mag]
            it += 1
        c = [a + b for a, b in zip(c, m)]
        out.append((*c[2:], it))
    return out


def twin_regions(values, width, p):
    """Flood fill, fusion twice, pruning: labels and sizes."""
    n = len(values)
    label = [-1] * n
    modes = []
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = len(modes)
        modes.append(tuple(values[seed]))
        stack = [seed]
        while stack:
            i = stack.pop()
            for d in (1, width - 1, width, width + 1):
                for j in (i + d, i - d):
                    if 0 <= j < n and label[j] < 0 and all(abs(a - b) < 1 for a, b in zip(values[i], values[j])):
                        label[j] = label[seed]
                        stack.append(j)

    def neighbours():
        out = {k: set() for k in range(len(modes))}
        for i in range(n):
            for j in ([i + 1] if (i + 1) % width else []) + ([i + width] if i + width < n else []):
                if label[i] != label[j]:
                    out[label[i]].add(label[j])
                    out[label[j]].add(label[i])
        return out

    def merge(links):
        nonlocal label, modes
        size = [label.count(k) for k in range(len(modes))]
        root = list(range(len(modes)))

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in links:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        tops = sorted({find(k) for k in range(len(modes))})
        fresh = {t: k for k, t in enumerate(tops)}
        new = []
        for t in tops:
            own = [k for k in range(len(modes)) if find(k) == t]
            new.append(tuple(float(grid(np.float64(sum(size[k] * modes[k][c] for k in own)) / sum(size[k] for k in own))) for c in range(3)))
        label = [fresh[find(x)] for x in label]
        modes = new

    def close(a, b):
        d = [(modes[a][c] - modes[b][c]) / p.sigma_r for c in range(3)]
        return (4 if modes[a][0] > 80 else 1) * d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < 0.25

    for _ in range(2):
        merge([(a, b) for a, bs in neighbours().items() for b in bs if close(a, b)])
    while True:
        size, links = [label.count(k) for k in range(len(modes))], []
        for a, bs in neighbours().items():
            if size[a] < p.min_region and bs:
                dist = lambda b, a=a: sum(((modes[a][c] - modes[b][c]) / p.sigma_r) * ((modes[a][c] - modes[b][c]) / p.sigma_r) for c in range(3))
                links.append((a, min(bs, key=lambda b: (dist(b), b))))
        if not links:
            return label, modes
        merge(links)


@pytest.fixture(scope="module")
def noisy():
    rng = random.Random(5)
    width, height = 9, 8
    tone = lambda x, y: (30.0 if x < 4 else 82.0) + (4 if y < 3 else 0)
    return width, [tuple(float(grid(np.float64(t))) for t in (tone(i % width, i // width) + rng.uniform(-3, 3), rng.uniform(-2, 2), rng.uniform(-2, 2))) for i in range(width * height)]


@pytest.mark.parametrize("slots", [0, 4, 8])
def test_filter_equals_the_sequential_twin(spark, noisy, slots):
    width, values = noisy
    p = Params(sigma_s=3.0, cycle_slots=slots)
    want = {i: r for i, r in enumerate(twin_filter(values, width, p))}
    luv = luv_frame(spark, values, width)
    for out in (M.filter_image(luv, p, band=3, halo=4), M.filter_image(luv, p)):
        got = {r.idx: (r.l, r.u, r.v, r.iters) for r in out.collect()}
        assert got == want


def test_relational_filter_equals_the_twin(spark, noisy):
    width, values = noisy
    p = Params(sigma_s=3.0)
    got = {r.idx: (r.l, r.u, r.v, r.iters) for r in M.filter_relational(luv_frame(spark, values, width), p).collect()}
    assert got == dict(enumerate(twin_filter(values, width, p)))


@pytest.mark.parametrize("side", [4, 128])
def test_offsets_over_tiles_nulls_and_copies(spark, noisy, monkeypatch, side):
    monkeypatch.setattr(M, "SIDE", side, raising=False)
    width, values = noisy
    rows = [("a", i, i % width, i // width, *v) for i, v in enumerate(values) if i % 11]
    rows += rows[:2] + [("a", 500, 3, 3, *values[3]), ("a", 501, 10**6, 10**6, *values[0]), ("a", 502, 2, 2, None, 1.0, 1.0), ("a", 503, None, None, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "image_id string, idx long, x int, y int, l double, u double, v double")
    got = M.window_mean_by_offsets(frame, Params(sigma_s=3.0)).collect()
    assert len(got) == len(set(rows)) and {r.n for r in got if r.idx in (502, 503)} == {0}
    for r in got:
        near, times = [], rows.count(("a", r.idx, r.y0, r.y1, r.y2, r.y3, r.y4))
        for q in rows:
            if r.y0 is None or r.y2 is None or q[2] is None or q[4] is None:
                continue
            d, c = [(q[k + 2] - r[f"y{k}"]) / (3.0 if k < 2 else 6.5) for k in range(5)], 4.0 if r.y2 > 80 else 1.0
            if d[0] ** 2 + d[1] ** 2 < 1 and c * d[2] * d[2] + d[3] * d[3] + d[4] * d[4] < 1:
                near.append(q)
        assert r.n == len(near) * times
        want = [sum(float(q[k + 2]) for q in near) / len(near) - r[f"y{k}"] if near else 0.0 for k in range(5)]
        assert [r[f"m{k}"] for k in range(5)] == want


@pytest.mark.parametrize("slots", [0, 4, 8])
@pytest.mark.parametrize("side", [4, 128])
def test_relational_filter_takes_a_round_for_a_tile(spark, noisy, monkeypatch, side, slots):
    width, values = noisy
    monkeypatch.setattr(M, "SIDE", side)
    p, written, saved = Params(sigma_s=3.0, cycle_slots=slots), [], M._saved
    monkeypatch.setattr(M, "_saved", lambda df, name: (written.append(name), saved(df, name))[1])
    got = {r.idx: (r.l, r.u, r.v, r.iters) for r in M.filter_relational(luv_frame(spark, values, width), p).collect()}
    want = dict(enumerate(twin_filter(values, width, p)))
    assert got == want and max(r[3] for r in want.values()) > 3
    assert written.count("filter") == 1 if side == 128 else 1 < written.count("filter") < max(r[3] for r in want.values())


def test_regions_equal_the_sequential_twin(spark):
    rng = random.Random(11)
    width, height = 7, 6
    values = [(float(rng.choice((20, 20.5, 22, 60, 85))), float(rng.choice((0, 0.5, 3))), 0.0) for _ in range(width * height)]
    p = Params(min_region=5)
    frame = luv_frame(spark, values, width)
    labels, regions = R.prune_regions(*R.fuse_regions(*labelled(frame, width, p), width, p), width, p)
    want, modes = twin_regions(values, width, p)
    assert {r.idx: r.label for r in labels.collect()} == dict(enumerate(want))
    got = {r.label: (r.l, r.u, r.v, r.n) for r in regions.collect()}
    assert got == {k: (*m, want.count(k)) for k, m in enumerate(modes)}
    assert sum(r[3] for r in got.values()) == width * height


@pytest.mark.parametrize("wrap,count", [(True, 2), (False, 3)])
def test_rows_wrap_by_index(spark, wrap, count):
    values = [(50.0, 0, 0), (10.0, 0, 0), (10.0, 0, 0), (50.0, 0, 0)] * 2  # outer columns equal, 4 wide
    labels = R.label_regions(luv_frame(spark, values, 4), 4, Params(wrap_rows=wrap))
    assert labels.select("label").distinct().count() == count


def test_similarity_is_strict(spark):
    assert R.label_regions(luv_frame(spark, [(10.0, 0, 0), (11.0, 0, 0)], 2), 2).select("label").distinct().count() == 2
    assert R.label_regions(luv_frame(spark, [(10.0, 0, 0), (10.999, 0, 0)], 2), 2).select("label").distinct().count() == 1


def test_bright_modes_fuse_from_either_side(spark):
    regions = spark.createDataFrame([("a", 0, 80.5, 0.0, 0.0, 9), ("a", 1, 78.0, 0.0, 0.0, 9), ("a", 2, 60.0, 0.0, 0.0, 9)], "image_id string, label int, l double, u double, v double, n bigint")
    edges = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("a", 1, 2), ("a", 2, 1)], "image_id string, a int, b int")
    assert [tuple(r) for r in R.fusion_edges(edges, regions).select("a", "b").collect()] == [(0, 1)]  # only the darker one's window holds the other


def test_ties_go_to_the_smallest_label(spark):
    regions = spark.createDataFrame([("a", 0, 40.0, 0.0, 0.0, 30), ("a", 1, 50.0, 0.0, 0.0, 1), ("a", 2, 60.0, 0.0, 0.0, 30)], "image_id string, label int, l double, u double, v double, n bigint")
    edges = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("a", 1, 0), ("a", 0, 1)], "image_id string, a int, b int")
    assert [(r.label, r.target) for r in R.prune_candidates(edges, regions).collect()] == [(1, 0)]


@pytest.mark.parametrize("width,height", [(1, 1), (5, 1), (1, 4), (3, 3)])
def test_small_images_go_through_the_whole_chain(spark, width, height):
    rows = [("a", i, i % width, i // width, 0, 0, 0) for i in range(width * height)]
    s = segment(spark.createDataFrame(rows, "image_id string, idx bigint, x int, y int, r int, g int, b int"), width)
    assert s.regions.count() == 1 and s.filtered_rgb.where("r + g + b > 0").count() == 0
    inner = max(0, width - 2) * max(0, height - 2)
    assert s.boundary.count() == width * height - inner
    assert s.boundary_image.where("value = 255").count() == inner


def test_black_and_white_survive_the_colour_round_trip(spark):
    px = spark.createDataFrame([("a", i, i, 0, *c) for i, c in enumerate([(0, 0, 0), (255, 255, 255), (255, 0, 0), (1, 2, 3), (0, 0, 255)])], "image_id string, idx bigint, x int, y int, r int, g int, b int")
    back = {r.idx: (r.r, r.g, r.b) for r in C.luv_to_rgb(C.rgb_to_luv(px)).collect()}
    want = {r.idx: (r.r, r.g, r.b) for r in px.collect()}
    assert all(max(abs(a - b) for a, b in zip(back[i], want[i])) <= 1 for i in want if i != 3)


def test_rounding_and_cutting(spark):
    row = spark.range(1).select(C.clamp_byte(F.lit(-0.5)).alias("a"), C.clamp_byte(F.lit(2.5)).alias("b"), C.clamp_byte(F.lit(300.0)).alias("c"), C.truncated(F.lit(-1.7)).alias("d")).first()
    assert tuple(row) == (0, 3, 255, -1)


def test_iteration_colours(spark):
    rows = spark.createDataFrame([(0,), (9,), (10,), (79,), (80,), (100,)], "n int").select("n", *(c.alias(k) for c, k in zip(C.iteration_colour(F.col("n")), "rgb"))).collect()
    assert [(r.r, r.g, r.b) for r in rows] == [(242, 241, 240), (242, 241, 240), (232, 231, 230), (172, 171, 170), (162, 49, 0), (162, 49, 0)]


def test_pnm_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ppm").write_bytes(b"P3\n# two pixels\n2 1\n255\n1 2 3 4 5 6\n")
    (tmp_path / "in/g.pgm").write_bytes(b"P5\n2 2\n255\n\x00\x0a\x20\xff")
    px = read_images(spark, str(tmp_path / "in")).cache()
    assert px.count() == 6
    assert read_images(spark, str(tmp_path / "in"), channels=1).count() == 4
    named = px.withColumn("image_id", F.element_at(F.split("image_id", "/"), -1))
    files = {r.image_id: r.file for r in sinks.write_images(named, str(tmp_path / "out")).collect()}
    assert np.array_equal(parse_pnm(open(files["a.ppm"], "rb").read()).ravel(), [1, 2, 3, 4, 5, 6])
    assert np.array_equal(parse_pnm(open(files["g.pgm"], "rb").read())[:, :, 0].ravel(), [0, 10, 32, 255])


@pytest.mark.parametrize("bad", [b"P4\n1 1\n1\n\x00", b"P6\n1 1\n65535\n\x00\x00", b"P6\n", b"P3\n2 2\n255\n1 2 3"])
def test_bad_images_are_refused(bad):
    with pytest.raises(ValueError):
        parse_pnm(bad)


def test_text_tables(spark, tmp_path):
    (tmp_path / "m.pgm").write_text("1 2 3\n4 5 6\n")
    assert [(r.x, r.y, r.value) for r in read_matrix(spark, str(tmp_path / "m.pgm"), 3).orderBy("idx").collect()][-1] == (2, 1, 6)
    (tmp_path / "t.data").write_text("{pix n} b\n1 2.5\n3 4\n")
    t = read_plot_table(spark, str(tmp_path / "t.data"))
    assert t.columns == ["pix n", "b"] and sorted(tuple(r) for r in t.collect()) == [(1.0, 2.5), (3.0, 4.0)]


def test_gaussian_sum_by_hand(spark):
    points = [5, 1, -1, -4, -5]
    got = {r.x: r.total for r in D.kernel_sum(spark.createDataFrame([(float(x),) for x in points], "p double"), "p", [-1.0, 0.0, 2.5], 0.7).collect()}
    for x, total in got.items():
        assert total == pytest.approx(sum(np.exp(-(((x - q) / 0.7) ** 2) / 2) / np.sqrt(2 * np.pi) for q in points), abs=1e-12)


def test_components(spark):
    edges = [(3, 4), (4, 5), (9, 9), (1, 2), (2, 1), (None, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 9, 1: 1, 2: 1}
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(chain).select("root").distinct().count() == 1
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("kind", ["int", "string", "binary"])
def test_few_links_take_no_rounds(spark, monkeypatch, kind):
    from driftmode.operators import components as K

    rng, written, saved = random.Random(2), [], K._saved
    monkeypatch.setattr(K, "_saved", lambda df, name: (written.append(name), saved(df, name))[1])
    links = [(i, i + 1) for i in range(1000, 1060)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(7, 7), (None, 5)]
    frame = spark.createDataFrame(links, "a int, b int").selectExpr(*(f"cast(cast({c} as string) as {kind}) {c}" for c in "ab"))
    few = sorted(tuple(r) for r in K.connected_components(frame).collect())
    assert len(written) == 2
    monkeypatch.setattr(K, "FEW_LINKS", 20)
    assert sorted(tuple(r) for r in K.connected_components(frame).collect()) == few
    assert len(written) > 5
