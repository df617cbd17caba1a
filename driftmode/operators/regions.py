"""Regions of filtered images: labelling, adjacency, fusion and pruning.

Labels are dense from 0 in the order of a region's lowest pixel index. All steps are joins and groupings on
(image_id, idx) or (image_id, label), so many images share the work; loops write their state to the
shared folder after each pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import quantised
from ..params import DEFAULT, Params
from .components import _saved, connected_components

#: Pixels of a band of rows (two rows at least), which one task labels by itself.
BAND_PIXELS = 1 << 16


def similar_neighbours(pixels: DataFrame, width: int | Column, p: Params = DEFAULT) -> DataFrame:
    """Pairs (image_id, a, b), a < b, of touching pixels (eight neighbours) whose channels all differ by less than the threshold."""
    w = F.lit(width) if isinstance(width, int) else width
    base = pixels.select("image_id", F.col("idx").alias("a"), F.col("l").alias("la"), F.col("u").alias("ua"), F.col("v").alias("va"), w.cast("bigint").alias("w"))
    out = base.withColumn("d", F.explode(F.array_distinct(F.array(F.lit(1).cast("bigint"), F.col("w") - 1, F.col("w"), F.col("w") + 1)))).where("d > 0")
    out = out.withColumn("b", F.col("a") + F.col("d"))
    if not p.wrap_rows:
        out = out.where(F.abs(F.pmod("a", "w") - F.pmod("b", "w")) <= 1)
    other = pixels.select("image_id", F.col("idx").alias("b"), F.col("l").alias("lb"), F.col("u").alias("ub"), F.col("v").alias("vb"))
    close = [F.abs(F.col(f"{c}a") - F.col(f"{c}b")) < p.luv_threshold for c in "luv"]
    return out.join(other, ["image_id", "b"]).where(close[0] & close[1] & close[2]).select("image_id", "a", "b")


def _dense(roots: DataFrame, node: str, root: str, out: str) -> DataFrame:
    """Number the roots of each image densely from 0 in ascending order: (image_id, node, out)."""
    order = Window.partitionBy("image_id").orderBy(root)
    numbers = roots.select("image_id", root).distinct().withColumn(out, (F.dense_rank().over(order) - 1).cast("int"))
    return roots.join(numbers, ["image_id", root]).select("image_id", node, out)


def _components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(image_id, node, root) of all nodes; ``edges`` has image_id, a, b."""
    key = lambda c: F.struct(F.col("image_id").alias("i"), F.col(c).alias("n"))
    roots = connected_components(edges.select(key("a").alias("a"), key("b").alias("b")))
    named = roots.select(F.col("node.i").alias("image_id"), F.col("node.n").alias(node), F.col("root.n").alias("root"))
    return nodes.select("image_id", node).join(named, ["image_id", node], "left").select("image_id", node, F.coalesce("root", node).alias("root"))


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest vertex of the component of each of ``n`` vertices, for links a[k], b[k]."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        new = root.copy()
        np.minimum.at(new, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, root):
            return root
        root = new


def _label_band(idx: np.ndarray, luv: np.ndarray, width: int, p: Params) -> np.ndarray:
    """The lowest index of each pixel's component, of the pixels given. Rows of one index are one pixel."""
    names, node = np.unique(idx, return_inverse=True)
    order = np.argsort(idx, kind="stable")
    ahead, a, b = idx[order], [], []
    for step in {1, width - 1, width, width + 1} - {0}:
        target = idx + step
        at, end = np.searchsorted(ahead, target, "left"), np.searchsorted(ahead, target, "right")
        if not p.wrap_rows:
            end = np.where(np.abs(idx % width - target % width) <= 1, end, at)
        while len(one := np.flatnonzero(at < end)):
            other = order[at[one]]
            close = (np.abs(luv[one] - luv[other]) < p.luv_threshold).all(axis=1)
            a.append(node[one[close]])
            b.append(node[other[close]])
            at = at + 1
    none = [np.zeros(0, np.int64)]
    return names[_smallest(len(names), np.concatenate(a or none), np.concatenate(b or none))[node]]


def label_regions(pixels: DataFrame, width: int | Column, p: Params = DEFAULT) -> DataFrame:
    """Labels of all pixels: (image_id, idx, label). Regions are the components of similar neighbours.

    A task labels a band of rows by itself; only pixels that may touch another band are joined, and only
    the bands' components that touch become vertices of the contraction. Rows without image_id or idx are left out."""
    w = F.lit(width) if isinstance(width, int) else width
    rows = pixels.where("image_id is not null and idx is not null").select("image_id", F.col("idx").cast("bigint").alias("idx"), "l", "u", "v", w.cast("bigint").alias("w"))
    rows = rows.withColumn("size", F.greatest(F.lit(2), F.floor(F.lit(BAND_PIXELS) / F.col("w"))) * F.col("w")).withColumn("band", F.floor(F.col("idx") / F.col("size")))

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        idx, wide, size = frame["idx"].to_numpy(), int(frame["w"].iloc[0]), int(frame["size"].iloc[0])
        place = idx % size
        rim = (place >= size - wide - 1) | ((place <= wide) & (idx >= size))
        return frame[["image_id", "idx", "l", "u", "v", "w"]].assign(root=_label_band(idx, frame[["l", "u", "v"]].to_numpy(np.float64), wide, p), rim=rim)

    kind = pixels.schema["image_id"].dataType.simpleString()
    own = _saved(rows.groupBy("image_id", "band").applyInPandas(label, f"image_id {kind}, idx bigint, l double, u double, v double, w bigint, root bigint, rim boolean"), "bands")
    rim = own.where("rim")
    end = lambda k: rim.select("image_id", F.col("idx").alias(k), F.col("root").alias(f"root_{k}")).distinct()
    links = similar_neighbours(rim, F.col("w"), p).join(end("a"), ["image_id", "a"]).join(end("b"), ["image_id", "b"]).where("root_a <> root_b")
    links = _saved(links.select("image_id", F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "links")
    if links.isEmpty():
        return _dense(own, "idx", "root", "label")
    tops = _components(own.select("image_id", F.col("root").alias("part")).distinct(), links, "part")
    return _dense(own.select("image_id", "idx", F.col("root").alias("part")).join(tops, ["image_id", "part"]), "idx", "root", "label")


def region_table(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """(image_id, label, l, u, v, n): a region's mode is the colour of its lowest pixel."""
    both = pixels.select("image_id", "idx", "l", "u", "v").join(labels, ["image_id", "idx"])
    seed = F.min_by(F.struct("l", "u", "v"), "idx")
    return both.groupBy("image_id", "label").agg(seed.alias("s"), F.count("*").alias("n")).select("image_id", "label", "s.l", "s.u", "s.v", "n")


def adjacency(labels: DataFrame, width: int | Column) -> DataFrame:
    """Touching regions (right and lower neighbours, no wrap), both directions: (image_id, a, b)."""
    w = F.lit(width) if isinstance(width, int) else width
    spot = labels.select("image_id", "label", F.pmod("idx", w).alias("x"), F.floor(F.col("idx") / w).alias("y"))
    right = F.lead("label").over(Window.partitionBy("image_id", "y").orderBy("x"))
    below = F.lead("label").over(Window.partitionBy("image_id", "x").orderBy("y"))
    beside = spot.select("image_id", F.col("label").alias("a"), right.alias("right"), below.alias("below"))
    pairs = beside.select("image_id", "a", F.explode(F.array("right", "below")).alias("b")).where("a <> b").distinct()
    return pairs.unionByName(pairs.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """(image_id, label, neighbours): ascending, without repeats."""
    return edges.groupBy("image_id", F.col("a").alias("label")).agg(F.sort_array(F.collect_set("b")).alias("neighbours"))


def _with_modes(edges: DataFrame, regions: DataFrame) -> DataFrame:
    side = lambda k: regions.select("image_id", F.col("label").alias(k), *(F.col(c).alias(f"{c}{k}") for c in ("l", "u", "v", "n")))
    return edges.join(side("a"), ["image_id", "a"]).join(side("b"), ["image_id", "b"])


def fusion_edges(edges: DataFrame, regions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adjacent regions whose modes are within the window of either one: (image_id, a, b), a < b. Edges may have a column
    ``strength``; strong ones (from ``strength_below`` on) part their regions, and so do null ones."""
    if "strength" in edges.columns:
        edges = edges.where(F.col("strength") < p.strength_below)
    both = _with_modes(edges.where("a < b"), regions)
    d = [(F.col(f"{c}a") - F.col(f"{c}b")) / F.lit(p.sigma_r) for c in "luv"]
    near = lambda k: F.when(F.col(f"l{k}") > p.bright, F.lit(4.0)).otherwise(F.lit(1.0)) * d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < p.fuse_below
    return both.where(near("a") | near("b")).select("image_id", "a", "b")


def prune_candidates(edges: DataFrame, regions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The nearest neighbour of every small region: (image_id, label, target, dist); ties go to the smallest label."""
    both = _with_modes(edges, regions).where(F.col("na") < p.min_region)
    d = [(F.col(f"{c}a") - F.col(f"{c}b")) / F.lit(p.sigma_r) for c in "luv"]
    dist = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    best = both.groupBy("image_id", F.col("a").alias("label")).agg(F.min(F.struct(dist.alias("dist"), F.col("b").alias("target"))).alias("m"))
    return best.select("image_id", "label", "m.target", "m.dist")


def merge_regions(labels: DataFrame, regions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge linked regions (image_id, a, b): new labels and the new region table, whose modes are means by size."""
    named = _saved(_dense(_components(regions, links, "label"), "label", "root", "new"), "merged")
    both = regions.join(named, ["image_id", "label"])
    total = F.sum("n")
    mean = lambda c: quantised(F.sum(F.col("n") * F.col(c)) / total).alias(c)
    table = both.groupBy("image_id", F.col("new").alias("label")).agg(mean("l"), mean("u"), mean("v"), total.alias("n"))
    pixels = labels.join(named, ["image_id", "label"]).select("image_id", "idx", F.col("new").alias("label"))
    return _saved(pixels, "labels"), _saved(table, "regions")


def fuse_regions(labels: DataFrame, regions: DataFrame, width: int | Column, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Fusion passes: two of them, or with ``fuse_passes=None`` until the number of regions stays."""
    count, passes = None, 0
    while p.fuse_passes is None or passes < p.fuse_passes:
        labels, regions = merge_regions(labels, regions, fusion_edges(adjacency(labels, width), regions, p))
        passes += 1
        now = regions.count()
        if p.fuse_passes is None and now == count:
            break
        count = now
    return labels, regions


def prune_pass(labels: DataFrame, regions: DataFrame, width: int | Column, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Every small region joins its nearest neighbour, by the modes and sizes at the start of the pass."""
    found = prune_candidates(adjacency(labels, width), regions, p).select("image_id", F.col("label").alias("a"), F.col("target").alias("b"))
    return merge_regions(labels, regions, found)


def prune_regions(labels: DataFrame, regions: DataFrame, width: int | Column, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Passes until no small region has a neighbour. An image that is one small region stays as it is."""
    for _ in range(p.prune_limit):
        small = regions.where(F.col("n") < p.min_region).select("image_id").distinct()
        several = regions.groupBy("image_id").count().where("count > 1")
        if small.join(several, "image_id").isEmpty():
            return labels, regions
        labels, regions = prune_pass(labels, regions, width, p)
    raise RuntimeError(f"small regions are left after {p.prune_limit} passes")


def paint(labels: DataFrame, regions: DataFrame) -> DataFrame:
    """Every pixel in its region's mode: (image_id, idx, l, u, v)."""
    return labels.join(regions.select("image_id", "label", "l", "u", "v"), ["image_id", "label"]).select("image_id", "idx", "l", "u", "v")


def boundary_pixels(labels: DataFrame, width: int | Column) -> DataFrame:
    """Pixels on the frame or beside another region (four neighbours): (image_id, label, idx, pos); pos counts within the region."""
    w = F.lit(width) if isinstance(width, int) else width
    spot = labels.select("image_id", "idx", "label", F.pmod("idx", w).alias("x"), F.floor(F.col("idx") / w).alias("y"))
    across, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    beside = [f("label").over(o) for f in (F.lag, F.lead) for o in (across, down)]
    # a missing neighbour is the frame
    edge = spot.select("image_id", "idx", "label", *(c.alias(f"b{k}") for k, c in enumerate(beside)))
    edge = edge.where(~(F.col("b0").eqNullSafe(F.col("label")) & F.col("b1").eqNullSafe(F.col("label")) & F.col("b2").eqNullSafe(F.col("label")) & F.col("b3").eqNullSafe(F.col("label"))))
    pos = F.row_number().over(Window.partitionBy("image_id", "label").orderBy("idx")) - 1
    return edge.select("image_id", "label", "idx", pos.cast("bigint").alias("pos"))


def checked_regions(regions: DataFrame) -> DataFrame:
    """The same rows; the query fails at a negative or null label and at a region without pixels."""
    bad = ~F.coalesce((F.col("label") >= 0) & (F.col("n") > 0), F.lit(False))
    told = F.raise_error(F.format_string("region %s has %s pixels", F.col("label").cast("string"), F.col("n").cast("string")))
    return regions.withColumn("n", F.when(bad, told.cast("bigint")).otherwise(F.col("n")))


def boundary_offsets(boundary: DataFrame) -> DataFrame:
    """Boundary pixels of each region, and those of all regions before: (image_id, label, n, off). Negative labels are refused."""
    counts = checked_regions(boundary.groupBy("image_id", "label").agg(F.count("*").alias("n")))
    before = Window.partitionBy("image_id").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))


def boundary_lists(boundary: DataFrame) -> DataFrame:
    """(image_id, label, indices) of each region's boundary, ascending."""
    return boundary.groupBy("image_id", "label").agg(F.sort_array(F.collect_list("idx")).alias("indices"))


def boundary_image(labels: DataFrame, boundary: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(image_id, idx, value): the edge value on boundaries, the background value elsewhere."""
    mask = boundary.select("image_id", "idx", F.lit(p.edge_value).alias("value"))
    return labels.select("image_id", "idx").join(mask, ["image_id", "idx"], "left").select("image_id", "idx", F.coalesce("value", F.lit(p.background_value)).alias("value"))
