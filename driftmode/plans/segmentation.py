"""The whole chain on a pixel table: colours, filter, regions, edges, images."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import iteration_colour, luv_to_rgb, rgb_to_luv
from ..operators import regions as R
from ..operators.components import _saved
from ..operators.mean_shift import filter_image, filter_relational
from ..params import DEFAULT, Params


@dataclass
class Segmentation:
    """Results by stage; labels and regions are those after pruning."""

    filtered: DataFrame
    labels: DataFrame
    regions: DataFrame
    boundary: DataFrame
    filtered_rgb: DataFrame
    segmented_rgb: DataFrame
    boundary_image: DataFrame
    iteration_image: DataFrame


def filter_pixels(pixels: DataFrame, p: Params = DEFAULT, *, relational: bool = False) -> DataFrame:
    """(image_id, idx, l, u, v, iters) of an r, g, b pixel table."""
    luv = rgb_to_luv(pixels)
    return filter_relational(luv, p) if relational else filter_image(luv, p)


def labelled(filtered: DataFrame, width: int, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    labels = _saved(R.label_regions(filtered, width, p), "labels")
    return labels, _saved(R.region_table(filtered, labels), "regions")


def segment(pixels: DataFrame, width: int, p: Params = DEFAULT) -> Segmentation:
    """All stages. Pixels need image_id, idx, x, y, r, g, b; images of one call have one width."""
    filtered = _saved(filter_pixels(pixels, p), "filtered")
    labels, regions = R.prune_regions(*R.fuse_regions(*labelled(filtered, width, p), width, p), width, p)
    boundary = _saved(R.boundary_pixels(labels, width), "boundary")
    place = pixels.select("image_id", "idx", "x", "y")
    rgb = lambda luv: luv_to_rgb(luv.select("image_id", "idx", "l", "u", "v")).join(place, ["image_id", "idx"])
    edges = R.boundary_image(labels, boundary, p).join(place, ["image_id", "idx"])
    heat = filtered.select("image_id", "idx", *(c.alias(n) for c, n in zip(iteration_colour(F.col("iters")), "rgb"))).join(place, ["image_id", "idx"])
    return Segmentation(filtered, labels, regions, boundary, rgb(filtered), rgb(R.paint(labels, regions)), edges, heat)
