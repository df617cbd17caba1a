"""Command line: filter and segment the images of a folder.

python -m driftmode.plans.cli IN OUT [--sigma-s 7] [--sigma-r 6.5] [--min-region 20] [--glob '*.ppm'] [--reference DIR] [--partitions N]
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import functions as F

from ..params import Params
from ..session import get_session
from ..sources.images import read_images
from ..sources.sinks import difference_count, montage, write_images
from .segmentation import segment


def main(args: Sequence[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("source")
    a.add_argument("target")
    a.add_argument("--glob")
    a.add_argument("--sigma-s", type=float, default=7.0)
    a.add_argument("--sigma-r", type=float, default=6.5)
    a.add_argument("--min-region", type=int, default=20)
    a.add_argument("--reference", help="folder of filtered images to compare with")
    a.add_argument("--partitions", type=int)
    o = a.parse_args(args)
    spark = get_session(shuffle_partitions=o.partitions)
    p = Params(sigma_s=o.sigma_s, sigma_r=o.sigma_r, min_region=o.min_region)
    pixels = read_images(spark, o.source, glob=o.glob)
    pixels = pixels.withColumn("image_id", F.regexp_replace(F.element_at(F.split("image_id", "/"), -1), r"\.[^.]*$", ""))
    widths = [r.w for r in pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w")).select("w").distinct().collect()]
    for w in widths:  # images of one width are one job
        own = pixels.join(pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w")).where(F.col("w") == w).select("image_id"), "image_id")
        s = segment(own, w, p)
        for frame, suffix in ((s.filtered_rgb, "_filt"), (s.segmented_rgb, "_segm"), (s.boundary_image, "_bndy"), (s.iteration_image, "_itr"), (montage([s.filtered_rgb, s.segmented_rgb, s.boundary_image], w), "_out")):
            write_images(frame, o.target, suffix).select("file").show(truncate=False)
        if o.reference:
            difference_count(s.filtered_rgb, read_images(spark, o.reference).withColumn("image_id", F.regexp_replace(F.element_at(F.split("image_id", "/"), -1), r"(_ref)?\.[^.]*$", ""))).show()


if __name__ == "__main__":
    main()
