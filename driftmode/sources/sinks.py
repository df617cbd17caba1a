"""Image sinks: files, montages and comparison."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encode_pnm(values: np.ndarray) -> bytes:
    """A binary PPM (three channels) or PGM (one) of a height x width x channels array."""
    h, w, c = values.shape
    return f"P{6 if c == 3 else 5}\n{w} {h}\n255\n".encode() + np.ascontiguousarray(values, np.uint8).tobytes()


def write_images(pixels: DataFrame, folder: str, suffix: str = "", fill: int = 0) -> DataFrame:
    """One file for each image, PPM from r, g, b or PGM from ``value``; (image_id, file). A file is written under a name of
    its own and moved into place, so a task may run twice. Missing pixels get ``fill``."""
    channels = ["value"] if "value" in pixels.columns else ["r", "g", "b"]
    kind = pixels.schema["image_id"].dataType.simpleString()
    end = "pgm" if len(channels) == 1 else "ppm"

    def save(frame: pd.DataFrame) -> pd.DataFrame:
        h, w = int(frame["y"].max()) + 1, int(frame["x"].max()) + 1
        out = np.full((h, w, len(channels)), fill, np.uint8)
        out[frame["y"].to_numpy(), frame["x"].to_numpy()] = frame[channels].to_numpy()
        name = frame["image_id"].iloc[0]
        system, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))
        system.create_dir(path, recursive=True)
        final = f"{path}/{quote(str(name), safe='')}{suffix}.{end}"
        draft = f"{final}.{uuid.uuid4().hex}"
        with system.open_output_stream(draft, compression=None) as f:
            f.write(encode_pnm(out))
        system.move(draft, final)
        return pd.DataFrame({"image_id": [name], "file": [final]})

    return pixels.select("image_id", "x", "y", *channels).groupBy("image_id").applyInPandas(save, f"image_id {kind}, file string")


def montage(frames: list[DataFrame], width: int) -> DataFrame:
    """Images of the same ids side by side: (image_id, x, y, r, g, b), frame k shifted right by k widths. One-channel frames become grey."""
    out = None
    for k, frame in enumerate(frames):
        if "value" in frame.columns:
            frame = frame.select("image_id", "x", "y", *(F.col("value").alias(c) for c in "rgb"))
        part = frame.select("image_id", (F.col("x") + k * width).cast("int").alias("x"), "y", "r", "g", "b")
        out = part if out is None else out.unionByName(part)
    return out


def image_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels in which two images differ or that one of them lacks: (image_id, idx, r_a.., r_b..)."""
    left = a.select("image_id", "idx", *(F.col(c).alias(f"{c}_a") for c in "rgb"))
    right = b.select("image_id", "idx", *(F.col(c).alias(f"{c}_b") for c in "rgb"))
    same = F.col("r_a").eqNullSafe(F.col("r_b")) & F.col("g_a").eqNullSafe(F.col("g_b")) & F.col("b_a").eqNullSafe(F.col("b_b"))
    return left.join(right, ["image_id", "idx"], "full_outer").where(~same)


def difference_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels and mismatches of each image."""
    mask = image_diff(a, b).groupBy("image_id").agg(F.count("*").alias("mismatches"))
    sizes = a.groupBy("image_id").agg(F.count("*").alias("pixels"))
    return sizes.join(mask, "image_id", "left").select("image_id", "pixels", F.coalesce("mismatches", F.lit(0)).alias("mismatches"))


def row_bands(pixels: DataFrame, bands: int, height: int) -> Iterator[DataFrame]:
    """The image cut into bands of rows, as devices would share it."""
    for k in range(bands):
        yield pixels.where((F.col("y") >= k * height // bands) & (F.col("y") < (k + 1) * height // bands))


def union_bands(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def timing_report(times: DataFrame, reference_ms: float) -> DataFrame:
    """Mean time of several runs or devices, and the reference's time over it: (runs, mean_ms, reference_ms, speedup)."""
    mean = F.sum("ms") / F.count("ms")
    return times.agg(F.count("ms").alias("runs"), mean.alias("mean_ms"), F.lit(reference_ms).alias("reference_ms"), (F.lit(reference_ms) / mean).alias("speedup"))
