"""Image and table readers. A pixel table has image_id, idx, x, y and r, g, b (or one channel ``value``)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "image_id string, idx bigint, x int, y int, r int, g int, b int"
_STRIP = 1 << 16


def parse_pnm(data: bytes) -> np.ndarray:
    """Height x width x channels of a PPM or PGM file, text (P2, P3) or binary (P5, P6), 8 bit."""
    at, fields = 0, []
    while len(fields) < 4:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("the header ends early")
        fields.append(data[at:end])
        at = end
    kind, width, height, top = fields[0], *(int(f) for f in fields[1:])
    if kind not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError(f"not a PGM or PPM image: {kind!r}")
    if top > 255:
        raise ValueError("only 8-bit images")
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if kind in (b"P5", b"P6"):
        values = np.frombuffer(data, np.uint8, n, at + 1)
    else:
        values = np.array(data[at:].split()[:n], np.int64)
        if len(values) < n:
            raise ValueError("the image ends early")
    return values.reshape(height, width, channels)


def read_images(spark: SparkSession, path: str, *, glob: str | None = None, channels: int | None = None) -> DataFrame:
    """Pixels of all PPM and PGM files at a path. Grey images have r = g = b; ``channels`` (1 or 3) keeps one kind only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                image = parse_pnm(data)
                if channels is not None and image.shape[2] != channels:
                    continue
                h, w, c = image.shape
                flat = image.reshape(-1, c).astype(np.int32)
                for k in range(0, h * w, _STRIP):
                    idx = np.arange(k, min(h * w, k + _STRIP))
                    part = flat[idx]
                    rgb = [part[:, min(j, c - 1)] for j in range(3)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(idx)), pa.array(idx), pa.array((idx % w).astype(np.int32)), pa.array((idx // w).astype(np.int32)), *map(pa.array, rgb)],
                        [f.split()[0] for f in PIXELS.split(", ")],
                    )

    files = spark.read.format("binaryFile")
    if glob:
        files = files.option("pathGlobFilter", glob)
    return files.load(path).select("path", "content").mapInArrow(run, PIXELS)


def read_matrix(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Header-less text matrices of grey values: (image_id, idx, x, y, value). A file is one image."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("image_id"), F.split(F.trim("value"), r"\s+").alias("v"))
    cells = text.select("image_id", F.posexplode("v").alias("i", "v")).where("v <> ''")
    return cells.select("image_id", F.col("i").cast("bigint").alias("idx"), F.pmod("i", F.lit(width)).cast("int").alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), F.col("v").cast("int").alias("value"))


def read_plot_table(spark: SparkSession, path: str) -> DataFrame:
    """White-space tables with a header line whose names may be quoted by braces; values are doubles."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).where("trim(value) <> ''")
    head = lines.orderBy("file", "line").select("value").first()
    if head is None:
        raise ValueError(f"empty table: {path}")
    names = [a or b for a, b in re.findall(r"\{([^}]*)\}|(\S+)", head["value"])]
    cells = F.split(F.trim("value"), r"\s+")
    body = lines.where("line > 0").select("line", cells.alias("c"))
    return body.select(*(F.try_element_at("c", F.lit(k + 1)).cast("double").alias(n) for k, n in enumerate(names)))


def table_image(orders: DataFrame, *, width: int = 50, rows: int = 30, spread: tuple[int, int, int] = (60, 50, 90)) -> DataFrame:
    """A blocky image with noise from a table with dense keys: every row is a pixel, every ``width * rows`` rows an image."""
    size = width * rows
    idx = F.pmod("o_orderkey", F.lit(size))
    nz = F.floor("o_totalprice").cast("bigint")
    base = orders.select(((F.col("o_orderkey") - idx) / size).cast("bigint").alias("image_id"), idx.alias("idx"), nz.alias("nz"))
    base = base.select("image_id", "idx", F.pmod("idx", F.lit(width)).cast("int").alias("x"), ((F.col("idx") - F.pmod("idx", F.lit(width))) / width).cast("int").alias("y"), "nz")
    block = lambda c: F.floor(F.col(c) / F.lit(11.0)) % 4
    a, b, c = spread
    return base.select(
        "image_id",
        "idx",
        "x",
        "y",
        F.least(F.lit(255), 40 + 60 * block("x") + F.col("nz") % a).cast("int").alias("r"),
        F.least(F.lit(255), 30 + 70 * block("y") + (F.col("nz") * 7) % b).cast("int").alias("g"),
        (90 + (F.col("nz") * 13) % c).cast("int").alias("b"),
    )
