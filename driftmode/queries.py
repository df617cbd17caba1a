"""Registered queries of the library's own operators: ``QUERIES`` and the matching ``ORACLE_SQL``.

Pixel queries use the images that ``table_image`` derives from all of ``orders``: 50 pixels wide, 30 high.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color as C
from .operators import density as D
from .operators import mean_shift as M
from .operators import regions as R
from .operators.components import _saved
from .params import DEFAULT
from .plans.segmentation import filter_pixels, labelled
from .session import shared_dir
from .sources import sinks
from .sources.images import read_images, table_image

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

W, H = 50, 30
GRID = [float(x) for x in range(-1000, 10001, 500)]
KDE_H = 700.0


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_image(table(spark, sf_dir, "orders"), width=W, rows=H)


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(filter_pixels(pixels(spark, sf_dir)), "filtered")


# --- parts of the oracle ---------------------------------------------------------------------------------------

_Q = "floor(({0}) * 1048576e0 + 0.5e0) / 1048576e0"
_PX = f"""i AS (SELECT o_orderkey // {W * H} AS image_id, o_orderkey % {W * H} AS idx, CAST(floor(o_totalprice) AS BIGINT) AS nz FROM orders),
j AS (SELECT image_id, idx, CAST(idx % {W} AS INT) AS x, CAST(idx // {W} AS INT) AS y, nz FROM i),
px AS (SELECT image_id, idx, x, y, CAST(least(255, 40 + 60 * (CAST(floor(x / 11e0) AS INT) % 4) + nz % 60) AS INT) AS r,
  CAST(least(255, 30 + 70 * (CAST(floor(y / 11e0) AS INT) % 4) + (nz * 7) % 50) AS INT) AS g, CAST(90 + (nz * 13) % 90 AS INT) AS b FROM j)"""
_XYZ = """xyz AS (SELECT *, 0.4125e0 * r + 0.3576e0 * g + 0.1804e0 * b AS cx, 0.2125e0 * r + 0.7154e0 * g + 0.0721e0 * b AS cy, 0.0193e0 * r + 0.1192e0 * g + 0.9502e0 * b AS cz FROM px),
lc AS (SELECT *, CASE WHEN cy / 255e0 > 0.008856e0 THEN 116e0 * pow(cy / 255e0, 1e0 / 3e0) - 16e0 ELSE 903.3e0 * (cy / 255e0) END AS l0,
  CASE WHEN cx + 15e0 * cy + 3e0 * cz <> 0 THEN 4e0 * cx / (cx + 15e0 * cy + 3e0 * cz) ELSE 4e0 END AS up,
  CASE WHEN cx + 15e0 * cy + 3e0 * cz <> 0 THEN 9e0 * cy / (cx + 15e0 * cy + 3e0 * cz) ELSE 0.6e0 END AS vp FROM xyz)"""
_LUV = f"""{_PX}, {_XYZ}, luv AS (SELECT image_id, idx, x, y, {_Q.format("l0")} AS l, {_Q.format("13e0 * l0 * (up - 0.19784977571475e0)")} AS u, {_Q.format("13e0 * l0 * (vp - 0.46834507665248e0)")} AS v FROM lc)"""
_WINDOW = """p.x BETWEEN greatest(CAST(trunc({a}y0 - 7e0) AS INT), 0) AND CAST(trunc({a}y0 + 7e0) AS INT) AND p.y BETWEEN greatest(CAST(trunc({a}y1 - 7e0) AS INT), 0) AND CAST(trunc({a}y1 + 7e0) AS INT)
  AND ((p.x - {a}y0) / 7e0) * ((p.x - {a}y0) / 7e0) + ((p.y - {a}y1) / 7e0) * ((p.y - {a}y1) / 7e0) < 1e0
  AND (CASE WHEN {a}y2 > 80e0 THEN 4e0 ELSE 1e0 END) * ((p.l - {a}y2) / 6.5e0) * ((p.l - {a}y2) / 6.5e0) + ((p.u - {a}y3) / 6.5e0) * ((p.u - {a}y3) / 6.5e0) + ((p.v - {a}y4) / 6.5e0) * ((p.v - {a}y4) / 6.5e0) < 1e0"""


def _step_sql(source: str, extra: str) -> str:
    """Window means of the centres in ``source``; ``extra`` columns are carried along."""
    sums = ", ".join(f"sum(CAST(p.{c} AS DOUBLE)) AS s{k}" for k, c in enumerate("xyluv"))
    ys = ", ".join(f"a.y{k}" for k in range(5))
    shift = ", ".join(f"CASE WHEN n > 0 THEN s{k} / n - y{k} ELSE 0e0 END AS m{k}" for k in range(5))
    carried = "".join(f"a.{c}, " for c in extra.split(", ") if c)
    mag = " + ".join(f"m{k} * m{k}" for k in range(5))
    return f"""(SELECT *, {mag} AS mag FROM (SELECT *, {shift} FROM (SELECT a.image_id, a.idx, {carried}{ys}, count(p.idx) AS n, {sums}
      FROM {source} a LEFT JOIN luv p ON p.image_id = a.image_id AND {_WINDOW.format(a="a.")} GROUP BY ALL)))"""


_START = "(SELECT image_id, idx, CAST(x AS DOUBLE) AS y0, CAST(y AS DOUBLE) AS y1, l AS y2, u AS y3, v AS y4 FROM luv)"
_STATE = ", ".join([*(f"y{k}" for k in range(5)), *(f"m{k}" for k in range(5))])
_MOVED = "(SELECT image_id, idx, it, ring, " + ", ".join(f"y{k} + m{k} AS y{k}" for k in range(5)) + " FROM loop WHERE NOT done)"
_FILTER = f"""{_LUV}, loop AS (
  SELECT image_id, idx, 1 AS it, {_STATE}, mag, [12345678e0, 12345678e0, 12345678e0, 12345678e0, 12345678e0, 12345678e0, 12345678e0, 12345678e0] AS ring, mag < 0.01e0 AS done FROM {_step_sql(_START, "")}
  UNION ALL
  SELECT image_id, idx, CASE WHEN list_contains(ring, mag) THEN it ELSE it + 1 END, {_STATE}, mag, list_append(ring[2:8], mag),
    list_contains(ring, mag) OR mag < 0.01e0 OR it + 1 >= 100 FROM {_step_sql(_MOVED, "it, ring")}),
filt AS MATERIALIZED (SELECT image_id, idx, CAST(idx % {W} AS INT) AS x, CAST(idx // {W} AS INT) AS y, y2 + m2 AS l, y3 + m3 AS u, y4 + m4 AS v, it AS iters FROM loop WHERE done)"""


def _components_sql(name: str, nodes: str, node: str, edges: str) -> str:
    """(image_id, node, root) over edges (image_id, a, b)."""
    return f"""{name}_e AS MATERIALIZED (SELECT image_id, a, b FROM {edges} UNION SELECT image_id, b, a FROM {edges}),
{name}(image_id, node, root) USING KEY (image_id, node) AS (SELECT image_id, {node}, {node} FROM {nodes}
  UNION SELECT e.image_id, e.b, min(c.root) FROM {name} c JOIN {name}_e e ON e.image_id = c.image_id AND e.a = c.node
  JOIN recurring.{name} k ON k.image_id = e.image_id AND k.node = e.b WHERE c.root < k.root GROUP BY e.image_id, e.b)"""


_LABELS = f"""{_FILTER}, near AS (SELECT a.image_id, a.idx AS a, b.idx AS b FROM filt a, unnest([1, {W - 1}, {W}, {W + 1}]) d(d) JOIN filt b ON b.image_id = a.image_id AND b.idx = a.idx + d.d
  WHERE abs(a.l - b.l) < 1e0 AND abs(a.u - b.u) < 1e0 AND abs(a.v - b.v) < 1e0),
{_components_sql("cc", "filt", "idx", "near")},
lab0 AS MATERIALIZED (SELECT image_id, node AS idx, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS INT) AS label FROM cc),
reg0 AS MATERIALIZED (SELECT g.image_id, label, arg_min(l, f.idx) AS l, arg_min(u, f.idx) AS u, arg_min(v, f.idx) AS v, count(*) AS n FROM lab0 g JOIN filt f ON f.image_id = g.image_id AND f.idx = g.idx GROUP BY g.image_id, label)"""


def _adjacent_sql(k: int) -> str:
    return f"""half{k} AS MATERIALIZED (SELECT DISTINCT a.image_id, a.label AS a, b.label AS b FROM lab{k} a JOIN lab{k} b ON b.image_id = a.image_id
  AND ((b.idx = a.idx + 1 AND b.idx % {W} > 0) OR b.idx = a.idx + {W}) WHERE a.label <> b.label),
adj{k} AS MATERIALIZED (SELECT image_id, a, b FROM half{k} UNION SELECT image_id, b, a FROM half{k})"""


_DIST = "((ra.l - rb.l) / 6.5e0) * ((ra.l - rb.l) / 6.5e0) + ((ra.u - rb.u) / 6.5e0) * ((ra.u - rb.u) / 6.5e0) + ((ra.v - rb.v) / 6.5e0) * ((ra.v - rb.v) / 6.5e0)"
_DIST4 = "4e0 * ((ra.l - rb.l) / 6.5e0) * ((ra.l - rb.l) / 6.5e0) + ((ra.u - rb.u) / 6.5e0) * ((ra.u - rb.u) / 6.5e0) + ((ra.v - rb.v) / 6.5e0) * ((ra.v - rb.v) / 6.5e0)"


def _pairs_sql(k: int) -> str:
    return f"adj{k} e JOIN reg{k} ra ON ra.image_id = e.image_id AND ra.label = e.a JOIN reg{k} rb ON rb.image_id = e.image_id AND rb.label = e.b"


def _fusable_sql(k: int) -> str:
    near = f"((CASE WHEN ra.l > 80e0 THEN {_DIST4} ELSE {_DIST} END) < 0.25e0 OR (CASE WHEN rb.l > 80e0 THEN {_DIST4} ELSE {_DIST} END) < 0.25e0)"
    return f"link{k} AS MATERIALIZED (SELECT e.image_id, e.a, e.b FROM {_pairs_sql(k)} WHERE e.a < e.b AND {near})"


def _smallest_sql(k: int) -> str:
    return f"""best{k} AS MATERIALIZED (SELECT image_id, label, target, dist FROM (SELECT e.image_id, e.a AS label, e.b AS target, {_DIST} AS dist,
  row_number() OVER (PARTITION BY e.image_id, e.a ORDER BY {_DIST}, e.b) AS k FROM {_pairs_sql(k)} WHERE ra.n < 20) WHERE k = 1),
link{k} AS MATERIALIZED (SELECT image_id, label AS a, target AS b FROM best{k})"""


def _merge_sql(k: int) -> str:
    mean = lambda c: _Q.format(f"sum(n * {c}) / sum(n)") + f" AS {c}"
    return f"""{_components_sql(f"m{k}", f"reg{k}", "label", f"link{k}")},
to{k} AS MATERIALIZED (SELECT image_id, node AS label, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS INT) AS fresh FROM m{k}),
lab{k + 1} AS MATERIALIZED (SELECT a.image_id, a.idx, t.fresh AS label FROM lab{k} a JOIN to{k} t ON t.image_id = a.image_id AND t.label = a.label),
reg{k + 1} AS MATERIALIZED (SELECT r.image_id, t.fresh AS label, {mean("l")}, {mean("u")}, {mean("v")}, CAST(sum(n) AS BIGINT) AS n FROM reg{k} r JOIN to{k} t ON t.image_id = r.image_id AND t.label = r.label GROUP BY r.image_id, t.fresh)"""


_FUSED = ", ".join([_LABELS, *(x for k in (0, 1) for x in (_adjacent_sql(k), _fusable_sql(k), _merge_sql(k)))])
_PRUNES = 6
_PRUNED = ", ".join([_FUSED, *(x for k in range(2, 2 + _PRUNES) for x in (_adjacent_sql(k), _smallest_sql(k), _merge_sql(k)))])
_DONE = 2 + _PRUNES
_EDGE = f"""edge AS (SELECT image_id, label, idx FROM (SELECT *, lag(label) OVER r AS a, lead(label) OVER r AS b, lag(label) OVER c AS d, lead(label) OVER c AS e
  FROM lab2 WINDOW r AS (PARTITION BY image_id, idx // {W} ORDER BY idx), c AS (PARTITION BY image_id, idx % {W} ORDER BY idx))
  WHERE a IS DISTINCT FROM label OR b IS DISTINCT FROM label OR d IS DISTINCT FROM label OR e IS DISTINCT FROM label)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


# --- pixels and colours ----------------------------------------------------------------------------------------


@query(_with(_PX, "SELECT * FROM px"))
def px_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir)


@query(_with(_PX, "SELECT image_id, idx, r | (g << 8) | (b << 16) AS rgba FROM px"))
def rgba_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("image_id", "idx", C.pack_rgba(F.col("r"), F.col("g"), F.col("b")).alias("rgba"))


@query(_with(_PX, "SELECT image_id, idx, r, g, b, 0 AS a FROM px"))
def rgba_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = rgba_pack(spark, sf_dir)
    return packed.select("image_id", "idx", *(c.alias(n) for c, n in zip(C.unpack_rgba(F.col("rgba")), "rgba")))


@query(_with(_PX, f"SELECT image_id, idx, idx - {W} * (idx // {W}) + {W} * (idx // {W}) AS back, CAST(trunc(idx / 7e0 - 100e0) AS INT) AS cut FROM px"))
def pixel_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index to place and back, and cutting towards zero."""
    x, y = C.place(F.col("idx"), W)
    return pixels(spark, sf_dir).select("image_id", "idx", C.index_of(x, y, W).alias("back"), C.truncated(F.col("idx") / F.lit(7.0) - F.lit(100.0)).alias("cut"))


@query(_with(_LUV, "SELECT * FROM luv"))
def rgb_to_luv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rgb_to_luv(pixels(spark, sf_dir)).select("image_id", "idx", "x", "y", "l", "u", "v")


_BACK = f"""{_LUV}, k AS (SELECT image_id, idx, l < 0.1e0 AS black, CASE WHEN l < 8e0 THEN l / 903.3e0 ELSE ((l + 16e0) / 116e0) * ((l + 16e0) / 116e0) * ((l + 16e0) / 116e0) END AS cy,
  u / (13e0 * l) + 0.19784977571475e0 AS up, v / (13e0 * l) + 0.46834507665248e0 AS vp FROM luv),
z AS (SELECT *, 9e0 * up * cy / (4e0 * vp) AS cx, (12e0 - 3e0 * up - 20e0 * vp) * cy / (4e0 * vp) AS cz FROM k)"""
_BYTE = "CASE WHEN black THEN 0 ELSE CAST(least(greatest(round(({0}e0 * cx + {1}e0 * cy + {2}e0 * cz) * 255e0), 0), 255) AS INT) END"


@query(_with(_BACK, "SELECT image_id, idx, " + ", ".join(_BYTE.format(*m).replace("+ -", "- ") + f" AS {n}" for m, n in zip(C.XYZ_TO_RGB, "rgb")) + " FROM z"))
def luv_to_rgb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.luv_to_rgb(rgb_to_luv(spark, sf_dir).drop("x", "y"))


# --- filter ----------------------------------------------------------------------------------------------------


@query(_with(_LUV, f"SELECT image_id, idx, n FROM {_step_sql(_START, '')}"))
def window_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels in the window of every pixel, by the range join."""
    luv = C.rgb_to_luv(pixels(spark, sf_dir))
    return M.window_mean(M.centres(luv), luv).select("image_id", "idx", "n")


_STEP = f"SELECT image_id, idx, n, m0, m1, m2, m3, m4, mag FROM {_step_sql(_START, '')}"


@query(_with(_LUV, _STEP))
def mean_shift_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first shift of every pixel, by the range join."""
    luv = C.rgb_to_luv(pixels(spark, sf_dir))
    return M.window_mean(M.centres(luv), luv).select("image_id", "idx", "n", "m0", "m1", "m2", "m3", "m4", "mag")


@query(_with(_LUV, _STEP))
def mean_shift_step_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the equi join on pixel offsets."""
    return M.window_mean_by_offsets(C.rgb_to_luv(pixels(spark, sf_dir))).select("image_id", "idx", "n", "m0", "m1", "m2", "m3", "m4", "mag")


@query(_with(_FILTER, "SELECT image_id, idx, l, u, v, iters FROM filt"))
def mean_shift_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter's kernel over bands of rows."""
    return filter_pixels(pixels(spark, sf_dir))


@query(_with(_FILTER, "SELECT image_id, idx, l, u, v, iters FROM filt"))
def mean_shift_filter_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter as a loop of joins."""
    return filter_pixels(pixels(spark, sf_dir), relational=True)


@query(_with(_FILTER, "SELECT image_id, iters, count(*) AS n FROM filt GROUP BY image_id, iters"))
def filter_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_pixels(pixels(spark, sf_dir)).groupBy("image_id", "iters").agg(F.count("*").alias("n"))


_SHADE = "CASE WHEN iters >= 80 THEN {0} ELSE {1} - 10 * CAST(iters // 10 AS INT) END AS {2}"


@query(_with(_FILTER, "SELECT image_id, idx, " + ", ".join(_SHADE.format(a, b, c) for a, b, c in ((162, 242, "r"), (49, 241, "g"), (0, 240, "b"))) + " FROM filt"))
def iteration_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_pixels(pixels(spark, sf_dir))
    return out.select("image_id", "idx", *(c.alias(n) for c, n in zip(C.iteration_colour(F.col("iters")), "rgb")))


# --- regions ---------------------------------------------------------------------------------------------------


@query(_with(_LABELS, "SELECT image_id, idx, label FROM lab0"))
def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.label_regions(filtered(spark, sf_dir), W)


@query(_with(_LABELS, "SELECT image_id, label, l, u, v, n FROM reg0"))
def region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(filtered(spark, sf_dir), W)[1]


@query(_with(_LABELS, "SELECT image_id, count(DISTINCT label) AS regions, count(*) AS pixels FROM lab0 GROUP BY image_id"))
def region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, _ = labelled(filtered(spark, sf_dir), W)
    return labels.groupBy("image_id").agg(F.countDistinct("label").alias("regions"), F.count("*").alias("pixels"))


@query(_with(f"{_LABELS}, {_adjacent_sql(0)}", "SELECT image_id, a, b FROM adj0"))
def region_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.adjacency(labelled(filtered(spark, sf_dir), W)[0], W)


@query(_with(f"{_LABELS}, {_adjacent_sql(0)}", "SELECT image_id, a AS label, string_agg(b, ',' ORDER BY b) AS neighbours FROM adj0 GROUP BY image_id, a"))
def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = R.adjacency_lists(region_adjacency(spark, sf_dir))
    return lists.select("image_id", "label", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query(_with(f"{_LABELS}, {_adjacent_sql(0)}, {_fusable_sql(0)}", "SELECT image_id, a, b FROM link0"))
def fusion_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, regions = labelled(filtered(spark, sf_dir), W)
    return R.fusion_edges(R.adjacency(labels, W), regions)


def _fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return R.fuse_regions(*labelled(filtered(spark, sf_dir), W), W)


@query(_with(_FUSED, "SELECT image_id, label, l, u, v, n FROM reg2"))
def fused_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)[1]


@query(_with(_FUSED, "SELECT image_id, idx, label FROM lab2"))
def fused_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)[0]


@query(_with(f"{_FUSED}, {_adjacent_sql(2)}, {_smallest_sql(2)}", "SELECT image_id, label, target, dist FROM best2"))
def prune_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, regions = _fused(spark, sf_dir)
    return R.prune_candidates(R.adjacency(labels, W), regions)


@query(_with(_PRUNED, f"SELECT image_id, label, l, u, v, n FROM reg{2 + _PRUNES}"))
def pruned_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pruning passes; the oracle unrolls more of them than these images need."""
    return R.prune_regions(*_fused(spark, sf_dir), W)[1]


@query(_with(_FUSED, "SELECT a.image_id, a.idx, r.l, r.u, r.v FROM lab2 a JOIN reg2 r ON r.image_id = a.image_id AND r.label = a.label"))
def segmented_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.paint(*_fused(spark, sf_dir))


_BP = f"{_FUSED}, {_EDGE}"


@query(_with(_BP, "SELECT image_id, label, idx, row_number() OVER (PARTITION BY image_id, label ORDER BY idx) - 1 AS pos FROM edge"))
def boundary_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.boundary_pixels(_fused(spark, sf_dir)[0], W)


@query(_with(_BP, "SELECT image_id, count(*) AS n FROM edge GROUP BY image_id"))
def boundary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary_pixels(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("n"))


@query(_with(f"{_BP}, c AS (SELECT image_id, label, count(*) AS n FROM edge GROUP BY image_id, label)", "SELECT image_id, label, n, CAST(coalesce(sum(n) OVER (PARTITION BY image_id ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM c"))
def boundary_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.boundary_offsets(boundary_pixels(spark, sf_dir))


@query(_with(_BP, "SELECT image_id, label, string_agg(idx, ',' ORDER BY idx) AS indices FROM edge GROUP BY image_id, label"))
def boundary_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = R.boundary_lists(boundary_pixels(spark, sf_dir))
    return lists.select("image_id", "label", F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("indices"))


@query(_with(_BP, "SELECT a.image_id, a.idx, CASE WHEN e.idx IS NULL THEN 255 ELSE 0 END AS value FROM lab2 a LEFT JOIN edge e ON e.image_id = a.image_id AND e.idx = a.idx"))
def boundary_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, _ = _fused(spark, sf_dir)
    return R.boundary_image(labels, R.boundary_pixels(labels, W))


# --- the finished segmentation: fused, pruned, painted, outlined ---


def _pruned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return R.prune_regions(*_fused(spark, sf_dir), W)


@query(_with(_PRUNED, f"SELECT image_id, idx, label FROM lab{_DONE}"))
def pruned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pruned(spark, sf_dir)[0]


_PAINTED = f"{_PRUNED}, seg AS (SELECT a.image_id, a.idx, r.l, r.u, r.v FROM lab{_DONE} a JOIN reg{_DONE} r ON r.image_id = a.image_id AND r.label = a.label)" + _BACK.removeprefix(_LUV).replace("FROM luv", "FROM seg")


@query(_with(_PAINTED, "SELECT image_id, idx, " + ", ".join(_BYTE.format(*m).replace("+ -", "- ") + f" AS {n}" for m, n in zip(C.XYZ_TO_RGB, "rgb")) + " FROM z"))
def pruned_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel in the colour of its region."""
    return C.luv_to_rgb(R.paint(*_pruned(spark, sf_dir))).select("image_id", "idx", "r", "g", "b")


_PRUNED_EDGE = f"{_PRUNED}, {_EDGE.replace('lab2', f'lab{_DONE}')}"


@query(_with(_PRUNED_EDGE, f"SELECT a.image_id, a.idx, CASE WHEN e.idx IS NULL THEN 255 ELSE 0 END AS dark_edge, CASE WHEN e.idx IS NULL THEN 0 ELSE 255 END AS light_edge FROM lab{_DONE} a LEFT JOIN edge e ON e.image_id = a.image_id AND e.idx = a.idx"))
def pruned_boundary_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of the finished regions, dark on light and light on dark."""
    labels, _ = _pruned(spark, sf_dir)
    edge = R.boundary_pixels(labels, W)
    dark, light = (R.boundary_image(labels, edge, replace(DEFAULT, edge_value=a, background_value=255 - a)) for a in (0, 255))
    return dark.withColumnRenamed("value", "dark_edge").join(light.withColumnRenamed("value", "light_edge"), ["image_id", "idx"])


@query(_with(_PRUNED_EDGE, "SELECT image_id, label, count(*) AS n FROM edge GROUP BY image_id, label"))
def pruned_boundary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.boundary_offsets(R.boundary_pixels(_pruned(spark, sf_dir)[0], W)).select("image_id", "label", "n")


@query(_with(_PX, "SELECT image_id, idx, r, g, b, g AS grey FROM px"))
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images written as PPM and PGM files and read back by a pattern."""
    px, folder = pixels(spark, sf_dir), f"{shared_dir(spark)}/images-{uuid4().hex}"
    sinks.write_images(px, folder, "-colour").unionByName(sinks.write_images(px.select("image_id", "x", "y", F.col("g").alias("value")), folder, "-grey")).collect()
    number = F.regexp_extract("image_id", r"(\d+)-(?:colour|grey)\.p[gp]m$", 1).cast("bigint").alias("image_id")
    colour = read_images(spark, folder, glob="*.ppm", channels=3).select(number, "x", "y", "r", "g", "b")
    grey = read_images(spark, folder, channels=1).select(number, "x", "y", F.col("r").alias("grey"))
    own = px.select("image_id", "idx", "x", "y")
    return own.join(colour, ["image_id", "x", "y"], "left").join(grey, ["image_id", "x", "y"], "left").select("image_id", "idx", "r", "g", "b", "grey")


# --- sinks as tables -------------------------------------------------------------------------------------------


def _inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("image_id", "idx", "x", "y", F.when(F.col("y") < 10, F.col("r")).otherwise(255 - F.col("r")).alias("r"), "g", "b")


@query(_with(_PX, f"SELECT image_id, x, y, r, g, b FROM px UNION ALL SELECT image_id, x + {W}, y, CASE WHEN y < 10 THEN r ELSE 255 - r END, g, b FROM px UNION ALL SELECT image_id, x + {2 * W}, y, g, g, g FROM px"))
def montage(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return sinks.montage([px, _inverted(spark, sf_dir), px.select("image_id", "x", "y", F.col("g").alias("value"))], W)


@query(_with(_PX, "SELECT image_id, idx, r AS r_a, g AS g_a, b AS b_a, 255 - r AS r_b, g AS g_b, b AS b_b FROM px WHERE y >= 10"))
def image_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.image_diff(pixels(spark, sf_dir), _inverted(spark, sf_dir))


@query(_with(_PX, "SELECT image_id, count(*) AS pixels, count(*) FILTER (y >= 10) AS mismatches FROM px GROUP BY image_id"))
def image_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.difference_count(pixels(spark, sf_dir), _inverted(spark, sf_dir))


@query(_with(_PX, "SELECT image_id, idx, x, y, r, g, b FROM px"))
def row_band_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.union_bands(list(sinks.row_bands(pixels(spark, sf_dir), 4, H)))


# --- densities -------------------------------------------------------------------------------------------------

_KERNELS = {
    "gaussian": "exp(-0.5e0 * q) / 2.5066282746310002e0",
    "epanechnikov": "CASE WHEN q < 1e0 THEN 0.75e0 * (1e0 - q) ELSE 0e0 END",
    "uniform": "CASE WHEN q < 1e0 THEN 0.5e0 ELSE 0e0 END",
}


def _kde_sql(kernel: str) -> str:
    return f"""WITH g AS (SELECT CAST(unnest(range(-1000, 10001, 500)) AS DOUBLE) AS x), d AS (SELECT x, ((x - c_acctbal) / {KDE_H}e0) * ((x - c_acctbal) / {KDE_H}e0) AS q FROM g, customer WHERE c_acctbal IS NOT NULL)
SELECT x, round(sum({_KERNELS[kernel]}) / (count(*) * {KDE_H}e0), 12) AS density FROM d GROUP BY x"""


def _kde(kernel: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = D.density(table(spark, sf_dir, "customer"), "c_acctbal", GRID, KDE_H, kernel)
        return out.select("x", F.round("density", 12).alias("density"))

    run.__name__ = f"kde_{kernel}"
    return run


for _k in _KERNELS:
    query(_kde_sql(_k))(_kde(_k))

_SPOTS = [(float(t), float(v)) for t in range(0, 24, 4) for v in range(0, 101, 20)]


def _hours() -> Column:
    """Hour of day with its fraction; doesn't depend on the session's time zone."""
    micros = (F.extract(F.lit("SECOND"), F.col("ts")) * 1000000).cast("bigint")
    return F.hour("ts") + F.minute("ts") / F.lit(60.0) + micros / F.lit(3.6e9)


@query(
    f"""WITH s AS (SELECT CAST(t AS DOUBLE) AS x, CAST(v AS DOUBLE) AS y FROM unnest(range(0, 24, 4)) a(t), unnest(range(0, 101, 20)) b(v)),
e AS (SELECT (hour(ts) + minute(ts) / 60e0 + microsecond(ts) / 3.6e9) AS h, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
d AS (SELECT x, y, ((x - h) / 3e0) * ((x - h) / 3e0) AS p, ((y - value) / 25e0) * ((y - value) / 25e0) AS q FROM s, e)
SELECT x, y, round(sum((exp(-0.5e0 * p) / 2.5066282746310002e0) * (CASE WHEN q < 1e0 THEN 0.75e0 * (1e0 - q) ELSE 0e0 END)) / (count(*) * 3e0 * 25e0), 10) AS density FROM d GROUP BY x, y"""
)
def joint_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product kernel over (hour of day, value) of all events."""
    rows = table(spark, sf_dir, "events").select(_hours().alias("h"), "value")
    return D.joint_density(rows, "h", "value", _SPOTS, (3.0, 25.0), ("gaussian", "epanechnikov")).select("x", "y", F.round("density", 10).alias("density"))


_VEC = "list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * 1048576e0 + 0.5e0) / 1048576e0)"
EMBED_H = 1.0


@query(
    f"""WITH e AS (SELECT vec_id, {_VEC} AS v FROM embeddings), p AS (SELECT q.vec_id AS id, e.v FROM e q JOIN e ON list_distance(q.v, e.v) < {EMBED_H}e0 WHERE q.vec_id % 50 = 0),
c AS (SELECT id, unnest(v) AS z, generate_subscripts(v, 1) AS k FROM p)
SELECT id, CAST(count(*) AS DOUBLE) AS weight, CAST(k - 1 AS INT) AS c, round(sum(z) / count(*), 9) AS shifted FROM c GROUP BY id, k"""
)
def embedding_mode_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One uniform step in all dimensions: every id divisible by 50 against all vectors, a row for each coordinate."""
    grid = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda c: C.quantised(c.cast("double"))).alias("v"))
    out = D.mean_shift_points(grid, grid.where(F.col("vec_id") % 50 == 0), EMBED_H, id_col="vec_id", vector_col="v")
    return out.select("id", "weight", F.posexplode("shifted").alias("c", "shifted")).select("id", "weight", "c", F.round("shifted", 9).alias("shifted"))


@query(
    """WITH e AS (SELECT event_id, floor((hour(ts) + minute(ts) / 60e0 + microsecond(ts) / 3.6e9) / 3e0 * 1048576e0 + 0.5e0) / 1048576e0 AS h, floor(value / 25e0 * 1048576e0 + 0.5e0) / 1048576e0 AS v FROM events),
p AS (SELECT q.event_id AS id, e.h, e.v FROM e q JOIN e ON ((q.h - e.h) / 1e0) * ((q.h - e.h) / 1e0) + ((q.v - e.v) / 1e0) * ((q.v - e.v) / 1e0) < 1e0 WHERE q.event_id % 50 = 0)
SELECT id, CAST(count(*) AS DOUBLE) AS weight, round(sum(h) / count(*), 9) AS hour, round(sum(v) / count(*), 9) AS value FROM p GROUP BY id"""
)
def event_mode_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One uniform step in (hour of day, value), in bandwidths of 3 hours and 25: every id divisible by 50 against all events."""
    rows = table(spark, sf_dir, "events").select("event_id", F.array(C.quantised(_hours() / F.lit(3.0)), C.quantised(F.col("value") / F.lit(25.0))).alias("v"))
    out = D.mean_shift_points(rows, rows.where(F.col("event_id") % 50 == 0), 1.0, id_col="event_id", vector_col="v")
    # (an event without time or value is near none, itself included)
    return out.where("weight > 0").select("id", "weight", F.round(F.col("shifted")[0], 9).alias("hour"), F.round(F.col("shifted")[1], 9).alias("value"))


MODE_STEPS, MODE_EPSILON = 5, 0.0004


def _climb_sql(k: int) -> str:
    """One more step of the queries that have not settled: s(k) from s(k - 1)."""
    d = "((q.h - e.h) / 1e0) * ((q.h - e.h) / 1e0) + ((q.v - e.v) / 1e0) * ((q.v - e.v) / 1e0)"
    return f"""m{k} AS MATERIALIZED (SELECT id, sum((1e0 - d) * eh) / sum(1e0 - d) AS h, sum((1e0 - d) * ev) / sum(1e0 - d) AS v FROM (SELECT q.id, e.h AS eh, e.v AS ev, {d} AS d FROM s{k - 1} q, e WHERE NOT q.settled) WHERE d < 1e0 GROUP BY id),
s{k} AS MATERIALIZED (SELECT q.id, CASE WHEN q.settled THEN q.steps ELSE q.steps + 1 END AS steps, coalesce(m.h, q.h) AS h, coalesce(m.v, q.v) AS v,
q.settled OR (coalesce(m.h, q.h) - q.h) * (coalesce(m.h, q.h) - q.h) + (coalesce(m.v, q.v) - q.v) * (coalesce(m.v, q.v) - q.v) < {MODE_EPSILON}e0 AS settled FROM s{k - 1} q LEFT JOIN m{k} m ON m.id = q.id)"""


@query(
    """WITH e AS MATERIALIZED (SELECT event_id, (hour(ts) + minute(ts) / 60e0 + microsecond(ts) / 3.6e9) / 3e0 AS h, value / 25e0 AS v FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
s0 AS (SELECT event_id AS id, 0 AS steps, h, v, false AS settled FROM e WHERE event_id % 50 = 0),
"""
    + ",\n".join(_climb_sql(k) for k in range(1, MODE_STEPS + 1))
    + f"\nSELECT id, steps, round(h, 6) AS hour, round(v, 6) AS value, settled FROM s{MODE_STEPS}"
)
def event_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epanechnikov weights in (hour of day, value), step by step until settled or five times: every id divisible by 50 against all events."""
    rows = table(spark, sf_dir, "events").where("ts is not null and value is not null").select("event_id", F.array(_hours() / F.lit(3.0), F.col("value") / F.lit(25.0)).alias("v"))
    out = D.mean_shift_modes(rows, rows.where(F.col("event_id") % 50 == 0), 1.0, "epanechnikov", id_col="event_id", vector_col="v", epsilon=MODE_EPSILON, limit=MODE_STEPS)
    return out.select("id", "steps", F.round(F.col("mode")[0], 6).alias("hour"), F.round(F.col("mode")[1], 6).alias("value"), "settled")


# --- tables of times -------------------------------------------------------------------------------------------

#: Published milliseconds of the filter (pixels, one device, processor).
PUBLISHED_MS = (
    (4096, 4.66, 571.26), (16384, 20.41, 2411.88), (65536, 71.59, 9616.77), (147456, 147.6, 20964.82), (262144, 250.39, 37198.26), (409600, 384.18, 57495.39),
    (589824, 543.82, 83064.95), (802816, 731.51, 112788.1), (1048576, 954.45, 147779.63), (1327104, 1209.69, 187018.94), (1638400, 1479.96, 233262.7),
    (1982464, 1789.59, 284368.87), (2359296, 2105.61, 340970.2), (2768896, 2466.66, 400997.07), (3211264, 2942.96, 468622.61), (3686400, 3313.71, 539875.91),
    (4194304, 3802.69, 614670.31), (4734976, 4275.25, 701980.6), (5308416, 4841.71, 784887.76), (5914624, 5368.35, 881574.04), (6553600, 5954.18, 978742.79), (7225344, 6565.11, 1082570.14),
)
_TIMES = "t(pixels, fast_ms, slow_ms) AS (SELECT CAST(a AS BIGINT), CAST(b AS DOUBLE), CAST(c AS DOUBLE) FROM (VALUES " + ", ".join(f"({a}, {b}e0, {c}e0)" for a, b, c in PUBLISHED_MS) + ") v(a, b, c))"


def _times(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PUBLISHED_MS, "pixels bigint, fast_ms double, slow_ms double")


@query(f"WITH {_TIMES} SELECT pixels, fast_ms, slow_ms, slow_ms / fast_ms AS speedup, pixels / fast_ms AS pixels_per_ms, (pixels / fast_ms) / (SELECT max(pixels / fast_ms) FROM t) AS normalised FROM t")
def speedup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.speedups(_times(spark))


@query("SELECT CAST(n AS BIGINT) AS n, round(1e0 / ((1e0 - 0.993e0) + 0.993e0 / n), 9) AS amdahl, round(n + (1e0 - n) * 0.007e0, 9) AS gustafson FROM unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512]) t(n)")
def amdahl_gustafson(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n").cast("double")
    rows = spark.createDataFrame([(2**k,) for k in range(10)], "n bigint")
    return rows.select("n", F.round(D.amdahl(F.lit(0.993), n), 9).alias("amdahl"), F.round(D.gustafson(F.lit(0.007), n), 9).alias("gustafson"))


@query(f"WITH {_TIMES} SELECT count(*) AS runs, round(sum(fast_ms) / count(*), 6) AS mean_ms, 10284.756e0 AS reference_ms, round(10284.756e0 / (sum(fast_ms) / count(*)), 6) AS speedup FROM t")
def timing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sinks.timing_report(_times(spark).select(F.col("fast_ms").alias("ms")), 10284.756)
    return out.select("runs", F.round("mean_ms", 6).alias("mean_ms"), "reference_ms", F.round("speedup", 6).alias("speedup"))
