"""Connected components of an edge table by alternating star contractions.

Every round replaces each vertex's links by links to its smallest neighbour, first for the larger
neighbours, then for the smaller ones; the rounds needed grow with the logarithm of the size.
Links stay in tables: grouping keeps one minimum per vertex and is combined before the shuffle, and a
vertex with very many links is an ordinary skewed join, of a written table on either side, that adaptive
execution splits. A table of few links, as given or after some rounds, is settled by the driver: rounds over little data
take long only by their number of jobs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_table, shared_dir

MAX_ROUNDS = 60
#: Links that the driver takes, at most: a few MB.
FEW_LINKS = 1 << 16


def _saved(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link every larger neighbour of a vertex to the vertex's smallest neighbour (or itself); also the written table this reads."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link a vertex and its smaller neighbours to the smallest of them. Edges have v < u."""
    least = _saved(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    down = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), least


def _stars(links: DataFrame) -> DataFrame:
    """Few links, of vertices of a simple type, as links of every vertex to the smallest of its component."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in links.collect():
        a, b = sorted(find(bytes(x) if isinstance(x, bytearray) else x) for x in (u, v))
        root[b] = a
    return links.sparkSession.createDataFrame([(x, find(x)) for x in root if find(x) != x], links.schema)


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, root) of every vertex of the edge table; root is the smallest vertex of its component.

    Loops, repeated edges and both directions are accepted; rows with a null end are left out.
    An empty table gives an empty result.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(f"{src} is not null and {dst} is not null")
    loops = e.where("u = v").select("u")
    nodes = e.select("u").unionByName(e.select(F.col("v").alias("u"))).unionByName(loops).distinct()
    cur = _saved(e.where("u <> v").distinct(), "components")
    seen, simple = None, isinstance(cur.schema["u"].dataType, (T.IntegralType, T.StringType, T.BinaryType))
    n = cur.count()
    for _ in range(MAX_ROUNDS):
        if simple and n <= FEW_LINKS:
            before, cur = cur, _saved(_stars(cur), "components")
            drop_table(before)
            break
        large, one = _large_star(cur)
        small, two = _small_star(large)
        before, cur = cur, _saved(small, "components")
        for done in (before, one, two):
            drop_table(done)
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen, n = tuple(state), state[0]
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return nodes.join(cur, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("root"))
