"""Edges between clusters: roll-up to a zoom or to k-means centres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.clusters import assign, tile_of


def to_tiles(edges: DataFrame, zoom: int, radius: float = 40.0) -> DataFrame:
    """Weights by unordered pair of tiles: ax, ay, bx, by, weight, self (both ends in one tile)."""
    rows = edges.withColumns(tile_of("lo_lon", "lo_lat", zoom, radius, "p") | tile_of("hi_lon", "hi_lat", zoom, radius, "q"))
    first = (F.col("p_x") < F.col("q_x")) | ((F.col("p_x") == F.col("q_x")) & (F.col("p_y") <= F.col("q_y")))
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    rows = rows.select(pick("p_x", "q_x").alias("ax"), pick("p_y", "q_y").alias("ay"), pick("q_x", "p_x").alias("bx"), pick("q_y", "p_y").alias("by"), "weight")
    return rows.groupBy("ax", "ay", "bx", "by").agg(F.sum("weight").alias("weight"))


def to_members(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Weights by unordered pair of clusters, for any membership(lon, lat, cluster): the general form, two equi-joins."""
    m = membership.select("lon", "lat", "cluster")
    a = m.select(F.col("lon").alias("lo_lon"), F.col("lat").alias("lo_lat"), F.col("cluster").alias("p"))
    b = m.select(F.col("lon").alias("hi_lon"), F.col("lat").alias("hi_lat"), F.col("cluster").alias("q"))
    rows = edges.join(a, ["lo_lon", "lo_lat"]).join(b, ["hi_lon", "hi_lat"])
    return rows.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("weight").alias("weight"))


def to_centers(edges: DataFrame, centers) -> DataFrame:
    """Weights by unordered pair of k-means centres; the centres are few, so membership is an expression."""
    p = assign(edges.withColumns({"lon": F.col("lo_lon"), "lat": F.col("lo_lat")}), centers).withColumnRenamed("k", "p").drop("d2")
    q = assign(p.withColumns({"lon": F.col("hi_lon"), "lat": F.col("hi_lat")}), centers)
    return q.groupBy(F.least("p", "k").alias("a"), F.greatest("p", "k").alias("b")).agg(F.sum("weight").alias("weight"))
