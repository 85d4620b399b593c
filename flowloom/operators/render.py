"""Rows ready to draw, and their JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.geo import line_width
from flowloom.operators.ranking import dense_ids
from flowloom.operators.store import settle

BLUE, RED = (0, 0, 255), (255, 0, 0)


def half_edges(edges: DataFrame) -> DataFrame:
    """Each edge (id, fx, fy, tx, ty, weight) as two halves: blue from its start, red to its end."""
    mx, my = (F.col("fx") + F.col("tx")) / 2, (F.col("fy") + F.col("ty")) / 2
    half = lambda i, x1, y1, x2, y2, rgb: F.struct(F.lit(i).alias("half"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.array(*map(F.lit, rgb)).alias("color"))
    parts = F.array(half(0, F.col("fx"), F.col("fy"), mx, my, BLUE), half(1, mx, my, F.col("tx"), F.col("ty"), RED))
    return edges.select("id", "weight", F.explode(parts).alias("p")).select("id", "p.*", "weight", line_width("weight").alias("width"))


def points_json(points: DataFrame) -> DataFrame:
    """points(lon, lat, size) -> json, one object each."""
    return points.select(F.to_json(F.struct(F.array("lon", "lat").alias("coordinates"), F.col("size").alias("size"))).alias("json"))


def edges_json(segments: DataFrame) -> DataFrame:
    """segments(x1, y1, x2, y2, width, color) -> json, one object each."""
    return segments.select(F.to_json(F.struct(F.array("x1", "y1").alias("from"), F.array("x2", "y2").alias("to"), "width", "color")).alias("json"))


def node_export(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense node ids, as text, in the order of their coordinates, and links between them: (node, lon, lat), (source, target, weight)."""
    from flowloom.operators.edges import endpoints

    ids = settle(dense_ids(endpoints(edges), "lon", "lat", name="node")).withColumn("node", F.col("node").cast("string"))
    a = ids.select(F.col("node").alias("source"), F.col("lon").alias("lo_lon"), F.col("lat").alias("lo_lat"))
    b = ids.select(F.col("node").alias("target"), F.col("lon").alias("hi_lon"), F.col("lat").alias("hi_lat"))
    return ids, edges.join(a, ["lo_lon", "lo_lat"]).join(b, ["hi_lon", "hi_lat"]).select("source", "target", "weight")


def envelope(flag: str, statuses: dict, counters: dict, points: list[str], edges: list[str]) -> str:
    """The response: counters beside the payloads, which are JSON texts themselves."""
    return json.dumps({"flag": flag, **statuses, **counters, "points": "[" + ",".join(points) + "]", "edges": "[" + ",".join(edges) + "]"})
