"""Weighted undirected edges: canonical keys, slices, merges, counters.

An edge is undirected: its ends are ordered by longitude, then latitude, vertical edges included. Rows with a
missing coordinate are left out rather than put at (0, 0).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.geo import length2

KEY = ["lo_lon", "lo_lat", "hi_lon", "hi_lat"]
ENDS = ["from_lon", "from_lat", "to_lon", "to_lat"]
LEAST = 0.001


def between(source: DataFrame, start, end, first: bool = False) -> DataFrame:
    """Rows with start < ts <= end; with `first`, start itself belongs to it."""
    after = F.col("ts") >= F.lit(start) if first else F.col("ts") > F.lit(start)
    return source.where(after & (F.col("ts") <= F.lit(end)))


def decoded(source: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows with all coordinates and a length above the degenerate one."""
    there = F.lit(True)
    for c in ENDS:
        there = there & F.col(c).isNotNull()
    return source.where(there & (length2(*ENDS) > least))


def canonical(source: DataFrame) -> DataFrame:
    """Adds the ordered ends and whether the row runs from the lower end."""
    forward = (F.col("from_lon") < F.col("to_lon")) | ((F.col("from_lon") == F.col("to_lon")) & (F.col("from_lat") <= F.col("to_lat")))
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    return source.withColumns({"lo_lon": pick("from_lon", "to_lon"), "lo_lat": pick("from_lat", "to_lat"), "hi_lon": pick("to_lon", "from_lon"), "hi_lat": pick("to_lat", "from_lat"), "forward": forward})


def weighted(source: DataFrame, least: float = LEAST) -> DataFrame:
    """lo_lon, lo_lat, hi_lon, hi_lat, weight, and the direction of the earliest row (by time, then id)."""
    rows = canonical(decoded(source, least))
    return rows.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min_by("forward", F.struct("ts", "id")).alias("forward"), F.min(F.struct("ts", "id")).alias("seen"))


def merge(total: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The total with a further batch; the direction seen first stays."""
    if total is None:
        return batch
    both = total.unionByName(batch)
    return both.groupBy(*KEY).agg(F.sum("weight").alias("weight"), F.min_by("forward", "seen").alias("forward"), F.min("seen").alias("seen"))


def endpoints(edges: DataFrame, distinct: bool = True) -> DataFrame:
    """lon, lat of all ends; distinct, or one row per end of each edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("lo_lon").alias("lon"), F.col("lo_lat").alias("lat")), F.struct(F.col("hi_lon").alias("lon"), F.col("hi_lat").alias("lat")))).alias("p")).select("p.lon", "p.lat")
    return ends.distinct() if distinct else ends


def counters(edges: DataFrame) -> DataFrame:
    """One row: replies_cnt, edges_cnt, points_cnt."""
    sums = edges.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("replies_cnt"), F.count("*").alias("edges_cnt"))
    return sums.crossJoin(endpoints(edges).agg(F.count("*").alias("points_cnt")))  # one row each


def upsert_leaves(leaves: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds the batch's weights to known leaves and its other edges as new leaves; is_new tells which."""
    old, new = leaves.select(*KEY, F.col("weight").alias("w_old")), batch.select(*KEY, F.col("weight").alias("w_new"))
    both = old.join(new, KEY, "full_outer")
    return both.select(*KEY, (F.coalesce("w_old", F.lit(0)) + F.coalesce("w_new", F.lit(0))).alias("weight"), F.col("w_old").isNull().alias("is_new"))


def unknown(batch: DataFrame, leaves: DataFrame) -> DataFrame:
    """Edges of the batch that aren't leaves yet."""
    return batch.join(leaves.select(*KEY), KEY, "left_anti")


def matching(edges: DataFrame, existing: DataFrame, radius: float) -> DataFrame:
    """Pairs of an edge and an existing hyperedge whose ends lie within `radius` of each other, side by side.

    An equi-join on the cells of both ends, then the exact distances: a cell is two radii wide, so what lies within one of them is in this cell or in the
    next on the nearer side. One side stands in those cells of its lower end, the other in those of its higher end, so that a pair meets once, each
    row has four copies, and a place of many edges is split by their other ends. The four cells are one long, 16 bits each: cells of equal bits lie 65536 apart.
    """
    half = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("long")

    def placed(rows, p, spread):
        out = rows.select(*[F.col(c).alias(f"{p}_{c}") for c in KEY], *[half(c).alias(f"c{i}") for i, c in enumerate(KEY)])
        for i in range(len(KEY)):
            # By halves of a cell: what lies within a radius is at most one half away.
            own = F.shiftright(f"c{i}", 1)
            out = out.withColumn(f"c{i}", F.explode(F.array(own, own + F.col(f"c{i}").bitwiseAND(1) * 2 - 1)) if i in spread else own)
        bits = [F.shiftleft(F.col(f"c{i}").bitwiseAND(0xFFFF), 16 * i) for i in range(len(KEY))]
        return out.select(*[f"{p}_{c}" for c in KEY], reduce(lambda x, y: x.bitwiseOR(y), bits).alias("cells"))

    d = lambda a: length2(f"e_{a}_lon", f"e_{a}_lat", f"h_{a}_lon", f"h_{a}_lat") <= radius * radius
    joined = placed(edges, "e", (2, 3)).join(placed(existing, "h", (0, 1)), "cells")
    return joined.where(d("lo") & d("hi")).select(*[f"e_{c}" for c in KEY], *[f"h_{c}" for c in KEY])


def isolated(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges (id) without any compatible partner in pairs(a, b)."""
    partners = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    return edges.join(partners, "id", "left_anti")


def moved_leaves(leaves: DataFrame, moved: DataFrame) -> DataFrame:
    """Cluster edges (ax, ay, bx, by) with an end in moved(cell_x, cell_y): those that bundling must take up again."""
    a = moved.select(F.col("cell_x").alias("ax"), F.col("cell_y").alias("ay"), F.lit(True).alias("_a"))
    b = moved.select(F.col("cell_x").alias("bx"), F.col("cell_y").alias("by"), F.lit(True).alias("_b"))
    return leaves.join(a, ["ax", "ay"], "left").join(b, ["bx", "by"], "left").where("_a or _b").drop("_a", "_b")
