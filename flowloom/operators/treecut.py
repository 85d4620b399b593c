"""Tree cut: off-screen ends are raised to the highest ancestor that no on-screen cluster shares.

An external cluster maps to its ancestor one level below the lowest ancestor that it has in common with any internal
cluster, to itself where its own parent is common, and to its zoom-1 ancestor where nothing is common.
Ancestors are tile prefixes, so the closure is an expression and the common ancestor a semi-join on (zoom, tile).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.geo import length2


def ancestors(clusters: DataFrame, zoom: int) -> DataFrame:
    """clusters(cx, cy) of a zoom -> one row per ancestor: anc_zoom, anc_x, anc_y (own zoom left out)."""
    up = clusters.withColumn("anc_zoom", F.explode(F.sequence(F.lit(0), F.lit(max(zoom - 1, 0)))))
    return up.withColumns({"anc_x": F.expr(f"shiftright(cx, {zoom} - anc_zoom)"), "anc_y": F.expr(f"shiftright(cy, {zoom} - anc_zoom)")})


def cut(external: DataFrame, internal: DataFrame, zoom: int) -> DataFrame:
    """external, internal(cx, cy) -> cx, cy, to_zoom, to_x, to_y."""
    held = ancestors(internal.distinct(), zoom).select("anc_zoom", "anc_x", "anc_y").distinct()
    outer = external.distinct()
    common = ancestors(outer, zoom).join(held, ["anc_zoom", "anc_x", "anc_y"], "left_semi").groupBy("cx", "cy").agg(F.max("anc_zoom").alias("common"))
    placed = outer.join(common, ["cx", "cy"], "left").withColumn("to_zoom", F.least(F.coalesce(F.col("common") + 1, F.lit(min(1, zoom))), F.lit(zoom)))
    return placed.select("cx", "cy", "to_zoom", F.expr(f"shiftright(cx, {zoom} - to_zoom)").alias("to_x"), F.expr(f"shiftright(cy, {zoom} - to_zoom)").alias("to_y"))


def cut_by_parents(external: DataFrame, internal: DataFrame, closure: DataFrame) -> DataFrame:
    """The same for any hierarchy: external, internal(id), closure(id, up, anc): the ancestor `up` levels above (0: itself).

    Returns id, target; without a common ancestor the target is the one below the root.
    """
    held = closure.where("up > 0").join(internal, "id", "left_semi").select("anc").distinct()
    own = closure.join(external, "id", "left_semi")
    least = own.where("up > 0").join(held, "anc", "left_semi").groupBy("id").agg(F.min("up").alias("common"))
    top = own.groupBy("id").agg(F.max("up").alias("top"))
    want = top.join(least, "id", "left").select("id", (F.coalesce("common", "top") - 1).alias("up"))
    return own.join(want.withColumn("up", F.greatest("up", F.lit(0))), ["id", "up"]).select("id", F.col("anc").alias("target"))


def rewrite(edges: DataFrame, mapping: DataFrame, centroids: DataFrame, least: float = 0.001) -> DataFrame:
    """Boundary edges (in_lon, in_lat, cx, cy, weight) to the raised ends, weights summed, degenerate edges left out.

    mapping as from cut(); centroids(zoom, cell_x, cell_y, lon, lat).
    """
    raised = mapping.join(centroids.select(F.col("zoom").alias("to_zoom"), F.col("cell_x").alias("to_x"), F.col("cell_y").alias("to_y"), F.col("lon").alias("out_lon"), F.col("lat").alias("out_lat")), ["to_zoom", "to_x", "to_y"])
    rows = edges.join(raised, ["cx", "cy"])
    rows = rows.where(length2("in_lon", "in_lat", "out_lon", "out_lat") > least)
    return rows.groupBy("in_lon", "in_lat", "out_lon", "out_lat").agg(F.sum("weight").alias("weight"))
