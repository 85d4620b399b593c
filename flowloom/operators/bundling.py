"""Edge bundling: the compatibility join, force-directed bundling, the representative tree, rendered segments.

The pair search is the distributed part: an equi-join on length bands and midpoint cells, pruned without loss, then
the exact score. Forces act only between compatible edges, so a connected component can be bundled in
a task of its own, by a vectorised kernel over its pair list; a large one goes through blocks of edges that exchange control points.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import compat
from flowloom.functions.bind import bound
from flowloom.functions.geo import gradient, length2
from flowloom.operators import forces, kernel
from flowloom.operators.graph import components
from flowloom.operators.store import settle

THRESHOLD = 0.6
#: Length ratio above which the scale factor alone is below the threshold (0.6 q^2 - 0.4 q - 3.4 = 0).
MOST_RATIO = (0.4 + math.sqrt(0.16 + 4 * 0.6 * 3.4)) / 1.2


def with_bands(edges: DataFrame) -> DataFrame:
    """edges(id, fx, fy, tx, ty) with their geometry and the length bands of the join."""
    rows = compat.with_geometry(edges).where("len > 0")
    return rows.withColumn("band", F.floor(F.log("len") / F.lit(math.log(MOST_RATIO))).cast("long"))


def compatible_pairs(edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs a < b with a score above the threshold: a, b, score.

    Lossless prunes: a pair needs a length ratio below 2.737, so its bands are neighbours; its midpoints lie
    closer than 0.667 times the mean length, so with cells as wide as that for the longest length of the wider band
    they lie in neighbouring cells. Each edge joins in the scheme of its own band and of the next one.
    """
    if threshold < THRESHOLD:
        raise ValueError("the prunes hold for thresholds from 0.6 on")
    rows = with_bands(edges)
    width = lambda band: F.lit(1 / THRESHOLD - 1) * F.exp((band + 1) * F.lit(math.log(MOST_RATIO)))
    cells = lambda rows: rows.withColumns({"i": F.floor(F.col("mx") / width(F.col("scheme"))).cast("long"), "j": F.floor(F.col("my") / width(F.col("scheme"))).cast("long")})
    keep = ["id", "fx", "fy", "tx", "ty", *compat.GEOMETRY, "band", "scheme", "i", "j"]
    own = cells(rows.withColumn("scheme", F.col("band"))).select(keep)
    both = cells(rows.withColumn("scheme", F.explode(F.array("band", F.col("band") + 1)))).select(keep)
    near = F.sequence(F.lit(-1), F.lit(1))
    spread = own.withColumn("di", F.explode(near)).withColumn("dj", F.explode(near)).withColumns({"i": F.col("i") + F.col("di"), "j": F.col("j") + F.col("dj")}).drop("di", "dj")
    p, q = spread.alias("p"), both.alias("q")
    same = (F.col("p.scheme") == F.col("q.scheme")) & (F.col("p.i") == F.col("q.i")) & (F.col("p.j") == F.col("q.j"))
    # Two edges of one band would meet twice, in either order: the smaller id leads there.
    once = F.when(F.col("p.band") == F.col("q.band"), F.col("p.id") < F.col("q.id")).otherwise(True)
    mean = (F.col("p.len") + F.col("q.len")) / 2
    close = length2("p.mx", "p.my", "q.mx", "q.my") < (mean * (1 / THRESHOLD - 1)) * (mean * (1 / THRESHOLD - 1))
    alike = F.greatest("p.len", "q.len") < F.least("p.len", "q.len") * MOST_RATIO
    pairs = p.join(q, same & once & close & alike)
    # No factor is above 1 by more than its last bits, so a pair whose product falls below the threshold needs no further factor.
    low = threshold - 1e-9
    scored = pairs.withColumn("score", bound(compat.angle("p", "q", True) * compat.scale("p", "q", True))).where(F.col("score") > low)
    scored = scored.withColumn("score", bound(F.col("score") * compat.position("p", "q", True))).where(F.col("score") > low)
    scored = scored.withColumn("score", bound(F.col("score") * compat.visibility("p", "q", True))).where(F.col("score") > threshold)
    return scored.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"), "score")


# Forces

#: Edges of a component of compatible edges up to which one task bundles it. Larger ones are bundled in blocks of as many (forces.py), with the same result.
BLOCK = 20_000
PATH = "array<struct<x:double,y:double>>"


def as_points(paths: np.ndarray):
    """Paths (n, points, 2) as an Arrow column of PATH."""
    import pyarrow as pa

    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(paths[..., i]).ravel()) for i in (0, 1)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(paths) * paths.shape[1] + 1, paths.shape[1]), pa.int32()), points)


def unpacked(rows: DataFrame) -> DataFrame:
    """id, weight, path as PATH of rows with packed paths."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch["id"], batch["weight"], as_points(forces.unpacked(batch["path"]))], ["id", "weight", "path"])

    return rows.mapInArrow(run, f"id long, weight long, path {PATH}")


def fdeb(edges: DataFrame, pairs: DataFrame, step: float = 0.025, pulls: DataFrame | None = None, label: DataFrame | None = None, block: int = BLOCK, cycles: int = kernel.CYCLES, iterations: int = kernel.ITERATIONS) -> DataFrame:
    """edges(id, fx, fy, tx, ty, weight) -> id, weight, path (array of struct x, y). Edges without partners stay straight.

    pulls(id, fx, fy, tx, ty): fixed segments that draw edge id to them; label: components(pairs), if at hand. Components of more than `block` edges are
    bundled in blocks, an iteration at a time; every other is one group of a task.
    """
    ends = ["fx", "fy", "tx", "ty"]
    edges = edges.select("id", *ends, F.col("weight").cast("long").alias("weight"))
    label = components(pairs) if label is None else label
    if pulls is not None:
        label = settle(label.unionByName(pulls.select("id").distinct().join(label, "id", "left_anti").withColumn("component", F.col("id"))))
    straight = edges.join(label, "id", "left_anti").select("id", "weight", F.array(F.struct(F.col("fx").alias("x"), F.col("fy").alias("y")), F.struct(F.col("tx").alias("x"), F.col("ty").alias("y"))).alias("path"))
    sized = label.groupBy("component").agg(F.count("*").alias("n"))
    large = settle(label.join(sized.where(F.col("n") > block), "component").select("id"))
    out = straight
    if not large.isEmpty():
        inside = lambda t, c: t.join(large.withColumnRenamed("id", c), c, "left_semi")
        held = pulls if pulls is None else inside(pulls, "id")
        bent = forces.bundle_in_blocks(inside(edges, "id"), inside(pairs, "a"), held, step, block, cycles, iterations)
        out = out.unionByName(unpacked(bent))
        label = label.join(large, "id", "left_anti")
    links = pairs.select("a", "b", *[F.lit(None).cast("double").alias(c) for c in ends])
    if pulls is not None:
        links = links.unionByName(pulls.select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), *ends))

    def run(key, nodes, links):
        import pyarrow as pa

        nodes, links = nodes.sort_by("id"), links.sort_by([(c, "ascending") for c in ("a", *ends)])
        ids, a, inner = nodes["id"].to_numpy(), links["a"].to_numpy(), links["b"].is_valid().to_numpy()
        at = np.searchsorted(ids, a)
        b = np.searchsorted(ids, links["b"].filter(pa.array(inner)).to_numpy())
        fixed = np.stack([links[c].to_numpy()[~inner] for c in ends], axis=1)
        paths = kernel.bundle(np.stack([nodes[c].to_numpy() for c in ends], axis=1), np.stack([at[inner], b], axis=1), step, cycles, iterations, at[~inner], fixed)
        return pa.Table.from_arrays([nodes["id"].combine_chunks(), nodes["weight"].combine_chunks(), as_points(paths)], ["id", "weight", "path"])

    placed = edges.join(label, "id").withColumnRenamed("component", "of_nodes")
    linked = links.join(label.select(F.col("id").alias("a"), F.col("component").alias("of_links")), "a").select("a", "b", *ends, "of_links")
    bent = placed.groupBy("of_nodes").cogroup(linked.groupBy("of_links")).applyInArrow(run, f"id long, weight long, path {PATH}")
    return bent.unionByName(out)


def segments(paths: DataFrame) -> DataFrame:
    """Rendered segments: x1, y1, x2, y2, width (sum over edges that share it), color of the largest part (by id, then place in the path).

    Id, place and number of parts are digits of one decimal, whose maximum Spark finds by hashing: a task holds its segments, not its rows, as sorting would.
    """
    n = F.size("path") - 1
    rows = paths.where("size(path) > 1").select("id", "weight", n.alias("parts"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.col("path")[i].alias("p"), F.col("path")[i + 1].alias("q")))).alias("at", "s"))
    forward = (F.col("s.p.x") < F.col("s.q.x")) | ((F.col("s.p.x") == F.col("s.q.x")) & (F.col("s.p.y") <= F.col("s.q.y")))
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    rows = rows.select("id", "weight", "at", pick("s.p.x", "s.q.x").alias("x1"), pick("s.p.y", "s.q.y").alias("y1"), pick("s.q.x", "s.p.x").alias("x2"), pick("s.q.y", "s.p.y").alias("y2"), "parts")
    digits = F.lit(10**9).cast("long")
    part = F.col("id").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col("at").cast("long") * digits + F.col("parts").cast("long")
    found = rows.groupBy("x1", "y1", "x2", "y2").agg(F.sum("weight").alias("width"), F.max(part.cast("decimal(38,0)")).alias("part"))
    place = F.pmod("part", F.lit(10**18).cast("decimal(38,0)")).cast("long")
    return found.select("x1", "y1", "x2", "y2", "width", gradient(F.floor(place / digits).cast("int"), (place % digits).cast("int")).alias("color"))


def path_length(path: str):
    """Sum of the lengths of a path column's stretches."""
    steps = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.sqrt(length2(F.col(path)[i - 1]["x"], F.col(path)[i - 1]["y"], F.col(path)[i]["x"], F.col(path)[i]["y"])))
    return F.when(F.size(path) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x))
