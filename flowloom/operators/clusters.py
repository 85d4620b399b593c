"""Clusters per zoom: tiles, the greedy hierarchy, k-means and incremental k-means.

`tiles` stands for the hierarchy at scale: a point belongs to the cell of its zoom, a cell's parent is the cell
of half its index, and the cluster lies at the weighted mean of its points. It approximates the greedy
hierarchy, which depends on the order of arrival; `greedy` keeps that rule with a fixed order by id.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.geo import lat_y, length2, lng_x
from flowloom.operators.graph import components
from flowloom.operators.store import drop, settle
from flowloom.operators.viewport import radius_join

MAX_ZOOM = 17


def mercator(points: DataFrame) -> DataFrame:
    """Adds mx, my to points(lon, lat), rounded so that cells don't hang on the last bit."""
    return points.withColumns({"mx": F.round(lng_x("lon"), 9), "my": F.round(lat_y("lat"), 9)})


def tile(c: str, zoom: int, radius: float):
    return F.floor(F.col(c) * F.lit(512.0 * 2**zoom / radius)).cast("long")


def tiles(points: DataFrame, radius: float = 40.0, min_zoom: int = 0, max_zoom: int = MAX_ZOOM) -> DataFrame:
    """points(lon, lat, n) -> zoom, cell_x, cell_y, parent_x, parent_y, mx, my, num_points, for every zoom.

    Points are aggregated once to the finest cells; coarser zooms are sums of those.
    """
    leaf = mercator(points).groupBy(tile("mx", max_zoom, radius).alias("x"), tile("my", max_zoom, radius).alias("y"))
    leaf = leaf.agg(F.sum("n").alias("n"), F.sum(F.col("mx") * F.col("n")).alias("sx"), F.sum(F.col("my") * F.col("n")).alias("sy"))
    every = leaf.withColumn("zoom", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
    cells = every.groupBy("zoom", F.expr(f"shiftright(x, {max_zoom} - zoom)").alias("cell_x"), F.expr(f"shiftright(y, {max_zoom} - zoom)").alias("cell_y"))
    out = cells.agg((F.sum("sx") / F.sum("n")).alias("mx"), (F.sum("sy") / F.sum("n")).alias("my"), F.sum("n").alias("num_points"))
    up = lambda c: F.when(F.col("zoom") > min_zoom, F.shiftright(c, 1))
    return out.select("zoom", "cell_x", "cell_y", up("cell_x").alias("parent_x"), up("cell_y").alias("parent_y"), "mx", "my", "num_points")


def tile_of(lon: str, lat: str, zoom: int, radius: float, prefix: str) -> dict:
    """Columns with the tile of a point at a zoom: membership needs no join."""
    mx, my = F.round(lng_x(lon), 9), F.round(lat_y(lat), 9)
    k = F.lit(512.0 * 2**zoom / radius)
    return {f"{prefix}_x": F.floor(mx * k).cast("long"), f"{prefix}_y": F.floor(my * k).cast("long")}


def first_come(ids: DataFrame, earlier: DataFrame) -> DataFrame:
    """id, centre for every id: a centre unless one of its earlier(id, other) is a centre; runs until none is undecided."""
    state = settle(ids.join(earlier.select("id").distinct(), "id", "left_anti").select("id", F.lit(True).alias("centre")))
    left = ids.count() - state.count()
    while left:
        open_ = ids.join(state, "id", "left_anti").select("id")
        judged = earlier.join(open_, "id").join(state.select(F.col("id").alias("other"), "centre"), "other", "left")
        judged = judged.groupBy("id").agg(F.max(F.coalesce("centre", F.lit(False))).alias("covered"), F.sum(F.col("centre").isNull().cast("int")).alias("waiting"))
        new = settle(judged.where("covered or waiting = 0").select("id", (~F.col("covered")).alias("centre")))
        if not (found := new.count()):
            raise RuntimeError(f"{left} points can't be decided")
        state, left = settle(state.unionByName(new)), left - found
    return state


#: Points of a strip, about: what a task of first_in_strips() holds.
IN_STRIP = 20_000


def first_in_strips(points: DataFrame, earlier: DataFrame) -> DataFrame:
    """As first_come(), for points(id, x): the points stand in strips by x, and a round decides in each all that does not wait for another strip.

    A chain of waiting points that crosses the map costs a round for each strip, not for each point.
    """
    strips = math.ceil(points.count() / IN_STRIP)
    bounds = points.approxQuantile("x", [i / strips for i in range(1, strips)], 0.001) if strips > 1 else []
    strip = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("x"))) if bounds else F.lit(0)
    needs = earlier.groupBy("id").agg(F.collect_list("other").alias("needs"))
    empty = F.array().cast("array<long>")
    open_ = points.select("id", strip.cast("long").alias("strip")).join(needs, "id", "left").select("strip", "id", F.lit(False).alias("covered"), F.coalesce("needs", empty).alias("needs"))

    def decide(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, centre, left, known = rows["id"].to_pylist(), [], [], {}
        for i, covered, waits in zip(ids, rows["covered"].to_pylist(), rows["needs"].to_pylist(), strict=True):
            open_waits = [j for j in waits if known.get(j) is None]
            verdict = False if covered or any(known.get(j) for j in waits) else None if open_waits else True
            known[i] = verdict
            centre.append(verdict)
            left.append(open_waits if verdict is None else [])
        return pa.table({"strip": rows["strip"], "id": rows["id"], "centre": pa.array(centre, pa.bool_()), "needs": pa.array(left, pa.list_(pa.int64()))})

    done = []
    while True:
        judged = settle(open_.groupBy("strip").applyInArrow(decide, "strip long, id long, centre boolean, needs array<long>"))
        decided, waiting = judged.where("centre IS NOT NULL").select("id", "centre"), judged.where("centre IS NULL")
        done.append(decided)
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, done)
        if decided.isEmpty():
            raise RuntimeError(f"{waiting.count()} points can't be decided")
        each = waiting.select("strip", "id", F.explode("needs").alias("other")).join(decided.select(F.col("id").alias("other"), "centre"), "other", "left")
        open_ = each.groupBy("strip", "id").agg(F.coalesce(F.max("centre"), F.lit(False)).alias("covered"), F.collect_list(F.when(F.col("centre").isNull(), F.col("other"))).alias("needs"))


def greedy(points: DataFrame, radius: float = 40.0, min_zoom: int = 0, max_zoom: int = MAX_ZOOM) -> tuple[DataFrame, DataFrame]:
    """points(id, lon, lat, n) -> clusters (zoom, id, mx, my, num_points) and memberships (zoom, child, centre) of the greedy hierarchy.

    From the finest zoom up: a cluster becomes a centre unless an earlier one (by id) is a centre within the zoom's radius;
    every other joins its nearest centre. The order-first rule is settled in rounds by strips: a point whose earlier
    neighbours are all decided is decided itself. Each zoom clusters the centroids of the zoom before. Points are inserted
    one by one; inserting pairs, hyperedges and attaching one side of a pair are not built.
    """
    now = mercator(points).select("id", F.col("mx").alias("x"), F.col("my").alias("y"), "n")
    out = None
    for zoom in range(max_zoom, min_zoom - 1, -1):
        r = radius / (512.0 * 2**zoom)
        now = settle(now)
        near = settle(radius_join(now, now, r).where("id != other").select("id", "other", "distance"))
        earlier = near.where("other < id").select("id", "other")
        state = settle(first_in_strips(now.select("id", "x"), earlier))
        centres = state.where("centre").select("id")
        joined = near.join(centres.select(F.col("id").alias("other")), "other").groupBy("id").agg(F.min_by("other", F.struct("distance", "other")).alias("c"))
        placed = now.join(centres.withColumn("own", F.lit(True)), "id", "left").join(joined, "id", "left")
        placed = placed.withColumn("centre", F.when(F.col("own"), F.col("id")).otherwise(F.col("c")))
        now = placed.groupBy(F.col("centre").alias("id")).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("y"), F.sum("n").alias("n"))
        now = settle(now)
        level = now.select(F.lit(zoom).alias("zoom"), "id", F.col("x").alias("mx"), F.col("y").alias("my"), F.col("n").alias("num_points"))
        member = settle(placed.select("id", "centre"))
        up = member.withColumnRenamed("id", "child").withColumn("zoom", F.lit(zoom))
        out = (level, up) if out is None else (out[0].unionByName(level), out[1].unionByName(up))
    return out


def absorb_overlaps(clusters: DataFrame, targets: DataFrame, radius: float, share: float = 0.6) -> DataFrame:
    """Pairs of clusters within `radius` whose link targets agree for more than `share` of the smaller set: keep, drop.

    clusters(id, x, y), targets(id, target).
    """
    near = near_pairs(clusters, radius)
    return overlapping(near, links_of(near, targets).distinct(), share)


def near_pairs(clusters: DataFrame, radius: float) -> DataFrame:
    """Clusters (id, x, y) within `radius` of each other: id, other, the smaller id first."""
    return radius_join(clusters, clusters, radius).where("id < other").select("id", "other")


def links_of(near: DataFrame, targets: DataFrame) -> DataFrame:
    """Those of targets(id, target) that a cluster of near(id, other) has."""
    return targets.select("id", "target").join(near.select("id").union(near.select("other")).distinct(), "id", "left_semi")


def overlapping(near: DataFrame, links: DataFrame, share: float) -> DataFrame:
    """absorb_overlaps() of near(id, other), with links_of() these, no row twice."""
    sizes = links.groupBy("id").agg(F.count("*").alias("size"))
    sized = near.join(sizes, "id").join(sizes.select(F.col("id").alias("other"), F.col("size").alias("size2")), "other")
    less = F.col("size") <= F.col("size2")
    sized = sized.withColumns({"few": F.when(less, F.col("id")).otherwise(F.col("other")), "many": F.when(less, F.col("other")).otherwise(F.col("id")), "least": F.least("size", "size2")})
    # One row for each target of the cluster with fewer, and a sum: no set is gathered.
    each = sized.select("id", "other", "least", "few", "many").join(links.select(F.col("id").alias("few"), "target"), "few")
    hit = each.join(links.select(F.col("id").alias("many"), "target"), ["many", "target"]).groupBy("id", "other", "least").agg(F.count("*").alias("shared"))
    alike = F.col("shared") / F.col("least")
    return hit.where(alike > share).select(F.col("id").alias("keep"), F.col("other").alias("drop"), alike.alias("similarity"))


def absorb_once(clusters: DataFrame, targets: DataFrame, into: DataFrame) -> tuple[DataFrame, DataFrame]:
    """clusters(id, x, y, n) and targets(id, target) after each cluster of into(id, component) has become part of its component's."""
    put = lambda t, c: t.join(into.select(F.col("id").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    targets = put(put(targets.select("id", "target"), "id"), "target").where("id != target").distinct()
    return put(clusters, "id").groupBy("id").agg(mean("x"), mean("y"), F.sum("n").alias("n")), targets


def absorb(clusters: DataFrame, targets: DataFrame, radius: float, share: float = 0.6) -> tuple[DataFrame, DataFrame | None]:
    """Merges overlapping clusters, with the sets of their targets (no row twice), until no pair within `radius` agrees for more than `share`.

    Clusters that are joined by pairs, directly or not, become one at once: the one with the smallest id, at the weighted mean. Returns clusters (id, x, y, n) and
    kept (id, kept) for every absorbed or absorbing cluster; None if there is no such pair.
    """
    kept = None
    while True:
        near = settle(near_pairs(clusters, radius))
        pairs = near if near.isEmpty() else settle(overlapping(near, links_of(near, targets), share))
        if pairs.isEmpty():
            return clusters, kept
        into = components(pairs.select(F.col("keep").alias("a"), F.col("drop").alias("b")))
        clusters, targets = (settle(t) for t in absorb_once(clusters, targets, into))
        new = into.select("id", F.col("component").alias("kept"))
        if kept is not None:
            onward = kept.join(new.select(F.col("id").alias("kept"), F.col("kept").alias("beyond")), "kept", "left").select("id", F.coalesce("beyond", "kept").alias("kept"))
            new = onward.unionByName(new.join(onward.select("id"), "id", "left_anti"))
        kept = settle(new)


def shifted(moved, n):
    """Whether a cluster of n points counts as moved: any move below 30 points, else more than n * (1 + n / 100) millionths, n up to 500."""
    n = F.least(n, F.lit(500))
    return F.when(n < 30, moved > 0).otherwise(moved > n * (F.lit(1) + F.floor(n / F.lit(100))) * F.lit(1e-6))


def shifts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tiles of both tables with how far each went: zoom, cell_x, cell_y, moved, shifted. A new tile counts as shifted."""
    key = ["zoom", "cell_x", "cell_y"]
    both = after.join(before.select(*key, F.col("mx").alias("ox"), F.col("my").alias("oy")), key, "left")
    moved = F.sqrt(length2("mx", "my", "ox", "oy"))
    return both.select(*key, moved.alias("moved"), F.coalesce(shifted(moved, F.col("num_points")), F.lit(True)).alias("shifted"))


# k-means


def assign(points: DataFrame, centers: list[tuple[float, float]]) -> DataFrame:
    """Adds `k`, the nearest of the fixed few centres (the lowest index among equals), and its squared distance."""
    far = [length2("lon", "lat", F.lit(float(x)), F.lit(float(y))) for x, y in centers]
    least = F.least(*far) if len(far) > 1 else far[0]
    at = points.withColumn("d2", least)
    k = F.lit(len(centers) - 1)
    for i in range(len(centers) - 2, -1, -1):
        k = F.when(far[i] == F.col("d2"), F.lit(i)).otherwise(k)
    return at.withColumn("k", k).select(*points.columns, "k", "d2")


def assigned(points: DataFrame, centers: list[tuple[float, float]]) -> DataFrame:
    """As assign(), with the centres in a literal array: the code that Spark generates is the same for all centres and compiled once."""
    every = F.lit([v for at in centers for v in map(float, at)])
    far = F.transform(F.sequence(F.lit(0), F.lit(len(centers) - 1)), lambda i: F.struct(length2("lon", "lat", every[2 * i], every[2 * i + 1]).alias("d2"), i.alias("k")))
    return points.withColumn("_near", F.array_min(far)).select(*points.columns, F.col("_near.k").alias("k"), F.col("_near.d2").alias("d2"))


def lloyd_step(points: DataFrame, centers) -> DataFrame:
    """k, lon, lat, n, sse of the new centres; a centre without points keeps its place."""
    rows = assign(points, centers).groupBy("k").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count("*").alias("n"), F.sum("d2").alias("sse"))
    old = points.sparkSession.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(centers)], "k int, olon double, olat double")
    both = old.join(rows, "k", "left")
    return both.select("k", F.coalesce("lon", "olon").alias("lon"), F.coalesce("lat", "olat").alias("lat"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sse", F.lit(0.0)).alias("sse"))


def seeds(points: DataFrame, k: int) -> list[tuple[float, float]]:
    """Up to k distinct points, by a hash of their coordinates."""
    rows = points.select("lon", "lat").distinct().orderBy(F.xxhash64("lon", "lat"), "lon", "lat").limit(k).collect()
    return [(r["lon"], r["lat"]) for r in rows]


def kmeans(points: DataFrame, k: int = 17, most: int = 2000, tol: float = 1e-6):
    """Lloyd's iterations until the SSE falls by less than `tol` of itself: (centres, sizes, sse by iteration). Raises if `most` don't settle it.

    The points are read once and counted by place; each iteration goes over the places and brings k rows of sums to the driver.
    """
    places = settle(points.groupBy("lon", "lat").agg(F.count("*").alias("n")))
    centers, history, sizes = seeds(places, k), [], []
    total = lambda c: F.sum(F.col(c) * F.col("n"))
    for _ in range(most):
        if not centers:
            break
        sums = assigned(places, centers).groupBy("k").agg(total("lon").alias("x"), total("lat").alias("y"), F.sum("n").alias("m"), total("d2").alias("sse"))
        rows = {r["k"]: r for r in sums.collect()}
        centers = [(rows[i]["x"] / rows[i]["m"], rows[i]["y"] / rows[i]["m"]) if i in rows else at for i, at in enumerate(centers)]
        sizes = [rows[i]["m"] if i in rows else 0 for i in range(len(centers))]
        history.append(sum(rows[i]["sse"] for i in sorted(rows)))
        if len(history) > 1 and history[-2] - history[-1] <= tol * max(history[-2], 1e-12):
            break
    else:
        raise RuntimeError(f"k-means is not settled after {most} iterations")
    drop(places)
    return centers, sizes, history


class IncrementalKMeans:
    """k centres with counts; the first batch seeds and settles them, later ones are assigned once and never again."""

    def __init__(self, k: int = 17):
        self.k, self.centers, self.n = k, [], []

    def add(self, points: DataFrame) -> None:
        if not self.centers:
            self.centers, self.n, _ = kmeans(points, self.k)
            return
        for r in running_mean_step(points, self.centers, self.n).collect():
            self.centers[r["k"]], self.n[r["k"]] = (r["lon"], r["lat"]), r["n"]


def running_mean_step(points: DataFrame, centers, counts) -> DataFrame:
    """New centres: (sum of the new points + centre * old count) / (new + old count)."""
    new = assign(points, centers).groupBy("k").agg(F.sum("lon").alias("sx"), F.sum("lat").alias("sy"), F.count("*").alias("m"))
    old = points.sparkSession.createDataFrame([(i, float(x), float(y), int(n)) for i, ((x, y), n) in enumerate(zip(centers, counts, strict=True))], "k int, x double, y double, c long")
    both = old.join(new, "k", "left").fillna({"sx": 0.0, "sy": 0.0, "m": 0})
    total = F.col("m") + F.col("c")
    mean = lambda s, c: F.when(total == 0, F.col(c)).otherwise((F.col(s) + F.col(c) * F.col("c")) / F.greatest(total, F.lit(1)))
    return both.select("k", mean("sx", "x").alias("lon"), mean("sy", "y").alias("lat"), total.alias("n"))
