"""A session: requests in, results out. Progressive over time slices for a new query, from kept state for a new viewport.

Points and edges stay DataFrames; `to_json` renders them. State is the weighted edge table alone (written to the
shared folder after each slice), and with incremental bundling the bundler of the present zoom, so a change of zoom or viewport never scans the source again, and a new query
starts from nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.config import EngineConfig, Request, Result
from flowloom.functions import geo, text
from flowloom.operators import bundling, clusters, edges, pairs, render, rollup, treecut, viewport
from flowloom.operators.store import mark, settle, sweep
from flowloom.operators.tree import IncrementalBundler
from flowloom.streaming import slicing

#: Values of Request.clusteringAlgorithm and of Request.bundlingAlgorithm.
HGC, INCREMENTAL_KMEANS, KMEANS = 0, 1, 2
FDEB, INCREMENTAL, CLIENT = 0, 1, 2


class EngineSession:
    def __init__(self, source: DataFrame, config: EngineConfig | None = None, first: datetime | None = None, last: datetime | None = None, fixed_interval: bool = False, properties: str | None = None):
        """`source` is an edge source: id, ts, four coordinates and, for keyword queries, from_text and to_text.

        `properties` names a file of settings that is read again for each new query; first and last, if given, go before its dates.
        """
        self.source, self.config, self.request = source, config or EngineConfig(), Request()
        self.dates, self.fixed, self.properties = (first, last), fixed_interval, properties
        self.since = mark()
        self.reset()

    def close(self) -> None:
        """Ends the session and deletes its tables, and with them what its results read."""
        self.reset()
        sweep(self.source.sparkSession, self.since, self.source)

    @property
    def first(self) -> datetime:
        return self.dates[0] or self.config.first_date

    @property
    def last(self) -> datetime:
        return self.dates[1] or self.config.last_date

    def reset(self) -> None:
        self.total: DataFrame | None = None
        self.model = clusters.IncrementalKMeans(self.config.k)
        self.centers: list = []
        self.bundler, self.view = None, None
        self.levels, self.levels_of = None, None

    def handle(self, message: str | dict) -> Iterator[Result]:
        """One result for each slice of a new query (flag N until the last, which has Y); one for a new viewport; none for a heartbeat."""
        if isinstance(message, str) and not message.strip():
            return
        self.request.update(message)
        r = self.request
        if not r.newQuery:
            if self.total is not None:
                yield self.draw("Y")
            return
        self.reset()
        if self.properties is not None:
            self.config = EngineConfig.read(self.source.sparkSession, self.properties, self.config)
        rows = self.matching()
        if r.clustering and r.clusteringAlgorithm == KMEANS:
            self.total = settle(edges.weighted(edges.between(rows, self.first, self.last, first=True), self.config.least_length2))
            self.centers = clusters.kmeans(edges.endpoints(self.total, distinct=False), self.config.k)[0]
            yield self.draw("Y")
            return
        for batch, _, _, done in slicing.progressive(rows, self.first, self.last, lambda df: df.count(), self.config, self.fixed):
            self.total = settle(edges.merge(self.total, batch))
            if r.clustering and r.clusteringAlgorithm == INCREMENTAL_KMEANS:
                self.model.add(edges.endpoints(batch, distinct=False))
                self.centers = list(self.model.centers)
            yield self.draw("Y" if done else "N")

    def matching(self) -> DataFrame:
        """Rows whose texts satisfy the query; all rows for an empty one or a source without texts."""
        if not self.request.query.strip() or "from_text" not in self.source.columns:
            return self.source
        return self.source.where(text.matches(F.col("from_text"), self.request.query) | text.matches(F.col("to_text"), self.request.query))

    @property
    def box(self):
        r = self.request
        return r.lowerLongitude, r.lowerLatitude, r.upperLongitude, r.upperLatitude

    @property
    def zoom(self) -> int:
        return min(viewport.clamp_zoom(self.request.zoom, self.config.min_zoom, self.config.max_zoom), self.config.max_zoom)

    def points(self) -> DataFrame:
        """lon, lat, size: raw ends, tiles in view, or centres with their sizes."""
        bag = edges.endpoints(self.total, distinct=False)
        if not self.request.clustering:
            return bag.select("lon", "lat", F.lit(1).cast("long").alias("size")).distinct()
        if self.request.clusteringAlgorithm == HGC:
            found = self.hierarchy()[1] if self.config.hierarchy == "pairs" else self.tiles()
            inside = viewport.clusters_in_view(found, self.zoom, self.box)
            return inside.select(geo.x_lng("mx").alias("lon"), geo.y_lat("my").alias("lat"), F.col("num_points").alias("size"))
        if not self.centers:
            return bag.select("lon", "lat", F.lit(1).cast("long").alias("size")).limit(0)
        sizes = clusters.assign(bag, self.centers).groupBy("k").agg(F.count("*").alias("size"))
        at = self.total.sparkSession.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(self.centers)], "k int, lon double, lat double")
        return at.join(sizes, "k").select("lon", "lat", "size")

    def tiles(self) -> DataFrame:
        bag = edges.endpoints(self.total, distinct=False).groupBy("lon", "lat").agg(F.count("*").alias("n"))
        return clusters.tiles(bag, self.request.radius, self.config.min_zoom, self.config.max_zoom)

    def drawn_edges(self) -> DataFrame:
        """id, from_lon, from_lat, to_lon, to_lat, weight of what is shown: clustered, cut to the view, with off-screen ends raised.

        An edge between clusters keeps its id when their centres move; others are named by their ends.
        """
        r = self.request
        named, by_ends = ["id", *edges.ENDS, "weight"], F.xxhash64(*edges.ENDS)
        if not r.clustering:
            e = self.total.select(F.col("lo_lon").alias("from_lon"), F.col("lo_lat").alias("from_lat"), F.col("hi_lon").alias("to_lon"), F.col("hi_lat").alias("to_lat"), "weight")
            return viewport.edge_classes(e, self.box).withColumn("id", by_ends).select(named)
        if r.clusteringAlgorithm != HGC:
            at = self.total.sparkSession.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(self.centers)], "k int, lon double, lat double")
            e = rollup.to_centers(self.total, self.centers).where("a != b")
            e = e.join(at.toDF("a", "from_lon", "from_lat"), "a").join(at.toDF("b", "to_lon", "to_lat"), "b")
            return viewport.edge_classes(e, self.box).withColumn("id", F.xxhash64("a", "b")).select(named)
        if self.config.hierarchy == "pairs":
            return self.edges_of_pairs().select(named)
        zoom, t = self.zoom, settle(self.tiles())
        cen = t.select("zoom", "cell_x", "cell_y", geo.x_lng("mx").alias("lon"), geo.y_lat("my").alias("lat"))
        here = cen.where(F.col("zoom") == zoom)
        e = rollup.to_tiles(self.total, zoom, r.radius)
        e = e.join(here.select(F.col("cell_x").alias("ax"), F.col("cell_y").alias("ay"), F.col("lon").alias("from_lon"), F.col("lat").alias("from_lat")), ["ax", "ay"])
        e = e.join(here.select(F.col("cell_x").alias("bx"), F.col("cell_y").alias("by"), F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat")), ["bx", "by"])
        e = e.where(geo.length2(*edges.ENDS) > self.config.least_length2)
        e = settle(viewport.edge_classes(e, self.box).withColumn("id", F.xxhash64("ax", "ay", "bx", "by")))
        if not r.treeCut:
            return e.select(named)
        inner, outer = e.where("edge_class = 'internal'"), e.where("edge_class = 'boundary'")
        out = lambda a, b: F.when(F.col("from_in"), F.col(b)).otherwise(F.col(a))
        cut = outer.select(out("to_lon", "from_lon").alias("in_lon"), out("to_lat", "from_lat").alias("in_lat"), out("ax", "bx").alias("cx"), out("ay", "by").alias("cy"), "weight")
        seen = e.where("from_in").select(F.col("ax").alias("cx"), F.col("ay").alias("cy")).union(e.where("to_in").select("bx", "by"))
        raised = treecut.rewrite(cut, treecut.cut(cut.select("cx", "cy"), seen, zoom), cen, self.config.least_length2)
        raised = raised.select(F.col("in_lon").alias("from_lon"), F.col("in_lat").alias("from_lat"), F.col("out_lon").alias("to_lon"), F.col("out_lat").alias("to_lat"), "weight")
        return inner.select(named).unionByName(raised.withColumn("id", by_ends))

    def hierarchy(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Places, clusters and members of the hierarchy over pairs; kept until the edges or the radius change."""
        key = (self.total, self.request.radius)
        if self.levels is None or self.levels_of[0] is not key[0] or self.levels_of[1] != key[1]:
            places, links = pairs.leaves(self.total)
            places = settle(places)
            found, members, _ = pairs.hierarchy(places, links, self.request.radius, self.config.min_zoom, self.config.max_zoom)
            self.levels, self.levels_of = (places, found, members), key
        return self.levels

    def edges_of_pairs(self) -> DataFrame:
        """Edges between clusters of the hierarchy over pairs, cut to the view, with off-screen ends raised along their ancestors."""
        zoom, (places, found, members) = self.zoom, self.hierarchy()
        held = pairs.placed_at(places, members, zoom, self.config.max_zoom)
        e = rollup.to_members(self.total, held.select("lon", "lat", "cluster")).where("a != b")
        cen = settle(found.select(pairs.node(F.col("zoom"), F.col("id")).alias("node"), geo.x_lng("mx").alias("lon"), geo.y_lat("my").alias("lat")))
        at = lambda c, p: cen.select(F.col("node").alias(c), F.col("lon").alias(f"{p}_lon"), F.col("lat").alias(f"{p}_lat"))
        e = e.withColumns({c: pairs.node(zoom, F.col(c)) for c in ("a", "b")}).join(at("a", "from"), "a").join(at("b", "to"), "b").where(geo.length2(*edges.ENDS) > self.config.least_length2)
        e = settle(viewport.edge_classes(e, self.box).withColumn("id", F.xxhash64("a", "b")))
        if not self.request.treeCut:
            return e
        out = lambda a, b: F.when(F.col("from_in"), F.col(b)).otherwise(F.col(a))
        cut = e.where("edge_class = 'boundary'").select(out("to_lon", "from_lon").alias("in_lon"), out("to_lat", "from_lat").alias("in_lat"), out("a", "b").alias("node"), "weight")
        seen = e.where("from_in").select(F.col("a").alias("id")).union(e.where("to_in").select("b")).distinct()
        line = pairs.closure(found.where(F.col("zoom") == zoom), members, zoom, self.config.min_zoom)
        raised = treecut.cut_by_parents(cut.select(F.col("node").alias("id")).distinct(), seen, settle(line))
        raised = cut.join(raised.select(F.col("id").alias("node"), F.col("target").alias("up")), "node").join(at("up", "out"), "up")
        raised = raised.where(geo.length2("in_lon", "in_lat", "out_lon", "out_lat") > self.config.least_length2)
        raised = raised.groupBy(F.col("in_lon").alias("from_lon"), F.col("in_lat").alias("from_lat"), F.col("out_lon").alias("to_lon"), F.col("out_lat").alias("to_lat")).agg(F.sum("weight").alias("weight"))
        raised = raised.withColumn("id", F.xxhash64(*edges.ENDS))
        return e.where("edge_class = 'internal'").select(raised.columns).unionByName(raised)

    def incremental(self) -> IncrementalBundler:
        """The bundler of the present zoom and clustering; another one starts from nothing."""
        r = self.request
        view = (r.clustering, r.clusteringAlgorithm, r.zoom, r.radius)
        if self.bundler is None or self.view != view:
            self.bundler = IncrementalBundler(step=geo.step_size(r.zoom), threshold=self.config.compatibility, block=self.config.bundling_block)
            self.view = view
        return self.bundler

    def draw(self, flag: str) -> Result:
        r, result = self.request, Result(flag)
        counts = edges.counters(self.total).first().asDict()
        result.counters = {"repliesCnt": counts["replies_cnt"], "edgesCnt": counts["edges_cnt"], "pointsCnt": counts["points_cnt"], "clustersCnt": 0, "isolatedEdgesCnt": 0}
        if r.pointStatus:
            result.points = settle(self.points())
            result.counters["clustersCnt"] = result.points.count()
        if r.edgeStatus:
            shown = settle(self.drawn_edges())
            result.counters["edgesCnt"] = shown.count()
            e = shown.select("id", F.col("from_lon").alias("fx"), F.col("from_lat").alias("fy"), F.col("to_lon").alias("tx"), F.col("to_lat").alias("ty"), "weight")
            if r.bundling and r.bundlingAlgorithm == INCREMENTAL and counts["edges_cnt"] > self.config.incremental_above:
                bundler = self.incremental()
                bundler.add(e)
                paths = bundler.paths(e)
                result.counters["isolatedEdgesCnt"] = paths.where("lonely").count()
                result.edges = bundling.segments(paths)
            elif r.bundling and r.bundlingAlgorithm != CLIENT:
                pairs = settle(bundling.compatible_pairs(e, self.config.compatibility))
                result.counters["isolatedEdgesCnt"] = edges.isolated(e, pairs).count()
                result.edges = bundling.segments(bundling.fdeb(e, pairs, geo.step_size(r.zoom), block=self.config.bundling_block))
            else:
                result.counters["isolatedEdgesCnt"] = result.counters["edgesCnt"]
                halves = render.half_edges(e)
                result.edges = halves.select("x1", "y1", "x2", "y2", "width", "color")
        return result

    def to_json(self, result: Result) -> str:
        """The response as JSON; its rows, those of one screen, come to the driver."""
        rows = lambda df: [r["json"] for r in df.collect()] if df is not None else []
        points = rows(render.points_json(result.points)) if result.points is not None else []
        drawn = rows(render.edges_json(result.edges)) if result.edges is not None else []
        return render.envelope(result.flag, {"pointStatus": self.request.pointStatus, "edgeStatus": self.request.edgeStatus}, result.counters, points, drawn)
