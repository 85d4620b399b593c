"""Registered queries of the graph engine, each with its SQL where SQL can tell it.

A query reads whole tables. Deviations from a row-at-a-time engine's habits are fixed here: rows with missing coordinates are left
out, the first slice includes its lower bound, edges keep weights through the tree cut, ties go to the lowest id.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import compat, geo, text
from flowloom.functions.bind import bound
from flowloom.operators import bundling, clusters, edges, pairs, render, rollup, treecut, viewport
from flowloom.operators.graph import components
from flowloom.operators.grid import Grid, stored
from flowloom.operators.store import settle, shared_dir
from flowloom.operators.tree import IncrementalBundler
from flowloom.sources import derived, ingest
from flowloom.streaming import slicing

QUERIES: dict = {}
SQL: dict[str, str] = {}

FIRST, LAST = datetime(1995, 1, 1), datetime(2001, 8, 1)
BOX = (-60.0, -30.0, 60.0, 45.0)
CENTERS = [(-150.0 + 18.0 * i, -70.0 + 8.5 * ((i * 5) % 17)) for i in range(17)]
ZOOM, RADIUS = 3, 40.0

FLIGHTS = """flights AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, o_orderdate AS ts,
    CAST((o_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS from_lon, CAST((o_custkey * 6101) % 17000 AS DOUBLE) / 100 - 85 AS from_lat,
    CAST((l_suppkey * 7919 + 13) % 36000 AS DOUBLE) / 100 - 180 AS to_lon, CAST((l_suppkey * 6101 + 17) % 17000 AS DOUBLE) / 100 - 85 AS to_lat
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CHECKINS = """checkins AS (
  SELECT event_id AS id, ts, CAST((before * 7919) % 36000 AS DOUBLE) / 100 - 180 AS from_lon, CAST((before * 6101) % 17000 AS DOUBLE) / 100 - 85 AS from_lat,
    CAST((event_id * 7919) % 36000 AS DOUBLE) / 100 - 180 AS to_lon, CAST((event_id * 6101) % 17000 AS DOUBLE) / 100 - 85 AS to_lat
  FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL)"""
REPLIES = """replies AS (
  SELECT conv_id * 1000 + turn AS id, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60) AS ts,
    CAST(((conv_id * 1000 + turn) * 7919) % 36000 AS DOUBLE) / 100 - 180 AS from_lon, CAST(((conv_id * 1000 + turn) * 6101) % 17000 AS DOUBLE) / 100 - 85 AS from_lat,
    CAST(((conv_id * 1000 + p) * 7919 + 13) % 36000 AS DOUBLE) / 100 - 180 AS to_lon, CAST(((conv_id * 1000 + p) * 6101 + 17) % 17000 AS DOUBLE) / 100 - 85 AS to_lat,
    text AS from_text, q AS to_text
  FROM (SELECT *, lag(text) OVER w AS q, lag(turn) OVER w AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE p IS NOT NULL)"""


def canonical_sql(source: str, where: str = "true") -> str:
    f = "from_lon < to_lon OR (from_lon = to_lon AND from_lat <= to_lat)"
    return f"""canon AS (
  SELECT *, {f} AS forward, CASE WHEN {f} THEN from_lon ELSE to_lon END AS lo_lon, CASE WHEN {f} THEN from_lat ELSE to_lat END AS lo_lat,
    CASE WHEN {f} THEN to_lon ELSE from_lon END AS hi_lon, CASE WHEN {f} THEN to_lat ELSE from_lat END AS hi_lat
  FROM {source} WHERE (to_lon - from_lon) * (to_lon - from_lon) + (to_lat - from_lat) * (to_lat - from_lat) > 0.001 AND ({where})),
weighted AS (SELECT lo_lon, lo_lat, hi_lon, hi_lat, count(*) AS weight FROM canon GROUP BY ALL)"""


EDGES = f"{FLIGHTS}, {canonical_sql('flights')}"
ENDS = "ends AS (SELECT lo_lon AS lon, lo_lat AS lat FROM weighted UNION ALL SELECT hi_lon, hi_lat FROM weighted)"


def mx_sql(lon: str) -> str:
    return f"round({lon} / CAST(360 AS DOUBLE) + CAST(0.5 AS DOUBLE), 9)"


def my_raw(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return f"(CASE WHEN {lat} >= 90 THEN 0.0 WHEN {lat} <= -90 THEN 1.0 ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 0.5 - 0.25 * ln((1 + {s}) / (1 - {s})) / pi())) END)"


def my_sql(lat: str) -> str:
    return f"round({my_raw(lat)}, 9)"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def flight_edges(spark, sf_dir) -> DataFrame:
    return edges.weighted(derived.flights(spark, sf_dir))


KEY = edges.KEY


# Scans and edges


@query(f"WITH {FLIGHTS} SELECT id, from_lon, from_lat, to_lon, to_lat FROM flights WHERE ts > TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1997-01-01'")
def scan_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time range, open at the left: S6, P1, P3, S7."""
    return edges.between(derived.flights(spark, sf_dir), datetime(1996, 1, 1), datetime(1997, 1, 1)).select("id", *edges.ENDS)


@query(f"WITH {CHECKINS} SELECT id, from_lon, from_lat, to_lon, to_lat FROM checkins WHERE ts > TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")
def scan_checkins(spark, sf_dir):
    return edges.between(derived.checkins(spark, sf_dir), datetime(2024, 1, 5), datetime(2024, 1, 20)).select("id", *edges.ENDS)


MATCH = " OR ".join(f"(list_contains(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), 'the') AND (list_contains(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), 'and') OR NOT list_contains(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), 'is')))" for c in ("from_text", "to_text"))


@query(f"WITH {REPLIES} SELECT id, from_lon, from_lat, to_lon, to_lat FROM replies WHERE {MATCH}")
def text_match(spark, sf_dir):
    """Keyword search over both texts, unstemmed: S3, P2."""
    rows = derived.replies(spark, sf_dir)
    hit = lambda c: text.matches(F.col(c), "the & (and | !is)", stemmed=False)
    return rows.where(hit("from_text") | hit("to_text")).select("id", *edges.ENDS)


@query()
def text_match_stemmed(spark, sf_dir):
    """P2 with stems and stop words: replies with both words in any form, or a third one; DuckDB has no stemmer here."""
    r = derived.replies(spark, sf_dir)
    hit = lambda c: text.matches(F.col(c), "(the der & dies) | than")
    return r.where(hit("from_text") | hit("to_text")).select("id")


@query(f"WITH {REPLIES} SELECT id FROM replies WHERE ({MATCH}) AND ts > TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-03'")
def text_match_timeslice(spark, sf_dir):
    """Keyword and time: S2."""
    rows = edges.between(derived.replies(spark, sf_dir), datetime(2024, 1, 1), datetime(2024, 1, 3))
    hit = lambda c: text.matches(F.col(c), "the & (and | !is)", stemmed=False)
    return rows.where(hit("from_text") | hit("to_text")).select("id")


@query(f"""WITH {REPLIES}, w AS (SELECT id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(from_text), '[^a-z0-9]+') || regexp_split_to_array(lower(to_text), '[^a-z0-9]+'), lambda x: x <> ''))) AS word FROM replies)
SELECT word, count(*) AS rows_with, min(id) AS first_id FROM w GROUP BY word""")
def token_index(spark, sf_dir):
    """Inverted index summary: S16."""
    return ingest.token_index(derived.replies(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("rows_with"), F.min("id").alias("first_id"))


@query(f"""WITH {EDGES} SELECT lo_lon, lo_lat, hi_lon, hi_lat, count(*) AS weight, arg_min(forward, epoch_us(ts)::HUGEINT * 100000000000 + id) AS forward FROM canon GROUP BY ALL""")
def edges_weighted(spark, sf_dir):
    """Undirected weights with the direction seen first: P4, P14, A1."""
    return flight_edges(spark, sf_dir).select(*KEY, "weight", "forward")


@query(f"WITH {FLIGHTS}, {canonical_sql('flights', "ts > TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1997-01-01'")} SELECT * FROM weighted")
def edges_timeslice(spark, sf_dir):
    return edges.weighted(edges.between(derived.flights(spark, sf_dir), datetime(1996, 1, 1), datetime(1997, 1, 1))).select(*KEY, "weight")


@query(f"""WITH {FLIGHTS}, {canonical_sql("flights", "ts >= TIMESTAMP '1995-01-01' AND ts <= TIMESTAMP '2001-08-01'")},
s AS (SELECT *, CAST(greatest(ceil((epoch(ts) - epoch(TIMESTAMP '1995-01-01')) / 5184000.0), 1) - 1 AS BIGINT) AS slice FROM canon)
SELECT slice, count(*) AS replies_cnt, count(DISTINCT (lo_lon, lo_lat, hi_lon, hi_lat)) AS edges_cnt FROM s GROUP BY slice""")
def edges_fixed_interval(spark, sf_dir):
    """Fixed 60-day slices, forward, in one pass: W11."""
    rows = edges.canonical(edges.decoded(edges.between(derived.flights(spark, sf_dir), FIRST, LAST, first=True)))
    age = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit(FIRST).cast("timestamp"))
    per = rows.withColumn("slice", F.greatest(F.ceil(age / F.lit(60.0 * 86400)), F.lit(1)).cast("long") - 1).groupBy("slice", *KEY).agg(F.count("*").alias("w"))
    return per.groupBy("slice").agg(F.sum("w").alias("replies_cnt"), F.count("*").alias("edges_cnt"))


@query(f"WITH {FLIGHTS}, {canonical_sql('flights', "ts >= TIMESTAMP '1995-01-01' AND ts <= TIMESTAMP '2001-08-01'")} SELECT * FROM weighted")
def edges_incremental_merge(spark, sf_dir):
    """A fold of two-year slices equals one scan: A2."""
    source, total = derived.flights(spark, sf_dir), None
    for start, end, _ in slicing.fixed_slices(FIRST, LAST, 730):
        total = edges.merge(total, edges.weighted(edges.between(source, start, end, first=start == FIRST)))
    return total.select(*KEY, "weight")


@query(f"WITH {EDGES}, {ENDS} SELECT CAST((SELECT sum(weight) FROM weighted) AS BIGINT) AS replies_cnt, (SELECT count(*) FROM weighted) AS edges_cnt, (SELECT count(*) FROM (SELECT DISTINCT lon, lat FROM ends)) AS points_cnt")
def counters(spark, sf_dir):
    """A3, A4, A5."""
    return edges.counters(flight_edges(spark, sf_dir))


@query(f"WITH {EDGES}, {ENDS} SELECT DISTINCT lon, lat, 1 AS size FROM ends")
def points_distinct(spark, sf_dir):
    """A9, U2."""
    return edges.endpoints(flight_edges(spark, sf_dir)).withColumn("size", F.lit(1))


HALF = "TIMESTAMP '1998-01-01'"
TWO = f"""WITH {FLIGHTS}, {canonical_sql('flights')},
a AS (SELECT lo_lon, lo_lat, hi_lon, hi_lat, count(*) AS w FROM canon WHERE ts <= {HALF} GROUP BY ALL),
b AS (SELECT lo_lon, lo_lat, hi_lon, hi_lat, count(*) AS w FROM canon WHERE ts > {HALF} GROUP BY ALL)"""


def _two(spark, sf_dir):
    source, half = derived.flights(spark, sf_dir), F.lit(datetime(1998, 1, 1))
    return edges.weighted(source.where(F.col("ts") <= half)), edges.weighted(source.where(F.col("ts") > half))


@query(f"""{TWO} SELECT coalesce(a.lo_lon, b.lo_lon) AS lo_lon, coalesce(a.lo_lat, b.lo_lat) AS lo_lat, coalesce(a.hi_lon, b.hi_lon) AS hi_lon, coalesce(a.hi_lat, b.hi_lat) AS hi_lat,
  coalesce(a.w, 0) + coalesce(b.w, 0) AS weight, a.w IS NULL AS is_new FROM a FULL OUTER JOIN b USING (lo_lon, lo_lat, hi_lon, hi_lat)""")
def leaf_upsert(spark, sf_dir):
    """J7."""
    return edges.upsert_leaves(*_two(spark, sf_dir))


@query(f"{TWO} SELECT lo_lon, lo_lat, hi_lon, hi_lat, w AS weight FROM b ANTI JOIN a USING (lo_lon, lo_lat, hi_lon, hi_lat)")
def known_leaf_antijoin(spark, sf_dir):
    """J6."""
    old, new = _two(spark, sf_dir)
    return edges.unknown(new, old).select(*KEY, "weight")


@query(f"""{TWO}, e AS (SELECT * FROM b), h AS (SELECT * FROM a)
SELECT e.lo_lon AS e_lo_lon, e.lo_lat AS e_lo_lat, e.hi_lon AS e_hi_lon, e.hi_lat AS e_hi_lat, h.lo_lon AS h_lo_lon, h.lo_lat AS h_lo_lat, h.hi_lon AS h_hi_lon, h.hi_lat AS h_hi_lat
FROM e JOIN h ON h.lo_lon BETWEEN e.lo_lon - 0.25 AND e.lo_lon + 0.25 AND (e.lo_lon - h.lo_lon) * (e.lo_lon - h.lo_lon) + (e.lo_lat - h.lo_lat) * (e.lo_lat - h.lo_lat) <= 0.0625
  AND (e.hi_lon - h.hi_lon) * (e.hi_lon - h.hi_lon) + (e.hi_lat - h.hi_lat) * (e.hi_lat - h.hi_lat) <= 0.0625""")
def hyperedge_match(spark, sf_dir):
    """Existing edges whose ends both lie within a radius: J5, P15."""
    old, new = _two(spark, sf_dir)
    return edges.matching(new, old, 0.25)


# Geometry


@query(f"WITH {EDGES}, {ENDS} SELECT DISTINCT lon, lat, round(lon / CAST(360 AS DOUBLE) + 0.5, 6) AS mx, round({my_raw('lat')}, 6) AS my FROM ends")
def mercator_points(spark, sf_dir):
    """F1, F2."""
    return edges.endpoints(flight_edges(spark, sf_dir)).select("lon", "lat", F.round(geo.lng_x("lon"), 6).alias("mx"), F.round(geo.lat_y("lat"), 6).alias("my"))


@query(f"WITH {EDGES}, {ENDS} SELECT DISTINCT lon, lat, round(lon, 6) AS lon_back, round(lat, 6) AS lat_back FROM ends")
def mercator_roundtrip(spark, sf_dir):
    """F3 and F4 undo F1 and F2."""
    return edges.endpoints(flight_edges(spark, sf_dir)).select("lon", "lat", F.round(geo.x_lng(geo.lng_x("lon")), 6).alias("lon_back"), F.round(geo.y_lat(geo.lat_y("lat")), 6).alias("lat_back"))


@query(f"""WITH {EDGES} SELECT lo_lon, lo_lat, hi_lon, hi_lat, round(sqrt((hi_lon - lo_lon) * (hi_lon - lo_lon) + (hi_lat - lo_lat) * (hi_lat - lo_lat)), 6) AS length,
  CASE WHEN hi_lon = lo_lon THEN NULL ELSE round(degrees(atan((hi_lat - lo_lat) / (hi_lon - lo_lon))), 6) END AS degree, round((lo_lon + hi_lon) / 2, 6) AS mid_lon, round((lo_lat + hi_lat) / 2, 6) AS mid_lat,
  CAST(greatest(least(ceil(sqrt(weight)), 15), 1) AS INTEGER) AS width, CAST(greatest(least(ceil(sqrt(weight)), 20), 1) AS INTEGER) AS label FROM weighted""")
def edge_geometry(spark, sf_dir):
    """F5-F9, F21, F22."""
    e = flight_edges(spark, sf_dir)
    mid = lambda a, b: F.round((F.col(a) + F.col(b)) / 2, 6)
    return e.select(*KEY, F.round(geo.guarded_length(*KEY), 6).alias("length"), F.round(geo.degree(*KEY), 6).alias("degree"), mid("lo_lon", "hi_lon").alias("mid_lon"), mid("lo_lat", "hi_lat").alias("mid_lat"), geo.line_width("weight").alias("width"), geo.label_size("weight").alias("label"))


_R = "(((10.0 - lo_lon) * (hi_lon - lo_lon) + (20.0 - lo_lat) * (hi_lat - lo_lat)) / ((hi_lon - lo_lon) * (hi_lon - lo_lon) + (hi_lat - lo_lat) * (hi_lat - lo_lat)))"


@query(f"WITH {EDGES} SELECT lo_lon, lo_lat, hi_lon, hi_lat, round({_R}, 6) AS r, round(lo_lon + {_R} * (hi_lon - lo_lon), 6) AS x, round(lo_lat + {_R} * (hi_lat - lo_lat), 6) AS y FROM weighted")
def nearest_on_edge(spark, sf_dir):
    """The point of every edge's line next to one place: F11."""
    e = flight_edges(spark, sf_dir).withColumn("p", geo.project(F.lit(10.0), F.lit(20.0), *KEY))
    return e.select(*KEY, *[F.round(F.col("p")[c], 6).alias(c) for c in ("r", "x", "y")])


@query(f"""WITH {EDGES}, n AS (SELECT least(weight, 12) AS parts FROM weighted), g AS (SELECT parts, unnest(range(0, parts)) AS place FROM n)
SELECT place, parts, CAST(round(CAST(255 AS FLOAT) * (CAST(place AS FLOAT) / CAST(parts AS FLOAT))) AS INTEGER) AS red, CAST(round((CAST(1 AS FLOAT) - CAST(place AS FLOAT) / CAST(parts AS FLOAT)) * CAST(255 AS FLOAT)) AS INTEGER) AS blue, count(*) AS n FROM g GROUP BY ALL""")
def color_gradient(spark, sf_dir):
    """F19."""
    e = flight_edges(spark, sf_dir).select(F.least("weight", F.lit(12)).alias("parts")).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return e.withColumn("c", geo.gradient("place", "parts")).groupBy("place", "parts", F.col("c")[0].alias("red"), F.col("c")[2].alias("blue")).agg(F.count("*").alias("n"))


@query(f"""WITH {EDGES}, {ENDS}, p AS (SELECT DISTINCT lon, lat FROM ends), g AS (
  SELECT lon, lat, greatest(0, least(CAST(floor((lon + 180) / 0.2) AS BIGINT), 1799)) AS cell_i, greatest(0, least(CAST(floor((lat + 180) / 0.2) AS BIGINT), 1799)) AS cell_j FROM p)
SELECT lon, lat, cell_i, cell_j, cell_j * 1800 + cell_i AS cell FROM g""")
def grid_cells(spark, sf_dir):
    """P13."""
    return viewport.grid(edges.endpoints(flight_edges(spark, sf_dir)), "lon", "lat", -180.0, 0.2, 1800)


GRID = Grid(step=5.0)
GRID_POINTS = f"WITH {EDGES}, {ENDS}, p AS (SELECT DISTINCT lon AS x, lat AS y FROM ends), c(q, qx, qy) AS (VALUES " + ", ".join(f"({i}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for i, (x, y) in enumerate(CENTERS)) + ")"


def _index(spark, sf_dir) -> DataFrame:
    points = GRID.index(edges.endpoints(flight_edges(spark, sf_dir)).toDF("x", "y"))
    return stored(points, f"{shared_dir(spark)}/grid-{uuid.uuid4().hex}")


def _asked(spark) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CENTERS)], "q int, qx double, qy double")


@query(f"{GRID_POINTS} SELECT q, x, y FROM p, c WHERE sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) <= 20")
def grid_within(spark, sf_dir):
    """Places within 20 degrees of each centre; cells inside the circle's square are taken unchecked."""
    return GRID.within(_index(spark, sf_dir), _asked(spark), 20.0).select("q", "x", "y")


@query(f"{GRID_POINTS} SELECT q, x, y FROM p, c WHERE x > qx - 12.5 AND x < qx + 30 AND y > qy - 7.25 AND y < qy + 15")
def grid_range(spark, sf_dir):
    """Places strictly inside a box around each centre."""
    boxes = _asked(spark).select("q", (F.col("qx") - 12.5).alias("x1"), (F.col("qy") - 7.25).alias("y1"), (F.col("qx") + 30).alias("x2"), (F.col("qy") + 15).alias("y2"))
    return GRID.range(_index(spark, sf_dir), boxes).select("q", "x", "y")


@query(f"""{GRID_POINTS}, gone AS (SELECT * FROM p WHERE CAST(floor(x * 100) AS BIGINT) % 3 = 0), asked AS (SELECT CAST(round(x * 100) AS BIGINT) AS q, x, y FROM p WHERE y > 0)
SELECT q, a.x, a.y FROM asked a JOIN p ON a.x = p.x AND a.y = p.y WHERE CAST(floor(a.x * 100) AS BIGINT) % 3 <> 0""")
def grid_delete_find(spark, sf_dir):
    """Of the places in the north, those found after some have been deleted."""
    index = _index(spark, sf_dir)
    left = GRID.delete(index, index.where("cast(floor(x * 100) as bigint) % 3 = 0"))
    return GRID.find(left, index.where("y > 0").select(F.round(F.col("x") * 100).cast("long").alias("q"), "x", "y")).select("q", "x", "y")


# Clusters


def _points(spark, sf_dir):
    return edges.endpoints(flight_edges(spark, sf_dir), distinct=False).groupBy("lon", "lat").agg(F.count("*").alias("n"))


TILES = f"""tp AS (SELECT lon, lat, count(*) AS n FROM ends GROUP BY lon, lat),
tm AS (SELECT {mx_sql('lon')} AS mx, {my_sql('lat')} AS my, n FROM tp),
tz AS (SELECT zoom, mx, my, n, CAST(floor(mx * (512.0 * pow(2, 17) / 40)) AS BIGINT) >> (17 - zoom) AS cell_x, CAST(floor(my * (512.0 * pow(2, 17) / 40)) AS BIGINT) >> (17 - zoom) AS cell_y FROM tm, (SELECT CAST(unnest(range(0, 18)) AS INTEGER) AS zoom)),
tiles AS (SELECT zoom, cell_x, cell_y, round(sum(mx * n) / sum(n), 6) AS mx, round(sum(my * n) / sum(n), 6) AS my, CAST(sum(n) AS BIGINT) AS num_points FROM tz GROUP BY zoom, cell_x, cell_y)"""


@query(f"""WITH {EDGES}, {ENDS}, {TILES} SELECT zoom, cell_x, cell_y, CASE WHEN zoom > 0 THEN cell_x >> 1 END AS parent_x, CASE WHEN zoom > 0 THEN cell_y >> 1 END AS parent_y, mx, my, num_points FROM tiles""")
def tiles_by_zoom(spark, sf_dir):
    """The hierarchy as tiles, an approximation of the greedy one: G2, A8, A10."""
    t = clusters.tiles(_points(spark, sf_dir), RADIUS)
    return t.withColumns({"mx": F.round("mx", 6), "my": F.round("my", 6)})


def cells_sql(zoom: int = ZOOM, radius: float = RADIUS) -> str:
    k = f"(512.0 * {2**zoom} / {radius:g})"
    c = lambda v: f"CAST(floor({v} * {k}) AS BIGINT)"
    return f"""cells AS (SELECT weight, lo_lon, lo_lat, hi_lon, hi_lat, {c(mx_sql('lo_lon'))} AS px, {c(my_sql('lo_lat'))} AS py, {c(mx_sql('hi_lon'))} AS qx, {c(my_sql('hi_lat'))} AS qy FROM weighted),
rolled AS (SELECT CASE WHEN px < qx OR (px = qx AND py <= qy) THEN px ELSE qx END AS ax, CASE WHEN px < qx OR (px = qx AND py <= qy) THEN py ELSE qy END AS ay,
  CASE WHEN px < qx OR (px = qx AND py <= qy) THEN qx ELSE px END AS bx, CASE WHEN px < qx OR (px = qx AND py <= qy) THEN qy ELSE py END AS by_, CAST(sum(weight) AS BIGINT) AS weight FROM cells GROUP BY ALL)"""


@query(f"""WITH {EDGES}, {ENDS}, {TILES} SELECT zoom, count(*) AS tiles, round(40 / (512 * pow(CAST(2 AS DOUBLE), zoom)) * 1000000, 4) AS micro_radius, round(greatest(CAST(0.025 AS DOUBLE) - CAST(0.0025 AS DOUBLE) * zoom, CAST(0.001 AS DOUBLE)), 6) AS step FROM tiles GROUP BY zoom""")
def zoom_settings(spark, sf_dir):
    """Search radius and bundling step of every zoom, beside its number of tiles: F12, F18."""
    steps = F.array(*[F.lit(geo.step_size(z)) for z in range(clusters.MAX_ZOOM + 1)])
    t = clusters.tiles(_points(spark, sf_dir), RADIUS).groupBy("zoom").agg(F.count("*").alias("tiles"))
    return t.select("zoom", "tiles", F.round(geo.zoom_radius(RADIUS, "zoom") * 1000000, 4).alias("micro_radius"), F.round(F.get(steps, F.col("zoom")), 6).alias("step"))


@query(f"WITH {EDGES}, {cells_sql(2)} SELECT least(px * 100000 + py, qx * 100000 + qy) AS a, greatest(px * 100000 + py, qx * 100000 + qy) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM cells GROUP BY 1, 2")
def member_edges(spark, sf_dir):
    """Edges between clusters by a table of members, as any hierarchy has one: J1, A6."""
    e = flight_edges(spark, sf_dir)
    places = edges.endpoints(e).withColumns(clusters.tile_of("lon", "lat", 2, RADIUS, "p"))
    return rollup.to_members(e, places.select("lon", "lat", (F.col("p_x") * 100000 + F.col("p_y")).alias("cluster")))


@query(f"WITH {EDGES}, {cells_sql()} SELECT ax, ay, bx, by_ AS \"by\", weight FROM rolled")
def cluster_edges_zoom(spark, sf_dir):
    """J1, A6."""
    return rollup.to_tiles(flight_edges(spark, sf_dir), ZOOM, RADIUS)


def _classes_sql():
    inside = lambda p: f"({p}_lon BETWEEN -60 AND 60 AND {p}_lat BETWEEN -30 AND 45)"
    return f"v AS (SELECT *, {inside('lo')} AS from_in, {inside('hi')} AS to_in FROM weighted)"


def _named(e):
    return e.select(F.col("lo_lon").alias("from_lon"), F.col("lo_lat").alias("from_lat"), F.col("hi_lon").alias("to_lon"), F.col("hi_lat").alias("to_lat"), "weight")


@query(f"""WITH {EDGES}, {_classes_sql()} SELECT lo_lon AS from_lon, lo_lat AS from_lat, hi_lon AS to_lon, hi_lat AS to_lat, weight, from_in, to_in, CASE WHEN from_in AND to_in THEN 'internal' ELSE 'boundary' END AS edge_class FROM v WHERE from_in OR to_in""")
def viewport_edges(spark, sf_dir):
    """P5, P6, P7."""
    return viewport.edge_classes(_named(flight_edges(spark, sf_dir)), BOX)


def _view(x1, y1, x2, y2):
    f = lambda v: f"CAST({v} AS DOUBLE)"
    return f"(mx > {f(x1)} / 360 + 0.5 AND mx < {f(x2)} / 360 + 0.5 AND my > {my_raw(f(y2))} AND my < {my_raw(f(y1))})"


@query(f"WITH {EDGES}, {ENDS}, {TILES} SELECT cell_x, cell_y, num_points FROM tiles WHERE zoom = 5 AND ({_view(150, -40, 180, 50)} OR {_view(-180, -40, -150, 50)})")
def viewport_wrap(spark, sf_dir):
    """A view across the date line: P8-P11, U1, G10."""
    t = clusters.tiles(_points(spark, sf_dir), RADIUS).withColumns({"mx": F.round("mx", 6), "my": F.round("my", 6)})
    return viewport.clusters_in_view(t, 5, (150.0, -40.0, 210.0, 50.0)).select("cell_x", "cell_y", "num_points")


PLACES = """places AS (SELECT DISTINCT 's' || s_suppkey AS id, CAST((s_suppkey * 7919 + 13) % 36000 AS DOUBLE) / 100 - 180 AS x, CAST((s_suppkey * 6101 + 17) % 17000 AS DOUBLE) / 100 - 85 AS y FROM supplier),
homes AS (SELECT 'c' || c_custkey AS id, CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS x, CAST((c_custkey * 6101) % 17000 AS DOUBLE) / 100 - 85 AS y FROM customer)"""
PAIRS = f"""WITH {PLACES}, pairs AS (SELECT h.id, p.id AS other, sqrt((p.x - h.x) * (p.x - h.x) + (p.y - h.y) * (p.y - h.y)) AS distance, p.x AS x2, p.y AS y2 FROM homes h JOIN places p ON sqrt((p.x - h.x) * (p.x - h.x) + (p.y - h.y) * (p.y - h.y)) <= 10)"""


def _homes_and_places(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), derived.lon("s_suppkey", 13).alias("x"), derived.lat("s_suppkey", 17).alias("y"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("c"), "c_custkey").alias("id"), derived.lon("c_custkey").alias("x"), derived.lat("c_custkey").alias("y"))
    return c, s


@query(f"{PAIRS} SELECT id, other, round(distance, 6) AS distance FROM pairs")
def radius_join(spark, sf_dir):
    """All customers and suppliers within 10 degrees: J3, F12."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return viewport.radius_join(*_homes_and_places(spark, sf_dir), 10.0, tasks).select("id", "other", F.round("distance", 6).alias("distance"))


@query(f"""{PAIRS}, c AS (SELECT *, greatest(0, least(CAST(floor((y2 + 180) / 5.0) AS BIGINT), 71)) * 72 + greatest(0, least(CAST(floor((x2 + 180) / 5.0) AS BIGINT), 71)) AS cell FROM pairs)
SELECT id, cell, other FROM (SELECT *, row_number() OVER (PARTITION BY id, cell ORDER BY distance, other) AS n FROM c) WHERE n = 1""")
def neighbour_per_cell(spark, sf_dir):
    """O1, O2."""
    return viewport.nearest_per_cell(*_homes_and_places(spark, sf_dir), 10.0, -180.0, 5.0, 72)


@query(f"{PAIRS} SELECT id, other AS nearest, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS n FROM pairs) WHERE n = 1")
def nearest_cluster(spark, sf_dir):
    """O3, O4."""
    return viewport.nearest_within(*_homes_and_places(spark, sf_dir), 10.0).withColumn("distance", F.round("distance", 6))


CENTER_ROWS = "centers(k, x, y) AS (VALUES " + ", ".join(f"({i}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for i, (x, y) in enumerate(CENTERS)) + ")"
ASSIGNED = f"""WITH {EDGES}, {ENDS}, {CENTER_ROWS}, places AS (SELECT DISTINCT lon, lat FROM ends),
near AS (SELECT lon, lat, k, (x - lon) * (x - lon) + (y - lat) * (y - lat) AS d2, row_number() OVER (PARTITION BY lon, lat ORDER BY (x - lon) * (x - lon) + (y - lat) * (y - lat), k) AS r FROM places, centers),
assigned AS (SELECT e.lon, e.lat, n.k, n.d2 FROM ends e JOIN near n ON e.lon = n.lon AND e.lat = n.lat WHERE r = 1)"""


def _bag(spark, sf_dir):
    return edges.endpoints(flight_edges(spark, sf_dir), distinct=False)


@query(f"{ASSIGNED} SELECT DISTINCT lon, lat, k, round(d2, 6) AS d2 FROM assigned")
def nearest_center(spark, sf_dir):
    """O5, J2, G16."""
    return clusters.assign(edges.endpoints(flight_edges(spark, sf_dir)), CENTERS).withColumn("d2", F.round("d2", 6))


@query(f"""{ASSIGNED} SELECT c.k, round(coalesce(avg(a.lon), any_value(c.x)), 6) AS lon, round(coalesce(avg(a.lat), any_value(c.y)), 6) AS lat, count(a.k) AS n, round(coalesce(sum(a.d2), 0), 2) AS sse FROM centers c LEFT JOIN assigned a ON a.k = c.k GROUP BY c.k""")
def kmeans_step(spark, sf_dir):
    """One Lloyd step over all ends of distinct edges: A12, A13, U3."""
    return clusters.lloyd_step(_bag(spark, sf_dir), CENTERS).withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6), "sse": F.round("sse", 2)})


@query(f"""{ASSIGNED} SELECT c.k, round((coalesce(sum(a.lon), 0) + any_value(c.x) * 100) / (count(a.k) + 100), 6) AS lon, round((coalesce(sum(a.lat), 0) + any_value(c.y) * 100) / (count(a.k) + 100), 6) AS lat, count(a.k) + 100 AS n FROM centers c LEFT JOIN assigned a ON a.k = c.k GROUP BY c.k""")
def ikmeans_step(spark, sf_dir):
    """One running-mean step from centres of 100 points each: A14."""
    return clusters.running_mean_step(_bag(spark, sf_dir), CENTERS, [100] * 17).withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})


@query(f"""{ASSIGNED}, kk AS (SELECT DISTINCT lon, lat, k FROM near WHERE r = 1)
SELECT CAST(least(p.k, q.k) AS INTEGER) AS a, CAST(greatest(p.k, q.k) AS INTEGER) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM weighted w JOIN kk p ON w.lo_lon = p.lon AND w.lo_lat = p.lat JOIN kk q ON w.hi_lon = q.lon AND w.hi_lat = q.lat GROUP BY 1, 2""")
def kmeans_edge_rollup(spark, sf_dir):
    """A7."""
    return rollup.to_centers(flight_edges(spark, sf_dir), CENTERS)


@query()
def kmeans_full(spark, sf_dir):
    """k = 17, seeded by hash, until the SSE settles."""
    centers, sizes, _ = clusters.kmeans(_bag(spark, sf_dir))
    return spark.createDataFrame([(i, float(x), float(y), int(n)) for i, ((x, y), n) in enumerate(zip(centers, sizes, strict=True))], "k int, lon double, lat double, n long")


@query()
def ikmeans_full(spark, sf_dir):
    """Two-year slices, newest last."""
    model, source = clusters.IncrementalKMeans(), derived.flights(spark, sf_dir)
    for start, end, _ in slicing.fixed_slices(FIRST, LAST, 1200):
        model.add(edges.endpoints(settle(edges.weighted(edges.between(source, start, end, first=start == FIRST))), distinct=False))
    return spark.createDataFrame([(i, float(x), float(y), int(n)) for i, ((x, y), n) in enumerate(zip(model.centers, model.n, strict=True))], "k int, lon double, lat double, n long")


@query()
def hgc_greedy(spark, sf_dir):
    """The greedy hierarchy over all places inserted one by one, zooms 17 to 0: G9."""
    p = _points(spark, sf_dir).withColumn("id", (F.round(F.col("lon") * 100).cast("long") + 18000) * 100000 + F.round(F.col("lat") * 100).cast("long") + 9000)
    return clusters.greedy(p, RADIUS)[0]


@query()
def hgc_pairs(spark, sf_dir):
    """The greedy hierarchy over pairs of all flights, zooms 17 to 0: G3-G8. Clusters with the number of their edges and of the clusters that they hold."""
    return pairs.counted(*pairs.leaves(edges.canonical(edges.decoded(derived.flights(spark, sf_dir)))), RADIUS)


def _targets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Tiles of zoom 1 (id, x, y, n: their links) and their links (id, target)."""
    e = flight_edges(spark, sf_dir).withColumns(clusters.tile_of("lo_lon", "lo_lat", 1, RADIUS, "p") | clusters.tile_of("hi_lon", "hi_lat", 1, RADIUS, "q"))
    a, b = F.col("p_x") * 100000 + F.col("p_y"), F.col("q_x") * 100000 + F.col("q_y")
    t = settle(e.select(a.alias("id"), b.alias("target")).union(e.select(b, a)).distinct())
    c = t.groupBy("id").agg(F.count("*").alias("n")).select("id", "n", F.floor(F.col("id") / 100000).cast("double").alias("x"), (F.col("id") % 100000).cast("double").alias("y"))
    return c, t


@query(f"""WITH {EDGES}, {cells_sql(1)}, t AS (SELECT DISTINCT px * 100000 + py AS id, qx * 100000 + qy AS target FROM cells UNION SELECT DISTINCT qx * 100000 + qy, px * 100000 + py FROM cells),
c AS (SELECT DISTINCT id, CAST(id // 100000 AS DOUBLE) AS x, CAST(id % 100000 AS DOUBLE) AS y FROM t),
s AS (SELECT id, count(*) AS n FROM t GROUP BY id),
i AS (SELECT a.id, b.id AS other, count(*) AS both_ FROM t a JOIN t b ON a.target = b.target AND a.id < b.id GROUP BY 1, 2)
SELECT i.id AS keep, i.other AS drop, round(both_ / CAST(least(s.n, r.n) AS DOUBLE), 6) AS similarity
FROM i JOIN c p ON p.id = i.id JOIN c q ON q.id = i.other JOIN s ON s.id = i.id JOIN s r ON r.id = i.other
WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 2.25 AND both_ / CAST(least(s.n, r.n) AS DOUBLE) > 0.6""")
def shared_targets(spark, sf_dir):
    """Neighbouring clusters that link to mostly the same clusters: J9, G7."""
    c, t = _targets(spark, sf_dir)
    return clusters.absorb_overlaps(c, t, 1.5).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {EDGES}, {cells_sql(1)}, t AS (SELECT DISTINCT px * 100000 + py AS id, qx * 100000 + qy AS target FROM cells UNION SELECT DISTINCT qx * 100000 + qy, px * 100000 + py FROM cells),
c AS (SELECT id, CAST(id // 100000 AS DOUBLE) AS x, CAST(id % 100000 AS DOUBLE) AS y, count(*) AS n FROM t GROUP BY id),
s AS (SELECT id, count(*) AS n FROM t GROUP BY id),
i AS (SELECT a.id, b.id AS other, count(*) AS both_ FROM t a JOIN t b ON a.target = b.target AND a.id < b.id GROUP BY 1, 2),
o AS (SELECT i.id AS a, i.other AS b FROM i JOIN c p ON p.id = i.id JOIN c q ON q.id = i.other JOIN s ON s.id = i.id JOIN s r ON r.id = i.other
  WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 2.25 AND both_ / CAST(least(s.n, r.n) AS DOUBLE) > 0.8),
l AS (SELECT a, b FROM o UNION SELECT b, a FROM o),
w(id, root) AS (SELECT id, id FROM c UNION SELECT l.b, w.root FROM w JOIN l ON l.a = w.id),
k AS (SELECT id, min(root) AS root FROM w GROUP BY id),
m AS (SELECT root AS id, sum(x * n) / sum(n) AS x, sum(y * n) / sum(n) AS y, sum(n) AS n, count(*) AS held FROM k JOIN c USING (id) GROUP BY root),
g AS (SELECT DISTINCT p.root AS id, q.root AS target FROM t JOIN k p ON p.id = t.id JOIN k q ON q.id = t.target WHERE p.root <> q.root)
SELECT m.id, round(x, 6) AS x, round(y, 6) AS y, CAST(n AS BIGINT) AS n, held, (SELECT count(*) FROM g WHERE g.id = m.id) AS targets FROM m""")
def absorb_round(spark, sf_dir):
    """One round of absorption over the tiles of zoom 1: overlapping tiles with over 80 % common targets become one: G7, J9."""
    c, t = _targets(spark, sf_dir)
    over = clusters.absorb_overlaps(c, t, 1.5, 0.8).select(F.col("keep").alias("a"), F.col("drop").alias("b"))
    into = components(over)
    after, linked = clusters.absorb_once(c, t, into)
    held = c.select("id").join(into, "id", "left").groupBy(F.coalesce("component", "id").alias("id")).agg(F.count("*").alias("held"))
    targets = linked.groupBy("id").agg(F.count("*").alias("targets"))
    out = after.join(held, "id").join(targets, "id", "left").fillna({"targets": 0})
    return out.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n", "held", "targets")


def _half_tiles(name: str, where: str) -> str:
    return f"""{name} AS (SELECT CAST(floor(mx * (512.0 * 32 / 40)) AS BIGINT) AS cell_x, CAST(floor(my * (512.0 * 32 / 40)) AS BIGINT) AS cell_y, round(sum(mx * n) / sum(n), 6) AS mx, round(sum(my * n) / sum(n), 6) AS my, sum(n) AS num_points
  FROM (SELECT {mx_sql('lon')} AS mx, {my_sql('lat')} AS my, count(*) AS n FROM (SELECT lo_lon AS lon, lo_lat AS lat FROM (SELECT DISTINCT lo_lon, lo_lat, hi_lon, hi_lat FROM canon WHERE {where}) UNION ALL SELECT hi_lon, hi_lat FROM (SELECT DISTINCT lo_lon, lo_lat, hi_lon, hi_lat FROM canon WHERE {where})) GROUP BY lon, lat) GROUP BY 1, 2)"""


SHIFTS = f"""WITH {FLIGHTS}, {canonical_sql('flights')}, {_half_tiles('old_', f'ts <= {HALF}')}, {_half_tiles('new_', 'true')},
d AS (SELECT n.cell_x, n.cell_y, least(n.num_points, 500) AS n, sqrt((n.mx - o.mx) * (n.mx - o.mx) + (n.my - o.my) * (n.my - o.my)) AS moved FROM new_ n LEFT JOIN old_ o USING (cell_x, cell_y)),
shifts AS (SELECT cell_x, cell_y, moved, coalesce(CASE WHEN n < 30 THEN moved > 0 ELSE moved > n * (1 + n // 100) * 1e-6 END, true) AS shifted FROM d)"""


def _shifts(spark, sf_dir):
    def t(e):
        p = edges.endpoints(e, distinct=False).groupBy("lon", "lat").agg(F.count("*").alias("n"))
        return clusters.tiles(p, RADIUS, 5, 5).withColumns({"mx": F.round("mx", 6), "my": F.round("my", 6)})

    return clusters.shifts(t(_two(spark, sf_dir)[0]), t(flight_edges(spark, sf_dir)))


@query(f"{SHIFTS} SELECT cell_x, cell_y, round(moved, 6) AS moved, shifted FROM shifts")
def shifted_clusters(spark, sf_dir):
    """Clusters that the second half of the data moved: F24."""
    return _shifts(spark, sf_dir).select("cell_x", "cell_y", F.round("moved", 6).alias("moved"), "shifted")


@query(f"""{SHIFTS}, {cells_sql(5)}, m AS (SELECT cell_x, cell_y FROM shifts WHERE shifted)
SELECT ax, ay, bx, by_ AS "by", weight FROM rolled WHERE EXISTS (SELECT 1 FROM m WHERE cell_x = ax AND cell_y = ay) OR EXISTS (SELECT 1 FROM m WHERE cell_x = bx AND cell_y = by_)""")
def moved_leaves(spark, sf_dir):
    """Cluster edges at an end that moved: B8, U4."""
    return edges.moved_leaves(rollup.to_tiles(flight_edges(spark, sf_dir), 5, RADIUS), _shifts(spark, sf_dir).where("shifted")).select("ax", "ay", "bx", "by", "weight")


# Tree cut


def _sides(spark, sf_dir):
    e = flight_edges(spark, sf_dir)
    both = _named(e).unionByName(_named(e.select(F.col("hi_lon").alias("lo_lon"), F.col("hi_lat").alias("lo_lat"), F.col("lo_lon").alias("hi_lon"), F.col("lo_lat").alias("hi_lat"), "weight")))
    rows = both.where(viewport.inside("from_lon", "from_lat", BOX)).withColumn("out", ~viewport.inside("to_lon", "to_lat", BOX))
    rows = rows.withColumns(clusters.tile_of("from_lon", "from_lat", 5, RADIUS, "p") | clusters.tile_of("to_lon", "to_lat", 5, RADIUS, "c"))
    return rows.withColumnsRenamed({"c_x": "cx", "c_y": "cy"})


CUT = f"""WITH {EDGES}, {ENDS}, {TILES}, {cells_sql(5)}, sides AS (
  SELECT lo_lon AS from_lon, lo_lat AS from_lat, hi_lon AS to_lon, hi_lat AS to_lat, px, py, qx AS cx, qy AS cy, weight FROM cells
  UNION ALL SELECT hi_lon, hi_lat, lo_lon, lo_lat, qx, qy, px, py, weight FROM cells),
seen AS (SELECT *, NOT (to_lon BETWEEN -60 AND 60 AND to_lat BETWEEN -30 AND 45) AS out_ FROM sides WHERE from_lon BETWEEN -60 AND 60 AND from_lat BETWEEN -30 AND 45),
z AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS z),
held AS (SELECT DISTINCT z, px >> (5 - z) AS x, py >> (5 - z) AS y FROM seen, z),
ext AS (SELECT DISTINCT cx, cy FROM seen WHERE out_),
common AS (SELECT cx, cy, max(z.z) AS common FROM ext, z WHERE EXISTS (SELECT 1 FROM held h WHERE h.z = z.z AND h.x = cx >> (5 - z.z) AND h.y = cy >> (5 - z.z)) GROUP BY cx, cy),
mapped AS (SELECT ext.cx, ext.cy, CAST(least(coalesce(common + 1, 1), 5) AS INTEGER) AS to_zoom FROM ext LEFT JOIN common USING (cx, cy)),
cut AS (SELECT cx, cy, to_zoom, cx >> (5 - to_zoom) AS to_x, cy >> (5 - to_zoom) AS to_y FROM mapped)"""


@query(f"{CUT} SELECT * FROM cut")
def treecut_map(spark, sf_dir):
    """J8, T1-T3."""
    rows = settle(_sides(spark, sf_dir))
    return treecut.cut(rows.where("out").select("cx", "cy"), rows.select(F.col("p_x").alias("cx"), F.col("p_y").alias("cy")), 5)


@query(f"""{CUT}, cen AS (SELECT zoom, cell_x, cell_y, round((mx - 0.5) * 360, 4) AS lon, round(360 * atan(exp((180 - my * 360) * pi() / 180)) / pi() - 90, 4) AS lat FROM tiles)
SELECT from_lon AS in_lon, from_lat AS in_lat, lon AS out_lon, lat AS out_lat, CAST(sum(weight) AS BIGINT) AS weight FROM seen JOIN cut USING (cx, cy) JOIN cen ON zoom = to_zoom AND cell_x = to_x AND cell_y = to_y
WHERE out_ AND (from_lon - lon) * (from_lon - lon) + (from_lat - lat) * (from_lat - lat) > 0.001 GROUP BY 1, 2, 3, 4""")
def treecut_edges(spark, sf_dir):
    """T4, weights summed."""
    rows = settle(_sides(spark, sf_dir))
    mapping = treecut.cut(rows.where("out").select("cx", "cy"), rows.select(F.col("p_x").alias("cx"), F.col("p_y").alias("cy")), 5)
    t = clusters.tiles(_points(spark, sf_dir), RADIUS).withColumns({"mx": F.round("mx", 6), "my": F.round("my", 6)})
    cen = t.select("zoom", "cell_x", "cell_y", F.round(geo.x_lng("mx"), 4).alias("lon"), F.round(geo.y_lat("my"), 4).alias("lat"))
    return treecut.rewrite(rows.where("out").select(F.col("from_lon").alias("in_lon"), F.col("from_lat").alias("in_lat"), "cx", "cy", "weight"), mapping, cen)


# Bundling


def _cluster_edges(spark, sf_dir, flights=None) -> DataFrame:
    """All flights (or these edges) rolled up to wide tiles of zoom 0, as segments between tile centres."""
    e = rollup.to_tiles(flight_edges(spark, sf_dir) if flights is None else flights, 0, 80.0).withColumn("apart", bound(F.expr("ax != bx or ay != by"))).where("apart")
    at = lambda c: (F.col(c) + F.lit(0.5)) * F.lit(10.0) + F.col(c) * F.col(c) * F.lit(0.125)
    return e.select((F.col("ax") * 1000000 + F.col("ay") * 10000 + F.col("bx") * 100 + F.col("by")).alias("id"), at("ax").alias("fx"), at("ay").alias("fy"), at("bx").alias("tx"), at("by").alias("ty"), "weight")


def _at(c):
    return f"((CAST({c} AS DOUBLE) + 0.5) * 10.0 + CAST({c} AS DOUBLE) * {c} * 0.125)"


def _seen_sql(p, q):
    w = f"(({p}.tx - {p}.fx) * ({p}.tx - {p}.fx) + ({p}.ty - {p}.fy) * ({p}.ty - {p}.fy))"
    r = lambda x, y: f"((({q}.{x} - {p}.fx) * ({p}.tx - {p}.fx) + ({q}.{y} - {p}.fy) * ({p}.ty - {p}.fy)) / {w})"
    r0, r1 = r("fx", "fy"), r("tx", "ty")
    return f"(CASE WHEN {r0} = {r1} THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), 1 - 2 * abs(0.5 - ({r0} + {r1}) / 2) / abs({r1} - {r0})) END)"


COMPAT = f"""WITH {EDGES}, {cells_sql(0, 80.0)},
seg AS (SELECT ax * 1000000 + ay * 10000 + bx * 100 + by_ AS id, {_at('ax')} AS fx, {_at('ay')} AS fy, {_at('bx')} AS tx, {_at('by_')} AS ty, weight FROM rolled WHERE ax <> bx OR ay <> by_),
e AS (SELECT *, sqrt((tx - fx) * (tx - fx) + (ty - fy) * (ty - fy)) AS len FROM seg),
s AS (SELECT p.id AS a, q.id AS b,
  abs(((p.tx - p.fx) * (q.tx - q.fx) + (p.ty - p.fy) * (q.ty - q.fy)) / (p.len * q.len)) AS angle,
  2 / ((p.len + q.len) / 2 / least(p.len, q.len) + greatest(p.len, q.len) / ((p.len + q.len) / 2)) AS scale,
  (p.len + q.len) / 2 / ((p.len + q.len) / 2 + sqrt(((p.fx + p.tx) / 2 - (q.fx + q.tx) / 2) * ((p.fx + p.tx) / 2 - (q.fx + q.tx) / 2) + ((p.fy + p.ty) / 2 - (q.fy + q.ty) / 2) * ((p.fy + p.ty) / 2 - (q.fy + q.ty) / 2))) AS position,
  least({_seen_sql('p', 'q')}, {_seen_sql('q', 'p')}) AS visibility FROM e p JOIN e q ON p.id < q.id)"""


@query(f"{COMPAT} SELECT a, b, round(angle * scale * position * visibility, 6) AS score FROM s WHERE angle * scale * position * visibility > 0.6")
def compat_pairs(spark, sf_dir):
    """Compatible pairs of all rolled-up edges: J4, F13-F17."""
    return bundling.compatible_pairs(settle(_cluster_edges(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query(f"{COMPAT} SELECT a, b, round(angle, 6) AS angle, round(scale, 6) AS scale, round(position, 6) AS position, round(visibility, 6) AS visibility FROM s WHERE angle * scale * position * visibility > 0.6")
def compat_scores(spark, sf_dir):
    """The factors of the compatible pairs."""
    e = settle(_cluster_edges(spark, sf_dir))
    rows = bundling.compatible_pairs(e).select("a", "b").join(e.select(F.col("id").alias("a"), F.struct("fx", "fy", "tx", "ty").alias("p")), "a").join(e.select(F.col("id").alias("b"), F.struct("fx", "fy", "tx", "ty").alias("q")), "b")
    return rows.select("a", "b", *[F.round(f("p", "q"), 6).alias(f.__name__) for f in (compat.angle, compat.scale, compat.position, compat.visibility)])


@query(f"{COMPAT}, m AS (SELECT a AS id FROM s WHERE angle * scale * position * visibility > 0.6 UNION SELECT b FROM s WHERE angle * scale * position * visibility > 0.6) SELECT count(*) AS edges_cnt, count(*) FILTER (WHERE id NOT IN (SELECT id FROM m)) AS isolated_cnt, count(*) FILTER (WHERE id IN (SELECT id FROM m)) AS bundled_cnt FROM e")
def isolated_edges(spark, sf_dir):
    """F25, F26."""
    e = settle(_cluster_edges(spark, sf_dir))
    alone = edges.isolated(e, bundling.compatible_pairs(e)).agg(F.count("*").alias("isolated_cnt"))
    return e.agg(F.count("*").alias("edges_cnt")).crossJoin(alone).select("edges_cnt", "isolated_cnt", (F.col("edges_cnt") - F.col("isolated_cnt")).alias("bundled_cnt"))  # one row each


@query()
def fdeb_segments(spark, sf_dir):
    """B1-B5, B16, A11."""
    e = settle(_cluster_edges(spark, sf_dir))
    return bundling.segments(bundling.fdeb(e, settle(bundling.compatible_pairs(e))))


@query()
def ifdeb_segments(spark, sf_dir):
    """The first half of the time, then all of it, folded into the representative tree."""
    bundler = IncrementalBundler()
    for flights in (_two(spark, sf_dir)[0], None):
        e = settle(_cluster_edges(spark, sf_dir, flights))
        bundler.add(e)
    return bundling.segments(bundler.paths(e))


# Rendering


@query(f"""WITH {EDGES}, r AS (SELECT row_number() OVER (ORDER BY lo_lon, lo_lat, hi_lon, hi_lat) AS id, * FROM weighted)
SELECT lo_lon, lo_lat, hi_lon, hi_lat, half, CASE half WHEN 0 THEN lo_lon ELSE (lo_lon + hi_lon) / 2 END AS x1, CASE half WHEN 0 THEN (lo_lon + hi_lon) / 2 ELSE hi_lon END AS x2, CASE half WHEN 0 THEN 255 ELSE 0 END AS blue,
  CAST(greatest(least(ceil(sqrt(weight)), 15), 1) AS INTEGER) AS width FROM r, (VALUES (0), (1)) h(half)""")
def half_edges_render(spark, sf_dir):
    """F20, R4, B14."""
    e = flight_edges(spark, sf_dir).select(F.struct(*KEY).alias("id"), F.col("lo_lon").alias("fx"), F.col("lo_lat").alias("fy"), F.col("hi_lon").alias("tx"), F.col("hi_lat").alias("ty"), "weight")
    return render.half_edges(e).select("id.*", "half", "x1", "x2", F.col("color")[2].alias("blue"), "width")


@query(f"""WITH {EDGES}, m AS (SELECT *, (lo_lon + hi_lon) / 2 AS mx, (lo_lat + hi_lat) / 2 AS my FROM weighted), h AS (
  SELECT lo_lon AS a, lo_lat AS b, mx AS c, my AS d, weight, '0,0,255' AS color FROM m UNION ALL SELECT mx, my, hi_lon, hi_lat, weight, '255,0,0' FROM m)
SELECT '{{"from":[' || round(a, 3) + CAST(0 AS DOUBLE) || ',' || round(b, 3) + CAST(0 AS DOUBLE) || '],"to":[' || round(c, 3) + CAST(0 AS DOUBLE) || ',' || round(d, 3) + CAST(0 AS DOUBLE) || '],"width":' || CAST(greatest(least(ceil(sqrt(weight)), 15), 1) AS INTEGER) || ',"color":[' || color || ']}}' AS json FROM h""")
def edges_json(spark, sf_dir):
    """Drawn halves as JSON objects; a zero has no sign."""
    e = flight_edges(spark, sf_dir).select(F.lit(0).alias("id"), F.col("lo_lon").alias("fx"), F.col("lo_lat").alias("fy"), F.col("hi_lon").alias("tx"), F.col("hi_lat").alias("ty"), "weight")
    return render.edges_json(render.half_edges(e).withColumns({c: F.round(c, 3) + F.lit(0.0) for c in ("x1", "y1", "x2", "y2")}))


_ID = "((((CAST(round(lo_lon * 100) AS BIGINT) + 18000) * 18000 + CAST(round(lo_lat * 100) AS BIGINT) + 9000) * 36000 + CAST(round(hi_lon * 100) AS BIGINT) + 18000) * 18000 + CAST(round(hi_lat * 100) AS BIGINT) + 9000)"


@query(f"""WITH {EDGES}, r AS (SELECT {_ID} AS id, weight, round(lo_lon / 10) * 10 + CAST(0 AS DOUBLE) AS fx, round(lo_lat / 10) * 10 + CAST(0 AS DOUBLE) AS fy, round(hi_lon / 10) * 10 + CAST(0 AS DOUBLE) AS tx, round(hi_lat / 10) * 10 + CAST(0 AS DOUBLE) AS ty FROM weighted),
h AS (SELECT id, 0 AS place, weight, fx AS a, fy AS b, (fx + tx) / 2 AS c, (fy + ty) / 2 AS d FROM r UNION ALL SELECT id, 1, weight, (fx + tx) / 2, (fy + ty) / 2, tx, ty FROM r),
f AS (SELECT id, place, weight, a < c OR (a = c AND b <= d) AS f, a, b, c, d FROM h)
SELECT CASE WHEN f THEN a ELSE c END AS x1, CASE WHEN f THEN b ELSE d END AS y1, CASE WHEN f THEN c ELSE a END AS x2, CASE WHEN f THEN d ELSE b END AS y2, CAST(sum(weight) AS BIGINT) AS width,
  arg_max(CASE place WHEN 0 THEN 0 ELSE 128 END, CAST(id AS HUGEINT) * 2 + place) AS red FROM f GROUP BY 1, 2, 3, 4""")
def segment_merge(spark, sf_dir):
    """Parts of paths that lie on each other become one segment of their common width: A11, B5."""
    to = lambda c: F.round(F.col(c) / 10) * 10 + F.lit(0.0)
    e = flight_edges(spark, sf_dir).select(F.expr(_ID).alias("id"), "weight", to("lo_lon").alias("fx"), to("lo_lat").alias("fy"), to("hi_lon").alias("tx"), to("hi_lat").alias("ty"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    path = F.array(point(F.col("fx"), F.col("fy")), point((F.col("fx") + F.col("tx")) / 2, (F.col("fy") + F.col("ty")) / 2), point(F.col("tx"), F.col("ty")))
    return bundling.segments(e.select("id", "weight", path.alias("path"))).select("x1", "y1", "x2", "y2", "width", F.col("color")[0].alias("red"))


@query(f"""WITH {EDGES}, {ENDS} SELECT '{{"coordinates":[' || lon || ',' || lat || '],"size":' || count(*) || '}}' AS json FROM ends GROUP BY lon, lat""")
def points_json(spark, sf_dir):
    """R3."""
    return render.points_json(_points(spark, sf_dir).withColumnRenamed("n", "size"))


@query(f"WITH {EDGES}, {ENDS}, n AS (SELECT CAST(row_number() OVER (ORDER BY lon, lat) - 1 AS VARCHAR) AS node, lon, lat FROM (SELECT DISTINCT lon, lat FROM ends)) SELECT a.node AS source, b.node AS target, weight FROM weighted JOIN n a ON lo_lon = a.lon AND lo_lat = a.lat JOIN n b ON hi_lon = b.lon AND hi_lat = b.lat")
def node_edge_export(spark, sf_dir):
    """R6, B15."""
    return render.node_export(settle(flight_edges(spark, sf_dir)))[1]


# Ingest


# Each reply as the feed brings it: a bracket, a comma or nothing around the object, exact places or boxes by turns, some replies
# to a place of their own, and lines that are no replies.
def _feed(spark, sf_dir) -> DataFrame:
    r = derived.replies(spark, sf_dir)
    here = F.col("id") % 7 == 0
    r = r.withColumns({"to_lon": F.when(here, F.col("from_lon")).otherwise(F.col("to_lon")), "to_lat": F.when(here, F.col("from_lat")).otherwise(F.col("to_lat"))})
    exact = lambda s, n: F.when(F.col("id") % n == 0, F.array(f"{s}_lon", f"{s}_lat")).alias(f"{s}_coordinate")
    corner = lambda s, x, y: F.array(F.col(f"{s}_lon") + x, F.col(f"{s}_lat") + y)
    box = lambda s, n: F.when(F.col("id") % n != 0, F.array(corner(s, -1, -2), corner(s, 3, 2))).alias(f"{s}_bounding_box")
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    fields = [F.col("id").alias("tweet_from"), (F.col("id") + 1).alias("tweet_to"), at.alias("from_create_at"), at.alias("to_create_at"), "from_text", "to_text", exact("from", 2), exact("to", 3), box("from", 2), box("to", 3)]
    text = F.to_json(F.struct(F.struct(*fields).alias("ds_tweet_reply_graph")))
    return r.select(F.concat(F.element_at(F.array(F.lit("["), F.lit(","), F.lit("  , "), F.lit("")), (F.col("id") % 4 + 1).cast("int")), text, F.when(F.col("id") % 5 == 0, F.lit("]\n\nnot json")).when(F.col("id") % 5 == 1, F.lit(" ,")).otherwise(F.lit(""))).alias("value"))


@query(f"""WITH {REPLIES}, f AS (SELECT id, ts, from_text, to_text, from_lon, from_lat, CASE WHEN id % 7 = 0 THEN from_lon ELSE to_lon END AS to_lon, CASE WHEN id % 7 = 0 THEN from_lat ELSE to_lat END AS to_lat FROM replies),
p AS (SELECT id AS tweet_from, id + 1 AS tweet_to, ts AS from_create_at, ts AS to_create_at, translate(from_text, chr(10) || '|', '  ') AS from_text, translate(to_text, chr(10) || '|', '  ') AS to_text,
  CASE WHEN id % 2 = 0 THEN from_lon ELSE from_lon + 1 END AS from_longitude, from_lat AS from_latitude, CASE WHEN id % 3 = 0 THEN to_lon ELSE to_lon + 1 END AS to_longitude, to_lat AS to_latitude,
  CASE WHEN id % 6 = 0 THEN 1 WHEN id % 2 = 0 THEN 2 WHEN id % 3 = 0 THEN 3 ELSE 4 END AS status FROM f)
SELECT tweet_from, tweet_to, strftime(from_create_at, '%Y-%m-%d %H:%M:%S') AS from_create_at, strftime(to_create_at, '%Y-%m-%d %H:%M:%S') AS to_create_at, from_text, to_text, status,
  round(from_longitude, 6) AS from_longitude, round(from_latitude, 6) AS from_latitude, round(to_longitude, 6) AS to_longitude, round(to_latitude, 6) AS to_latitude
FROM p WHERE NOT (abs(from_longitude - to_longitude) <= 1e-5 AND abs(from_latitude - to_latitude) <= 1e-5)""")
def ingest_fallback(spark, sf_dir):
    """All replies written as lines of the raw feed, read, repaired and parsed."""
    path = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    _feed(spark, sf_dir).write.text(path)
    rows, at = ingest.read_json(spark, path), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    places = [F.round(c, 6).alias(c) for c in ("from_longitude", "from_latitude", "to_longitude", "to_latitude")]
    return rows.select("tweet_from", "tweet_to", at("from_create_at"), at("to_create_at"), "from_text", "to_text", "status", *places)


@query(f"WITH {REPLIES} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM replies WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05' GROUP BY 1")
def bulk_load_days(spark, sf_dir):
    """Replies loaded into a table by day, of which a slice reads its days only."""
    r, path = derived.replies(spark, sf_dir), f"{shared_dir(spark)}/bulk-{uuid.uuid4().hex}"
    ingest.load_bulk(r.select(F.col("id").alias("tweet_from"), F.col("ts").alias("from_create_at"), "from_text"), path)
    some = spark.read.parquet(path).where("day >= DATE'2024-01-02' AND day < DATE'2024-01-05'")
    return some.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("tweet_from").alias("ids"))


@query(f"""WITH {REPLIES} SELECT CAST(id AS VARCHAR) AS tweet_from, strftime(ts, '%Y-%m-%d %H:%M') AS from_create_at, translate(from_text, chr(10) || '|', '  ') || ' "' || id || '"' AS from_text,
  round(from_lon, 6) AS from_longitude, round(from_lat, 6) AS from_latitude, CAST(id + 1 AS VARCHAR) AS tweet_to, strftime(ts, '%Y-%m-%d %H:%M') AS to_create_at, CASE WHEN id % 3 = 0 THEN NULL ELSE 'a|b "c" ' || id END AS to_text,
  round(to_lon, 6) AS to_longitude, round(to_lat, 6) AS to_latitude FROM replies""")
def csv_round_trip(spark, sf_dir):
    """The ten columns written bar-separated and read back, with quotes, bars and missing texts among them."""
    rows = derived.replies(spark, sf_dir)
    to_text = F.when(F.col("id") % 3 != 0, F.concat(F.lit('a|b "c" '), F.col("id").cast("string")))
    from_text = F.concat(ingest.clean(F.col("from_text")), F.lit(' "'), F.col("id").cast("string"), F.lit('"'))
    rows = rows.select(F.col("id").alias("tweet_from"), F.col("ts").alias("from_create_at"), from_text.alias("from_text"), F.col("from_lon").alias("from_longitude"), F.col("from_lat").alias("from_latitude"), (F.col("id") + 1).alias("tweet_to"), F.col("ts").alias("to_create_at"), to_text.alias("to_text"), F.col("to_lon").alias("to_longitude"), F.col("to_lat").alias("to_latitude"))
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    ingest.write_csv(rows, path)
    back = spark.read.option("sep", "|").option("escape", '"').csv(path).toDF(*ingest.COLUMNS)
    at = lambda c: F.regexp_replace(F.substring(c, 1, 16), "T", " ").alias(c)
    number = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return back.select("tweet_from", at("from_create_at"), "from_text", number("from_longitude"), number("from_latitude"), "tweet_to", at("to_create_at"), "to_text", number("to_longitude"), number("to_latitude"))


# Pacing


@query("""WITH h AS (SELECT CAST(extract(hour FROM ts) AS DOUBLE) + 24 AS r, value + 3 * extract(hour FROM ts) AS a FROM events WHERE value IS NOT NULL), f AS (SELECT regr_intercept(a, r) AS a0, regr_slope(a, r) AS a1 FROM h)
SELECT round(any_value(a0), 4) AS a0, round(any_value(a1), 4) AS a1, round(avg((a0 + a1 * r - a) * (a0 + a1 * r - a)), 3) AS var FROM h, f""")
def drum_regression(spark, sf_dir):
    """A17, A18 over a table of observations."""
    h = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null").select((F.hour("ts") + 24).cast("double").alias("r"), (F.col("value") + 3 * F.hour("ts")).alias("a"))
    f = h.agg(F.regr_intercept("a", "r").alias("a0"), F.regr_slope("a", "r").alias("a1"))
    err = F.col("a0") + F.col("a1") * F.col("r") - F.col("a")
    return h.join(F.broadcast(f)).agg(F.round(F.first("a0"), 4).alias("a0"), F.round(F.first("a1"), 4).alias("a1"), F.round(F.avg(err * err), 3).alias("var"))  # f is one row


@query(f"WITH {FLIGHTS}, {canonical_sql('flights', "ts >= TIMESTAMP '1995-01-01' AND ts <= TIMESTAMP '2001-08-01'")} SELECT CAST(sum(weight) AS BIGINT) AS replies_cnt FROM weighted")
def drum_slices(spark, sf_dir):
    """All slices of the paced query together hold every row once: W1-W10, W12."""
    from flowloom.config import EngineConfig

    total = 0
    for batch, *_ in slicing.progressive(settle(derived.flights(spark, sf_dir)), FIRST, LAST, lambda df: df.count(), EngineConfig(interval_ms=3000, initial_days=400, minimum_days=200)):
        total += batch.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    return spark.createDataFrame([(int(total),)], "replies_cnt long")
