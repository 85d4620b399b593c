"""Golden vectors, properties and edge cases of the graph engine."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.config import EngineConfig, Request
from flowloom.functions import compat, geo, text
from flowloom.operators import bundling, clusters, edges, kernel, treecut, viewport
from flowloom.operators.tree import IncrementalBundler, Tree, score, star_groups
from flowloom.plans import catalog
from flowloom.sources import derived, ingest
from flowloom.streaming import continuous, slicing


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("lon,lat,x,y,back", [(0, 0, 0.5, 0.5, 0.0), (-118.25, 34.05, 0.17152777777777778, 0.39930090825047676, 34.05), (10, 85.06, 0.5277777777777778, 0.0, 85.05112878), (10, 90, 0.5277777777777778, 0.0, 85.05112878), (10, -90, 0.5277777777777778, 1.0, -85.05112878)])
def test_mercator(spark, lon, lat, x, y, back):
    lon, lat = F.lit(float(lon)), F.lit(float(lat))
    r = one(spark, geo.lng_x(lon).alias("x"), geo.lat_y(lat).alias("y"), geo.y_lat(geo.lat_y(lat)).alias("b"), geo.x_lng(geo.lng_x(lon)).alias("l"))
    assert r["x"] == pytest.approx(x) and r["y"] == pytest.approx(y, abs=1e-12) and r["b"] == pytest.approx(back)


@pytest.mark.parametrize("q,want", [((0, 0, 10, 0), (1, 1, 1, 1)), ((0, 1, 10, 1), (1, 1, 0.909091, 1)), ((2, 1, 6, 1), (1, 0.629213, 0.831926, 0.5)), ((0, 0, 7, 7), (0.707107, 0.994962, 0.723216, 0.571429)), ((5, -5, 5, 5), (0, 1, 1, 0))])
def test_compatibility(spark, q, want):
    seg = lambda v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("fx", "fy", "tx", "ty"), strict=True)])
    df = spark.range(1).select(seg((0, 0, 10, 0)).alias("p"), seg(q).alias("q"))
    r = df.select(*[f("p", "q") for f in (compat.angle, compat.scale, compat.position, compat.visibility)]).first()
    assert [round(v, 6) for v in r] == pytest.approx(list(want), abs=2e-6)


def test_compatible_pairs_lose_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=4) * (3 if i % 2 else 0.4))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, fx double, fy double, tx double, ty double")
    got = {(r["a"], r["b"]) for r in bundling.compatible_pairs(df).collect()}
    p, q = df.select("id", F.struct("fx", "fy", "tx", "ty").alias("p")), df.select(F.col("id").alias("j"), F.struct("fx", "fy", "tx", "ty").alias("q"))
    want = {(r["id"], r["j"]) for r in p.join(q, F.col("id") < F.col("j")).where(compat.score("p", "q") > 0.6).collect()}
    assert got == want and want


def test_edges_are_undirected(spark):
    rows = [(1, 0, 0.0, 0.0, 1.0, 1.0), (2, 1, 1.0, 1.0, 0.0, 0.0), (3, 2, 5.0, 1.0, 5.0, 3.0), (4, 3, 5.0, 3.0, 5.0, 1.0), (5, 4, 0.0, 0.0, 0.03, 0.0), (6, 5, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, s long, from_lon double, from_lat double, to_lon double, to_lat double").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["lo_lon"], r["hi_lat"]): (r["weight"], r["forward"]) for r in edges.weighted(df).collect()}
    assert got == {(0.0, 1.0): (2, True), (5.0, 3.0): (2, True)}


def test_boxes():
    assert viewport.boxes(150, -10, 210, 10) == [(150, -10, 180.0, 10), (-180.0, -10, -150.0, 10)]
    assert viewport.boxes(-200, -100, 200, 95) == [(-180.0, -90.0, 180.0, 90.0)]
    assert viewport.clamp_zoom(40) == 18 and viewport.clamp_zoom(-2) == 0


def test_tiles_conserve_points(spark, sf):
    p = edges.endpoints(edges.weighted(derived.flights(spark, sf)), distinct=False).groupBy("lon", "lat").agg(F.count("*").alias("n"))
    sums = {r["s"] for r in clusters.tiles(p).groupBy("zoom").agg(F.sum("num_points").alias("s")).collect()}
    assert len(sums) == 1


def test_greedy_keeps_its_rule(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), 1) for i, (a, b) in enumerate(rng.uniform(-40, 40, size=(60, 2)))]
    got, members = clusters.greedy(spark.createDataFrame(rows, "id long, lon double, lat double, n long"), 40.0, 3, 3)
    x, y = [a / 360 + 0.5 for _, a, _, _ in rows], [0.5 - 0.25 * math.log((1 + math.sin(math.radians(b))) / (1 - math.sin(math.radians(b)))) / math.pi for _, _, b, _ in rows]
    r, want = 40 / (512 * 8), []
    for i in range(60):
        if all(math.hypot(x[i] - x[j], y[i] - y[j]) > r for j in want):
            want.append(i)
    assert {c["id"] for c in got.collect()} == set(want)
    assert got.agg(F.sum("num_points")).first()[0] == 60 and members.count() == 60


def test_greedy_decides_every_point_or_raises(spark):
    ids = spark.range(6)
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 6)], "id long, other long")
    assert {r["id"]: r["centre"] for r in clusters.first_come(ids, chain).collect()} == {i: i % 2 == 0 for i in range(6)}
    with pytest.raises(RuntimeError):
        clusters.first_come(ids, chain.union(spark.createDataFrame([(4, 5), (3, 4)], "id long, other long"))).count()


def test_greedy_query_has_all_zooms(spark, monkeypatch):
    few = spark.createDataFrame([(i / 8, i / 9, 1) for i in range(9)], "lon double, lat double, n long")
    monkeypatch.setattr(catalog, "_points", lambda spark, sf_dir: few)
    got = {r["zoom"]: r["s"] for r in catalog.QUERIES["hgc_greedy"](spark, "").groupBy("zoom").agg(F.sum("num_points").alias("s")).collect()}
    assert got == dict.fromkeys(range(18), 9)


def test_kmeans_settles_or_raises(spark, monkeypatch):
    line = spark.range(200).select(F.col("id").cast("double").alias("lon"), (F.col("id") % 7).cast("double").alias("lat"))
    with pytest.raises(RuntimeError):
        clusters.kmeans(line, 5, most=2)
    asked = []
    monkeypatch.setattr(catalog, "_bag", lambda spark, sf_dir: line)
    monkeypatch.setattr(clusters, "kmeans", lambda points, *a, **b: asked.append((a, b)) or ([(0.0, 0.0)], [1], [0.0]))
    catalog.QUERIES["kmeans_full"](spark, "")
    assert asked == [((), {})]


def test_kmeans_edges(spark):
    few = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (5.0, 5.0)], "lon double, lat double")
    centers, sizes, history = clusters.kmeans(few, 17)
    assert sorted(sizes) == [1, 2] and history[-1] == pytest.approx(0)
    assert clusters.kmeans(few.limit(0), 3) == ([], [], [])
    tie = clusters.assign(spark.createDataFrame([(0.0, 0.0)], "lon double, lat double"), [(1.0, 0.0), (-1.0, 0.0)]).first()
    assert tie["k"] == 0


def test_kmeans_reads_its_points_once(spark):
    """However many iterations it takes: the points may stand for joins of whole tables."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    line = spark.range(300).select((F.col("id") % 100).cast("double").alias("lon"), (F.col("id") % 7).cast("double").alias("lat"))
    centers, sizes, history = clusters.kmeans(line.mapInArrow(count, line.schema), 5)
    assert seen.value == 300 and sum(sizes) == 300 and len(history) > 2
    (x, y), n = centers[0], sizes[0]
    at = clusters.assign(line, centers).where("k = 0").agg(F.avg("lon"), F.avg("lat"), F.count("*")).first()
    assert (x, y, n) == (pytest.approx(at[0]), pytest.approx(at[1]), at[2])


def test_tree_cut_by_parents(spark):
    parent = {"A": "W", "B": "X", "C": "W", "D": "Y", "E": "X", "F": "X", "G": "Y", "H": "V", "W": "R", "X": "R", "Y": "R", "V": "R"}

    def chain(c):
        out, up = [], 0
        while c:
            out.append((up, c))
            c, up = parent.get(c), up + 1
        return out

    closure = spark.createDataFrame([(i, up, a) for i in "ABCDEFGH" for up, a in chain(i)], "id string, up int, anc string")
    ids = lambda s: spark.createDataFrame([(c,) for c in s], "id string")
    got = {r["id"]: r["target"] for r in treecut.cut_by_parents(ids("EGH"), ids("ABCDF"), closure).collect()}
    assert got == {"E": "E", "G": "G", "H": "V"}


def test_bundling_keeps_ends():
    ends = np.array([[0, 0, 10, 0], [0, 1, 10, 1], [0, 2, 10, 2]], float)
    paths = kernel.bundle(ends, np.array([[0, 1], [1, 2]]))
    assert paths.shape[1] == 66
    assert np.allclose(paths[:, 0], ends[:, :2]) and np.allclose(paths[:, -1], ends[:, 2:])
    assert paths[0, 33, 1] > 0 and paths[2, 33, 1] < 2


def below(node):
    return [node] if not node.children else [x for c in node.children for x in below(c)]


def test_tree_conserves_weight():
    rng = np.random.default_rng(3)
    for cap in (60, 400, 10000):
        tree = Tree(cap=cap, most=6)
        sums = np.zeros(4)
        for i in range(300):
            ends = rng.uniform(0, 10, 4)
            at = tree.insert(ends, 1 + i % 3)
            sums += ends * (1 + i % 3)
            assert not tree.nodes[at].children
        assert tree.total() == pytest.approx(sum(1 + i % 3 for i in range(300)))
        assert len(tree.nodes) < cap + 6 and all(len(n.children) <= 6 for n in tree.nodes.values())
        for node in tree.nodes.values():
            assert node.weight == pytest.approx(sum(x.weight for x in below(node)))
            assert node.ends == pytest.approx(sum(x.ends * x.weight for x in below(node)) / node.weight)
        assert sum(r.ends * r.weight for r in tree.roots) == pytest.approx(sums)
    assert star_groups([1, 2, 3, 4], [(1, 2), (1, 3)]) == [[1, 2, 3], [4]]


def test_tree_takes_the_branch_below_a_weaker_root():
    """The best node lies below a root that is not the best one."""
    tree = Tree(most=2)
    for y in (0.0, 30.0):
        tree.insert((0.0, y, 10.0, y), 1)
    a, b = tree.roots
    far = tree._new((0.0, 5.0, 10.0, 5.0), 1, b)
    b.children = [far]
    wanted = (0.0, 4.9, 10.0, 4.9)
    assert score(a.ends, wanted) > score(b.ends, wanted) and tree.nearest(wanted) is far


def test_fixed_segments_pull():
    from flowloom.operators.kernel import bundle

    ends = np.array([[0.0, 0.0, 10.0, 0.0], [0.0, 50.0, 10.0, 50.0]])
    paths = bundle(ends, np.zeros((0, 2), dtype=int), pulled=np.array([0]), pulls=np.array([[0.0, 1.0, 10.0, 1.0]]))
    assert 0 < paths[0, 33, 1] <= 1.1 and (paths[1, :, 1] == 50).all()
    assert (paths[0, 0] == ends[0, :2]).all() and (paths[0, -1] == ends[0, 2:]).all()


def test_incremental_bundling_step_by_step(spark):
    """Batches of parallel edges: pairs across batches act through representatives, weights add up, moved edges are bundled again."""
    names = "id long, fx double, fy double, tx double, ty double, weight long"
    first = [(i, 0.0, 0.2 * i, 10.0, 0.2 * i, 2) for i in range(4)] + [(9, 80.0, 80.0, 80.0, 85.0, 1)]
    b = IncrementalBundler(most=4)
    assert b.add(spark.createDataFrame(first, names)) == {"new": 5, "moved": 0} and b.tree.total() == 9
    # Edge 20 is alone in its batch, and runs the other way; the representative of the first batch pulls it.
    second = [(i, 0.0, 0.2 * i, 10.0, 0.2 * i, 5) for i in range(4)] + [(20, 10.0, 1.0, 0.0, 1.0, 7)]
    e = spark.createDataFrame(second, names)
    assert b.add(e) == {"new": 1, "moved": 0} and b.tree.total() == 28
    rows = {r["id"]: r for r in b.paths(e).collect()}
    assert set(rows) == {0, 1, 2, 3, 20} and rows[0]["weight"] == 5 and not rows[20]["lonely"]
    middle = rows[20]["path"][len(rows[20]["path"]) // 2]
    assert middle["y"] < 1 and tuple(rows[20]["path"][0]) == (10.0, 1.0)
    assert b.leaves.where("id = 9").first()["lonely"]
    moved = spark.createDataFrame([(0, 0.0, 0.5, 10.0, 0.5, 6)], names)
    assert b.add(moved) == {"new": 0, "moved": 1} and b.tree.total() == 29
    assert tuple(b.paths(moved).first()["path"][0]) == (0.0, 0.5) and b.leaves.count() == 6
    total = sum(r.ends * r.weight for r in b.tree.roots)
    want = np.zeros(4)
    for r in b.leaves.collect():
        side = [r["fx"], r["fy"], r["tx"], r["ty"]] if (r["fx"], r["fy"]) <= (r["tx"], r["ty"]) else [r["tx"], r["ty"], r["fx"], r["fy"]]
        want += np.array(side) * r["weight"]
    assert total == pytest.approx(want)
    assert b.add(spark.createDataFrame([], names)) == {"new": 0, "moved": 0} and b.leaves.count() == 6


def test_drum_golden():
    d = slicing.Drum(45132, 24)
    assert d.estimate(500) == (24, slicing.MAX_MS)
    d.learn(48, slicing.MAX_MS, 100)
    assert d.estimate(900) == (96, slicing.MAX_MS)
    d.learn(96, slicing.MAX_MS, 150)
    assert d.estimate(800) == (192, slicing.MAX_MS)
    d.learn(192, slicing.MAX_MS, 260)
    a0, a1 = slicing.regression(d.history)
    assert (round(a0, 4), round(a1, 6)) == (45.0, 1.116071) and d.estimate(700) == (384, 473)
    d.learn(384, 437, 480)
    assert d.estimate(600) == (490, 599)
    e = slicing.Drum(45132, 24)
    e.history = [(24, slicing.MAX_MS, 60000), (24, slicing.MAX_MS, 61000), (25, slicing.MAX_MS, 64000)]
    assert e.estimate(500) == (24, 61440)


def test_slices_tile_the_range():
    first, last = datetime(2020, 1, 1), datetime(2020, 5, 20)
    parts = list(slicing.fixed_slices(first, last, 60))
    assert parts[0][0] == first and parts[-1][1] == last and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    now = iter(range(10_000))
    got = list(slicing.drum_slices(first, last, lambda s, e: None, clock=lambda: next(now) * 0.01))
    assert got[0][2] == last and got[-1][1] == first and got[-1][3] and all(a[1] == b[2] for a, b in zip(got, got[1:], strict=False))


def test_progressive_equals_scan(spark, sf):
    source = derived.flights(spark, sf)
    total = None
    for batch, *_ in slicing.progressive(source, datetime(1995, 1, 1), datetime(2001, 8, 1), lambda df: None, EngineConfig(fixed_days=900), fixed=True):
        total = edges.merge(total, batch)
    one_scan = edges.weighted(source)
    key = [*edges.KEY, "weight", "forward"]
    assert total.select(key).exceptAll(one_scan.select(key)).count() == 0 and total.count() == one_scan.count()


def test_text(spark):
    rows = [("The cats were running quickly",), ("A dog ran",), (None,), ("Ponies and churches",)]
    df = spark.createDataFrame(rows, "t string")
    hit = lambda q, stemmed=True: [r[0] for r in df.select(text.matches(F.col("t"), q, stemmed)).collect()]
    assert hit("cat & run") == [True, False, False, False]
    assert hit("dog | pony") == [False, True, False, True]
    assert hit("!(cat | dog)") == [False, False, True, True]
    assert hit("the cats", False) == [True, False, False, False]
    words = ["running", "ponies", "classes", "boss", "happily", "stopped", "made", "sky", "bed", "flies"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.stem_column(F.col("w"))).collect()]
    assert got == [text.stem(w) for w in words]
    for bad in ("(a", "a &", "a )"):
        with pytest.raises(ValueError):
            text.parse(bad)


def test_request_is_sticky():
    r = Request().update('{"query": "storm", "zoom": "7", "newQuery": "false"}').update({"radius": "80"}).update("")
    assert (r.query, r.zoom, r.newQuery, r.radius) == ("storm", 7, False, 80.0)


def test_ingest_skips_noise(spark):
    rows = ingest.parse_lines(spark.createDataFrame([("",), ("]",), ("not json",)], "value string"))
    assert rows.count() == 0


def test_bulk_load_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime(2020, 1, 1), "a"), (2, datetime(2020, 1, 2), "b")], "tweet_from long, from_create_at timestamp, from_text string")
    ingest.load_bulk(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("day = '2020-01-02'").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=i), float(i % 3), 0.0, 5.0, float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, from_lon double, from_lat double, to_lon double, to_lat double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = continuous.fold_into(stream, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination()
    got = {tuple(r) for r in continuous.totals(spark, str(tmp_path / "out")).select(*edges.KEY, "weight").collect()}
    assert got == {tuple(r) for r in edges.weighted(df).select(*edges.KEY, "weight").collect()}


def test_stop_words_leave_the_query(spark):
    """Stop words drop out of the tree, with whatever they leave empty; a query of them alone matches nothing."""
    from flowloom.functions import text

    df = spark.createDataFrame([("a dog",), ("red cat",), ("the end",)], "t string")
    found = lambda q: [r["t"] for r in df.where(text.matches(F.col("t"), q)).collect()]
    assert found("the | cat") == found("!the & cat") == found("the cat") == ["red cat"]
    assert found("the") == found("!(the | is)") == []
    assert found("!cat") == ["a dog", "the end"]


def test_factors_from_known_geometry(spark):
    """The factors are the same from the ends alone and from geometry computed once for each edge."""
    rng = np.random.default_rng(4)
    rows = [tuple(map(float, rng.normal(size=4))) for _ in range(20)]
    e = compat.with_geometry(spark.createDataFrame(rows, "fx double, fy double, tx double, ty double"))
    pairs = e.alias("p").crossJoin(e.alias("q"))
    for f in (compat.angle, compat.scale, compat.position, compat.visibility, compat.score):
        assert pairs.where(f("p", "q") != f("p", "q", True)).count() == 0


def test_shared_folder(spark, monkeypatch):
    from flowloom.operators import store

    class Far:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master, getCheckpointDir = "spark://far:7077", staticmethod(lambda: None)

    with pytest.raises(ValueError):
        store.shared_dir(Far)
    Far.sparkContext.getCheckpointDir = staticmethod(lambda: "hdfs://own")
    assert store.shared_dir(Far) == "hdfs://own"
    assert store.shared_dir(spark)


def test_nearest_searches_write_no_pairs(spark, monkeypatch):
    """Same as over all pairs, with ties, copies and places in groups of several parts, while all searched distances stay small."""
    import random

    from flowloom.operators import viewport

    rng = random.Random(7)
    put = lambda p, n, k: spark.createDataFrame([(f"{p}{i}", rng.randrange(-k, k) / 4, rng.randrange(-k, k) / 4) for i in range(n)], "id string, x double, y double")
    a, b = put("a", 150, 100), put("b", 8000, 60)
    pairs = viewport.radius_join(a, b, 10.0).localCheckpoint()
    want = sorted(map(tuple, viewport.nearest(pairs).select("id", "nearest", "distance").collect()))
    cells = sorted(map(tuple, viewport.one_per_cell(pairs, -30.0, 5.0, 9).select("id", "cell", "other").collect()))
    asked, plain = [], viewport.nearest_of
    monkeypatch.setattr(viewport, "nearest_of", lambda s, n, r: asked.append((s.count(), r)) or plain(s, n, r))
    for most in (2048, 16):
        monkeypatch.setattr(viewport, "IN_GROUP", most)
        asked.clear()
        assert sorted(map(tuple, viewport.nearest_within(a, b, 10.0).collect())) == want
        assert asked[0][1] < 10 and asked[-1][0] < 150
        assert sorted(map(tuple, viewport.nearest_per_cell(a, b, 10.0, -30.0, 5.0, 9).collect())) == cells
    assert viewport.nearest_within(a, b.limit(0), 10.0).isEmpty() and viewport.nearest_per_cell(a.limit(0), b, 10.0, -30.0, 5.0, 9).isEmpty()


def test_greedy_in_strips_takes_few_rounds(spark, monkeypatch):
    """A chain of 400 points, each waiting for the one before: one round for each strip, the same centres as by single rounds."""
    monkeypatch.setattr(clusters, "IN_STRIP", 100)
    points = spark.createDataFrame([(i, i / 400) for i in range(400)], "id long, x double")
    chain = spark.createDataFrame([(i, i - d) for i in range(1, 400) for d in (1, 2) if i >= d], "id long, other long")
    rounds, plain = [], clusters.settle
    monkeypatch.setattr(clusters, "settle", lambda df: rounds.append(1) or plain(df))
    assert {r["id"]: r["centre"] for r in clusters.first_in_strips(points, chain).collect()} == {i: i % 3 == 0 for i in range(400)}
    assert len(rounds) <= 5
    with pytest.raises(RuntimeError):
        clusters.first_in_strips(points, spark.createDataFrame([(1, 2), (2, 1)], "id long, other long")).count()
