"""The hierarchy over pairs against one pair after the other, its branches, and absorption."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import clusters, pairs


def one_after_the_other(now, items, singles, r):
    """A level by the rules of the docstring. now: id -> (x, y, n); items: [(order, a, b)]; singles: [(order, id)]."""
    d = lambda p, q: math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2)
    parent, centres, edges = {}, {}, {}

    def near(i, reach):
        return sorted((d(now[i], at), c) for c, at in centres.items() if d(now[i], at) <= reach)

    def link(a, b, o):
        p, q = parent[a], parent[b]
        if p != q:
            edges.setdefault((min(p, q), max(p, q)), o)

    queue = sorted([(o, 0, a, b) for o, a, b in items] + [(o, 1, i, i) for o, i in singles])
    branches = set()
    for o, alone, a, b in queue:
        if alone:
            found = near(a, r)
            parent[a] = found[0][1] if found else a
            if not found:
                centres[a] = now[a][:2]
            continue
        fresh = [i for i in (a, b) if i not in parent]
        if fresh and d(now[a], now[b]) <= r:
            if len(fresh) == 2:
                low, high = sorted((a, b))
                n = now[low][2] + now[high][2]
                centres[low] = tuple((now[low][i] * now[low][2] + now[high][i] * now[high][2]) / n for i in (0, 1))
                parent[a] = parent[b] = low
                branches.add("merge")
            else:
                parent[fresh[0]] = parent[b if fresh[0] == a else a]
                branches.add("follow")
        else:
            found = {i: near(i, 2 * r) for i in fresh}
            for i in fresh:
                if not found[i]:
                    parent[i] = i
            options = {i: [(0.0, parent[i])] if i in parent else found[i] for i in (a, b)}
            hits = [(edges[key], da + db, ca, cb) for da, ca in options[a] for db, cb in options[b] if ca != cb and (key := (min(ca, cb), max(ca, cb))) in edges]
            branches.add({2: "new pair", 1: "one side"}.get(sum(not found[i] for i in fresh), "joined" if fresh else "edge only"))
            if hits and any(i not in parent for i in fresh):
                _, _, ca, cb = min(hits)
                branches.add("oldest edge")
            else:
                ca, cb = min(options[a])[1], min(options[b])[1]
            for i, c in ((a, ca), (b, cb)):
                parent.setdefault(i, c)
            for i in fresh:
                if not found[i]:
                    centres[i] = now[i][:2]
        link(a, b, o)
    return parent, edges, branches


def fixture(n, seed, spread):
    rng = random.Random(seed)
    places = [(i, 0.5 + rng.gauss(0, spread), 0.5 + rng.gauss(0, spread), 1) for i in range(n // 2)]
    links = {tuple(sorted(rng.sample(range(n // 2), 2))) for _ in range(n)}
    return places, sorted(links)


def by_hand(spark, places, links, zooms, radius):
    """Levels of the sequential form: parents, edges and branches of each zoom."""
    df = spark.createDataFrame(links, "a long, b long").select(pairs.order_of(F.col("a"), F.col("b")).alias("o"), "a", "b")
    items = [(tuple(r["o"]), r["a"], r["b"]) for r in df.collect()]
    held = {i for _, a, b in items for i in (a, b)}
    now, singles, out = {i: (x, y, n) for i, x, y, n in places if i in held}, [], []
    for zoom in zooms:
        parent, edges, branches = one_after_the_other(now, items, singles, radius / (512.0 * 2**zoom))
        first = {}
        for o, *ends in [*items, *singles]:
            for i in ends:
                first[i] = min(first.get(i, o), o)
        up = {}
        for i, p in parent.items():
            x, y, n = now[i]
            was = up.get(p, (0.0, 0.0, 0, first[i]))
            up[p] = (was[0] + x * n, was[1] + y * n, was[2] + n, min(was[3], first[i]))
        now = {p: (x / n, y / n, n) for p, (x, y, n, _) in up.items()}
        items = [(o, a, b) for (a, b), o in edges.items()]
        paired = {i for _, a, b in items for i in (a, b)}
        singles = [(up[p][3], p) for p in now if p not in paired]
        out.append((zoom, parent, set(edges), branches, now))
    return df, out


@pytest.mark.parametrize("n,seed,spread,zooms", [(500, 3, 0.1, range(2, -1, -1))])
def test_same_as_one_pair_after_the_other(spark, n, seed, spread, zooms):
    places, links = fixture(n, seed, spread)
    df, want = by_hand(spark, places, links, zooms, 40.0)
    got, members, edges = pairs.hierarchy(spark.createDataFrame(places, "id long, x double, y double, n long"), df, 40.0, zooms[-1], zooms[0], None)
    parents, links_at, weights = {}, {}, {}
    for r in members.collect():
        parents.setdefault(r["zoom"], {})[r["child"]] = r["parent"]
    for r in edges.collect():
        links_at.setdefault(r["zoom"], set()).add((r["a"], r["b"]))
    for r in got.collect():
        weights.setdefault(r["zoom"], {})[r["id"]] = (r["mx"], r["my"], r["num_points"])
    seen = set()
    for zoom, parent, between, branches, now in want:
        assert parents[zoom] == parent, zoom
        assert links_at.get(zoom, set()) == between
        assert {i: v[2] for i, v in weights[zoom].items()} == {i: v[2] for i, v in now.items()}
        assert all(v[:2] == pytest.approx(now[i][:2]) for i, v in weights[zoom].items())
        seen |= branches
    assert seen == {"merge", "follow", "new pair", "one side", "joined", "edge only", "oldest edge"}


def test_absorption_runs_until_nothing_overlaps(spark):
    """1 and 2 share 2 of 3 targets; only together with 2 does 3 share enough with 1; 4 is out of reach, 5 points elsewhere."""
    c = spark.createDataFrame([(1, 0.0, 0.0, 1), (2, 0.1, 0.0, 1), (3, 0.2, 0.0, 2), (4, 9.0, 9.0, 1), (5, 0.1, 0.1, 1), *((i, 50.0 + i, 0.0, 1) for i in range(10, 16))], "id long, x double, y double, n long")
    t = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (2, 11), (2, 13), (3, 12), (3, 13), (3, 14), (4, 10), (4, 11), (5, 15)], "id long, target long")
    once = {(r["keep"], r["drop"]) for r in clusters.absorb_overlaps(c, t, 1.0).collect()}
    assert once == {(1, 2)}
    left, kept = clusters.absorb(c, t, 1.0)
    assert {r["id"]: r["kept"] for r in kept.collect()} == {1: 1, 2: 1, 3: 1}
    rows = {r["id"]: r for r in left.collect()}
    assert set(rows) == {1, 4, 5, *range(10, 16)} and rows[1]["n"] == 4 and rows[1]["x"] == pytest.approx(0.125)
    assert clusters.absorb(c.where("id > 3"), t.where("id > 3"), 1.0)[1] is None


def test_a_level_absorbs(spark):
    """2 goes into 1: members, edges and weights follow; the edge between them is gone, and of two equal edges the older place stays."""
    o = lambda h: (h, 0, 0)
    kind = "struct<h:long,p:long,q:long>"
    members = spark.createDataFrame([(11, 1, o(5)), (12, 2, o(3)), (13, 3, o(4))], f"id long, parent long, o {kind}")
    edges = spark.createDataFrame([(1, 3, o(9)), (2, 3, o(7)), (1, 2, o(1))], f"lo long, hi long, t {kind}")
    up = spark.createDataFrame([(1, 0.0, 0.0, 1, o(5)), (2, 0.3, 0.0, 2, o(3)), (3, 5.0, 0.0, 1, o(4))], f"id long, x double, y double, n long, o {kind}")
    m, e, u = pairs.absorbed(members, edges, up, 1.0, 0.4)
    assert {(r["id"], r["parent"]) for r in m.collect()} == {(11, 1), (12, 1), (13, 3)}
    assert [(r["lo"], r["hi"], r["t"]["h"]) for r in e.collect()] == [(1, 3, 7)]
    assert {(r["id"], round(r["x"], 6), r["n"], r["o"]["h"]) for r in u.collect()} == {(1, 0.2, 3, 3), (3, 5.0, 1, 4)}


def test_hierarchy_of_places(spark, sf):
    """Weights add up at every zoom, every parent exists, nothing is left to absorb; places without a pair are left out."""
    from flowloom.operators import edges as e
    from flowloom.sources import derived

    places, links = pairs.leaves(e.weighted(derived.flights(spark, sf)).where("lo_lon < -60"))
    got, members, between = pairs.hierarchy(places, links, 40.0, 2, 3)
    held = places.join(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), "id").agg(F.sum("n")).first()[0]
    assert {r["s"] for r in got.groupBy("zoom").agg(F.sum("num_points").alias("s")).collect()} == {held}
    assert members.join(got.select("zoom", F.col("id").alias("parent")), ["zoom", "parent"], "left_anti").isEmpty()
    for z in (3, 2):
        c, t = got.where(F.col("zoom") == z), between.where(F.col("zoom") == z)
        t = t.select(F.col("a").alias("id"), F.col("b").alias("target")).union(t.select("b", "a"))
        assert clusters.absorb_overlaps(c.select("id", F.col("mx").alias("x"), F.col("my").alias("y")), t, 40.0 / (512 * 2**z)).isEmpty()
    assert [x.count() for x in pairs.hierarchy(places.limit(0), links.limit(0), 40.0, 2, 3)] == [0, 0, 0]


def test_levels_of_places_far_apart_write_nothing(spark, monkeypatch):
    """Nine zooms at which no two places are near repeat the finest one: they cost no tables, and the coarser ones are the same."""
    written = []
    monkeypatch.setattr(pairs, "settle", lambda df, f=pairs.settle: written.append(1) or f(df))
    places = spark.createDataFrame([(i, 0.1 * i, 0.5, 1) for i in range(9)], "id long, x double, y double, n long")
    links = spark.createDataFrame([(5, 1), (1, 8), (2, 3)], "a long, b long").select(pairs.order_of(F.col("a"), F.col("b")).alias("o"), "a", "b")
    got, members, edges = pairs.hierarchy(places, links, 40.0, 9, 17)
    assert len(written) == 3
    assert {(r["zoom"], r["child"], r["parent"]) for r in members.collect()} == {(z, i, i) for z in range(9, 18) for i in (1, 2, 3, 5, 8)}
    assert {(r["zoom"], r["a"], r["b"]) for r in edges.collect()} == {(z, *e) for z in range(9, 18) for e in ((1, 5), (1, 8), (2, 3))}
    assert {(r["zoom"], r["id"], r["num_points"]) for r in got.collect()} == {(z, i, 1) for z in range(9, 18) for i in (1, 2, 3, 5, 8)}


@pytest.mark.parametrize("most", [0, 60])
def test_centres_in_rounds_and_in_one_task(spark, monkeypatch, most):
    """The same centres as one site after the other, by rounds alone and with the last ones in one task; sites of one place in the order don't cover each other."""
    monkeypatch.setattr(pairs, "IN_TASK", most)
    rng = random.Random(7)
    rows = [(i, rng.random(), rng.random(), (rng.randrange(150), 0, 0), rng.choice((0.05, 0.1)), i % 9 == 0) for i in range(300)]
    sites = spark.createDataFrame(rows, "id long, x double, y double, o struct<h:long,p:long,q:long>, reach double, fixed boolean").withColumns(pairs.cells(0.05))
    want = {}
    for i, x, y, o, reach, fixed in sorted(rows, key=lambda s: s[3]):
        if fixed or not any(p < o and math.hypot(x - u, y - v) <= reach for u, v, p in want.values()):
            want[i] = (x, y, o)
    assert {r["id"] for r in pairs.first_centres(sites).collect()} == set(want)


def levels_by_rounds(spark, monkeypatch, most, at_hand):
    monkeypatch.setattr(pairs, "IN_TASK", most)
    monkeypatch.setattr(pairs, "AT_HAND", at_hand)
    places, links = fixture(160, 5, 0.1)
    df, want = by_hand(spark, places, links, [2, 1], 40.0)
    _, members, edges = pairs.hierarchy(spark.createDataFrame(places, "id long, x double, y double, n long"), df, 40.0, 1, 2, None)
    assert {(r["zoom"], r["child"], r["parent"]) for r in members.collect()} == {(z, i, p) for z, parent, *_ in want for i, p in parent.items()}
    assert {(r["zoom"], r["a"], r["b"]) for r in edges.collect()} == {(z, *e) for z, _, between, *_ in want for e in between}


def test_pairs_in_rounds_of_joins(spark, monkeypatch):
    """The same levels when nothing is decided in one task and no table of clusters is broadcast by name."""
    levels_by_rounds(spark, monkeypatch, 0, 0)


def test_a_level_decides_few_pairs_in_one_task(spark, monkeypatch):
    """What places the clusters of a small level is one task: it costs no table for each round."""
    placed = []
    monkeypatch.setattr(pairs, "placed_in_order", lambda *a, f=pairs.placed_in_order: placed.append(1) or f(*a))
    levels_by_rounds(spark, monkeypatch, 1000, 1000)
    assert len(placed) == 2


def test_zooms_at_which_nothing_is_near_are_found_by_halving(spark, monkeypatch):
    """Eighteen zooms, nothing near before zoom 3: six looks at the clusters, not one for each zoom; a look that ends at the coarsest zoom goes no further."""
    looks = []
    monkeypatch.setattr(pairs, "apart", lambda c, r, f=pairs.apart: looks.append(r) or f(c, r))
    near = 40.0 / (512 * 2**3) * 2
    own = spark.createDataFrame([(1, 0.1, 0.5), (2, 0.1 + near * 0.9, 0.5), (3, 0.9, 0.9)], "id long, x double, y double")
    assert pairs.still(own, 17, 0, 40.0) == list(range(17, 3, -1)) and len(looks) <= 6
    assert pairs.still(own, 3, 0, 40.0) == [] and pairs.still(own, 17, 9, 40.0) == list(range(17, 8, -1))


def test_pairs_carried_to_parents(spark):
    """1 and 2 become 1, 7 becomes 6 alone: pairs that meet keep the earliest place, the others stay, inner ones go; however many clusters there are."""
    items = spark.createDataFrame([(9, 1, 3), (4, 2, 3), (5, 1, 2), (6, 3, 4), (7, 4, 7), (8, 2, 7)], "o long, a long, b long")
    to = spark.createDataFrame([(1, 1), (2, 1), (7, 6), (3, 3), (4, 4)], "id long, parent long")
    for n in (4, 100):
        assert {tuple(r) for r in pairs.carried(items, to, n).collect()} == {(1, 3, 4), (3, 4, 6), (4, 6, 7), (1, 6, 8)}


def test_numbers_keep_the_order(spark):
    rng = random.Random(2)
    rows = [((rng.randrange(-3, 3), rng.randrange(5), i), i, i + 1) for i in range(200)]
    got = pairs.numbered(spark.createDataFrame(rows, "o struct<h:long,p:long,q:long>, a long, b long").repartition(7)).collect()
    assert [r["a"] for r in sorted(got, key=lambda r: r["o"])] == [a for _, a, _ in sorted(rows)] and len({r["o"] for r in got}) == 200


def test_overlaps_of_few_and_many_targets(spark):
    """The share is of the smaller set, whichever id has it, repeated targets count once, and targets of clusters out of reach don't matter."""
    c = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 9.0, 9.0), (4, 9.5, 9.0), (5, 50.0, 0.0)], "id long, x double, y double")
    t = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (2, 11), (2, 12), (2, 13), (3, 20), (3, 21), (3, 22), (4, 20), (4, 20), (5, 20), (5, 10)], "id long, target long")
    assert {tuple(r) for r in clusters.absorb_overlaps(c, t, 1.0).collect()} == {(1, 2, 1.0), (3, 4, 1.0)}
