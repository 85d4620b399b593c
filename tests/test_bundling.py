"""Bundling in blocks against one task, bulk insertion into the tree, pruned descent, covers in rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import bundling, store
from flowloom.operators.tree import DESCEND, HIT, Frozen, IncrementalBundler, Tree, cover_in_rounds, score, scores, star_groups

EDGE = "id long, fx double, fy double, tx double, ty double, weight long"


def segments(n, seed, wide=6.0):
    rng = np.random.default_rng(seed)
    return [(i, *map(float, (x, y, x + 5 + u, y + v)), 1 + i % 3) for i, (x, y, u, v) in enumerate(rng.uniform((0, 0, -1, -1), (wide, wide, 1, 1), size=(n, 4)))]


def test_blocks_give_what_one_task_gives(spark):
    """Some 60 edges in one component, in blocks of 7, with fixed segments that pull; every cycle but the last two of the schedule."""
    edges = spark.createDataFrame(segments(60, 1), EDGE)
    pairs = store.settle(bundling.compatible_pairs(edges))
    pulls = spark.createDataFrame([(3, 0.0, 9.0, 5.0, 9.0), (3, 0.0, 8.0, 5.0, 8.0), (4, 1.0, 9.0, 6.0, 9.0)], "id long, fx double, fy double, tx double, ty double")
    found = []
    for block in (1000, 7):
        rows = bundling.fdeb(edges, pairs, 0.025, pulls, block=block, cycles=4, iterations=5).collect()
        assert len(rows) == 60
        found.append({r["id"]: (r["weight"], np.array([(p["x"], p["y"]) for p in r["path"]])) for r in rows})
    bent = 0
    for i, (weight, path) in found[0].items():
        other = found[1][i]
        assert weight == other[0] and path.shape == other[1].shape and np.abs(path - other[1]).max() < 1e-9
        bent += len(path) > 2
    assert bent > 50


def test_no_task_sees_more_than_two_blocks(spark, monkeypatch):
    from flowloom.operators import forces

    seen = spark.sparkContext.accumulator(0)
    unpacked = forces.unpacked

    def counted(column):
        seen.add(len(column) > 10)
        return unpacked(column)

    edges = spark.createDataFrame(segments(40, 2, 2.0), EDGE)
    pairs = store.settle(bundling.compatible_pairs(edges))
    assert pairs.count() > 300
    state = forces.bundle_in_blocks(edges, pairs, None, 0.025, 5, 1, 2)
    monkeypatch.setattr(forces, "unpacked", counted)
    links = spark.createDataFrame([(0, 1, 1, 2)], "t long, s long, a long, b long")
    needs = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "id long, t long, s long")
    assert forces.partial_pulls(state, needs, links).count() == 1 and seen.value == 0


def test_score_matrix():
    """Broadcast scores are those of one pair, and of the formula by projected ends."""
    rng = np.random.default_rng(3)
    p, q = rng.normal(size=(7, 1, 4)), rng.normal(size=(1, 5, 4))
    got = scores(p, q)
    assert got.shape == (7, 5) and all(got[i, j] == pytest.approx(score(p[i, 0], q[0, j])) for i in range(7) for j in range(5))
    assert score((0, 0, 10, 0), (2, 1, 6, 1)) == pytest.approx(0.261729, abs=2e-6) and score((0, 0, 7, 7), (0, 0, 10, 0)) == pytest.approx(0.290751, abs=2e-6)
    assert score((0, 0, 0, 0), (0, 0, 1, 1)) == 0 and score((5, -5, 5, 5), (0, 0, 10, 0)) == 0


def grown(n, cap=400, most=6, seed=4):
    tree, rng = Tree(cap, most), np.random.default_rng(seed)
    for i in range(n):
        x, y, u, v = rng.uniform((0, 0, -3, -3), (9, 9, 3, 3))
        tree.insert((x, y, x + 4 + u, y + v), 1 + i % 2)
    return tree


def test_partners_by_pruned_descent(spark):
    """The same representatives as by scoring every node, for a fraction of the scores."""
    tree, rows = grown(300), segments(50, 9, 9.0)
    frozen = Frozen(tree)
    q = np.array([r[1:5] for r in rows])
    want, order = set(), [*tree.roots]
    for n in order:
        order += n.children
    index = {n.id: i for i, n in enumerate(order)}

    def walk(nodes, i):
        for n in nodes:
            value = score(n.ends, q[i])
            if value > HIT:
                want.add((i, index[n.id]))
            elif value > DESCEND:
                walk(n.children, i)

    for i in range(len(q)):
        walk(tree.roots, i)
    assert set(zip(*map(np.ndarray.tolist, frozen.pulling(q)), strict=True)) == want and want
    assert frozen.scored < len(q) * len(tree.nodes) / 2
    df = spark.createDataFrame(rows, EDGE)
    assert tree.partners(df).groupBy("id").count().agg(F.sum("count")).first()[0] == len(want)
    assert Tree().partners(df).count() == 0


def test_bottom_descent():
    tree = grown(200)
    frozen, q = Frozen(tree), np.array([r[1:5] for r in segments(40, 5, 9.0)])
    at, value = frozen.bottom(q)
    for i, (a, v) in enumerate(zip(at, value, strict=True)):
        node = tree.nodes[int(frozen.ids[a])]
        assert not node.children and v == pytest.approx(score(node.ends, q[i]))
    assert Frozen(Tree()).bottom(q)[0].tolist() == [-1] * 40


def test_bulk_insertion_of_many_lone_edges(spark):
    """100,000 edges without partners and a tree of 300 nodes: the driver sees two rows for each node at most, weights add up, every leaf has its node."""
    e = spark.range(100_000).select("id", (F.col("id") * 1000.0).alias("fx"), F.lit(0.0).alias("fy"), (F.col("id") * 1000.0 + 1 + F.col("id") % 7).alias("tx"), (F.col("id") % 11).cast("double").alias("ty"), (1 + F.col("id") % 2).alias("weight"))
    b = IncrementalBundler(cap=300, most=10)
    assert b.add(e) == {"new": 100_000, "moved": 0}
    assert b.collected <= 2 * (300 + 10) and len(b.tree.nodes) < 310
    assert b.tree.total() == pytest.approx(150_000)
    nodes = {r["node"]: r["w"] for r in b.leaves.groupBy("node").agg(F.sum("weight").alias("w")).collect()}
    assert sum(nodes.values()) == 150_000 and all(not b.tree.nodes[i].children and b.tree.nodes[i].weight == pytest.approx(w) for i, w in nodes.items())
    assert b.leaves.where("not lonely").isEmpty() and b.leaves.count() == 100_000


def test_covers_in_rounds(spark):
    rng = random.Random(7)
    for n, m in ((30, 60), (40, 30), (12, 60)):
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
        ids = sorted({i for p in pairs for i in p})
        want = {i: g[0] for g in star_groups(ids, pairs) for i in g}
        got = {r["id"]: r["leader"] for r in cover_in_rounds(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert want == {i: got.get(i, i) for i in ids}
