"""The stemmer against a published vocabulary, the grid index against plain distances, dense ids, hyperedge matches."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.functions import stemmer, text
from flowloom.operators import edges, ranking
from flowloom.plans import catalog
from flowloom.operators.grid import Grid, stored

# Words of the published sample vocabulary with their stems.
STEMS = """consign consign, consigned consign, consigning consign, consignment consign, consist consist, consistency consist, consistently consist, consolation consol, consolatory consolatori,
console consol, consolidate consolid, consolidating consolid, consolingly consol, conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci, conspirator conspir, constable constabl, constancy constanc,
knack knack, knackeries knackeri, knaves knave, knavish knavish, kneaded knead, kneeling kneel, knew knew, knife knife, knightly knight, knights knight, knives knive, knock knock, knots knot, knotted knot,
hopping hop, hoping hope, ties tie, cries cri, gas gas, this this, flies fli, dies die, relational relat, skies sky, bias bias, dying die, inning inning, yes yes, saying say, boys boy, generously generous,
communication communic, electricity electr, nationally nation, luxuriated luxuri, hissing hiss, falling fall, filing file, agreed agre, feed feed, controlling control, bed bed, ox ox, youth youth, x1 x1"""


def test_stems(spark):
    want = dict(p.split() for p in STEMS.replace("\n", " ").split(", "))
    assert {w: stemmer.stem(w) for w in want} == want
    rng = random.Random(2)
    parts = ["gener", "al", "iz", "ing", "ational", "ful", "ness", "li", "y", "e", "s", "ed", "eed", "tt", "ab", "le", "ment", "ion", "st", "ous", "ie", "b", "a", "oy", "ize", "ogi", "ll", "9"]
    words = sorted({"".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(1500)} | set(want))
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", stemmer.stem_column(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == {w: stemmer.stem(w) for w in words}


def test_stemmed_queries(spark):
    df = spark.createDataFrame([("Generalizations were relating",), ("a general relation",), ("dogs",), (None,)], "t string")
    found = lambda q: [r[0] for r in df.select(text.matches(F.col("t"), q)).collect()]
    assert found("general & related") == [True, True, False, False]
    assert found("!dog & the") == [True, True, False, True]


def test_few_words_are_stemmed(spark):
    """Only words that may have a stem of the query are stemmed, and none that has one is left out."""
    rng = random.Random(3)
    parts = ["gener", "al", "iz", "ing", "ational", "ful", "li", "y", "e", "s", "ed", "eed", "tt", "ment", "ion", "ies", "ie", "b", "a", "oy", "ogi", "9"]
    held = sorted({"".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(1500)} | set(stemmer.EXCEPTIONS) | {w.split()[0] for w in STEMS.replace("\n", " ").split(", ")})
    stems = {w: stemmer.stem(w) for w in held}
    for s in {s[:2]: s for s in stems.values()}.values():
        rows = spark.createDataFrame([(w,) for w in held], "w string")
        kept = {r["w"] for r in rows.where(text.may_stem_to(F.col("w"), [s])).collect()}
        assert {w for w in held if stems[w] == s} <= kept and len(kept) < len(held) / 2
    assert all(w in stemmer.EXCEPTIONS or w.startswith(s[:2]) for w, s in stems.items())


@pytest.mark.parametrize("step", [0.7, 5.0, 60.0])
def test_grid_index(spark, tmp_path, step):
    rng = random.Random(6)
    points = [(i, round(rng.uniform(-21, 21), 1), round(rng.uniform(-11, 11), 1)) for i in range(600)]
    g = Grid(-20.0, -10.0, 20.0, 10.0, step)
    index = stored(g.index(spark.createDataFrame(points, "id long, x double, y double")), str(tmp_path / "g"))
    asked = [(0, 0.0, 0.0), (1, 19.5, 9.9), (2, -25.0, 3.0), (3, 3.3, -4.4)]
    got = g.within(index, spark.createDataFrame(asked, "q int, qx double, qy double"), 6.5)
    want = {(q, i) for q, a, b in asked for i, x, y in points if ((x - a) ** 2 + (y - b) ** 2) ** 0.5 <= 6.5}
    assert {(r["q"], r["id"]) for r in got.collect()} == want and got.count() == len(want)
    assert (step > 5) == got.where("whole").isEmpty()
    boxes = [(0, -5.0, -5.0, 5.0, 5.0), (1, 10.0, 0.0, 30.0, 30.0), (2, 1.0, 1.0, 1.0, 4.0), (3, 2.0, 2.0, 1.0, 1.0), (4, -20.0, -10.0, 20.0, 10.0)]
    got = g.range(index, spark.createDataFrame(boxes, "q int, x1 double, y1 double, x2 double, y2 double"))
    assert {(r["q"], r["id"]) for r in got.collect()} == {(q, i) for q, a, b, c, d in boxes for i, x, y in points if a < x < c and b < y < d}
    gone = {(x, y) for i, x, y in points if i % 5 == 0}
    left = g.delete(index, spark.createDataFrame(sorted(gone), "x double, y double"))
    places = [(i, x, y) for i, x, y in points[:50]] + [(99, 0.05, 0.05)]
    found = g.find(left, spark.createDataFrame(places, "q int, x double, y double"))
    assert {(r["q"], r["id"]) for r in found.collect()} == {(q, i) for q, a, b in places for i, x, y in points if (x, y) == (a, b) and (x, y) not in gone}


def test_dense_ids(spark):
    rows = spark.range(5000).select((F.col("id") * 37 % 5000).alias("a"), F.lit("z").alias("_x")).repartition(7)
    got = ranking.dense_ids(rows, "a", name="n")
    assert got.columns == ["a", "_x", "n"] and got.where("a != n").isEmpty() and got.count() == 5000
    assert ranking.dense_ids(rows.limit(0), "a").count() == 0


def test_hyperedges_match_once(spark):
    rng = random.Random(8)
    rows = lambda n: [tuple(round(rng.uniform(0, 3), 2) for _ in range(4)) for _ in range(n)]
    a, b = rows(80), rows(60)
    df = lambda r: spark.createDataFrame(r, ", ".join(f"{c} double" for c in edges.KEY))
    near = lambda p, q, i: (p[i] - q[i]) ** 2 + (p[i + 1] - q[i + 1]) ** 2 <= 0.25
    got = edges.matching(df(a), df(b), 0.5)
    assert sorted(tuple(r) for r in got.collect()) == sorted((*p, *q) for p in a for q in b if near(p, q, 0) and near(p, q, 2))


def test_hyperedges_have_four_copies(spark):
    """Rows that meet: each side has four copies; places below zero, on the borders of cells and exactly a radius apart."""
    at = [-2.0, -1.5, -1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0]
    rng = random.Random(9)
    rows = lambda n: sorted({tuple(rng.choice(at) for _ in range(4)) for _ in range(n)})
    a, b = rows(150), rows(150)
    df = lambda r: spark.createDataFrame(r, ", ".join(f"{c} double" for c in edges.KEY))
    near = lambda p, q, i: (p[i] - q[i]) ** 2 + (p[i + 1] - q[i + 1]) ** 2 <= 0.25
    got = edges.matching(df(a), df(b), 0.5)
    assert sorted(tuple(r) for r in got.collect()) == sorted((*p, *q) for p in a for q in b if near(p, q, 0) and near(p, q, 2))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(array(") == 4 and "explode([-1,0,1])" not in plan


def test_radius_join_in_set_tasks(spark, sf):
    """However few bytes the points are, the cells of the join are dealt to as many tasks as Spark shuffles into."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        found = catalog.QUERIES["radius_join"](spark, sf)
        assert found.rdd.getNumPartitions() == 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
