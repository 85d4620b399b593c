"""The colour of merged segments: that of the part with the greatest id, then place; found by hashing."""

from pyspark.sql import functions as F

from flowloom.operators import bundling


def test_segments_are_hashed_not_sorted(spark):
    """Ids below zero and at both ends of a long, one edge that runs over a segment twice, edges of different numbers of parts."""
    low, high = -(2**63), 2**63 - 1
    line, there, back = [(0, 0), (1, 0), (2, 0)], [(0, 0), (1, 0)], [(0, 0), (1, 0), (0, 0), (1, 0), (1, 1)]
    held = [(low, 1, line), (-5, 2, there), (-4, 3, back), (7, 4, [(5, 5), (6, 5), (7, 5), (8, 5)]), (high, 5, [(9, 9), (6, 5), (7, 5)])]
    rows = [(i, w, [(float(x), float(y)) for x, y in path]) for i, w, path in held]
    found = bundling.segments(spark.createDataFrame(rows, f"id long, weight long, path {bundling.PATH}"))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, w, path in held:
        for at, (p, q) in enumerate(zip(path, path[1:])):
            width, most = want.get(key := (*min(p, q), *max(p, q)), (0, (low, -1, 0)))
            want[key] = (width + w, max(most, (i, at, len(path) - 1)))
    colors = spark.createDataFrame([(*most[1:], *map(float, key), width) for key, (width, most) in want.items()], "at int, parts int, x1 double, y1 double, x2 double, y2 double, width long")
    colors = colors.select("x1", "y1", "x2", "y2", "width", bundling.gradient("at", "parts").alias("color"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, colors.collect())) and len(want) == found.select(F.col("x1")).count()
