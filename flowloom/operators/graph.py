"""Connected components of a link table, by joins only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.store import mark, settle, sweep


#: Rows, at most, that one task goes through. While there are more, rounds of joins do it.
IN_TASK = 20_000


def joined(links: DataFrame) -> DataFrame:
    """components() of at most IN_TASK links, in one task."""

    def run(rows: pa.Table) -> pa.Table:
        up: dict[int, int] = {}

        def root(i):
            while (above := up.setdefault(i, i)) != i:
                up[i] = i = up[above]
            return i

        for a, b in zip(rows["a"].to_pylist(), rows["b"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        ids = list(up)
        return pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array([root(i) for i in ids], pa.int64())})

    return links.groupBy(F.lit(0).alias("all")).applyInArrow(run, "id long, component long")


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> id, component: the smallest id that is reachable, for every id that has a link.

    Few links are one task, without rounds. Else each round takes the least component among an id's neighbours and then jumps to that component's own, so long
    chains shrink geometrically. A round is written to the shared folder; nothing is collected but one count.
    """
    since, links = mark(), links.where("a != b")
    once = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if once.count() <= IN_TASK:
        labels = settle(joined(once))
        sweep(labels.sparkSession, since, labels)
        return labels
    edges = once.union(once.select(F.col("b"), F.col("a")))
    labels = settle(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        around = edges.join(labels.select(F.col("id").alias("b"), F.col("component").alias("l")), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l"))
        pulled = settle(labels.join(around, "id").select("id", F.col("component").alias("was"), F.least("component", "l").alias("component")))
        jump = pulled.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        new = settle(pulled.join(jump, "component", "left").select("id", "was", F.least("component", F.coalesce("beyond", "component")).alias("component")))
        labels = new.select("id", "component")
        if new.where("was != component").isEmpty():
            sweep(new.sparkSession, since, new)
            return labels
        sweep(new.sparkSession, since, new, edges)


def grown(labels: DataFrame, links: DataFrame) -> DataFrame:
    """components() of the links behind `labels` and of these new ones, of which only the components that they join are gone through."""
    at = lambda e: labels.select(F.col("id").alias(e), F.col("component").alias(f"of_{e}"))
    between = links.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left")
    joined = components(between.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    beyond = joined.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
    moved = labels.join(beyond, "component", "left").select("id", F.coalesce("beyond", "component").alias("component"))
    return settle(moved.unionByName(joined.join(labels.select("id"), "id", "left_anti")))
