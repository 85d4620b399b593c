"""The greedy hierarchy over pairs: both ends of an edge are inserted together, so that clusters follow the edges between them.

Levels are done one after the other, from the finest zoom up. What a level inserts, in the order of a hash, is pairs of clusters of the level
before (at first the edges between places) and single clusters. With r the radius of the zoom, a pair

* merges into one cluster if its ends lie within r of each other, and goes on as a single one;
* joins the oldest edge of this zoom with an end within 2r of either of its ends;
* opens two clusters and an edge between them if neither end has a cluster within 2r;
* joins the nearest clusters if both have one;
* is attached by one side if one end has a cluster or has been placed by an earlier pair: that end joins, the other opens a cluster of its own, with an
  edge between both, at this zoom and the ones above, until it finds a neighbour there.

A single cluster joins its nearest cluster within r, or stays one by itself. A cluster that several pairs share is placed by the first of them;
the later ones only add their edge. Positions are those of the level before; centroids follow when the level is done, so both chains of
ancestors are sums over members.

Distributed, with the same result as one pair after the other: a pair waits only for earlier ones that could change its outcome.
Which ends open clusters depends on places alone: the earliest undecided site of a cell of diameter 2r opens one if no cell around has an earlier one,
and everything in reach of it is decided with it. Which edge a pair joins depends on edges between the few clusters in its reach; it is decided
once the oldest known one is older than every undecided pair that might found another. The order is hashed, so chains of waiting pairs stay short.
No neighbourhood is expanded into pairs of places: sites meet clusters, of which a cell holds few.

Pairs are far more than places. So a level goes through all of them three times: for each cluster's first pair, for the few that may found an edge before the last
pair that could join it, and to carry them over to the clusters of the level. Their place in the order is a number, and what a pass needs of the clusters
is broadcast while they are at most AT_HAND.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.clusters import MAX_ZOOM, absorb, mercator
from flowloom.operators.store import mark, settle, sweep
from flowloom.operators.viewport import distance


#: Rows, at most, that one task goes through. While there are more, rounds of joins do it.
IN_TASK = 100_000
#: Rows, at most, of a table of clusters that is broadcast to the tasks which go through the pairs.
AT_HAND = 2_000_000


def order_of(a: Column, b: Column) -> Column:
    """Place in the order of insertion: a hash of both ids, then the ids."""
    return F.struct(F.xxhash64(a, b).alias("h"), a.alias("p"), b.alias("q"))


def cells(r: float) -> dict:
    """Columns ci, cj of cells of side 2r: what lies within 2r is in a cell or in one beside it."""
    side = F.lit(2 * r)
    return {"ci": F.floor(F.col("x") / side).cast("long"), "cj": F.floor(F.col("y") / side).cast("long")}


def spread(rows: DataFrame) -> DataFrame:
    """Each row once for each of the 3 x 3 cells around its own."""
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    far = rows.withColumn("_i", around).withColumn("_j", around)
    return far.withColumns({"ci": F.col("ci") + F.col("_i"), "cj": F.col("cj") + F.col("_j")}).drop("_i", "_j")


def at_hand(clusters: DataFrame, n: int) -> DataFrame:
    """A settled table of n clusters, to be joined to pairs."""
    return F.broadcast(clusters) if n <= AT_HAND else clusters


def in_reach(sites: DataFrame, centres: DataFrame) -> DataFrame:
    """sites(id, x, y, o, reach, ci, cj) beside the earlier centres in their reach: id, centre, distance."""
    near = spread(centres.select(F.col("id").alias("centre"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("o").alias("o2"), "ci", "cj"))
    both = sites.join(near, ["ci", "cj"]).withColumn("distance", distance("x", "y", "x2", "y2"))
    return both.where((F.col("o2") < F.col("o")) & (F.col("distance") <= F.col("reach"))).select("id", "centre", "distance")


def decided(open_: DataFrame) -> DataFrame:
    """Those of at most IN_TASK sites that become centres, one after the other in one task."""

    def run(rows: pa.Table) -> pa.Table:
        side, centres, kept = max(rows["reach"].to_pylist()), {}, []
        plain = lambda o: tuple(o.values()) if isinstance(o, dict) else o
        sites = sorted((plain(o), i, x, y, reach) for i, x, y, o, reach in zip(*(rows[c].to_pylist() for c in ("id", "x", "y", "o", "reach")), strict=True))
        for o, i, x, y, reach in sites:
            ci, cj = math.floor(x / side), math.floor(y / side)
            near = (c for a in (-1, 0, 1) for b in (-1, 0, 1) for c in centres.get((ci + a, cj + b), ()))
            if not any(p < o and math.sqrt((x - u) * (x - u) + (y - v) * (y - v)) <= reach for p, u, v in near):
                centres.setdefault((ci, cj), []).append((o, x, y))
                kept.append(i)
        return pa.table({"id": pa.array(kept, pa.int64())})

    return open_.join(open_.groupBy(F.lit(0).alias("all")).applyInArrow(run, "id long"), "id", "left_semi")


def first_centres(sites: DataFrame) -> DataFrame:
    """sites(id, x, y, o, reach, fixed, ci, cj) -> those that become centres: the fixed ones, and every one without an earlier centre in its reach.

    While more than IN_TASK sites are undecided, all cells decide in rounds; one task decides the rest in their order.
    """
    new, open_, found = sites.where("fixed"), sites.where("NOT fixed"), []
    while True:
        found.append(new)
        open_ = settle(open_.join(in_reach(open_, new).select("id").distinct(), "id", "left_anti"))
        left = open_.count()
        if left <= IN_TASK:
            return reduce(DataFrame.unionByName, [*found, settle(decided(open_))] if left else found)
        least = spread(open_.groupBy("ci", "cj").agg(F.min("o").alias("least"))).groupBy("ci", "cj").agg(F.min("least").alias("least"))
        new = settle(open_.join(least, ["ci", "cj"]).where("o <= least").select(sites.columns))
        open_ = open_.join(new.select("id"), "id", "left_anti")


def apart(clusters: DataFrame, r: float) -> bool:
    """Whether no two clusters lie within 2r of each other. Distances are looked at only if no cell of diameter 2r holds two."""
    placed = clusters.select("id", "x", "y")
    small = lambda c: F.floor(F.col(c) / F.lit(r * math.sqrt(2))).cast("long")
    if not placed.groupBy(small("x").alias("ci"), small("y").alias("cj")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    placed = placed.withColumns(cells(r))
    near = spread(placed.select(F.col("id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), "ci", "cj"))
    return placed.join(near, ["ci", "cj"]).where("id != other").where(distance("x", "y", "x2", "y2") <= 2 * r).isEmpty()


def still(clusters: DataFrame, zoom: int, min_zoom: int, radius: float) -> list[int]:
    """Zooms from `zoom` up at which no two clusters are near: what is apart at one is so at all finer ones."""
    if not apart(clusters, radius / (512.0 * 2**zoom)):
        return []
    yes, no = zoom, min_zoom - 1
    while yes - no > 1:
        z = (yes + no) // 2
        yes, no = (z, no) if apart(clusters, radius / (512.0 * 2**z)) else (yes, z)
    return list(range(zoom, yes - 1, -1))


def roots(follows: DataFrame) -> DataFrame:
    """follows(id, root) -> the same, with every root that follows another replaced by that one's root."""
    follows = settle(follows)
    while not follows.isEmpty():
        beyond = follows.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        new = settle(follows.join(beyond, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("went")))
        follows = new.select("id", "root")
        if new.where("went").isEmpty():
            break
    return follows


def edges_between(items: DataFrame, known: DataFrame) -> DataFrame:
    """Edges of the level with the place of their first pair: lo, hi, t. items(o, a, b) whose ends both have a known parent."""
    at = lambda e, p: known.select(F.col("id").alias(e), F.col("parent").alias(p))
    both = items.select("o", "a", "b").join(at("a", "pa"), "a").join(at("b", "pb"), "b").where("pa != pb")
    return both.groupBy(F.least("pa", "pb").alias("lo"), F.greatest("pa", "pb").alias("hi")).agg(F.min("o").alias("t"))


def carried(items: DataFrame, parents: DataFrame, n: int) -> DataFrame:
    """items(o, a, b) between the parents of their ends: lo, hi, t. Of n clusters, those that are not in parents(id, parent) stay what they are.

    Only a pair with an end in a cluster of several can meet another one: if these are few, the others need no shuffle.
    """
    held = parents.groupBy("parent").agg(F.count("*").alias("held"))
    to = settle(parents.join(held, "parent").where("id != parent OR held > 1").select("id", "parent", (F.col("held") > 1).alias("several")))
    changed = to.count()
    at = lambda e: at_hand(to.select(F.col("id").alias(e), F.col("parent").alias(f"p{e}"), F.col("several").alias(f"s{e}")), changed)
    both = items.select("o", "a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left").withColumns({"pa": F.coalesce("pa", "a"), "pb": F.coalesce("pb", "b")}).where("pa != pb")
    lo, hi, meets = F.least("pa", "pb").alias("lo"), F.greatest("pa", "pb").alias("hi"), F.coalesce("sa", F.lit(False)) | F.coalesce("sb", F.lit(False))
    first = lambda rows: rows.groupBy(lo, hi).agg(F.min("o").alias("t"))
    if 2 * changed > n:
        return settle(first(both))
    return settle(first(both.where(meets)).unionByName(both.where(~meets).select(lo, hi, F.col("o").alias("t"))))


def may_found(items: DataFrame, placing: DataFrame, can: DataFrame, follows: DataFrame) -> DataFrame:
    """Of items(o, a, b), ends by their roots, those before the last of the placing pairs that could join an edge at what their ends can join."""
    asked = placing.where("lo != hi")
    last = asked.select(F.col("lo").alias("centre"), "o").unionByName(asked.select(F.col("hi").alias("centre"), "o")).groupBy("centre").agg(F.max("o").alias("until"))
    until = settle(can.join(last, "centre").groupBy("id").agg(F.max("until").alias("until")).withColumn("root", F.col("id")))
    if not follows.isEmpty():
        until = settle(until.unionByName(follows.join(until.select("root", "until"), "root").select(until.columns)))
    n = until.count()
    at = lambda e: at_hand(until.select(F.col("id").alias(e), F.col("root").alias(f"r{e}"), F.col("until").alias(f"u{e}")), n)
    early = items.join(at("a"), "a").join(at("b"), "b").where((F.col("o") < F.col("ua")) & (F.col("o") < F.col("ub")))
    return early.select("o", F.col("ra").alias("a"), F.col("rb").alias("b")).where("a != b")


def placed_in_order(open_: DataFrame, edges: DataFrame) -> DataFrame:
    """Parents (id, parent) of the clusters that at most IN_TASK rows of choose() place, one pair after the other in one task."""

    def run(rows: pa.Table) -> pa.Table:
        parent, since, choices = {}, {}, {}
        for r in rows.to_pylist():
            choices.setdefault(r["o"], []).append(r)
            if r["t"] is not None:
                since[r["lo"], r["hi"]] = r["t"]
        for o in sorted(choices):
            can = choices[o]
            one = can[0]
            here = {e: one[f"p{e}"] if one[f"p{e}"] is not None else parent.get(one[e]) for e in ("a", "b")}
            can = [r for r in can if here["a"] in (None, r["ca"]) and here["b"] in (None, r["cb"])]
            if not can:
                continue
            if one["wa"] == o or one["wb"] == o:
                older = [(since[r["lo"], r["hi"]], r["da"] + r["db"], r["ca"], r["cb"]) for r in can if r["ca"] != r["cb"] and since.get((r["lo"], r["hi"]), o) < o]
                ca, cb = min(older)[2:] if older else (min((r["da"], r["ca"]) for r in can)[1], min((r["db"], r["cb"]) for r in can)[1])
                for e, c in (("a", ca), ("b", cb)):
                    if here[e] is None:
                        parent[one[e]] = c
            elif here["a"] is None or here["b"] is None:
                continue
            else:
                ca, cb = here["a"], here["b"]
            if ca != cb:
                key = min(ca, cb), max(ca, cb)
                since[key] = min(since.get(key, o), o)
        return pa.table({"id": pa.array(list(parent), pa.int64()), "parent": pa.array(list(parent.values()), pa.int64())})

    known = edges.groupBy("lo", "hi").agg(F.min("t").alias("t"))
    return open_.join(known, ["lo", "hi"], "left").groupBy(F.lit(0).alias("all")).applyInArrow(run, "id long, parent long")


def choose(items: DataFrame, firsts: DataFrame, known: DataFrame, waiting: DataFrame, choices: DataFrame, follows: DataFrame) -> DataFrame:
    """Parents of all clusters but those that follow others.

    items(o, a, b); firsts(o, a, b): the pairs that place waiting clusters, ends by their roots; known(id, parent); waiting(id, w): clusters without a parent
    and the pair that places them; choices(id, centre, distance): what they can join; follows(id, root).
    """
    if waiting.isEmpty():
        return known
    can = choices.unionByName(known.select("id", F.col("parent").alias("centre"), F.lit(0.0).alias("distance")))
    end = lambda e: can.select(F.col("id").alias(e), F.col("centre").alias(f"c{e}"), F.col("distance").alias(f"d{e}"))
    mine = lambda e: waiting.select(F.col("id").alias(e), F.col("w").alias(f"w{e}"))
    flagged = lambda rows: rows.join(mine("a"), "a", "left").join(mine("b"), "b", "left")
    places = "(wa <=> o OR wb <=> o)"
    both = lambda rows: rows.join(end("a"), "a").join(end("b"), "b").withColumns({"lo": F.least("ca", "cb"), "hi": F.greatest("ca", "cb")})
    placing = settle(both(flagged(firsts)))
    # Of the others, only what may found an edge that a placing pair can join, before it and before any that is known.
    early = settle(flagged(may_found(items, placing, can, follows)).where(f"NOT {places}"))
    sure = settle(edges_between(early.where("wa IS NULL AND wb IS NULL"), known))
    asked = placing.where("lo != hi").groupBy("lo", "hi").agg(F.max("o").alias("last")).join(sure, ["lo", "hi"], "left").select("lo", "hi", F.least("last", "t").alias("until"))
    founding = both(early.where("wa IS NOT NULL OR wb IS NOT NULL")).join(asked, ["lo", "hi"]).where("o < until").select(placing.columns)
    given = lambda e: F.when(F.col(f"w{e}").isNull(), F.col(f"c{e}")).alias(f"p{e}")
    open_, edges = settle(placing.unionByName(founding).select("*", given("a"), given("b"))), sure
    while left := open_.count():
        if left <= IN_TASK:
            known = known.unionByName(placed_in_order(open_, edges))
            break
        first = open_.groupBy("lo", "hi").agg(F.min("o").alias("first"))
        seen = open_.where(places).join(edges, ["lo", "hi"], "left").join(first, ["lo", "hi"])
        older = F.when((F.col("t") < F.col("o")) & (F.col("ca") != F.col("cb")), F.struct("t", (F.col("da") + F.col("db")).alias("d"), "ca", "cb"))
        best = seen.groupBy("o", "a", "b", "wa", "wb", "pa", "pb").agg(
            F.min(older).alias("edge"), F.min(F.when((F.col("first") < F.col("o")) & (F.col("ca") != F.col("cb")), F.col("first"))).alias("before"), F.min(F.struct("da", "ca")).alias("na"), F.min(F.struct("db", "cb")).alias("nb")
        )
        ready = "(pa IS NOT NULL OR wa = o) AND (pb IS NOT NULL OR wb = o) AND (before IS NULL OR edge.t < before)"
        done = best.where(ready).withColumns({"ca": F.coalesce("edge.ca", "na.ca"), "cb": F.coalesce("edge.cb", "nb.cb")})
        placed = settle(done.where("pa IS NULL").select(F.col("a").alias("id"), F.col("ca").alias("parent")).unionByName(done.where("pb IS NULL").select(F.col("b").alias("id"), F.col("cb").alias("parent"))))
        known = known.unionByName(placed)
        new = lambda e: placed.select(F.col("id").alias(e), F.col("parent").alias(f"n{e}"))  # noqa: B023, E731
        now = open_.join(new("a"), "a", "left").join(new("b"), "b", "left").withColumns({"pa": F.coalesce("pa", "na"), "pb": F.coalesce("pb", "nb")}).drop("na", "nb")
        now = settle(now.where("(pa IS NULL OR pa = ca) AND (pb IS NULL OR pb = cb)"))
        found = now.where("pa IS NOT NULL AND pb IS NOT NULL AND ca != cb")
        edges = edges.unionByName(found.groupBy("lo", "hi").agg(F.min("o").alias("t")))
        open_ = now.where("pa IS NULL OR pb IS NULL")
    return settle(known)


def touched(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """clusters(id, x, y, n), items(o, a, b) -> the clusters with o, the first pair of each, mate, its other end there, and links, the number of pairs.

    Clusters (id, x, y, n, o) are inserted alone at their o if they are in no pair; without o, those are left out.
    """
    first = items.select(F.col("a").alias("id"), "o", F.col("b").alias("mate")).unionByName(items.select(F.col("b").alias("id"), "o", F.col("a").alias("mate")))
    first = first.groupBy("id").agg(F.min("o").alias("first"), F.min_by("mate", "o").alias("mate"), F.count("*").alias("links"))
    if "o" not in clusters.columns:
        return clusters.join(first, "id").select("id", "x", "y", "n", F.col("first").alias("o"), "mate", "links")
    return clusters.join(first, "id", "left").select("id", "x", "y", "n", F.coalesce("first", "o").alias("o"), "mate", F.coalesce("links", F.lit(0)).alias("links"))


def level(own: DataFrame, items: DataFrame, r: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One zoom: touched() clusters and items(o, a, b) of the level before -> members(id, parent, o), edges(lo, hi, t).

    Third, the clusters of this level (id, x, y, n, o).
    """
    other = own.select(F.col("id").alias("mate"), F.col("x").alias("mx"), F.col("y").alias("my"), F.col("n").alias("mn"), F.col("o").alias("mo"))
    close = distance("x", "y", "mx", "my") <= r
    kind = F.when(F.col("mate").isNull(), "single").when(close & (F.col("mo") == F.col("o")), "merged").when(close, "follow").otherwise("end")
    own = settle(own.join(other, "mate", "left").withColumn("kind", kind))
    mean = lambda c: (F.col(c) * F.col("n") + F.col(f"m{c}") * F.col("mn")) / (F.col("n") + F.col("mn"))
    merged = own.where("kind = 'merged' AND id < mate").select("id", mean("x").alias("x"), mean("y").alias("y"), "o", F.lit(r).alias("reach"), F.lit(True).alias("fixed"))
    free = own.where("kind IN ('end', 'single')").select("id", "x", "y", "o", F.when(F.col("kind") == "end", F.lit(2 * r)).otherwise(F.lit(r)).alias("reach"), F.lit(False).alias("fixed"))
    sites = settle(merged.unionByName(free).withColumns(cells(r)))
    centres = first_centres(sites)
    found = settle(in_reach(sites.where("NOT fixed").join(centres.select("id"), "id", "left_anti"), centres))
    alone = own.where("kind = 'single'").select("id")
    nearest = found.join(alone, "id", "left_semi").groupBy("id").agg(F.min_by("centre", F.struct("distance", "centre")).alias("parent"))
    known = centres.where("NOT fixed").select("id", F.col("id").alias("parent")).unionByName(own.where("kind = 'merged'").select("id", F.least("id", "mate").alias("parent"))).unionByName(nearest)
    known = settle(known)
    waiting = settle(own.where("kind = 'end'").join(known.select("id"), "id", "left_anti").select("id", F.col("o").alias("w")))
    follows = roots(own.where("kind = 'follow'").select("id", F.col("mate").alias("root")))
    pair = own.join(waiting.select("id"), "id", "left_semi").select("o", "id", "mate").join(follows.select(F.col("id").alias("mate"), "root"), "mate", "left").withColumn("root", F.coalesce("root", "mate"))
    firsts = pair.select("o", F.when(F.col("id") < F.col("mate"), F.col("id")).otherwise(F.col("root")).alias("a"), F.when(F.col("id") < F.col("mate"), F.col("root")).otherwise(F.col("id")).alias("b"))
    known = choose(items, firsts.where("a != b").distinct(), known, waiting, found.join(waiting.select("id"), "id", "left_semi"), follows)
    parents = known.unionByName(follows.join(known.select(F.col("id").alias("root"), "parent"), "root").select("id", "parent"))
    members = settle(own.select("id", "o", "x", "y", "n").join(parents, "id"))
    up = members.groupBy(F.col("parent").alias("id")).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("y"), F.sum("n").alias("n"), F.min("o").alias("o"))
    return members.select("id", "parent", "o"), carried(items, members.select("id", "parent"), own.count()), settle(up)


def absorbed(members: DataFrame, edges: DataFrame, up: DataFrame, r: float, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The level after clusters within r that share over `share` of their targets have become one."""
    targets = edges.select(F.col("lo").alias("id"), F.col("hi").alias("target")).unionByName(edges.select(F.col("hi"), F.col("lo")).toDF("id", "target"))
    _, kept = absorb(up.select("id", "x", "y", "n"), targets, r, share)
    if kept is None:
        return members, edges, up
    at = lambda e: kept.select(F.col("id").alias(e), F.col("kept").alias(f"k{e}"))
    members = members.join(at("parent"), "parent", "left").select("id", F.coalesce("kparent", "parent").alias("parent"), "o")
    edges = carried(edges.select(F.col("t").alias("o"), F.col("lo").alias("a"), F.col("hi").alias("b")), kept.select("id", F.col("kept").alias("parent")), up.count())
    up = up.join(at("id"), "id", "left").withColumn("id", F.coalesce("kid", "id"))
    up = up.groupBy("id").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("y"), F.sum("n").alias("n"), F.min("o").alias("o"))
    return settle(members), edges, settle(up)


def leaves(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (lo_lon, lo_lat, hi_lon, hi_lat), counted once if there are several of them -> places (id, x, y, n: ends of edges there, lon, lat) and pairs of places (o, a, b)."""
    place = lambda e: F.xxhash64(f"{e}_lon", f"{e}_lat")
    sides = (("p", "lo"), ("q", "hi"))
    rows = edges.withColumns({i: place(e) for i, e in sides}).where("p != q")
    rows = settle(rows.groupBy("p", "q").agg(*[F.min(f"{e}_{c}").alias(f"{e}_{c}") for _, e in sides for c in ("lon", "lat")]))
    ends = reduce(DataFrame.unionByName, [rows.select(F.col(i).alias("id"), F.col(f"{e}_lon").alias("lon"), F.col(f"{e}_lat").alias("lat")) for i, e in sides])
    places = mercator(ends.groupBy("id").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"), F.count("*").alias("n")))
    pairs = rows.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return places.select("id", F.col("mx").alias("x"), F.col("my").alias("y"), "n", "lon", "lat"), pairs.select(order_of(F.col("a"), F.col("b")).alias("o"), "a", "b")


def numbered(pairs: DataFrame) -> DataFrame:
    """pairs(o, a, b) with a number in place of o, in the same order: sums over pairs then go by hashing, and rows are short."""
    fields = pairs.schema["o"].dataType
    order = [F.col(f"o.{f}") for f in fields.names] if hasattr(fields, "names") else [F.col("o")]
    return pairs.orderBy(*order).select(F.monotonically_increasing_id().alias("o"), "a", "b")


def levels(places: DataFrame, pairs: DataFrame, radius: float = 40.0, min_zoom: int = 0, max_zoom: int = MAX_ZOOM, share: float | None = 0.6) -> list[tuple[list[int], DataFrame, DataFrame, DataFrame]]:
    """hierarchy() by groups of zooms at which nothing changes: zooms, clusters (id, x, y, n, links), members (id, parent), pairs (o, a, b)."""
    items = settle(numbered(pairs.where("a != b").select("o", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    own, out, zoom, same = settle(touched(settle(places.select("id", "x", "y", "n")), items)), [], max_zoom, []
    while zoom >= min_zoom:
        if not same and (same := still(own, zoom, min_zoom, radius)):  # nothing can merge, join or be absorbed: the levels repeat the one before, and the next one inserts the same
            out.append((same, own, own.select("id", F.col("id").alias("parent")), items))
            zoom = same[-1] - 1
            continue
        since, r = mark(), radius / (512.0 * 2**zoom)
        members, edges, up = level(own, items, r)
        if share is not None:
            members, edges, up = absorbed(members, edges, up, r, share)
        items = edges.select(F.col("t").alias("o"), F.col("lo").alias("a"), F.col("hi").alias("b"))
        own, same = settle(touched(up, items)), []
        sweep(own.sparkSession, since, members, items, own)
        out.append(([zoom], own, members.select("id", "parent"), items))
        zoom -= 1
    return out


def at_zooms(rows: DataFrame, zooms: list[int]) -> DataFrame:
    """Each row once for each zoom."""
    return rows.select(F.lit(zooms[0]).alias("zoom") if len(zooms) == 1 else F.explode(F.lit(zooms)).alias("zoom"), "*")


def hierarchy(places: DataFrame, pairs: DataFrame, radius: float = 40.0, min_zoom: int = 0, max_zoom: int = MAX_ZOOM, share: float | None = 0.6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """places(id, x, y, n), pairs(o, a, b) -> clusters (zoom, id, mx, my, num_points), members (zoom, child, parent), edges (zoom, a, b).

    With `share`, each level ends with absorption; None leaves overlapping clusters apart. Places in no pair are left out; so are pairs
    of a place with itself.
    """
    out = [
        (
            at_zooms(own.select("id", F.col("x").alias("mx"), F.col("y").alias("my"), F.col("n").alias("num_points")), zooms),
            at_zooms(members.select(F.col("id").alias("child"), "parent"), zooms),
            at_zooms(items.select("a", "b"), zooms),
        )
        for zooms, own, members, items in levels(places, pairs, radius, min_zoom, max_zoom, share)
    ]
    clusters, members, edges = (reduce(DataFrame.unionByName, part) for part in zip(*out, strict=True))
    return clusters, members, edges


def counted(places: DataFrame, pairs: DataFrame, radius: float = 40.0, min_zoom: int = 0, max_zoom: int = MAX_ZOOM, share: float | None = 0.6) -> DataFrame:
    """The clusters of hierarchy() with `children`, the number of clusters of the level before in each, and `edges`, of the edges at it."""
    out = []
    for zooms, own, members, _ in levels(places, pairs, radius, min_zoom, max_zoom, share):
        held = members.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
        out.append(at_zooms(own.join(held, "id").select("id", F.col("x").alias("mx"), F.col("y").alias("my"), F.col("n").alias("num_points"), "children", F.col("links").alias("edges")), zooms))
    return reduce(DataFrame.unionByName, out)


def placed_at(places: DataFrame, members: DataFrame, zoom: int, max_zoom: int = MAX_ZOOM) -> DataFrame:
    """places(id, ...) with `cluster`, the one that holds each at a zoom; members as from hierarchy()."""
    out = places.withColumn("cluster", F.col("id"))
    for z in range(max_zoom, zoom - 1, -1):
        step = members.where(F.col("zoom") == z).select(F.col("child").alias("cluster"), F.col("parent").alias("_up"))
        out = out.join(step, "cluster").drop("cluster").withColumnRenamed("_up", "cluster")
    return out


def node(zoom, cluster) -> Column:
    """Name of a cluster among those of all zooms: a cluster's id is that of one of its members."""
    return F.concat_ws(":", F.lit(zoom) if isinstance(zoom, int) else zoom, cluster)


def closure(clusters: DataFrame, members: DataFrame, zoom: int, min_zoom: int = 0) -> DataFrame:
    """Ancestors of clusters(id) of a zoom, by node(): id, up (0: itself), anc."""
    now = clusters.select(F.col("id"), F.col("id").alias("at")).distinct()
    out = now.select(node(zoom, F.col("id")).alias("id"), F.lit(0).alias("up"), node(zoom, F.col("at")).alias("anc"))
    for up in range(1, zoom - min_zoom + 1):
        step = members.where(F.col("zoom") == zoom - up).select(F.col("child").alias("at"), "parent")
        now = now.join(step, "at").select("id", F.col("parent").alias("at"))
        out = out.unionByName(now.select(node(zoom, F.col("id")).alias("id"), F.lit(up).alias("up"), node(zoom - up, F.col("at")).alias("anc")))
    return out
