"""Incremental bundling: representatives of edges in a tree of bounded size, edges themselves in a table.

Each edge seen is a leaf, a row of a table in the shared folder with its bundled path and the tree node that stands for it.
A step takes the edges as they are now. Known ones only change weights; new ones, and those whose ends moved, are bundled:
forces act between compatible edges of the batch, and from the compatible representatives, whose control points
stay on their lines. New edges are then grouped by greedy star covers, and each group's centroid goes into the tree
below the most compatible node. A node of 50 children is split in two by a spectral cut; at the size cap a new node
merges into its most alike sibling instead.

Pairs, paths, covers and the descent of all groups are made by Spark; the driver holds the tree alone (at most SIZE_CAP nodes) and takes
from a batch as many rows as the tree can have nodes, twice at most. Weights and centroids of a node are those of all leaves below it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators import bundling
from flowloom.operators.graph import components
from flowloom.operators.store import mark, settle, sweep

SIZE_CAP, CHILDREN, SIGMA = 16_400, 50, 0.2
#: Score above which a representative pulls an edge, and above which the nodes below it are looked at.
HIT, DESCEND = 0.6, 0.3
ENDS = ["fx", "fy", "tx", "ty"]
LEAVES = "id long, fx double, fy double, tx double, ty double, weight long, node long, lonely boolean, path array<struct<x:double,y:double>>"


def scores(p, q) -> np.ndarray:
    """Compatibility of the segments of p with those of q, arrays (..., 4) that are broadcast against each other; 0 where it isn't defined."""
    p, q = np.asarray(p, dtype=float), np.asarray(q, dtype=float)
    u, v = p[..., 2:] - p[..., :2], q[..., 2:] - q[..., :2]
    lp, lq = np.hypot(u[..., 0], u[..., 1]), np.hypot(v[..., 0], v[..., 1])
    good = (lp >= 1e-12) & (lq >= 1e-12)
    lp, lq = np.where(lp >= 1e-12, lp, 1.0), np.where(lq >= 1e-12, lq, 1.0)
    mean = (lp + lq) / 2
    along = np.abs((u * v).sum(axis=-1))
    scale = 2 / (mean / np.minimum(lp, lq) + np.maximum(lp, lq) / mean)
    m = (p[..., :2] + p[..., 2:] - q[..., :2] - q[..., 2:]) / 2
    apart = np.sqrt((m * m).sum(axis=-1))
    # From p, q's ends fall on places r0, r1 of p's line: |1/2 - (r0 + r1) / 2| is |m u| / lp^2, and |r1 - r0| is |u v| / lp^2.
    off = np.maximum(np.abs((m * u).sum(axis=-1)), np.abs((m * v).sum(axis=-1)))
    visible = np.where(along > 0, np.maximum(0.0, 1 - 2 * off / np.where(along > 0, along, 1.0)), 0.0)
    return np.where(good, along / (lp * lq) * scale * mean / (mean + apart) * visible, 0.0)


def score(p, q) -> float:
    return float(scores(p, q))


@dataclass
class Node:
    id: int
    ends: np.ndarray
    weight: float
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)


def star_groups(ids: list[int], pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Greedy cover: the edge with the most free partners leads a group with them; ties by id."""
    partners: dict[int, set[int]] = {i: set() for i in ids}
    for a, b in pairs:
        partners[a].add(b)
        partners[b].add(a)
    free, groups = set(ids), []
    heap = [(-len(partners[i]), i) for i in ids]
    heapq.heapify(heap)
    while heap:
        size, i = heapq.heappop(heap)
        if i not in free:
            continue
        now = partners[i] & free
        if len(now) != -size:
            heapq.heappush(heap, (-len(now), i))
            continue
        groups.append([i, *sorted(now)])
        free -= {i, *now}
    return groups


def spectral_halves(nodes: list[Node]) -> tuple[list[Node], list[Node]]:
    """Two parts by the sign of the second eigenvector of the normalised Laplacian of the score matrix."""
    ends = np.array([x.ends for x in nodes])
    a = np.exp(-((1 - np.array([scores(ends, e) for e in ends])) ** 2) / (2 * SIGMA**2))
    np.fill_diagonal(a, 1.0)
    d = 1 / np.sqrt(a.sum(axis=1))
    _, v = np.linalg.eigh(np.eye(len(nodes)) - a * d[:, None] * d[None, :])
    side = v[:, 1] >= np.median(v[:, 1])
    return [x for x, s in zip(nodes, side, strict=True) if s], [x for x, s in zip(nodes, side, strict=True) if not s]


class Tree:
    def __init__(self, cap: int = SIZE_CAP, most: int = CHILDREN):
        self.roots: list[Node] = []
        self.nodes: dict[int, Node] = {}
        self.next, self.cap, self.most = 0, cap, most

    def _new(self, ends, weight: float, parent: Node | None = None) -> Node:
        node = Node(self.next, np.array(ends, dtype=float), float(weight), parent)
        self.nodes[node.id] = node
        self.next += 1
        return node

    def change(self, node: Node | None, sums, weight: float) -> None:
        """Adds to the weight, and to the weighted sum of ends, of a node and all above it."""
        while node is not None:
            total = node.weight + weight
            if total > 0:
                node.ends = (node.ends * node.weight + np.asarray(sums, dtype=float)) / total
            node.weight, node = total, node.parent

    def insert(self, ends, weight: float) -> int:
        """The id of the node that now stands for the segment."""
        if len(self.roots) < self.most:
            node = self._new(ends, weight)
            self.roots.append(node)
            return node.id
        above = self.nearest(ends)
        sums = np.asarray(ends, dtype=float) * weight
        if len(self.nodes) >= self.cap:
            while above.children:  # the new node would be one of them: it merges into the most alike, at the bottom
                above = above.children[int(np.argmax(scores([c.ends for c in above.children], ends)))]
            self.change(above, sums, weight)
            return above.id
        if not above.children:
            # What stands for edges stays at the bottom under its id; a new inner node takes its place.
            above = self._inner(above)
        node = self._new(ends, weight, above)
        above.children.append(node)
        self.change(above, sums, weight)
        if len(above.children) >= self.most:
            self._split(above)
        return node.id

    def _inner(self, node: Node) -> Node:
        inner = self._new(node.ends, node.weight, node.parent)
        siblings = node.parent.children if node.parent else self.roots
        siblings[siblings.index(node)] = inner
        inner.children, node.parent = [node], inner
        return inner

    def nearest(self, ends) -> Node:
        """Best-first search, from the two upper levels on: the last of the nodes that each score above all before them."""
        heap, opened = [], set()

        def look_at(nodes):
            new = [n for n in nodes if n.id not in opened]
            if new:
                opened.update(n.id for n in new)
                for n, value in zip(new, scores([n.ends for n in new], ends).tolist(), strict=True):
                    heapq.heappush(heap, (-value, n.id))

        look_at(self.roots)
        look_at([c for r in self.roots for c in r.children])
        best, top = self.roots[0], -1.0
        while heap and -heap[0][0] > top:
            value, i = heapq.heappop(heap)
            best, top = self.nodes[i], -value
            known = all(c.id in opened for c in best.children)
            look_at([g for c in best.children for g in c.children] if known else best.children)
        return best

    def _split(self, node: Node) -> None:
        halves = [h for h in spectral_halves(node.children) if h]
        if len(halves) < 2:
            return
        node.children = []
        for half in halves:
            weight = sum(c.weight for c in half)
            inner = self._new(sum(c.ends * c.weight for c in half) / weight, weight, node)
            inner.children = half
            for c in half:
                c.parent = inner
            node.children.append(inner)

    def table(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ends of all nodes level by level, the row of each one's parent (-1 for roots), and the level bounds."""
        rows, above, bounds = list(self.roots), [-1] * len(self.roots), [0, len(self.roots)]
        while bounds[-1] > bounds[-2]:
            for i in range(bounds[-2], bounds[-1]):
                rows += rows[i].children
                above += [i] * len(rows[i].children)
            bounds.append(len(rows))
        return np.array([n.ends for n in rows]).reshape(-1, 4), np.array(above, dtype=int), bounds[:-1]

    def partners(self, edges: DataFrame) -> DataFrame:
        """id, fx, fy, tx, ty: the representatives that pull each edge, turned its way. A branch ends at the first that does, or
        at one that scores DESCEND or less. The tree goes to the tasks whole: it has a cap."""
        frozen = Frozen(self)

        def run(batches):
            import pyarrow as pa

            for part in slices(batches):
                q = ends_of(part)
                row, node = frozen.pulling(q)
                hit = frozen.ends[node]
                turned = (((hit[:, 2:] - hit[:, :2]) * (q[row, 2:] - q[row, :2])).sum(axis=1) < 0)[:, None]
                hit = np.where(turned, hit[:, [2, 3, 0, 1]], hit)
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(row)), *(pa.array(hit[:, i]) for i in range(4))], ["id", *ENDS])

        return edges.select("id", *ENDS).mapInArrow(run, "id long, fx double, fy double, tx double, ty double")

    def alike(self, groups: DataFrame) -> DataFrame:
        """groups(leader, fx, fy, tx, ty, weight) with `node`, the bottom node that is most like each, and its score; -1 and null for an empty tree."""
        frozen = Frozen(self)

        def run(batches):
            import pyarrow as pa

            for part in slices(batches):
                at, value = frozen.bottom(ends_of(part))
                found = pa.array(frozen.ids[at] if len(frozen.ids) else np.zeros(len(at)), pa.int64(), mask=at < 0)
                yield pa.RecordBatch.from_arrays([*part.columns, found, pa.array(value)], [*part.schema.names, "node", "score"])

        return groups.select("leader", *ENDS, "weight").mapInArrow(run, "leader long, fx double, fy double, tx double, ty double, weight long, node long, score double")

    def total(self) -> float:
        return sum(r.weight for r in self.roots)


#: Edges that are held against the tree at once.
STEP = 256


def slices(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, STEP):
            yield batch.slice(low, STEP)


def ends_of(part) -> np.ndarray:
    return np.stack([part[c].to_numpy() for c in ENDS], axis=1)


class Frozen:
    """A tree as arrays, level by level, for tasks that only look at it: children of node i are first[i] to first[i] + count[i]."""

    def __init__(self, tree: Tree):
        self.ends, above, self.bounds = tree.table()
        rows = list(tree.roots)
        for n in rows:
            rows += n.children
        self.ids = np.array([n.id for n in rows], dtype=np.int64)
        self.count = np.array([len(n.children) for n in rows], dtype=np.int64)
        self.first = np.concatenate(([len(tree.roots)], len(tree.roots) + np.cumsum(self.count)[:-1])) if len(rows) else np.zeros(0, dtype=np.int64)
        #: Pairs of an edge and a node that have been scored.
        self.scored = 0

    def below(self, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each (row, node) as one pair for each child."""
        n = self.count[node]
        start = np.repeat(self.first[node] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n, n)
        return np.repeat(row, n), start + np.arange(n.sum())

    def of(self, q: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        self.scored += len(row)
        return scores(self.ends[node], q[row])

    def roots(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.bounds[1] if len(self.bounds) > 1 else len(self.ids)
        return np.repeat(np.arange(len(q)), n), np.tile(np.arange(n), len(q))

    def pulling(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) of all that pull: a branch is followed while its nodes score between DESCEND and HIT."""
        rows, nodes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        row, node = self.roots(q)
        while len(row):
            value = self.of(q, row, node)
            rows.append(row[value > HIT])
            nodes.append(node[value > HIT])
            go = (value > DESCEND) & (value <= HIT)
            row, node = self.below(row[go], node[go])
        return np.concatenate(rows), np.concatenate(nodes)

    def bottom(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q the bottom node reached from the best of the two upper levels by the best child each time, and its score; -1 without nodes."""
        if not len(self.ids):
            return np.full(len(q), -1), np.full(len(q), -1.0)
        row, node = self.roots(q)
        under = self.below(row, node)
        row, node = np.concatenate((row, under[0])), np.concatenate((node, under[1]))
        at, best = np.zeros(len(q), dtype=np.int64), np.full(len(q), -1.0)
        while len(row):
            value = self.of(q, row, node)
            order = np.lexsort((node, -value, row))
            lead = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
            at[row[lead]], best[row[lead]] = node[lead], value[lead]
            row, node = self.below(row[lead], node[lead])
        return at, best


def left_to_right(row: str = "") -> list[Column]:
    """The four coordinates of a segment, the end of smaller x (then y) first."""
    c = {k: F.col(row + k) for k in ENDS}
    forward = (c["fx"] < c["tx"]) | ((c["fx"] == c["tx"]) & (c["fy"] <= c["ty"]))
    return [F.when(forward, c[a]).otherwise(c[b]) for a, b in (("fx", "tx"), ("fy", "ty"), ("tx", "fx"), ("ty", "fy"))]


def leaders(edges: DataFrame, pairs: DataFrame, label: DataFrame, block: int = bundling.BLOCK) -> DataFrame:
    """id, leader of the star cover, for every edge. label(id, component) tells the components of pairs(a, b); one of up to `block` edges is one
    task, larger ones are covered in rounds with the same result."""

    def run(key, links):
        import pyarrow as pa

        a, b = links["a"].to_pylist(), links["b"].to_pylist()
        rows = [(i, g[0]) for g in star_groups(sorted({*a, *b}), list(zip(a, b, strict=True))) for i in g]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["id", "leader"])

    held = edges.select("id")
    inside = settle(pairs.join(held.toDF("a"), "a").join(held.toDF("b"), "b").select("a", "b").join(label.toDF("a", "component"), "a"))
    sized = label.groupBy("component").agg(F.count("*").alias("n"))
    large = settle(sized.where(F.col("n") > block).select("component"))
    covered = inside.join(large, "component", "left_anti").groupBy("component").applyInArrow(run, "id long, leader long")
    if not large.isEmpty():
        covered = covered.unionByName(cover_in_rounds(inside.join(large, "component", "left_semi")))
    return held.join(covered, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def cover_in_rounds(pairs: DataFrame) -> DataFrame:
    """The greedy star cover of pairs(a, b) by joins: id, leader.

    A round lets every edge lead that has more free partners than any other within two steps (ties by id): none of those can change its number of
    partners before it leads. So the result is that of leading one after the other.
    """
    links = settle(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    done = links.select(F.col("a").alias("id"), F.col("a").alias("leader")).limit(0)
    while True:
        key = links.groupBy("a").agg(F.struct(F.count("*").alias("n"), (-F.col("a")).alias("i")).alias("key"))
        near = links.join(key.select(F.col("a").alias("b"), F.col("key").alias("k")), "b").groupBy("a").agg(F.max("k").alias("k"))
        one = settle(key.join(near, "a").select("a", "key", F.greatest("key", "k").alias("best")))
        far = links.join(one.select(F.col("a").alias("b"), F.col("best").alias("k")), "b").groupBy("a").agg(F.max("k").alias("k"))
        lead = settle(one.join(far, "a").where("key = greatest(best, k)").select("a"))
        if lead.isEmpty():
            return done
        led = links.join(lead, "a").select(F.col("b").alias("id"), F.col("a").alias("leader")).unionByName(lead.select(F.col("a").alias("id"), F.col("a").alias("leader")))
        done = settle(done.unionByName(led))
        gone = done.select("id")
        links = settle(links.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti"))


class IncrementalBundler:
    """Bundles growing edges step by step. `tolerance`: how far (in units of the ends) an end may go before its edge is bundled again."""

    def __init__(self, cap: int = SIZE_CAP, most: int = CHILDREN, step: float = 0.025, threshold: float = bundling.THRESHOLD, block: int = bundling.BLOCK, tolerance: float = 1e-6):
        self.tree, self.leaves = Tree(cap, most), None
        self.step, self.threshold, self.block, self.tolerance = step, threshold, block, tolerance
        #: Rows that steps have brought to the driver, at most two for each node of the tree and step beside the changed nodes.
        self.collected = 0

    def add(self, edges: DataFrame) -> dict[str, int]:
        """edges(id, fx, fy, tx, ty, weight): those shown now, ids unique, weights in total. Counts of new and moved edges.

        Leaves that are not among them stay as they are.
        """
        spark, since = edges.sparkSession, mark()
        leaves = spark.createDataFrame([], LEAVES) if self.leaves is None else self.leaves
        was = leaves.select("id", F.struct(*ENDS, "weight").alias("was"), "node")
        far = F.lit(False)
        for c in ENDS:
            far = far | (F.abs(F.col(c) - F.col(f"was.{c}")) > self.tolerance)
        state = edges.select("id", *ENDS, F.col("weight").cast("long").alias("weight")).join(was, "id", "left")
        state = settle(state.withColumns({"new": F.col("was").isNull(), "moved": F.coalesce(far, F.lit(False))}))
        known = state.where("not new")
        sums = [F.sum(F.when(F.col("moved"), a).otherwise(b) * F.col("weight") - b * F.col("was.weight")).alias(k) for k, a, b in zip(ENDS, left_to_right(), left_to_right("was."), strict=True)]
        for row in known.groupBy("node").agg(F.sum(F.col("weight") - F.col("was.weight")).alias("more"), *sums).orderBy("node").collect():  # one row for each tree node, at most
            self.tree.change(self.tree.nodes[row["node"]], [row[k] for k in ENDS], row["more"])

        batch = state.where("new or moved").select("id", *ENDS, "weight", "node", "new")
        pairs = settle(bundling.compatible_pairs(batch, self.threshold))
        label = components(pairs)
        pulls = settle(self.tree.partners(batch))
        bent = settle(bundling.fdeb(batch, pairs, self.step, pulls, label, self.block))

        new = batch.where("new")
        led = settle(leaders(new, pairs, label, self.block))
        means = [(F.sum(c * F.col("weight")) / F.sum("weight")).alias(k) for k, c in zip(ENDS, left_to_right(), strict=True)]
        at = self.insert(settle(new.join(led, "id").groupBy("leader").agg(F.sum("weight").alias("weight"), *means)))
        nodes = led.join(at, "leader").select("id", "at")
        partners = label.select("id").union(pulls.select("id")).distinct().withColumn("bent", F.lit(True))
        done = batch.join(nodes, "id", "left").join(bent.select("id", "path"), "id").join(partners, "id", "left")
        done = done.select("id", *ENDS, "weight", F.coalesce("node", "at").alias("node"), F.col("bent").isNull().alias("lonely"), "path")
        kept = leaves.withColumnRenamed("weight", "w").join(batch.select("id"), "id", "left_anti").join(known.where("not moved").select("id", "weight"), "id", "left")
        kept = kept.select("id", *ENDS, F.coalesce("weight", "w").alias("weight"), "node", "lonely", "path")
        self.leaves = settle(kept.unionByName(done))
        counts = state.agg(F.count_if("new").alias("new"), F.count_if("moved").alias("moved")).first()
        sweep(spark, since, self.leaves)
        return {"new": counts["new"], "moved": counts["moved"]}

    def insert(self, groups: DataFrame) -> DataFrame:
        """groups(leader, fx, fy, tx, ty, weight) -> leader, at: the node that now stands for each.

        All groups descend the tree as it is. Those that are least like anything in it become nodes, as many as the cap leaves room for, one
        after the other; the others descend again and are added to the bottom node most like them, in one sum for each node. So the
        driver sees at most a row for each node that the tree can hold, twice, however many groups there are.
        """
        spark = groups.sparkSession
        room = max(0, self.tree.cap - len(self.tree.nodes), self.tree.most - len(self.tree.roots))
        chosen = self.tree.alike(groups).orderBy("score", "leader").limit(room).collect() if room else []
        placed = [(g["leader"], self.tree.insert([g[k] for k in ENDS], g["weight"])) for g in chosen]
        at = settle(spark.createDataFrame(placed, "leader long, at long"))
        rest = settle(self.tree.alike(groups.join(at, "leader", "left_anti")))
        sums = [F.sum(F.col(k) * F.col("weight")).alias(k) for k in ENDS]
        merged = rest.groupBy("node").agg(F.sum("weight").alias("weight"), *sums).orderBy("node").collect()
        for row in merged:
            self.tree.change(self.tree.nodes[row["node"]], [row[k] for k in ENDS], row["weight"])
        self.collected += len(chosen) + len(merged)
        return at.unionByName(rest.select("leader", F.col("node").alias("at")))

    def paths(self, edges: DataFrame) -> DataFrame:
        """id, weight, path, lonely of the leaves of these edges (id)."""
        return self.leaves.join(edges.select("id"), "id", "left_semi").select("id", "weight", "path", "lonely")
