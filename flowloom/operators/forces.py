"""The force-directed method beyond one task: edges in blocks, control points exchanged as rows in every iteration.

An iteration moves all control points by what the iteration before has left, so it is a round of messages. Edges are dealt into blocks of a set size by
their midpoints. For each two blocks with partners among their edges one task sees the paths of these partners, and adds up what those of one block do to each
edge of the other; an edge's sums over all blocks are a partial aggregation; the springs along a path and the resampling at the end of a cycle
need that path alone. No task holds more than two blocks, however large a component of compatible edges is or however many partners an
edge has. The state is a written table, so a lost executor costs the running iteration at most; the table before is deleted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import kernel
from flowloom.operators.ranking import dense_ids
from flowloom.operators.store import drop, settle

ENDS = ["fx", "fy", "tx", "ty"]
STATE = "id long, fx double, fy double, tx double, ty double, weight long, path binary"


def unpacked(column) -> np.ndarray:
    """Paths (n, points, 2) of a column of packed doubles, all of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1, 2)


def packed(paths: np.ndarray):
    import pyarrow as pa

    return pa.array([p.tobytes() for p in np.ascontiguousarray(paths, np.float64)], pa.binary())


def partial_pulls(state: DataFrame, needs: DataFrame, links: DataFrame) -> DataFrame:
    """id, pull (array of doubles): what the partners of one block do to an edge, one row for each block that has any.

    needs(id, t, s) and links(t, s, a, b) tell which edges and pairs the two blocks t and s have in common.
    """

    def run(key, nodes, pairs):
        import pyarrow as pa

        ids = nodes["id"].to_numpy()
        order = np.argsort(ids)
        paths = unpacked(nodes["path"])[order]
        a, b = (np.searchsorted(ids[order], pairs[c].to_numpy()) for c in ("a", "b"))
        pull = np.zeros((len(paths), 2 * (paths.shape[1] - 2)))
        np.add.at(pull, a, kernel.units(paths[b, 1:-1] - paths[a, 1:-1]).reshape(len(a), -1))
        moved = np.unique(a)
        width = pull.shape[1]
        arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(moved) + 1) * width, width), pa.int32()), pa.array(pull[moved].ravel()))
        return pa.Table.from_arrays([pa.array(ids[order][moved]), arrays], ["id", "pull"])

    held = state.select("id", "path").join(needs, "id")
    return held.groupBy("t", "s").cogroup(links.groupBy("t", "s")).applyInArrow(run, "id long, pull array<double>")


def advanced(state: DataFrame, pulls: DataFrame, turn: kernel.Turn) -> DataFrame:
    """The state after an iteration. pulls(id, pull)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            paths = unpacked(batch["path"])
            ends = np.stack([batch[c].to_numpy() for c in ENDS], axis=1)
            pull = np.array([p if p is not None else [0.0] * (2 * (paths.shape[1] - 2)) for p in batch["pull"].to_pylist()]).reshape(len(paths), -1, 2)
            paths = kernel.moved(paths, kernel.lengths(ends), pull, turn)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", *ENDS, "weight")), packed(paths)], ["id", *ENDS, "weight", "path"])

    return state.join(pulls, "id", "left").mapInArrow(run, STATE)


def fixed_pulls(segments: DataFrame, state: DataFrame) -> DataFrame:
    """id, pull: what each fixed segment(id, fx, fy, tx, ty) does to its edge."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            paths, ends = unpacked(batch["path"]), np.stack([batch[c].to_numpy() for c in ENDS], axis=1)
            pull = kernel.units(kernel.straight(ends, paths.shape[1] - 1)[:, 1:-1] - paths[:, 1:-1]).reshape(len(paths), -1)
            offsets = pa.array(np.arange(0, pull.size + 1, pull.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(offsets, pa.array(pull.ravel()))], ["id", "pull"])

    return segments.join(state.select("id", "path"), "id").mapInArrow(run, "id long, pull array<double>")


def bundle_in_blocks(edges: DataFrame, pairs: DataFrame, segments: DataFrame | None, step: float, block: int, cycles: int = kernel.CYCLES, iterations: int = kernel.ITERATIONS) -> DataFrame:
    """edges(id, fx, fy, tx, ty, weight), pairs(a, b), fixed segments(id, fx, fy, tx, ty) -> id, weight, path (packed doubles)."""
    middle = edges.select("id", *ENDS, F.col("weight").cast("long").alias("weight")).withColumns({"_x": F.col("fx") + F.col("tx"), "_y": F.col("fy") + F.col("ty")})
    dealt = settle(dense_ids(middle, "_x", "_y", "id", name="_n").withColumn("block", F.floor(F.col("_n") / block)))
    of = lambda e, t: dealt.select(F.col("id").alias(e), F.col("block").alias(t))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    links = settle(both.join(of("a", "t"), "a").join(of("b", "s"), "b").select("t", "s", "a", "b"))
    needs = settle(links.select(F.col("a").alias("id"), "t", "s").union(links.select("b", "t", "s")).distinct())

    def start(batches):
        import pyarrow as pa

        for batch in batches:
            ends = np.stack([batch[c].to_numpy() for c in ENDS], axis=1).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, packed(kernel.straight(ends, 2))], [*batch.schema.names, "path"])

    state = settle(dealt.select("id", *ENDS, "weight").mapInArrow(start, STATE))
    for turn in kernel.schedule(step, cycles, iterations):
        pulls = partial_pulls(state, needs, links)
        if segments is not None:
            pulls = pulls.unionByName(fixed_pulls(segments, state))
        # Sums by place in the path; a task adds up what it has before anything is shuffled.
        summed = pulls.groupBy("id").agg(F.array(*[F.sum(F.col("pull")[i]) for i in range(2 * turn.inner)]).alias("pull"))
        new = settle(advanced(state, summed, turn))
        drop(state)
        state = new
    for t in (dealt, links, needs):
        drop(t)
    return state.select("id", "weight", "path")
