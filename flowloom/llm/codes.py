"""Vector code compression: product codes whose codebooks come from delta-maintained Lloyd rounds.

Vectors are packed once into blocks, written as a table bucketed by block. Each round reads it beside the assignments of the round
before, a table bucketed alike, so that the two meet without a shuffle; it writes the new assignments and, for the parts whose assignment
changed only, what leaves one codebook entry and comes to another: plus and minus sums, added up inside the block. Only
those are shuffled. The driver keeps the running integer sums and counts of all entries (8 parts x 16 entries, whatever the number of vectors)
and derives the next codebooks from them. All arithmetic is on integers, so any order of addition gives the same codes.

Defined cases: a vector that is null, empty, or holds a null or non-finite component is dropped; so is one whose length
isn't that of the vectors with the smallest id, or no multiple of the number of parts; rows that repeat an id, or have none, are coded
each by itself; the codebooks start from the smallest distinct ids (of an id's rows the vector that comes first in order), rows without an id
are never among these; with fewer ids the codebooks are shorter; without any kept row there is no result. Components beyond +-16384 count as
that, so that squared distances fit 64 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import materialize, table
from flowloom.operators.store import shared_dir

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bytes of components in a block, and about as many of a bucket.
BLOCK_BYTES, BUCKET_BYTES = 1 << 20, 64 << 20
#: Largest magnitude of a scaled component.
MOST = 1 << 26


def usable(vector: Column) -> Column:
    """Whether a vector has components, none of them null or non-finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine)


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 32-bit integers, within +-MOST."""
    return np.clip(np.floor(values.astype(np.float64) * scale), -MOST, MOST).astype(np.int32)


def seeds(vectors: DataFrame, most: int = ENTRIES) -> list[tuple[int, list[float]]]:
    """The smallest `most` distinct ids in ascending order, each with the first of its vectors."""
    out: list = []
    left = vectors.where(F.col("vec_id").isNotNull())
    while len(out) < most:
        beyond = left.where(F.col("vec_id") > out[-1][0]) if out else left
        rows = beyond.orderBy("vec_id", "vector").limit(most).collect()
        if not rows:
            break
        for r in rows:
            if len(out) < most and (not out or r["vec_id"] != out[-1][0]):
                out.append((r["vec_id"], r["vector"]))
    return out


def blocks_of(vectors: DataFrame, width: int, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, label, vector) -> block, ids, labels, values (32-bit integers of all its vectors one after the other)."""
    kind = vectors.schema["label"].dataType.simpleString()
    size = max(1, BLOCK_BYTES // (4 * width))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                values = scaled(part["vector"].flatten().to_numpy(zero_copy_only=False), scale)
                rows = [pa.array([part.num_rows and number])]
                rows += [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part[c]) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*rows, pa.array([values.tobytes()], pa.binary())], ["block", "ids", "labels", "values"])
                number += 1

    return vectors.mapInArrow(run, f"block long, ids array<long>, labels array<{kind}>, values binary")


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """parts (n, p, w), books (p, e, w), integers -> the nearest entry of each part (the lowest among equals) and its squared distance."""
    n, p, w = parts.shape
    high = max(int(np.abs(parts).max(initial=0)), int(np.abs(books).max(initial=0)))
    # Whole numbers below 2**53 are exact in doubles, and their products are far faster.
    kind = np.float64 if 4 * w * high * high < 1 << 53 else np.int64
    code, error = np.empty((n, p), np.uint8), np.empty((n, p), np.int64)
    for i in range(p):
        v, c = parts[:, i].astype(kind), books[i].astype(kind)
        d = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None]
        code[:, i] = d.argmin(1)
        error[:, i] = d[np.arange(n), code[:, i]]
    return code, error


def changes(parts: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int):
    """What moves between entries: cells (part * entries + entry), how many parts more, sums more; only of parts whose entry changed."""
    cells, n, sums = [], [], []
    for i in range(parts.shape[1]):
        at = slice(None) if old is None else np.flatnonzero(old[:, i] != new[:, i])
        moved = parts[at, i].astype(np.int64)
        count, total = np.zeros(entries, np.int64), np.zeros((entries, parts.shape[2]), np.int64)
        for sign, code in ((1, new), (-1, old)) if old is not None else ((1, new),):
            np.add.at(count, code[at, i], sign)
            np.add.at(total, code[at, i], sign * moved)
        for e in np.flatnonzero((count != 0) | (total != 0).any(1)).tolist():
            cells.append(i * entries + e)
            n.append(int(count[e]))
            sums.append(total[e].tolist())
    return cells, n, sums


class Buckets:
    """Tables bucketed by block in the shared folder: joined to each other, they need no shuffle."""

    def __init__(self, spark, number: int):
        self.spark, self.number, self.names = spark, number, []

    def write(self, df: DataFrame) -> DataFrame:
        name = f"flowloom_{uuid.uuid4().hex}"
        df.write.bucketBy(self.number, "block").sortBy("block").option("path", f"{shared_dir(self.spark)}/{name}").format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self) -> None:
        """Takes the names out of the catalog; the files stay until the shared folder is cleared, as results still read them."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def assign(blocks: DataFrame, before: DataFrame | None, books: np.ndarray) -> DataFrame:
    """block, codes and the changes against the assignment `before`."""
    p, e, w = books.shape

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                parts = np.frombuffer(row["values"], np.int32).reshape(-1, p, w)
                code, _ = nearest(parts, books)
                old = np.frombuffer(row["codes"], np.uint8).reshape(-1, p) if "codes" in row else None
                cells, n, sums = changes(parts, old, code, e)
                cols = [pa.array([row["block"]]), pa.array([code.tobytes()]), pa.array([[{"cell": c, "n": k, "sums": s} for c, k, s in zip(cells, n, sums, strict=True)]], pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])))]
                yield pa.RecordBatch.from_arrays(cols, ["block", "codes", "changes"])

    read = blocks.select("block", "values")
    read = read if before is None else read.join(before.select("block", "codes"), "block")
    return read.mapInArrow(run, "block long, codes binary, changes array<struct<cell:int,n:long,sums:array<long>>>")


def summed(assigned: DataFrame) -> list:
    """All blocks' changes added up: rows (cell, position, n, x), at most as many as the codebooks have components."""
    rows = assigned.select(F.explode("changes").alias("c")).select("c.cell", "c.n", F.posexplode("c.sums").alias("position", "x"))
    return rows.groupBy("cell", "position").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()


def fit(blocks: DataFrame, start: np.ndarray, store: Buckets, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) after so many rounds."""
    p, e, w = start.shape
    books, counts, sums = start.copy(), np.zeros((p, e), np.int64), np.zeros((p, e, w), np.int64)
    before = None
    for _ in range(rounds):
        before = store.write(assign(blocks, before, books))
        for r in summed(before):
            i, j = divmod(r["cell"], e)
            sums[i, j, r["position"]] += r["x"]
            if r["position"] == 0:
                counts[i, j] += r["n"]
        used = counts > 0
        books[used] = sums[used] // counts[used][:, None]
    return books


def coded(blocks: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error of every vector."""
    p, _, w = books.shape

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for b in range(batch.num_rows):
                row = batch.slice(b, 1)
                code, error = nearest(np.frombuffer(row["values"][0].as_py(), np.int32).reshape(-1, p, w), books)
                text = code.tobytes().hex()
                texts = [text[i : i + 2 * p] for i in range(0, len(text), 2 * p)]
                yield pa.RecordBatch.from_arrays([row["ids"].flatten(), row["labels"].flatten(), pa.array(texts), pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds label_error, the errors of all rows of a label. Labels of over a thousandth of the rows are fewer than 1000 and go to every task, the others are joined."""
    sums = materialize(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    of = F.col("r.label").eqNullSafe(F.col("s.label"))
    common, rare = (sums.where(c).select("label", "label_error") for c in (F.col("n") * 1000 > total, F.col("n") * 1000 <= total))
    held = rows.alias("r").join(F.broadcast(common.alias("s")), of, "left").select("r.*", "label_error")
    rest = held.where("label_error IS NULL").drop("label_error")
    return held.where("label_error IS NOT NULL").unionByName(rest.alias("r").join(rare.alias("s"), of).select("r.*", "label_error"))


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """embeddings(vec_id, embedding, label) -> (vec_id, label, code, error, label_error), codebooks (parts, entries, width)."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long"), "label", F.col("embedding").alias("vector")).where(usable(F.col("vector")) & (F.size("vector") % parts == 0))
    label = vectors.schema["label"].dataType.simpleString()
    first = vectors.where("vec_id IS NOT NULL").orderBy("vec_id", "vector").limit(1).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id long, label {label}, code string, error long, label_error long"), np.zeros((parts, 0, 0), np.int64)
    width = len(first[0]["vector"])
    vectors = vectors.where(F.size("vector") == width)
    start = np.array([v for _, v in seeds(vectors, entries)])
    start = scaled(start, scale).astype(np.int64).reshape(-1, parts, width // parts).transpose(1, 0, 2)
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() * 4 * width // BUCKET_BYTES))
    store = Buckets(spark, number)
    blocks = store.write(blocks_of(vectors, width, scale).repartition(number, "block"))
    books = fit(blocks, start, store, rounds)
    rows = materialize(coded(blocks, books, label))
    store.drop()
    return with_label_error(rows), books


def digest(books: np.ndarray) -> str:
    """All components as decimal integers by part, entry and position, comma-joined: lowercase hex SHA-256."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_codes(spark, sf_dir: str) -> DataFrame:
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(i: int) -> str:
    return f"""
near{i} AS MATERIALIZED (
  SELECT row_id, part, min((d, entry)) AS best FROM (
    SELECT row_id, v.part, entry, sum((v.x - b.x) * (v.x - b.x)) AS d FROM components v JOIN books{i} b ON v.part = b.part AND v.position = b.position GROUP BY ALL)
  GROUP BY ALL)"""


def _books(i: int) -> str:
    return f"""
books{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.position, coalesce(m.x, b.x) AS x FROM books{i} b LEFT JOIN (
    SELECT part, best[2] AS entry, position, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x FROM components JOIN near{i} USING (row_id, part) GROUP BY ALL) m
  USING (part, entry, position))"""


OP11_SQL = (
    f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row_id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // {PARTS} AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
components AS MATERIALIZED (SELECT row_id, (position - 1) // w AS part, (position - 1) % w AS position, x FROM (SELECT row_id, w, unnest(v) AS x, generate_subscripts(v, 1) AS position FROM kept)),
books0 AS MATERIALIZED (SELECT part, row_id - 1 AS entry, position, x FROM components WHERE row_id <= {ENTRIES})"""
    + "".join(f",{_round(i)},{_books(i)}" for i in range(ROUNDS))
    + f",{_round(ROUNDS)}"
    + f""",
coded AS (SELECT row_id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY row_id),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, position)) AS codebooks_sha256 FROM books{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row_id) CROSS JOIN digest"""
)
