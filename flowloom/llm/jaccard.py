"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are distinct sets (copies collapse before anything is shuffled), columns are n-grams, hashed
into blocks. Two sets that link differ in at most H n-grams, H following from their sizes, so of H + 1 + 2 e blocks at
least 1 + 2 e are equal in both. A set leaves out its e smallest blocks, which say least; one equal block stays
common to both, and only rows that share one are multiplied. The block count depends on a size class; a set
uses the scheme of its own class and of the next one, so that any two sets whose sizes can link meet in a scheme.

For these pairs the blocks of a sketch (finer ones, a byte each) are counted first: more unequal ones than H, and the pair is
discarded. The overlap of the others is accumulated exactly, column block by column block, and a pair is discarded
as soon as what is left can't lift it to the bound derived from its sizes. Pairs are never expanded inside a group: sets
that are equal are one row from the start; each bucket is first compared with one pivot, the links found are joined
into components, and only sets of different components in a bucket are compared after that, in blocks inside a task. Blocks
return pairs in rounds: one partner for each member, then up to 16, 256 and so on of those whose components have not
become one meanwhile. So a large group is linked by about as many pairs as it has members, and yet every
pair that the sketch allows is verified, or lies within one component already. A round's links join the components found before;
earlier links are not gone through again.

What is large is dealt in DEALS parts, one after the other, so that the disk holds the shuffle of one of them: the blocks of all sets, and the texts, which
are read once more for the n-grams of all sets that share a block. Tables are deleted as soon as nothing reads them.

N-grams are 64-bit hashes; a set is told from others by 128 bits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import materialize, table
from flowloom.operators.graph import components, grown
from flowloom.operators.store import drop, mark, sweep

#: Words of a shingle, and the similarity in hundredths.
WORDS, PERCENT = 3, 90
#: One block in so many is spare: a set leaves out as many of its smallest blocks.
SPARE = 8
#: Blocks of the sketch for each block of the own scheme, at least; their number is a power of two, so that sketches fold to one length.
FINE = 6
#: Column blocks in which an overlap is accumulated.
COLUMNS = 8
#: Members of a bucket that are compared in one task as one block, about.
BLOCK = 512
#: Partners of a member that a round of the second comparison takes: 1, in the next so many times as many, until none is left.
WIDEN = 16
#: Parts in which blocks and texts are shuffled, one after the other.
DEALS = 4
#: Sets that a task remembers, so as to cut equal ones into blocks once.
SEEN = 1 << 20
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = 256

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, 1 << 15)
        for key, b in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=np.uint64)
        n = len(_powers["up"])
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h + np.uint64(salt)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than a shingle are one; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(found)
    raw = np.frombuffer(line, dtype=np.uint8)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
    k = min(words, len(found)) - 1
    s, e = starts[: len(starts) - k], ends[k:]
    return np.unique(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def most_apart(size: int, percent: int = PERCENT) -> int:
    """Most n-grams in which two linked sets of `size` n-grams in sum can differ."""
    least = -(-percent * size // (100 + percent))
    return size - 2 * least


class Schemes:
    """Size classes and their blocks: class k holds sizes from edge[k] up to below edge[k + 1]."""

    def __init__(self, percent: int = PERCENT):
        self.edge, self.percent = [1], percent
        while self.edge[-1] < 1 << 40:
            self.edge.append(max(self.edge[-1] + 1, 100 * self.edge[-1] // percent + 1))
        self.edges = np.array(self.edge)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def most(self, k: int) -> int:
        """N-grams in which two linked sets of scheme k differ at most; 0: only equal sets link."""
        top = 2 * (self.edge[k + 1] - 1)
        return max(most_apart(s, self.percent) for s in range(max(2, top - 4), top + 1))

    def spare(self, k: int) -> int:
        return self.most(k) // SPARE

    def blocks(self, k: int) -> int:
        return 1 + self.most(k) + 2 * self.spare(k)


def block_signatures(grams: np.ndarray, k: int, schemes: Schemes) -> np.ndarray:
    """For scheme k: a 64-bit signature of every block but the smallest ones."""
    n = schemes.blocks(k)
    at = ((mix(grams, 0xA5A5) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
    sums = np.zeros(n, dtype=np.uint64)
    np.add.at(sums, at, mix(grams, 0x51ED))
    keys = mix(sums ^ mix(np.arange(n, dtype=np.uint64) + np.uint64(k << 32), 0x77))
    kept = np.sort(np.argsort(np.bincount(at, minlength=n), kind="stable")[schemes.spare(k) :])
    return keys[kept]


def sketch(grams: np.ndarray, blocks: int) -> bytes:
    """A byte for each of the finer blocks; sets that differ in d n-grams differ in d bytes at most, folded or not."""
    n = 1 << (FINE * blocks - 1).bit_length()
    sums = np.bincount((mix(grams, 0x3C3C) & np.uint64(n - 1)).astype(np.int64), (mix(grams, 0xBEEF) >> np.uint64(56)).astype(float), n)
    return sums.astype(np.int64).astype(np.uint8).tobytes()


def folded(a: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(a, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] + out[len(out) // 2 :]
    return out


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def set_hash(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed longs."""
    both = mix(np.array([mix(grams, salt).sum(dtype=np.uint64) for salt in (0x1234, 0x8765)], dtype=np.uint64), len(grams))
    return tuple(both.view(np.int64).tolist())


def digest(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, h (hash of the text), n, node, node2 (hash of the set, null without words), sketch, schemes: array of struct(own, keys).

    sketch is null and schemes empty where the task has had an equal set before.
    """
    schema = "doc_id long, h long, n long, node long, node2 long, sketch binary, schemes array<struct<own:boolean,keys:array<long>>>"

    def run(batches):
        import pyarrow as pa

        schemes, seen = Schemes(percent), set()
        kind = pa.list_(pa.struct([("own", pa.bool_()), ("keys", pa.list_(pa.int64()))]))
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                part = batch.slice(low, STEP)
                sizes, nodes, all_schemes, sketches = [], [], [], []
                for text in part["text"].to_pylist():
                    grams = shingles(text, words)
                    sizes.append(len(grams))
                    node, rows, fine = (None, None), [], None
                    if len(grams):
                        node = set_hash(grams)
                        if node not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(node)
                            k = schemes.of(len(grams))
                            for j in (k, k + 1):
                                if schemes.most(j):
                                    rows.append({"own": j == k, "keys": block_signatures(grams, j, schemes).view(np.int64)})
                            fine = sketch(grams, schemes.blocks(k))
                    nodes.append(node)
                    all_schemes.append(rows)
                    sketches.append(fine)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["h"], pa.array(sizes, pa.int64()), *(pa.array([x[i] for x in nodes], pa.int64()) for i in (0, 1)), pa.array(sketches, pa.binary()), pa.array(all_schemes, kind)], ["doc_id", "h", "n", "node", "node2", "sketch", "schemes"])

    return docs.select("doc_id", "text", text_hash().alias("h")).mapInArrow(run, schema)


def apart(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int((folded(a, size) != folded(b, size)).sum())


def pivot_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the sketch leaves possible. rows: a, b, n, sketch, n2, sketch2."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept = [(min(a, b), max(a, b)) for a, b, n, s, m, t in zip(*(batch[c].to_pylist() for c in ("a", "b", "n", "sketch", "n2", "sketch2")), strict=True) if apart(s, t) <= most_apart(n + m, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.select("a", "b", "n", "sketch", "n2", "sketch2").mapInArrow(run, "a long, b long").distinct()


def cross_pairs(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """A round of the second comparison: a, b of pairs to verify, and key, a of each member (in a bucket) of a pair left for later.

    A member's possible partners in a block are those of other components that the sketch allows, in the order of a hash of
    the pair. The round takes the first `most` of them. Of the rest, a pair that becomes one component meanwhile
    would add nothing; the others come again, with a larger `most`.

    rows: key, first, second (the two parts of the bucket compared here), part, own, node, n, label, sketch; sorted by
    key, first, second.
    """

    def compare(group):
        size = np.array([g["n"] for g in group])
        node, label, part, own = (np.array([g[c] for g in group]) for c in ("node", "label", "part", "own"))
        first, second = group[0]["first"], group[0]["second"]
        length = min(len(g["sketch"]) for g in group)
        sketch = np.stack([folded(g["sketch"], length) for g in group])
        possible = np.zeros((len(group), len(group)), dtype=bool)
        for i in np.flatnonzero(part == first):
            other = np.flatnonzero((label != label[i]) & (own | own[i]) & (part == second))
            if first == second:
                other = other[other > i]
            if len(other):
                total = size[other] + size[i]
                bound = total - 2 * (-(-percent * total // (100 + percent)))
                possible[i, other] = (sketch[other] != sketch[i]).sum(axis=1) <= bound
        possible |= possible.T
        found, more = set(), set()
        for i in np.flatnonzero(possible.any(axis=1)):
            other = np.flatnonzero(possible[i])
            other = other[np.argsort(mix((node[other] ^ node[i]).view(np.uint64)), kind="stable")]
            found |= {(min(x, y), max(x, y)) for x, y in ((int(node[i]), int(node[j])) for j in other[:most])}
            if len(other) > most:
                more |= {int(node[i]), *node[other[most:]].tolist()}
        return [(*pair, None) for pair in found] + [(x, None, group[0]["key"]) for x in more]

    def run(batches):
        import pyarrow as pa

        at, group = None, []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.int64()) for i in (0, 1, 2)], ["a", "b", "key"])

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                for row in batch.slice(start, 1024).to_pylist():
                    key = (row["key"], row["first"], row["second"])
                    if key != at and group:
                        yield out(compare(group))
                        group = []
                    at = key
                    group.append(row)
        if group:
            yield out(compare(group))

    return rows.mapInArrow(run, "a long, b long, key long").distinct()


def dealt(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members of buckets, each bucket in parts of about BLOCK, every two of which meet in one task."""
    parts = F.ceil(F.col("m") / F.lit(float(BLOCK))).cast("int")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    both = members.join(sketches, "node").withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    both = both.select("key", F.least("part", "with").alias("first"), F.greatest("part", "with").alias("second"), "part", "own", "node", "n", "label", "sketch")
    return both.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second", "node")


def in_deals(rows: DataFrame, key: str, then) -> DataFrame:
    """then(rows) for each of the DEALS parts of the rows by the hash `key`, each written by itself."""
    return reduce(DataFrame.union, [materialize(then(rows.where(F.pmod(key, F.lit(DEALS)) == i))) for i in range(DEALS)])


def incidence(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """nodes(node, rep) -> node, n, columns: the rows of the matrix as COLUMNS arrays of n-gram hashes. rep names a document of the set."""
    rep = nodes.select(F.col("node").alias("wanted"), F.col("rep.h").alias("h"), F.col("rep.no_id").alias("no_id"), F.col("rep.id").alias("id"))
    given = docs.select(text_hash().alias("h"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "text")

    def run(batches):
        import pyarrow as pa

        edges = np.arange(1, COLUMNS, dtype=np.uint64) << np.uint64(64 - COLUMNS.bit_length() + 1)
        kind = pa.list_(pa.list_(pa.int64()))
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                part = batch.slice(low, STEP)
                node, sizes, sets, had = [], [], [], set()
                for text, wanted in zip(part["text"].to_pylist(), part["wanted"].to_pylist(), strict=True):
                    if wanted in had:  # repeated rows
                        continue
                    had.add(wanted)
                    grams = shingles(text, words)
                    node.append(wanted)
                    sizes.append(len(grams))
                    sets.append(np.split(grams.view(np.int64), np.searchsorted(grams, edges)))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, kind)], ["node", "n", "columns"])

    def part(given):
        texts = given.join(rep, ["h", "no_id", "id"]).select("text", "wanted")
        return texts.mapInArrow(run, "node long, n long, columns array<array<long>>").dropDuplicates(["node"])

    return in_deals(given, "h", part)


def overlap(x: Column, y: Column, n: Column, m: Column, least: Column) -> Column:
    """Overlap of two sets of n and m n-grams, accumulated over their column blocks; no longer once it can't reach `least`."""
    long = lambda c: F.size(c).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("o"), n.alias("x"), m.alias("y"))

    def step(a, z):
        more = F.struct((a["o"] + long(F.array_intersect(z["x"], z["y"]))).alias("o"), (a["x"] - long(z["x"])).alias("x"), (a["y"] - long(z["y"])).alias("y"))
        return F.when(a["o"] + F.least(a["x"], a["y"]) < least, a).otherwise(more)

    return F.aggregate(F.arrays_zip(x.alias("x"), y.alias("y")), start, step, lambda a: a["o"])


def overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose n-grams overlap enough; sets as from incidence()."""
    both = pairs.join(sets.toDF("a", "n", "x"), "a").join(sets.toDF("b", "m", "y"), "b")
    least = F.ceil((F.col("n") + F.col("m")) * percent / F.lit(100 + percent))
    return both.where(overlap(F.col("x"), F.col("y"), F.col("n"), F.col("m"), least) >= least).select("a", "b")


def join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (the smallest doc_id reachable by links), h, component.

    h is text_hash() of the row; component tells components apart even where ids repeat or are null, and is null
    without words. Texts without words have no shingles and are components of their own. One row per input row; rows
    with one doc_id and different texts are documents of their own. A null doc_id has a null component_id only if no
    other id is in its component. Other columns are ignored; an empty table gives no rows. Very long texts are one row
    of a task each, with a few bytes for each word.
    """
    since, docs = mark(), docs.select("doc_id", "text")
    digests = whole = materialize(digest(docs, percent, words))
    names = whole.where("node is not null").groupBy("node")
    rep = F.min(F.struct("h", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id")))
    clashes = [r["node"] for r in names.agg(F.min("node2").alias("x"), F.max("node2").alias("y")).where("x < y").collect()]
    if clashes:  # different sets with the same first 64 bits: n * n / 2**65 of n are expected
        whole = whole.withColumn("node", F.when(F.col("node").isin(clashes), F.xxhash64("node", "node2")).otherwise(F.col("node")))
    rows = materialize(whole.select("doc_id", "h", "n", "node"))
    nodes = materialize(rows.where("node is not null").groupBy("node").agg(rep.alias("rep"), F.min("doc_id").alias("least")))
    flat = whole.where("node is not null").select("node", F.explode("schemes").alias("s"))
    entry = flat.select("node", "s.own", F.explode("s.keys").alias("key"))
    of_key = Window.partitionBy("key")
    # A bucket counts if it holds two different sets, one of them in its own size class; copies of a set are one member.
    mixed = (F.min("node").over(of_key) < F.max("node").over(of_key)) & F.max("own").over(of_key)

    def meeting(entry):
        shared = entry.withColumn("mixed", mixed).where("mixed").select("key", "node", "own").dropDuplicates()
        return shared.withColumn("m", F.count("*").over(of_key)).withColumn("pivot", F.min(F.when(F.col("own"), F.col("node"))).over(of_key))

    shared = in_deals(entry, "key", meeting)
    met = shared.select("node").distinct()
    sketches = materialize(whole.where("sketch is not null").select("node", "n", "sketch").join(met, "node").dropDuplicates(["node"]))
    drop(digests)
    sets = incidence(nodes.select("node", "rep").join(met, "node"), docs, words)
    tried = shared.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    tried = tried.join(sketches.withColumnRenamed("node", "a"), "a").join(sketches.toDF("b", "n2", "sketch2"), "b")
    first = materialize(overlaps(materialize(pivot_pairs(tried, percent)), sets, percent))
    label = components(first)
    # All have met the pivot; the others of a bucket meet if they stand in different components and one is in its own class.
    members = shared.where("node != pivot").drop("pivot").join(label.toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    most = 1
    while True:
        low, high, some, m = F.min("label").over(of_key), F.max("label").over(of_key), F.max("own").over(of_key), F.count("*").over(of_key)
        members = materialize(members.withColumns({"low": low, "high": high, "some": some, "m": m}).where("low < high and some").drop("low", "high", "some"))
        found = materialize(cross_pairs(dealt(members, sketches), percent, most))
        pairs, more = found.where("key is null").select("a", "b"), found.where("key is not null").select("key", F.col("a").alias("node")).distinct()
        if pairs.limit(1).count():
            label = grown(label, materialize(overlaps(pairs, sets, percent)))
        if not more.limit(1).count():
            break
        members = members.drop("label").join(more, ["key", "node"], "left_semi").join(label.toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        most *= WIDEN
    ends = label.toDF("node", "label")
    placed = nodes.select("node", "least").join(ends, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    final = placed.join(smallest, "label").select("node", "component_id", "label")
    out = rows.where("node is not null").join(final, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "h", F.col("label").alias("component"))
    alone = rows.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "h", F.lit(None).cast("long").alias("component"))
    out = materialize(out.unionByName(alone))
    sweep(out.sparkSession, since, out)
    return out


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
