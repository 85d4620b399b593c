"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier.

A suffix array over a whole corpus fits in no task, so the text is first cut into stretches that can be
compared apart: every 100-byte window belongs to the least hash among its 32-byte grams, a run of windows
with the same least hash is a stretch, and equal windows always lie in stretches of the same hash. Stretches
are grouped by that hash; equal stretches (copies, shared passages; by 128-bit digests of their bytes) collapse
to their first, all later ones are removed whole. What is left, different stretches of the same hash, is sorted:
suffixes smaller than their successors directly, the others induced by bucket scans; the windows between adjacent common
prefixes of 100 bytes are equal, and all but the first of them are removed.

A hash whose different stretches exceed GROUP_BYTES (the borders of a passage that very many documents share) is
not one task's work: its stretches are cut again by the least of their 64-byte grams, then by 96 and at last by 100
bytes, and collapse at each level, so that what lies inside the passage is gone before a single window is a
row. Every level sends what is no longer crowded to the same suffix sort; at the last one stretches are equal or
have nothing in common. All levels give the same result, so GROUP_BYTES only says where work is done.

Hot stretches: a task collapses the copies among the texts it has read (CHUNK_BYTES at a time) before anything is
shuffled, deals the copies anywhere, and all but one of the different stretches of a hash by their content.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import materialize, table
from flowloom.llm.jaccard import BASE, mix

LENGTH = 100
#: Bytes of a gram at each level of cutting; at the last a gram is a window.
GRAMS = (32, 64, 96, LENGTH)
#: Bytes of different stretches of a hash that one sort takes at most, before they are cut again.
GROUP_BYTES = 1 << 20
#: Bytes that are sorted at once, about, and that a task collapses at once.
FLUSH, CHUNK_BYTES = 1 << 20, 8 << 20
STEP = 128
LOWEST = -(1 << 63)


def gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` bytes from each place on: doubled spans, put together by the bits of the width."""
    h, span, m = raw.astype(np.uint64) + np.uint64(1), 1, int(BASE)
    out, have = None, 0
    while True:
        if width & span:
            out = h if out is None else out[: len(h) - have] * np.uint64(m) + h[have:]
            have += span
            if have == width:
                return mix(out)
        h = h[: len(h) - span] * np.uint64(m) + h[span:]
        m, span = m * m % (1 << 64), span * 2


def sliding(h: np.ndarray, width: int, pick) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h = pick(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return pick(h[: len(h) - rest], h[rest:]) if rest else h


def stretches(raw: np.ndarray, gram: int = GRAMS[0]):
    """start, windows, least hash, digest (two columns) and whether a window may repeat inside, of each stretch."""
    h, span = gram_hashes(raw, gram), LENGTH - gram + 1
    least = sliding(h, span, np.minimum)
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    count = np.diff(np.concatenate((start, [len(least)])))
    pad = np.zeros(span - 1, dtype=np.uint64)
    chosen = h[sliding(np.concatenate((pad, least, pad)), span, np.maximum) == h]
    values, times = np.unique(chosen, return_counts=True)
    again = values[times > 1]
    key = least[start]
    bytes_, digest = memoryview(raw.tobytes()), hashlib.blake2b
    ends = start + count + LENGTH - 1
    content = np.frombuffer(b"".join([digest(bytes_[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
    return start, count, key, content, (np.isin(key, again) if len(again) else np.zeros(len(key), dtype=bool))


FIELDS = ("deal", "key", "c1", "c2", "doc", "dup", "s", "n", "again", "later", "crowd")
ROWS = "deal long, key long, c1 long, c2 long, doc long, dup long, s int, n int, again boolean, later boolean, crowd boolean"


def collapse(key, c1, c2, doc, dup, s, n, again) -> list[np.ndarray]:
    """The columns FIELDS of a task's stretches, with those that equal an earlier one of them marked `later`.

    deal: where a row goes. Later ones go anywhere; of several different stretches of a hash (`crowd`) one goes by the hash and
    the others by their content; a hash of one stretch is dealt by itself.
    """
    deal, later, crowd = key.copy(), np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    of = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))
    if len(of):
        at = order[of]
        at = at[np.lexsort((s[at], dup[at], doc[at], c2[at], c1[at], key[at]))]
        other_key = np.concatenate(([True], key[at][1:] != key[at][:-1]))
        other = other_key | np.concatenate(([True], (c1[at][1:] != c1[at][:-1]) | (c2[at][1:] != c2[at][:-1])))
        later[at] = ~other
        group = np.cumsum(other_key) - 1
        crowd[at] = (np.bincount(group, other) > 1)[group]
        spread = crowd[at] & ~other_key & other
        deal[at[spread]] = mix((key ^ c1)[at[spread]].view(np.uint64), 7).view(np.int64)
        gone = at[~other]
        deal[gone] = mix((doc[gone] ^ (s[gone].astype(np.int64) << 20)).view(np.uint64), 9).view(np.int64)
    return [deal, key, c1, c2, doc, dup, s, n, again, later, crowd]


def stretch_rows(docs: DataFrame) -> DataFrame:
    """docs(doc, dup, text) -> FIELDS: its stretches by 32-byte grams."""

    def run(batches):
        import pyarrow as pa

        cols, held = [[] for _ in range(8)], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in collapse(*map(np.concatenate, cols))], FIELDS)

        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                part = batch.slice(low, STEP)
                for doc, dup, text in zip(part["doc"].to_pylist(), part["dup"].to_pylist(), part["text"].to_pylist(), strict=True):
                    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                    if len(raw) < LENGTH:
                        continue
                    s, n, key, content, again = stretches(raw)
                    found = (key.view(np.int64), content[:, 0], content[:, 1], np.full(len(s), doc), np.full(len(s), dup), s.astype(np.int32), n.astype(np.int32), again)
                    for c, v in zip(cols, found, strict=True):
                        c.append(v)
                    held += len(raw)
                    if held > CHUNK_BYTES:
                        yield out()
                        cols, held = [[] for _ in range(8)], 0
        if held:
            yield out()

    return docs.mapInArrow(run, ROWS)


def cut_again(pieces: DataFrame, level: int) -> DataFrame:
    """pieces(doc, dup, s, n, data) -> FIELDS and data: their stretches by the grams of `level`."""

    def run(batches):
        import pyarrow as pa

        cols, data, held = [[] for _ in range(8)], [], 0

        def out():
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in collapse(*map(np.concatenate, cols))), pa.array(data, pa.binary())], [*FIELDS, "data"])

        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                for row in batch.slice(low, STEP).to_pylist():
                    raw = np.frombuffer(row["data"], np.uint8)
                    s, n, key, content, again = stretches(raw, GRAMS[level])
                    found = (mix(key, level).view(np.int64), content[:, 0], content[:, 1], np.full(len(s), row["doc"]), np.full(len(s), row["dup"]), (s + row["s"]).astype(np.int32), n.astype(np.int32), again)
                    for c, v in zip(cols, found, strict=True):
                        c.append(v)
                    data += [row["data"][a : a + k + LENGTH - 1] for a, k in zip(s.tolist(), n.tolist(), strict=True)]
                    held += sum(map(len, data[-len(s) :]))
                    if held > CHUNK_BYTES:
                        yield out()
                        cols, data, held = [[] for _ in range(8)], [], 0
        if held:
            yield out()

    return pieces.select("doc", "dup", "s", "n", "data").mapInArrow(run, ROWS + ", data binary")


def word_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number, zeros behind the end."""
    w = np.concatenate((raw, np.zeros(8, np.uint8))).astype(np.uint64)
    for span in (1, 2, 4):
        w = (w[:-span] << np.uint64(8 * span)) | w[span:]
    return w[: len(raw)]


def suffix_array(raw: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in order of at least their first `depth` bytes, by two-stage sorting."""
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.int64)
    rise = np.sign(np.concatenate((raw[1:].astype(np.int16), [-1])) - raw.astype(np.int16))
    at = np.where(rise != 0, np.arange(n), n)
    small = rise[np.minimum.accumulate(at[::-1])[::-1]] > 0  # smaller than the successor; the last one isn't

    # Stage one: direct sort of the small ones, eight bytes at a time, only ties go on.
    word = np.concatenate((word_at(raw), np.zeros(depth + 16, dtype=np.uint64)))
    direct = np.flatnonzero(small)
    direct = direct[np.argsort(word[direct], kind="stable")]
    first = word[direct]
    tied = np.zeros(len(direct), dtype=bool)
    group = np.cumsum(np.concatenate(([0], first[1:] != first[:-1]))) if len(direct) else np.zeros(0, dtype=np.int64)
    for offset in range(8, depth, 8):
        same = group[1:] == group[:-1]
        tied[:] = False
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        g, key = group[where], word[direct[where] + offset]
        order = np.lexsort((key, g))
        direct[where] = direct[where][order]
        g, key = g[order], key[order]
        new = np.zeros(len(group), dtype=np.int64)
        inner = np.concatenate(([False], (g[1:] == g[:-1]) & (key[1:] != key[:-1])))
        new[where[inner]] = 1
        group = group + np.cumsum(new)

    # Stage two: scan the buckets of first bytes in order; each suffix read induces the larger one before it.
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[raw[n - 1]].append(np.array([n - 1]))
    bounds = np.searchsorted(raw[direct], np.arange(257))
    out = []
    # Where the run of one byte that holds a place begins.
    run_start = np.maximum.accumulate(np.where(np.concatenate(([True], raw[1:] != raw[:-1])), np.arange(n), 0))

    def induce(read, bucket):
        """Deals out the larger predecessors of the suffixes read; gives back those of the same bucket."""
        before = read[read > 0] - 1
        before = before[~small[before]]
        byte = raw[before]
        stay, go = before[byte == bucket], byte != bucket
        before, byte = before[go], byte[go]
        if len(before):
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cuts = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
            for piece, b in zip(np.split(before, cuts[1:]), byte[cuts], strict=True):
                pending[b].append(piece)
        return stay

    for c in range(256):
        read = np.concatenate(pending[c]) if pending[c] else np.zeros(0, dtype=np.int64)
        pending[c] = []
        for _ in range(depth):
            if not len(read):
                break
            out.append(read)
            read = induce(read, c)
        if len(read):  # all that is left of these runs starts with `depth` times this byte: any order will do
            begin = run_start[read]
            count = read - begin + 1
            out.append(np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum()))
            induce(begin, c)
        read = direct[bounds[c] : bounds[c + 1]]
        out.append(read)
        induce(read, c)
    return np.concatenate(out)


def common_prefixes(raw: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length, up to LENGTH, of the common prefix of each suffix in order with the one before it; the first has none."""
    word = np.concatenate((word_at(raw), np.zeros(LENGTH + 8, dtype=np.uint64)))
    out, at = np.zeros(len(order), dtype=np.int64), np.arange(1, len(order))
    bounds = np.uint64(1) << np.arange(56, -8, -8, dtype=np.uint64)
    for offset in range(0, LENGTH, 8):
        differ = word[order[at] + offset] ^ word[order[at - 1] + offset]
        out[at] += (differ[:, None] < bounds).sum(axis=1)
        at = at[differ == 0]
    return np.minimum(out, LENGTH)


def repeated_windows(raw: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Places of the valid windows that equal a valid window before them."""
    order = suffix_array(raw)
    order = order[valid[order]]
    if not len(order):
        return order
    starts = np.flatnonzero(common_prefixes(raw, order) < LENGTH)
    least = np.minimum.reduceat(order, starts)
    return np.sort(order[order > np.repeat(least, np.diff(np.concatenate((starts, [len(order)]))))])


def sort_stretches(rows: DataFrame) -> DataFrame:
    """rows(key, doc, dup, s, n, data), sorted by key -> doc, dup, low, high of the removed runs."""

    def flush(group):
        import pyarrow as pa

        group.sort(key=lambda g: (g["doc"], g["dup"], g["s"]))
        raw = np.frombuffer(b"".join(g["data"] for g in group), np.uint8)
        n = np.array([g["n"] for g in group])
        base = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        valid = np.zeros(len(raw), dtype=bool)
        valid[np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())] = True
        gone = repeated_windows(raw, valid)
        if not len(gone):
            return None
        of = np.searchsorted(base, gone, side="right") - 1
        new = np.concatenate(([True], (gone[1:] != gone[:-1] + 1) | (of[1:] != of[:-1])))
        low, high = gone[new], gone[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(gone) - 1]))] + LENGTH
        of = of[new]
        shift = np.array([g["s"] for g in group])[of] - base[of]
        cols = [np.array([g[c] for g in group])[of] for c in ("doc", "dup")]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(low + shift, pa.int32()), pa.array(high + shift, pa.int32())], ["doc", "dup", "low", "high"])

    def run(batches):
        group, size, at = [], 0, None
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                for row in batch.slice(low, 1024).to_pylist():
                    if row["key"] != at and size > FLUSH:
                        if (out := flush(group)) is not None:
                            yield out
                        group, size = [], 0
                    at = row["key"]
                    group.append(row)
                    size += len(row["data"])
        if group and (out := flush(group)) is not None:
            yield out

    return rows.mapInArrow(run, "doc long, dup long, low int, high int")


def stretch_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stretches wanted(key, doc, dup, s, n) with their bytes, `data`."""
    asked = wanted.groupBy("doc", "dup").agg(F.collect_list(F.struct("key", "s", "n")).alias("asked"))
    both = docs.join(asked, ["doc", "dup"]).select("doc", "dup", "text", "asked")

    def run(batches):
        import pyarrow as pa

        names = ["key", "doc", "dup", "s", "n", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                part = batch.slice(low, STEP)
                rows = []
                for doc, dup, text, asked in zip(*(part[c].to_pylist() for c in ("doc", "dup", "text", "asked")), strict=True):
                    whole = text.encode("utf-8", "surrogatepass")
                    rows += [(a["key"], doc, dup, a["s"], a["n"], whole[a["s"] : a["s"] + a["n"] + LENGTH - 1]) for a in asked]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return both.mapInArrow(run, "key long, doc long, dup long, s int, n int, data binary")


def classify(rows: DataFrame) -> DataFrame:
    """Of FIELDS and more: the stretches to remove whole (later) and those that may share windows with others."""
    rows = rows.repartition("deal")
    turn = F.row_number().over(Window.partitionBy("deal", "key", "c1", "c2").orderBy("doc", "dup", "s"))
    rows = rows.withColumn("later", F.col("later") | (turn > 1))
    of_key = Window.partitionBy("deal", "key")
    rows = rows.withColumn("m", F.sum((~F.col("later")).cast("int")).over(of_key)).withColumn("some", F.max("crowd").over(of_key))
    return rows.where("later or m > 1 or some or again or crowd").drop("deal", "m", "some", "again", "crowd")


def crowded(found: DataFrame) -> DataFrame:
    """The hashes (k) that hold too many different stretches for one sort."""
    return materialize(found.where("not later").groupBy(F.col("key").alias("k")).agg(F.count("*").alias("m"), F.sum(F.col("n") + LENGTH - 1).alias("size")).where((F.col("m") > 1) & (F.col("size") > GROUP_BYTES)).select("k"))


def whole_runs(found: DataFrame) -> DataFrame:
    return found.where("later").select("doc", "dup", F.col("s").alias("low"), (F.col("s") + F.col("n") + LENGTH - 1).alias("high"))


def removed_runs(docs: DataFrame) -> DataFrame:
    """doc, dup, low, high: byte runs whose bytes go; they overlap."""
    found = materialize(classify(stretch_rows(docs)))
    runs, sorts, level = whole_runs(found), None, 0
    pieces = materialize(stretch_bytes(docs, found.where("not later").drop("c1", "c2", "later")))
    many = crowded(found)
    while True:
        more = level + 1 < len(GRAMS) and bool(many.limit(1).count())
        few = pieces.join(many, pieces.key == many.k, "left_anti") if more else pieces
        few = few.select("key", "doc", "dup", "s", "n", "data")
        sorts = few if sorts is None else sorts.unionByName(few)
        if not more:
            break
        level += 1
        found = materialize(classify(cut_again(pieces.join(many, pieces.key == many.k, "left_semi"), level)))
        runs, pieces, many = runs.unionByName(whole_runs(found)), found.where("not later"), crowded(found)
    return runs.unionByName(materialize(sort_stretches(sorts.repartition("key").sortWithinPartitions("key"))))


def dedup(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, removed (array of low, high: maximal byte runs), kept (binary).

    Texts are taken as UTF-8; a null text is empty. A null doc_id comes before all others; rows that repeat a
    doc_id come in the order of a hash of their text. One row per input row. An empty table gives no rows, other columns are not read. A
    very long text is cut into stretches in one task, with some 100 bytes of arrays for each byte of it.
    """
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(LOWEST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    if docs.groupBy("doc").count().where("count > 1").limit(1).count():
        docs = docs.withColumn("dup", F.xxhash64("text")).groupBy("doc", "dup").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
        docs = materialize(docs)
    else:
        docs = docs.withColumn("dup", F.lit(0).cast("long")).withColumn("copies", F.lit(1).cast("long"))
    runs = removed_runs(docs).groupBy("doc", "dup").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    both = docs.join(runs, ["doc", "dup"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "text", "runs", "copy")

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                part = batch.slice(low, STEP)
                sizes, spans, kept = [], [], []
                for text, runs_, copy in zip(part["text"].to_pylist(), part["runs"].to_pylist(), part["copy"].to_pylist(), strict=True):
                    whole = text.encode("utf-8", "surrogatepass")
                    if copy > 1:  # all its windows stand in the row before
                        runs_ = [{"low": 0, "high": len(whole)}] if len(whole) >= LENGTH else []
                    merged: list[list[int]] = []
                    for a, b in sorted((r["low"], r["high"]) for r in runs_ or ()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    ends = [0, *(x for m in merged for x in m), len(whole)]
                    sizes.append(len(whole))
                    spans.append([{"low": a, "high": b} for a, b in merged])
                    kept.append(b"".join(whole[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<low:long,high:long>>, kept binary")


def op6_suffixes(spark, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents"))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["high"] - r["low"])
    return done.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
