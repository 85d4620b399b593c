"""Ranked lexical search with block-max pruning.

`index` cuts the documents of each partition, in order of their ids, into blocks. A block holds its documents' terms and
frequencies (the forward index) and, for each of its terms, the largest part of a score that the term gives any of
its documents. The sum of weight times maximum over a query's terms bounds what any document of the block can score.

`search` reads the index twice. First only the maxima: the blocks of the highest bounds of each query are scored, and the
k-th best score found is the query's threshold. Then every other block, sorted by bound among those read together, is scored
until the bound drops below the threshold, which rises as better documents turn up. A block whose bound equals the threshold is
scored, as a document of equal score and smaller id may lie in it. Results are those of scoring every document.

Nothing is shuffled by term, so a very common term is no hot key, and copies of one document give at most k rows for each
task. Queries go to the tasks in groups of at most `ITEMS`, which bounds what is broadcast.

Defined cases: a text that is null or has no term gives no document (it counts in neither N nor L); an empty table of documents
gives no rows; a query without terms gives no rows; rows of one item_id, null included, are one item with the terms of all of them;
rows that repeat a doc_id are documents of their own, rows without one come after others of equal score; very long texts are one
row of their block; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import materialize, table

#: Documents of a block, and distinct (document, term) entries after which a block ends early.
DOCS, ENTRIES = 64, 1 << 15
#: Blocks of the highest bounds that give a query its first threshold.
FIRST = 4
#: Queries that are searched for together.
ITEMS = 1000
#: Terms of the queries up to which an index for known queries is limited to these.
VOCABULARY = 1 << 20
#: Results for each query.
BEST = 10
#: ASCII digits and letters and all bytes of longer characters are parts of terms; A-Z are lower-cased, the rest are gaps.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
#: Rows of an Arrow batch handled at once.
STEP = 128


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text with repeats: maximal runs of ASCII letters, digits and characters above ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def forward(docs: DataFrame, vocabulary: set[bytes] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n (terms with repeats), terms (distinct, between spaces), tfs (32-bit integers), for each text with a term.

    With a vocabulary, only its terms are listed.
    """
    wanted = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                ids, ns, terms, tfs = [], [], [], []
                part = batch.slice(low, STEP)
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    if found := terms_of(text):
                        counts = Counter(found if wanted is None else filter(wanted.value.__contains__, found))
                        ids.append(doc)
                        ns.append(len(found))
                        terms.append(b" ".join(counts).decode("utf-8", "replace"))
                        tfs.append(np.fromiter(counts.values(), np.int32, len(counts)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.string()), pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms string, tfs binary")


def impact(tf: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """What a term of frequency tf gives a document of n terms, before its weight; total documents hold `length` terms."""
    if 90 * int(n.max(initial=0)) * total < 1 << 63:
        m = 10 + (90 * n * total) // length
    else:
        m = np.array([10 + 90 * int(x) * total // length for x in n], dtype=np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


#: A block; terms lie between spaces, the other binary columns are arrays of 32-bit integers.
BLOCK = "block long, doc_ids array<long>, ends binary, places binary, gives binary, terms string, most binary"


def index(docs: DataFrame, vocabulary: set[bytes] | None = None) -> tuple[DataFrame, DataFrame, int, int]:
    """Blocks (as BLOCK), document frequencies (term, df), N and L.

    In a block document i has the entries from ends[i - 1] to ends[i]: places in `terms`, and what each gives before its weight.
    """
    rows = materialize(forward(docs, vocabulary))
    total, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = rows.where("terms != ''").select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number, held, entries = TaskContext.get().partitionId() << 32, [], 0

        def block():
            nonlocal number
            names: dict[str, int] = {}
            places = np.array([names.setdefault(t, len(names)) for h in held for t in h[2]], np.int32)
            sizes = [len(h[2]) for h in held]
            tf, n = np.concatenate([h[3] for h in held]).astype(np.int64), np.repeat(np.array([h[1] for h in held], np.int64), sizes)
            gives = impact(tf, n, total, length)
            most = np.zeros(len(names), np.int64)
            np.maximum.at(most, places, gives)
            number += 1
            small = lambda x: pa.array([np.asarray(x, np.int32).tobytes()], pa.binary())
            cols = [pa.array([number - 1]), pa.array([[h[0] for h in held]], pa.list_(pa.int64())), small(np.cumsum(sizes)), small(places), small(gives), pa.array([" ".join(names)]), small(most)]
            return pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "ends", "places", "gives", "terms", "most"])

        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                part = batch.slice(low, STEP)
                for doc, n, terms, tfs in zip(*(part[c].to_pylist() for c in ("doc_id", "n", "terms", "tfs")), strict=True):
                    if terms:
                        held.append((doc, n, terms.split(" "), np.frombuffer(tfs, np.int32)))
                        entries += len(held[-1][2])
                    if len(held) >= DOCS or entries >= ENTRIES:
                        yield block()
                        held, entries = [], 0
        if held:
            yield block()

    blocks = rows.sortWithinPartitions("doc_id").mapInArrow(pack, BLOCK)
    return materialize(blocks), frequencies, total, length


class Queries:
    """Queries as flat arrays: the entries of query i, from starts[i] on, are (place of a term, weight); no query is empty."""

    def __init__(self, found: dict, weights: dict[str, int]):
        listed = [(item, [t for t in sorted(terms) if t in weights]) for item, terms in found.items()]
        listed = [(item, terms) for item, terms in listed if terms]
        self.items = [item for item, _ in listed]
        self.place = {t: i for i, t in enumerate(sorted({t for _, terms in listed for t in terms}))}
        self.at = np.array([self.place[t] for _, terms in listed for t in terms], np.int64)
        self.weight = np.array([weights[t] for _, terms in listed for t in terms], np.int64)
        self.starts = np.cumsum([0, *(len(terms) for _, terms in listed)])[:-1]

    def bounds(self, batch) -> np.ndarray:
        """For each block of a batch and each query, what no document of the block scores above."""
        out, get = [], self.place.get
        for terms, most in zip(batch["terms"].to_pylist(), batch["most"].to_pylist(), strict=True):
            held = np.zeros(len(self.place) + 1, np.int64)  # the last place is that of terms in no query
            held[[get(t, -1) for t in terms.split(" ")]] = np.frombuffer(most, np.int32)
            out.append(np.add.reduceat(held[self.at] * self.weight, self.starts))
        return np.array(out)

    def scorer(self, block: dict):
        """Ids of a block's documents, and a function of a query's number: their scores."""
        of = lambda c: np.frombuffer(block[c], np.int32)
        back = np.array([self.place.get(t, -1) for t in block["terms"].split(" ")], np.int64)
        at, gives, ends, stops = back[of("places")], of("gives").astype(np.int64), of("ends"), [*self.starts[1:], len(self.at)]

        def scores(q: int) -> np.ndarray:
            weight = np.zeros(len(self.place) + 1, np.int64)
            mine = slice(self.starts[q], stops[q])
            weight[self.at[mine]] = self.weight[mine]
            return np.diff(np.cumsum(weight[at] * gives)[ends - 1], prepend=0)

        return block["doc_ids"], scores


def better(row) -> tuple:
    """Order of results: higher score, then smaller id, those without one last."""
    return -row[2], row[1] is None, row[1] or 0


def best_of(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows (q, doc_id, score) of each query with their rank."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rows_of(found: list) -> object:
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["q", "doc_id", "score"])


def slices(batches):
    """Batches of at most STEP blocks, none empty."""
    for batch in batches:
        for low in range(0, batch.num_rows, STEP):
            yield batch.slice(low, STEP)


def highest_blocks(blocks: DataFrame, queries, most: int) -> DataFrame:
    """q, block: the `most` blocks of each query with the highest bounds above 0. Reads the maxima only."""

    def run(batches):
        import pyarrow as pa

        asked, top, at = queries.value, None, None
        for part in slices(batches):
            bounds = asked.bounds(part)
            ids = np.repeat(part["block"].to_numpy()[:, None], bounds.shape[1], 1)
            if top is not None:
                bounds, ids = np.vstack([top, bounds]), np.vstack([at, ids])
            order = np.argsort(-bounds, axis=0, kind="stable")[:most]
            top, at = np.take_along_axis(bounds, order, 0), np.take_along_axis(ids, order, 0)
        if top is not None:
            q = np.repeat(np.arange(top.shape[1], dtype=np.int32)[None], top.shape[0], 0)
            keep = top > 0
            yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(at[keep]), pa.array(top[keep])], ["q", "block", "bound"])

    found = blocks.select("block", "terms", "most").mapInArrow(run, "q int, block long, bound long")
    order = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("q", "block")


def score_chosen(blocks: DataFrame, chosen: dict[int, list[int]], queries, k: int) -> DataFrame:
    """The k best (q, doc_id, score) of each chosen pair of block and query."""

    def run(batches):
        for part in slices(batches):
            out = []
            for block in part.to_pylist():
                ids, scores = queries.value.scorer(block)
                for q in chosen[block["block"]]:
                    out += sorted(((q, d, s) for d, s in zip(ids, scores(q).tolist(), strict=True) if s > 0), key=better)[:k]
            yield rows_of(out)

    return blocks.where(F.col("block").isin(list(chosen))).mapInArrow(run, "q int, doc_id long, score long")


def score_rest(blocks: DataFrame, queries, thresholds, k: int) -> DataFrame:
    """For each task, the k best (q, doc_id, score) of each query that reach its threshold."""

    def run(batches):
        asked, floor = queries.value, thresholds.value.copy()
        best: dict[int, list] = {}
        for part in slices(batches):
            bounds, scorers = asked.bounds(part), {}
            for q in np.flatnonzero((bounds >= floor).any(0)).tolist():
                for b in np.argsort(-bounds[:, q], kind="stable").tolist():
                    if bounds[b, q] < floor[q]:
                        break
                    if b not in scorers:
                        scorers[b] = asked.scorer(part.slice(b, 1).to_pylist()[0])
                    ids, scores = scorers[b]
                    found = scores(q)
                    at = np.flatnonzero(found >= floor[q]).tolist()
                    best[q] = sorted([*best.get(q, []), *((q, ids[i], int(found[i])) for i in at)], key=better)[:k]
                    if len(best[q]) == k:
                        floor[q] = max(floor[q], best[q][-1][2])
        yield rows_of([row for rows in best.values() for row in rows])

    return blocks.mapInArrow(run, "q int, doc_id long, score long")


def query_terms(queries: DataFrame) -> dict:
    """item -> its set of terms. For a bounded number of items."""
    found: dict = {}
    for r in queries.select("item_id", "text").collect():
        found.setdefault(r["item_id"], set()).update(terms_of(r["text"]))
    return found


def search(blocks: DataFrame, frequencies: DataFrame, total: int, found: dict, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of each of at most ITEMS queries (item -> terms)."""
    spark = blocks.sparkSession
    context = spark.sparkContext
    asked_for = {i: {t.decode("utf-8", "replace") for t in terms} for i, terms in found.items()}
    wanted = spark.createDataFrame([(t,) for t in sorted(set().union(*asked_for.values()))], "term string")
    held = frequencies.join(F.broadcast(wanted), "term").collect()  # one row for each term of the queries at most
    weights = {r["term"]: math.floor(1000 * math.log((2 * total + 2) / (2 * r["df"] + 1))) for r in held}
    asked = Queries(asked_for, weights)
    if not asked.items:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    sent = context.broadcast(asked)
    chosen: dict[int, list[int]] = {}
    for r in highest_blocks(blocks, sent, FIRST).collect():  # FIRST rows for each query
        chosen.setdefault(r["block"], []).append(r["q"])
    floor = np.ones(len(asked.items), np.int64)
    for r in best_of(score_chosen(blocks, chosen, sent, k), k).where(F.col("rank") == k).collect():
        floor[r["q"]] = r["score"]
    ranked = best_of(score_rest(blocks, sent, context.broadcast(floor), k), k)
    names = spark.createDataFrame(list(enumerate(asked.items)), "q int, item_id long")
    return ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def search_all(docs: DataFrame, queries: DataFrame, k: int = BEST) -> DataFrame:
    """docs(doc_id, text), queries(item_id, text) -> item_id, rank, doc_id, score.

    The index is limited to the queries' terms if they are at most VOCABULARY in number; otherwise it holds every term. Queries are
    searched for in groups of about ITEMS at most; rows of one item_id are in one group.
    """
    queries = queries.select(F.col("item_id").cast("long"), "text")
    groups = -(-queries.select("item_id").distinct().count() // ITEMS)
    part = lambda g: query_terms(queries.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g))
    vocabulary: set | None = set()
    for g in range(groups):
        vocabulary |= set().union(*part(g).values())
        if len(vocabulary) > VOCABULARY:
            vocabulary = None
            break
    blocks, frequencies, total, _ = index(docs, vocabulary)
    frequencies = materialize(frequencies) if groups > 1 else frequencies
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for g in range(groups):
        found = search(blocks, frequencies, total, part(g), k)
        out = found if groups == 1 else out.unionByName(materialize(found))
    return out


def op13_search(spark, sf_dir: str) -> DataFrame:
    return search_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"""
OP13_SQL = f"""
WITH tokens AS (SELECT doc_id, row_number() OVER () AS row_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_id, row_id, terms, len(terms) AS n FROM tokens WHERE len(terms) > 0),
totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs),
tf AS (SELECT doc_id, row_id, n, term, count(*) AS tf FROM (SELECT doc_id, row_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
scored AS (
  SELECT item_id, doc_id, row_id,
    CAST(sum(CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) CROSS JOIN totals GROUP BY item_id, doc_id, row_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""
