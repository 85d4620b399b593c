"""Mixing sources to target weights (native: DataFrame functions only).

Method: a low-discrepancy schedule. Slot k gets the golden-ratio point frac(k * phi), which is mapped
through the cumulative slot shares of the sources; the slots of a source are ranked, and the slot of rank r
takes block r of the source's shuffled word stream, cut into blocks of equal word counts. A pass over all
blocks of a source repeats when its target is above its size.

Scale: no group is ever gathered. The running word position of a document inside its source comes from a
two-level prefix sum over (source, hash prefix), slot ranks from a two-level count over (source, slot chunk),
and the point-to-source map is an equi-join on grid cells. Only the table of sources (one row per source)
is windowed without a partition key.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import materialize, table, word_count

PHI = (math.sqrt(5) - 1) / 2
CELLS = 1024
CHUNK = 1024
#: Documents of one source under one hash prefix, on average.
PER_BUCKET = 256


def golden(k):
    """frac(k * phi) for k below 2**40, with k split so that no product loses its fraction."""
    high, low = F.shiftright(k, 20), k.bitwiseAND(F.lit((1 << 20) - 1))
    x = high * F.lit(((1 << 20) * PHI) % 1.0) + low * F.lit(PHI)
    return x - F.floor(x)


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source_rank, source, source_size, weight, target (double).

    Sources stand in code point order, null last; weights repeat along that order. The targets share
    `share` times all sizes by weight; a target stops at `cap` times its source's size and the excess is
    shared again by weight (the fixed point: target = min(cap * size, level * weight)).
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    pick = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    src = src.withColumn("source_rank", rank).withColumn("weight", F.element_at(pick, ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    src = src.withColumn(
        "level",
        (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    free = F.col("ratio") > F.col("level")
    level = F.min_by(F.when(free, F.col("level")), F.when(free, F.col("ratio"))).over(whole)
    return src.withColumn("target", F.when(free, level * F.col("weight")).otherwise(F.col("cap"))).select("source_rank", "source", "source_size", "weight", "target")


def mix_schedule(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 2048) -> DataFrame:
    """The mix as rows (doc_id, size, source_size, target, start, slot, word_from, word_to).

    `sized` has doc_id, source, size. Words word_from..word_to (exclusive) of the document are read at that
    slot of the schedule; a document outside the mix, or without words, has one row with a null slot.
    Repeated rows are separate documents. Ties in the shuffle order are broken by size. An empty table
    gives no rows.
    """
    spark = sized.sparkSession
    n = sized.count()
    digits = max(1, math.ceil(math.log(max(n, 1) / PER_BUCKET, 16))) if n > PER_BUCKET else 1
    sized = sized.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bucket", F.substring("h", 1, digits))
    src = source_targets(sized, weights, share, cap)
    size, goal, b = F.col("source_size"), F.col("goal"), F.lit(int(block_words)).cast("long")
    src = src.withColumn("goal", F.floor(F.col("target") + 0.5).cast("long")).withColumn("blocks", F.ceil(size / b).cast("long"))
    turns = F.when(size > 0, F.floor(goal / F.greatest(size, F.lit(1))).cast("long")).otherwise(0)
    src = src.withColumn("slots", F.when(size > 0, turns * F.col("blocks") + F.ceil((goal - turns * size) / b)).otherwise(0).cast("long"))
    order = Window.orderBy("source_rank")
    src = src.withColumn("slot_to", F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    src = materialize(src.withColumn("slot_from", F.col("slot_to") - F.col("slots")))
    total = src.agg(F.max("slot_to")).first()[0] or 0

    # Golden-ratio points through the cumulative shares: an equi-join on grid cells and an exact bound.
    grid = lambda c: F.least(F.floor(c / F.lit(max(total, 1)) * CELLS), F.lit(CELLS - 1)).cast("long")
    cells = src.where("slots > 0").withColumn("cell", F.explode(F.sequence(grid(F.col("slot_from")), grid(F.col("slot_to")))))
    points = spark.range(total).select(F.col("id").alias("slot"), golden(F.col("id")).alias("u"))
    points = points.withColumn("cell", F.least(F.floor(F.col("u") * CELLS), F.lit(CELLS - 1)).cast("long"))
    at = F.col("u") * F.lit(max(total, 1))
    drawn = points.join(cells, "cell").where((at >= F.col("slot_from")) & (at < F.col("slot_to"))).withColumn("chunk", F.shiftright("slot", 10))
    per_chunk = drawn.groupBy("source_rank", "chunk").agg(F.count("*").alias("here"))
    earlier = Window.partitionBy("source_rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = per_chunk.withColumn("earlier", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("source_rank", "chunk").orderBy("slot")) - 1
    ranked = (
        drawn.withColumn("within", within)
        .join(per_chunk.select("source_rank", "chunk", "earlier"), ["source_rank", "chunk"])
        .select("slot", "source_rank", (F.col("earlier") + F.col("within")).alias("rank"), "source_size", "goal", "blocks", "slots")
        .where("rank < slots")
    )
    # The points give a source a few slots more or less than its share: surplus ranks went above, closing slots follow.
    got = per_chunk.groupBy("source_rank").agg(F.sum("here").alias("got"))
    closing = (
        src.join(got, "source_rank", "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .where("got < slots")
        .withColumn("rank", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)))
        .select((F.lit(total) + F.col("rank") - F.col("got")).alias("slot"), "source_rank", "rank", "source_size", "goal", "blocks", "slots")
    )
    slots = ranked.unionByName(closing)
    turn, block = F.floor(F.col("rank") / F.col("blocks")).cast("long"), F.col("rank") % F.col("blocks")
    slots = slots.select(
        "source_rank", block.alias("block"), "slot",
        F.least((block + 1) * b, F.col("source_size"), F.col("goal") - turn * F.col("source_size")).alias("slot_end"),
    )

    # Shuffled word streams: position of each document inside its source.
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    per_bucket = per_bucket.join(src.select("source", "source_rank", "source_size", "target"), per_bucket.source.eqNullSafe(src.source)).drop(src.source)
    earlier = Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("first", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words").withColumnRenamed("source", "s").withColumnRenamed("bucket", "k")
    inside = Window.partitionBy("source_rank", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.join(per_bucket, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
        .withColumn("start", F.col("first") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .select("doc_id", "size", "source_size", "target", "source_rank", "start")
    )
    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b).cast("long"), F.floor((end - 1) / b).cast("long"))))
    pieces = pieces.withColumn("low", F.greatest("start", F.col("block") * b)).withColumn("high", F.least(end, (F.col("block") + 1) * b))
    taken = F.when(F.col("slot").isNotNull(), F.least("high", "slot_end")).otherwise(F.col("low"))
    mixed = pieces.join(slots, ["source_rank", "block"], "left").select(
        "doc_id", "size", "source_size", "target", "source_rank", "start", "slot",
        (F.col("low") - F.col("start")).alias("word_from"), (F.greatest(taken, F.col("low")) - F.col("start")).alias("word_to"),
    )
    none = F.lit(0).cast("long")
    wordless = placed.where("size = 0").select("doc_id", "size", "source_size", "target", "source_rank", "start", F.lit(None).cast("long").alias("slot"), none.alias("word_from"), none.alias("word_to"))
    return mixed.unionByName(wordless)


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every document, written once: the texts are read a single time."""
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 2048) -> DataFrame:
    """Words that the mix takes of each document, and where in the schedule: doc_id, size, source_size, target, taken,
    first_slot (null if nothing is taken), n_slots.

    `docs` has doc_id, source, text; other columns are ignored, whatever their names. A null text has size 0 and takes 0.
    A null source is a source of its own, the last one. One row per input row; repeated rows are documents of their
    own, and a very long text is many slots. An empty table gives no rows.
    """
    plan = mix_schedule(sized_documents(docs), weights, share, cap, block_words)
    keyed = plan.where("size > 0").groupBy("source_rank", "start", "doc_id", "size", "source_size", "target")
    read = F.when(F.col("word_to") > F.col("word_from"), F.col("slot"))
    keyed = keyed.agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"), F.min(read).alias("first_slot"), F.count(read).alias("n_slots"))
    cols = ["doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots"]
    none = {"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long"), "n_slots": F.lit(0).cast("long")}
    return keyed.select(cols).unionByName(plan.where("size = 0").withColumns(none).select(cols))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (source_rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CAST(2 AS DOUBLE) * source_size AS cap FROM src),
levels AS (
  SELECT *, cap / weight AS ratio,
    (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed
  WINDOW w AS (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT *, CASE WHEN ratio > level THEN min_by(level, ratio) FILTER (WHERE ratio > level) OVER () * weight ELSE cap END AS target FROM levels),
src2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN turns * blocks + CAST(ceil((goal - turns * source_size) / 2048.0) AS BIGINT) ELSE 0 END AS slots
  FROM (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS turns, CAST(ceil(source_size / 2048.0) AS BIGINT) AS blocks
    FROM (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM targets))),
src3 AS (SELECT *, CAST(sum(slots) OVER (ORDER BY source_rank) AS BIGINT) AS slot_to FROM src2),
src4 AS (SELECT *, slot_to - slots AS slot_from, max(slot_to) OVER () AS total FROM src3),
points AS (SELECT slot, x - floor(x) AS u FROM (
  SELECT slot, CAST(slot >> 20 AS DOUBLE) * CAST('{((1 << 20) * PHI) % 1.0!r}' AS DOUBLE) + CAST(slot & 1048575 AS DOUBLE) * CAST('{PHI!r}' AS DOUBLE) AS x
  FROM (SELECT unnest(range((SELECT coalesce(max(total), 0) FROM src4))) AS slot))),
drawn AS (
  SELECT t.*, p.slot, row_number() OVER (PARTITION BY t.source_rank ORDER BY p.slot) - 1 AS rank
  FROM points p JOIN src4 t ON t.slots > 0 AND p.u * t.total >= t.slot_from AND p.u * t.total < t.slot_to),
got AS (SELECT t.source_rank, count(d.slot) AS got FROM src4 t LEFT JOIN drawn d USING (source_rank) GROUP BY t.source_rank),
ranked AS (
  SELECT source_rank, slot, rank, blocks, goal, source_size FROM drawn WHERE rank < slots
  UNION ALL SELECT source_rank, total + rank - got, rank, blocks, goal, source_size
    FROM (SELECT t.*, got, unnest(range(got, t.slots)) AS rank FROM src4 t JOIN got USING (source_rank) WHERE got < t.slots)),
sched AS (
  SELECT source_rank, rank % blocks AS block, slot, least((rank % blocks + 1) * 2048, source_size, goal - rank // blocks * source_size) AS slot_end FROM ranked),
placed AS (
  SELECT row_number() OVER () AS rid, s.doc_id, s.size, t.source_rank, t.source_size, t.target,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY t.source_rank ORDER BY s.h, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
pieces AS (
  SELECT rid, source_rank, block, greatest(start, block * 2048) AS low, least(start + size, (block + 1) * 2048) AS high
  FROM (SELECT *, unnest(range(start // 2048, (start + size - 1) // 2048 + 1)) AS block FROM placed WHERE size > 0)),
reads AS (SELECT rid, slot, least(high, slot_end) - low AS n FROM pieces JOIN sched USING (source_rank, block) WHERE least(high, slot_end) > low),
sums AS (SELECT rid, CAST(sum(n) AS BIGINT) AS taken, min(slot) AS first_slot, count(*) AS n_slots FROM reads GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots FROM placed LEFT JOIN sums USING (rid)
"""
