"""Dense numbers in a global order without a single task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.store import settle

#: Bits of monotonically_increasing_id below the partition's number.
LOCAL = 33


def dense_ids(rows: DataFrame, *keys: str, name: str = "id") -> DataFrame:
    """Adds `name`: 0, 1, 2 and so on in the order of `keys`.

    Rows are dealt by ranges of the keys and sorted inside; a row's number is its place there plus the sizes of the ranges before. The
    driver sees one count for each partition. Rows of equal keys get different numbers in no fixed order.
    """
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settle(sorted_.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", LOCAL)
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    before = [0, *accumulate(n for _, n in counts)]
    starts = placed.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part long, _before long")
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row for each partition
    return joined.select(*rows.columns, (F.col("_before") + F.col("_m").bitwiseAND((1 << LOCAL) - 1)).alias(name))
