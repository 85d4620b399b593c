"""Edge sources: flights, check-ins and replies as (id, ts, from_lon, from_lat, to_lon, to_lat[, texts]).

The tables carry no coordinates; places are derived from integer keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lon(key, salt: int = 0) -> Column:
    return ((F.col(key) if isinstance(key, str) else key) * 7919 + salt) % 36000 / F.lit(100.0) - F.lit(180.0)


def lat(key, salt: int = 0) -> Column:
    return ((F.col(key) if isinstance(key, str) else key) * 6101 + salt) % 17000 / F.lit(100.0) - F.lit(85.0)


def _place(key, prefix, salts=(0, 0)):
    return [lon(key, salts[0]).alias(f"{prefix}_lon"), lat(key, salts[1]).alias(f"{prefix}_lat")]


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier of each line item, at its order's date."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    return joined.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_orderdate").alias("ts"), *_place("o_custkey", "from"), *_place("l_suppkey", "to", (13, 17)))


def checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a user's event to the next one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    moved = events.withColumn("before", before).where("before is not null")
    return moved.select(F.col("event_id").alias("id"), "ts", *_place("before", "from"), *_place("event_id", "to"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a turn of a conversation to the turn that it answers, with both texts."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("to_text", F.lag("text").over(w)).withColumn("to_turn", F.lag("turn").over(w)).where("to_turn is not null")
    key, answered = F.col("conv_id") * 1000 + F.col("turn"), F.col("conv_id") * 1000 + F.col("to_turn")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return pairs.select(key.alias("id"), ts.alias("ts"), *_place(key, "from"), *_place(answered, "to", (13, 17)), F.col("text").alias("from_text"), "to_text")


def adapt(df: DataFrame, id_col: str, time_col: str, coords: tuple[str, str, str, str], texts: tuple[str, str] | None = None) -> DataFrame:
    """Any table with a time and four coordinates as an edge source."""
    names = ("from_lon", "from_lat", "to_lon", "to_lat")
    cols = [F.col(id_col).alias("id"), F.col(time_col).alias("ts"), *[F.col(c).cast("double").alias(n) for c, n in zip(coords, names, strict=True)]]
    return df.select(*cols, *([F.col(texts[0]).alias("from_text"), F.col(texts[1]).alias("to_text")] if texts else []))


def jdbc(spark: SparkSession, url: str, dbtable: str, column: str, lower: str, upper: str, partitions: int, **options) -> DataFrame:
    """A table of a database, read in ranges of `column`; credentials come from the caller."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=dbtable, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.options(**options).load()
