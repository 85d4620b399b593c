"""Raw JSON lines to reply rows, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAME_PLACE = 1e-5
# The field names of the raw feed.
RAW = (
    "ds_tweet_reply_graph struct<tweet_from:bigint,tweet_to:bigint,from_create_at:string,to_create_at:string,from_text:string,to_text:string,"
    "from_coordinate:array<double>,to_coordinate:array<double>,from_bounding_box:array<array<double>>,to_bounding_box:array<array<double>>>"
)


def repair(line: Column) -> Column:
    """One JSON object per line: no array brackets and commas around it."""
    inner = F.regexp_replace(F.trim(line), r"^[\[,\s]+", "")
    return F.regexp_replace(inner, r"[\],\s]+$", "")


def status(from_coordinate: Column, to_coordinate: Column) -> Column:
    """1: both ends have an exact place, 2: the first only, 3: the second only, 4: neither."""
    a, b = from_coordinate.isNotNull(), to_coordinate.isNotNull()
    return F.when(a & b, 1).when(a, 2).when(b, 3).otherwise(4)


def _axis(side: str, i: int) -> Column:
    exact, box = F.col(f"r.{side}_coordinate"), F.col(f"r.{side}_bounding_box")
    return F.coalesce(F.get(exact, F.lit(i)), (F.get(F.get(box, F.lit(0)), F.lit(i)) + F.get(F.get(box, F.lit(1)), F.lit(i))) / 2)


def clean(text: Column) -> Column:
    return F.translate(text, "\n|", "  ")


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines(value) -> reply rows. Blank lines and lines that aren't JSON are left out, and so are rows whose ends are the same place."""
    raw = lines.select(F.from_json(repair(F.col("value")), RAW)["ds_tweet_reply_graph"].alias("r")).where("r is not null and r.tweet_from is not null")
    rows = raw.select(
        "r.tweet_from", F.to_timestamp("r.from_create_at").alias("from_create_at"), clean(F.col("r.from_text")).alias("from_text"), _axis("from", 0).alias("from_longitude"), _axis("from", 1).alias("from_latitude"),
        "r.tweet_to", F.to_timestamp("r.to_create_at").alias("to_create_at"), clean(F.col("r.to_text")).alias("to_text"), _axis("to", 0).alias("to_longitude"), _axis("to", 1).alias("to_latitude"),
        status(F.col("r.from_coordinate"), F.col("r.to_coordinate")).alias("status"),
    )
    same = (F.abs(F.col("from_longitude") - F.col("to_longitude")) <= SAME_PLACE) & (F.abs(F.col("from_latitude") - F.col("to_latitude")) <= SAME_PLACE)
    return rows.where(~F.coalesce(same, F.lit(False)))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


COLUMNS = ("tweet_from", "from_create_at", "from_text", "from_longitude", "from_latitude", "tweet_to", "to_create_at", "to_text", "to_longitude", "to_latitude")


def write_csv(rows: DataFrame, path: str) -> None:
    """Bar-separated, quoted only where needed."""
    rows.select(*COLUMNS).write.mode("overwrite").option("sep", "|").option("quote", '"').option("escape", '"').csv(path)


def load_bulk(rows: DataFrame, path: str) -> None:
    """The queryable table: Parquet, one folder per day, so that a time slice reads its days only."""
    rows.withColumn("day", F.to_date("from_create_at")).write.mode("overwrite").partitionBy("day").parquet(path)


def token_index(rows: DataFrame) -> DataFrame:
    """word -> row id, for both texts."""
    from flowloom.functions.text import words

    both = F.array_union(words(F.col("from_text")), words(F.col("to_text")))
    return rows.select(F.col("id"), F.explode(both).alias("word")).select("word", "id")
