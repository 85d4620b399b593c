"""Continuous arrival: a stream of edge rows folded into the weighted edge table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.edges import KEY, canonical, decoded


def running_weights(stream: DataFrame, least: float = 0.001) -> DataFrame:
    """Streaming aggregation: weight by undirected edge over all that has arrived; for outputMode update or complete."""
    return canonical(decoded(stream, least)).groupBy(*KEY).agg(F.count("*").alias("weight"))


def windowed_weights(stream: DataFrame, width: str, late: str, least: float = 0.001) -> DataFrame:
    """Weight by edge and time window; windows close once the watermark has passed, so state stays bounded."""
    rows = canonical(decoded(stream.withWatermark("ts", late), least))
    return rows.groupBy(F.window("ts", width).alias("w"), *KEY).agg(F.count("*").alias("weight")).select(F.col("w.start").alias("start"), *KEY, "weight")


def fold_into(stream: DataFrame, path: str, checkpoint: str, least: float = 0.001, **trigger):
    """Starts a query that appends each batch's weights under `path`/batch=N; totals(spark, path) sums them.

    A batch that is repeated after a failure overwrites its own folder, so no row counts twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        canonical(decoded(batch, least)).groupBy(*KEY).agg(F.count("*").alias("weight")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def totals(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").groupBy(*KEY).agg(F.sum("weight").alias("weight"))
