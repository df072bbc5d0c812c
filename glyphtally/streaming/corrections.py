"""An append-only corrections log as a stream: an addition to the batch analysis.

Each micro-batch is folded to its last corrections and merged with the table kept so far, so the
state is one row per marker and survives a restart with the query's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtally.operators.counting import fold_corrections

SCHEMA = "image_id long, marker_id long, seq long, number int, rejected boolean"


def corrections_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def fold_stream(corrections: DataFrame, kept: str, checkpoint: str):
    """Start a query that keeps the last correction of each marker in versions under the folder ``kept``."""
    spark = corrections.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = batch.select("image_id", "marker_id", "seq", "number", "rejected")
        if epoch:
            rows = rows.unionByName(spark.read.parquet(f"{kept}/version={epoch - 1}"))
        last = fold_corrections(rows, ["image_id", "marker_id"], "seq", ["seq", "number", "rejected"]).drop("corrections")
        last.write.mode("overwrite").parquet(f"{kept}/version={epoch}")

    return corrections.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_corrections(markers: DataFrame, corrections: DataFrame) -> DataFrame:
    """Markers with the kept corrections: a number set by hand, or a rejection."""
    c = corrections.select("image_id", "marker_id", F.col("number").alias("__number"), F.col("rejected").alias("__rejected"))
    met = markers.join(c, ["image_id", "marker_id"], "left")
    met = met.withColumn("manual_number", F.coalesce("__number", "manual_number")).withColumn("rejected", F.coalesce("__rejected", "rejected"))
    return met.drop("__number", "__rejected")
