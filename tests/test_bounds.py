"""What is broadcast stays small."""

from pyspark.sql import functions as F

from glyphtally.operators.lineage import BROADCAST_BYTES, bounded_broadcasts, cut

PLANNED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def test_written_pixels_are_not_broadcast(spark):
    """A million regular pixels are less than 256 kB of files, and 40 MB as rows."""
    before = {k: spark.conf.get(k, None) for k in (PLANNED, MEASURED)}
    try:
        spark.conf.set(PLANNED, "10MB")
        spark.conf.unset(MEASURED)
        at = F.col("id")
        px = cut(spark.range(1 << 20).select(F.floor(at / 4096).alias("image_id"), F.floor(at % 4096 / 64).cast("int").alias("y"), (at % 64).cast("int").alias("x"), (at * 37 % 251).cast("int").alias("v")))
        met = px.join(px.withColumnRenamed("v", "w"), ["image_id", "y", "x"])
        assert met.count() == 1 << 20
        assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
        assert spark.conf.get(PLANNED) == "-1" and spark.conf.get(MEASURED) == str(BROADCAST_BYTES)
        spark.conf.set(MEASURED, "100k")
        spark.conf.set(PLANNED, "1g")
        bounded_broadcasts(spark)
        assert (spark.conf.get(PLANNED), spark.conf.get(MEASURED)) == ("-1", "100k")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
