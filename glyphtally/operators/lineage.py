"""Cutting the lineage of iterative jobs by written tables in the shared checkpoint folder, and numbering rows at scale."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of rows up to which Spark may broadcast a table unasked.
BROADCAST_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may leave it unset: a temporary folder is one that all its threads see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def bounded_broadcasts(spark: SparkSession) -> None:
    """Let Spark broadcast unasked only by what rows take, known at run time: plans know the size of files, where pixels take a small part of it, and the driver holds what is
    broadcast. Of a session that broadcasts nothing unasked, nothing changes."""
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(planned).strip() != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, str(BROADCAST_BYTES))
        spark.conf.set(planned, "-1")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again."""
    bounded_broadcasts(df.sparkSession)
    where = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with gapless numbers from 0 in a total order, sorted in range partitions: no task sees more than its range."""
    placed = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__held"))
    before = F.coalesce(F.sum("__held").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))  # a row per partition
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return placed.withColumn(name, inside).join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col(name)).drop("__part", "__before")


def order_statistics(df: DataFrame, group: str, value: str, pick: dict[str, Column], bins: int = 2048, few: int = 100_000) -> DataFrame:
    """(group, n, names): exact values at 0-based ranks, each an expression of ``n``, the group's count; null values are left out.

    A rank lies in a range of its group's values. A range with more than ``few`` rows is counted in ``bins`` bins, its ends apart, and the rank goes on with the bin it falls
    into, until its range holds one value, however often, or few enough rows to be sorted. So no task sorts more, and ties are counted, not sorted.
    """
    rows = df.select(group, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    asked = F.inline(F.array(*[F.struct(F.lit(k).alias("__k"), r.cast("long").alias("__rank")) for k, r in enumerate(pick.values())]))
    ends = rows.groupBy(group).agg(F.count("*").alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    open_ = cut(ends.select(group, "n", "__lo", "__hi", F.lit(0).cast("long").alias("__before"), F.col("n").alias("__held"), asked))
    many = (F.col("__lo") < F.col("__hi")) & (F.col("__held") > few)
    span = [group, "__lo", "__hi", "__before"]
    within = F.col("__v").between(F.col("__lo"), F.col("__hi"))
    while open_.where(many).limit(1).count():
        place = F.greatest(F.lit(0), F.least(F.lit(bins - 3), F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (bins - 2)))) + 1
        place = F.when(F.col("__v") == F.col("__lo"), 0).when(F.col("__v") == F.col("__hi"), bins - 1).otherwise(place)
        met = rows.join(open_.where(many).select(*span).distinct(), group).where(within).withColumn("__bin", place)
        counts = met.groupBy(*span, "__bin").agg(F.count("*").alias("__n"), F.min("__v").alias("__a"), F.max("__v").alias("__z"))
        above = F.sum("__n").over(Window.partitionBy(*span).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")  # at most ``bins`` rows a range
        counts = counts.withColumn("__from", F.col("__before") + above)
        on = open_.where(many).join(counts, span).where((F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__from") + F.col("__n")))
        on = on.select(group, "n", F.col("__a").alias("__lo"), F.col("__z").alias("__hi"), F.col("__from").alias("__before"), F.col("__n").alias("__held"), "__k", "__rank")
        open_ = cut(open_.where(~many).unionByName(on))
    alike = open_.where("__lo = __hi AND __rank < __before + __held").select(group, "n", "__k", F.col("__lo").alias("__v"))
    rest = open_.where("__lo < __hi")
    met = rows.join(rest.groupBy(*span).agg(F.collect_list(F.struct("__k", "__rank")).alias("__asked"), F.first("n").alias("n")), group).where(within)
    met = met.withColumn("__at", F.row_number().over(Window.partitionBy(*span).orderBy("__v")) - 1 + F.col("__before"))
    met = met.select(group, "n", "__v", F.explode(F.filter("__asked", lambda a: a["__rank"] == F.col("__at"))).alias("__a")).select(group, "n", "__a.__k", "__v")
    found = alike.unionByName(met).groupBy(group).agg(*[F.max(F.when(F.col("__k") == k, F.col("__v"))).alias(name) for k, name in enumerate(pick)])
    return open_.select(group, "n").distinct().join(found, group, "left")
