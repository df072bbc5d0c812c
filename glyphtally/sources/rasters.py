"""Rasters as long tables (image_id, y, x, v): from vectors, from image files; and the truth files beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtally.functions.numeric import clamp8
from glyphtally.operators.raster import downscale_by

MAX_PIXELS = 24_000_000
TRUTH_SCHEMA = "image string, counts map<string,long>, total long, notes string"


def level(x: Column) -> Column:
    """A vector component as a gray level."""
    return clamp8(128 + 256 * x.cast("double"))


def vector_pixels(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", side: int = 8) -> DataFrame:
    """One side x side image per vector."""
    long = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("image_id"), F.posexplode(vector_col).alias("pos", "e"))
    return long.select("image_id", F.floor(F.col("pos") / side).cast("int").alias("y"), (F.col("pos") % side).alias("x"), level(F.col("e")).alias("v"))


def mosaic_pixels(df: DataFrame, tiles: int, id_col: str = "vec_id", vector_col: str = "embedding", side: int = 8) -> DataFrame:
    """tiles x tiles vectors of consecutive ids side by side in one image."""
    px = vector_pixels(df, id_col, vector_col, side)
    n = tiles * tiles
    tile = F.pmod("image_id", F.lit(n))
    return px.select(
        F.floor(F.col("image_id") / n).cast("long").alias("image_id"), (F.col("y") + side * F.floor(tile / tiles)).cast("int").alias("y"),
        (F.col("x") + side * F.pmod(tile, F.lit(tiles))).cast("int").alias("x"), "v")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """PNG and JPEG files as (path, height, width, channels, data); unreadable ones are left out."""
    images = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(path)
    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").toDF("path", "height", "width", "channels", "data")


def file_pixels(images: DataFrame, most: int = MAX_PIXELS) -> DataFrame:
    """(path, y, x, r, g, b) of decoded files; the reader stores blue first.

    Pictures above ``most`` pixels are reduced to about so many, every pixel the mean of those it stands for.
    """
    pixels = F.col("height").cast("long") * F.col("width")
    small, large = _all_pixels(images.where(pixels <= most)), _all_pixels(images.where(pixels > most))
    reduced = downscale_by(large.withColumnRenamed("path", "image_id"), F.sqrt(F.lit(float(most)) / (F.col("h") * F.col("w"))), ("r", "g", "b"))
    return small.unionByName(reduced.withColumnRenamed("image_id", "path"))


def _all_pixels(images: DataFrame) -> DataFrame:
    at = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    row = F.substring(F.col("data"), F.col("y") * F.col("width") * F.col("channels") + 1, F.col("width") * F.col("channels"))
    at = at.select("path", "y", "width", "channels", row.alias("row")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))

    def channel(k: int) -> Column:
        k = F.when(F.col("channels") >= 3, k).otherwise(0)
        return F.conv(F.hex(F.substring(F.col("row"), F.col("x") * F.col("channels") + k + 1, F.lit(1))), 16, 10).cast("int")

    return at.select("path", "y", "x", channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))


def exif_orientation(content: bytes) -> int:
    """The orientation tag of a JPEG file, in either byte order; 1 without one or in a broken file."""
    try:
        if content[:2] != b"\xff\xd8":
            return 1
        at = 2
        while content[at] == 0xFF and content[at + 1] != 0xDA:
            size = int.from_bytes(content[at + 2:at + 4], "big")
            if content[at + 1] == 0xE1 and content[at + 4:at + 10] == b"Exif\0\0":
                tiff = content[at + 10:at + 2 + size]
                order = "little" if tiff[:2] == b"II" else "big"
                first = int.from_bytes(tiff[4:8], order)
                for k in range(int.from_bytes(tiff[first:first + 2], order)):
                    entry = tiff[first + 2 + 12 * k:first + 14 + 12 * k]
                    if int.from_bytes(entry[:2], order) == 0x0112:
                        return int.from_bytes(entry[8:10], order)
                return 1
            at += 2 + size
    except IndexError:
        pass
    return 1


def orientations(spark: SparkSession, path: str) -> DataFrame:
    """(path, orientation) of the JPEG and PNG files; the image reader itself drops the tag."""
    tag = F.pandas_udf(lambda s: s.map(exif_orientation), "int")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(path)
    return files.select("path", tag("content").alias("orientation"))


def base_name(path: Column) -> Column:
    """The file's name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def truth_for(images: DataFrame, truth: DataFrame) -> DataFrame:
    """``images`` (path, ...) with the hand counts (file, number, expected) of the same base name; null where there are none."""
    return images.withColumn("__name", base_name(F.col("path"))).join(truth.withColumn("__name", base_name(F.col("file"))).drop("file"), "__name", "left").drop("__name")


def truth_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, image, number, expected) of hand counts kept as JSON."""
    truth = spark.read.schema(TRUTH_SCHEMA).option("multiLine", True).json(path).select("*", "_metadata.file_path")
    return truth.select(F.col("file_path").alias("file"), "image", F.explode("counts").alias("number", "expected")).withColumn("number", F.col("number").cast("int"))
