"""Sizes of images out of their first bytes, and images given as base64 text or as files, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The signatures of the formats, and the JPEG markers of a frame header (SOF0 to SOF15 without DHT, JPG and DAC).
PNG, GIF, JPEG = "89504E470D0A1A0A", ("474946383761", "474946383961"), "FFD8"
FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
# Fixed values end.
#: JPEG segments before the frame header that are passed over; pictures have some ten.
SEGMENTS = 64


def number(data: Column, at, size: int, little: bool = False) -> Column:
    """The unsigned integer in ``size`` bytes from ``at`` (from 0), null beyond the end and beyond 31 bits."""
    part = F.hex(F.substring(data, at + 1 if isinstance(at, Column) else F.lit(at + 1), F.lit(size)))
    digits = F.concat(*[F.substring(part, 2 * i + 1, 2) for i in reversed(range(size))]) if little else part
    return F.when(F.length(part) == 2 * size, F.conv(digits, 16, 10).try_cast("int"))


def _jpeg(data: Column) -> Column:
    """Walks from segment to segment up to the frame header."""
    start = F.struct(F.lit(2).alias("at"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))

    def step(s, _):
        marker, at = number(data, s["at"] + 1, 1), s["at"]
        frame = marker.isin(*FRAMES)
        fill = marker == 0xFF  # a marker may have more than one FF before it
        after = F.when(fill, at + 1).otherwise(at + 2 + number(data, at + 2, 2))
        found = F.struct(F.lit(None).cast("int").alias("at"), number(data, at + 7, 2).alias("width"), number(data, at + 5, 2).alias("height"))
        return F.when(at.isNull(), s).when(frame, found).otherwise(F.struct(after.alias("at"), s["width"].alias("width"), s["height"].alias("height")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step)


def size(data: Column) -> Column:
    """A struct ``kind, width, height`` of PNG, GIF and JPEG bytes; all null for anything else, and where the header is cut off."""
    head = F.hex(F.substring(data, 1, 8))
    png, gif, jpeg = head == PNG, F.substring(head, 1, 12).isin(*GIF), F.substring(head, 1, 4) == JPEG
    walked = F.when(jpeg, _jpeg(data))
    width = F.when(png, number(data, 16, 4)).when(gif, number(data, 6, 2, True)).otherwise(walked["width"])
    height = F.when(png, number(data, 20, 4)).when(gif, number(data, 8, 2, True)).otherwise(walked["height"])
    known = width.isNotNull() & height.isNotNull()
    kind = F.when(png, "png").when(gif, "gif").when(jpeg, "jpeg")
    return F.struct(F.when(known, kind).alias("kind"), F.when(known, width).alias("width"), F.when(known, height).alias("height"))


def from_base64(text: Column) -> Column:
    """The bytes of base64 text, with or without a ``data:`` prefix; null for text that is none."""
    body = F.regexp_replace(F.regexp_replace(text, r"^data:[^,]{0,200},", ""), r"\s", "")
    return F.try_to_binary(body, F.lit("base64"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, kind, width, height`` of the image files below ``path`` whose names match."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return got.withColumn("s", size(F.col("content"))).select("path", "length", "s.*")
