"""Document files as rows, and which of them are refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 100 * 1024 * 1024


def reject_reason(content: Column, length: Column) -> Column:
    """Why a file is no usable PDF; null if it is one. Only its head is looked at."""
    head = F.substring(content, 1, 5)
    return F.when(content.isNull() | (length < 8), "too short").when(length > MOST_BYTES, "over 100 MB").when(head != F.encode(F.lit("%PDF-"), "US-ASCII"), "no PDF header")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, reject_reason) of the files under a path. Contents of refused files are dropped."""
    rows = spark.read.format("binaryFile").load(path).withColumn("reject_reason", reject_reason(F.col("content"), F.col("length")))
    return rows.select("path", "length", F.when(F.col("reject_reason").isNull(), F.col("content")).alias("content"), "reject_reason")


def fit_page(width: Column, height: Column, most: float = 2000.0) -> tuple[Column, Column]:
    """An image's size as a page: its longer side at most `most`."""
    scale = F.least(F.lit(1.0), F.lit(most) / F.greatest(width, height))
    return width * scale, height * scale


def clamp_compression(side: Column, quality: Column) -> tuple[Column, Column]:
    """Export settings within their limits: side 400 to 4000, quality 0.3 to 0.95."""
    return F.least(F.greatest(F.floor(side + 0.5), F.lit(400)), F.lit(4000)), F.least(F.greatest(quality, F.lit(0.3)), F.lit(0.95))


#: How far pages are compressed (fixed values): longest side in pixels, quality.
PRESETS = {"high": (2000, 0.85), "medium": (1500, 0.7), "low": (1000, 0.55)}
#: A page is not drawn larger than this many times its size.
MOST_SCALE = 3.0


def compressed_size(width: Column, height: Column, preset: str) -> tuple[Column, Column, Column]:
    """(pixels across, pixels down, quality) of a page of width by height points under a preset."""
    side, quality = PRESETS[preset]
    longest = F.greatest(width, height)
    scale = F.least(F.lit(MOST_SCALE), F.lit(float(side)) / F.when(longest > 0, longest).otherwise(1.0))
    pixels = lambda v: F.greatest(F.lit(1), F.floor(v * scale)).cast("int")
    return pixels(width), pixels(height), F.lit(quality)


def saved(before: Column, after: Column) -> Column:
    """What is left of a file's size; 1 for an empty one."""
    return F.when(before > 0, after / before).otherwise(1.0)


def image_size(content: Column) -> Column:
    """struct(width, height) from a PNG's or a JPEG's header; null for other contents. A JPEG's size stands in its first frame header, which
    segments with a length lead to; of a header beyond them nothing is known."""
    byte = lambda at: F.conv(F.hex(F.substring(content, at, 1)), 16, 10).cast("int")
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    jpeg = F.hex(F.substring(content, 1, 2)) == "FFD8"
    is_frame = lambda at: byte(at + 1).between(0xC0, 0xCF) & ~byte(at + 1).isin(0xC4, 0xC8, 0xCC)
    # A segment's marker has two bytes, then its length two; SEGMENTS of them are followed.
    step = lambda at, _: F.when((byte(at) == 0xFF) & ~is_frame(at), at + 2 + number(at + 2, 2)).otherwise(at)
    at = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), F.lit(3), step)
    frame = F.transform(F.array(at), lambda p: F.when((byte(p) == 0xFF) & is_frame(p), size(number(p + 7, 2), number(p + 5, 2))))[0]
    return F.when(png, size(number(17, 4), number(21, 4))).when(jpeg, frame)


#: Segments of a JPEG that are looked at before its frame header.
SEGMENTS = 64


def session_json(docs: DataFrame) -> DataFrame:
    """(doc_id, session): a document and its pages as one JSON text, the form a session is saved in; flip included."""
    return docs.select("doc_id", F.to_json(F.struct("name", "pages", F.base64(F.encode("text", "UTF-8")).alias("data"))).alias("session"))


def restore_session(sessions: DataFrame) -> DataFrame:
    """The documents of saved sessions; a malformed one has null fields."""
    kind = "struct<name:string, pages:array<struct<page:bigint,rot:int,flip:int>>, data:string>"
    s = F.from_json("session", kind)
    return sessions.select("doc_id", s["name"].alias("name"), s["pages"].alias("pages"), F.decode(F.unbase64(s["data"]), "UTF-8").alias("text"))
