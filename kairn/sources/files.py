"""Frames from files: text vectors, FITS images and cubes, PNG lists; and result tables in text form."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VIDEO = (".mp4", ".avi", ".mov", ".mkv")


def read_frames(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """(frame_id, data[, width, height]) by format or file ending; everything unknown is FITS."""
    low = path.lower()
    if format == "ascii" or (format is None and low.endswith(".txt")):
        return read_ascii(spark, path)
    if format == "video" or (format is None and low.endswith(VIDEO)):
        raise NotImplementedError("no video decoder is installed; decode to FITS or PNG first")
    if format == "png" or (format is None and low.endswith(".png")):
        return read_png(spark, path)
    if format == "parquet" or (format is None and low.endswith(".parquet")):
        return spark.read.parquet(path).select("frame_id", F.col("data").cast("array<double>").alias("data"))
    return read_fits(spark, path)


def read_ascii(spark: SparkSession, path: str, skip_comments: bool = True) -> DataFrame:
    """One vector per line, numbered by place in the file. Blank lines and # lines don't count.

    Lines are numbered inside each split of the file and offset by the splits before it, so a large
    file is read in parallel.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m"))
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    rows = raw.withColumn("line", line).where("line <> ''")
    if skip_comments:
        rows = rows.where(~F.col("line").startswith("#"))
    counts = rows.groupBy("f", "at").agg(F.count("*").alias("n"))
    before = Window.orderBy("f", "at").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("f", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("f", "at").orderBy("m"))
    numbered = rows.withColumn("k", inner).join(F.broadcast(base), ["f", "at"])
    return numbered.select((F.col("base") + F.col("k") - 1).alias("frame_id"), F.transform(F.split("line", " "), lambda v: v.cast("double")).alias("data"))


def decode_fits(content: bytes) -> np.ndarray:
    """(frames, height, width) of a FITS image or cube, as doubles."""
    cards, at = {}, 0
    while True:
        card = content[at : at + 80].decode("ascii")
        at += 80
        if card.startswith("END") or not card:
            break
        if card[8:10] == "= ":
            cards[card[:8].strip()] = card[10:].split("/")[0].strip()
    at = -(-at // 2880) * 2880
    # fixed values: sample formats by BITPIX
    kinds = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
    axes = [int(cards[f"NAXIS{k + 1}"]) for k in range(int(cards["NAXIS"]))]
    if len(axes) not in (2, 3):
        raise ValueError("only two or three axes are images")
    kind = np.dtype(kinds[int(cards["BITPIX"])])
    data = np.frombuffer(content, kind, int(np.prod(axes)), at).astype(float)
    data = data * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
    return data.reshape([1] * (3 - len(axes)) + axes[::-1])


def encode_fits(images: np.ndarray) -> bytes:
    """A FITS cube of doubles from (frames, height, width)."""
    n, h, w = images.shape
    cards = ["SIMPLE  =                    T", "BITPIX  =                  -64", "NAXIS   =                    3", f"NAXIS1  = {w:>20}", f"NAXIS2  = {h:>20}", f"NAXIS3  = {n:>20}", "END"]
    head = "".join(c.ljust(80) for c in cards).encode()
    body = images.astype(">f8").tobytes()
    return head.ljust(-(-len(head) // 2880) * 2880) + body + b"\0" * (-len(body) % 2880)


def decode_png(content: bytes) -> np.ndarray:
    """(height, width) grey values 0..255 of a PNG that isn't interlaced."""
    at, body, palette = 8, b"", None
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        chunk = content[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            w, h, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
    if interlaced:
        raise ValueError("interlaced PNG files are not supported")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step = max(1, channels * depth // 8)
    width = -(-w * channels * depth // 8)
    raw, last, rows = zlib.decompress(body), np.zeros(width, np.int64), []
    for y in range(h):
        kind, line = raw[y * (width + 1)], np.frombuffer(raw, np.uint8, width, y * (width + 1) + 1).astype(np.int64)
        if kind == 2:
            line = (line + last) & 255
        elif kind:
            for x in range(width):
                left, up, corner = (line[x - step] if x >= step else 0), last[x], (last[x - step] if x >= step else 0)
                if kind == 1:
                    add = left
                elif kind == 3:
                    add = (left + up) // 2
                else:
                    guess = left + up - corner
                    far = (abs(guess - left), abs(guess - up), abs(guess - corner))
                    add = (left, up, corner)[far.index(min(far))]
                line[x] = (line[x] + add) & 255
        rows.append(line)
        last = line
    px = np.array(rows, np.uint8)
    if depth == 16:
        px = px.reshape(h, -1, 2)[:, :, 0]
    elif depth < 8:
        px = np.unpackbits(px, axis=1).reshape(h, -1, depth)
        px = (px * (1 << np.arange(depth)[::-1])).sum(axis=2)[:, :w]
        px = px if color == 3 else px * 255 // ((1 << depth) - 1)
    px = px.reshape(h, w, channels)
    if color == 3:
        px = palette[px[:, :, 0]]
    return px[:, :, :3].astype(float) @ np.array([0.299, 0.587, 0.114]) if px.shape[2] >= 3 else px[:, :, 0].astype(float)


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit grey PNG; values are clipped to 0..255."""
    h, w = image.shape
    px = np.clip(np.round(image), 0, 255).astype(np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in px)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


_IMAGE = "frame_id long, data array<double>, width int, height int"


def _images(files: DataFrame, decode) -> DataFrame:
    """files: content and base (the first frame's number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, base in zip(batch.column("content"), batch.column("base").to_pylist(), strict=True):
                x = decode(content.as_py())
                x = x[None] if x.ndim == 2 else x
                n, h, w = x.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(base, base + n), pa.int64()), pa.array([f.ravel().tolist() for f in x], pa.list_(pa.float64())), pa.array([w] * n, pa.int32()), pa.array([h] * n, pa.int32())],
                    names=["frame_id", "data", "width", "height"],
                )

    return files.mapInArrow(run, _IMAGE)


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """Frames of one FITS file. A file is decoded by one task, as its frames have no index."""
    return _images(spark.read.format("binaryFile").load(path).select("content", F.lit(0).cast("long").alias("base")), decode_fits)


def read_png(spark: SparkSession, *paths: str) -> DataFrame:
    """Grey frames of PNG files, numbered in order of path."""
    files = spark.read.format("binaryFile").load(list(paths))
    # only the paths are put in order by one task; the contents stay where they are
    order = files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("base"))
    return _images(files.select("path", "content").join(order, "path").select("content", "base"), decode_png)


def read_png_list(spark: SparkSession, list_path: str) -> DataFrame:
    """Frames of the PNG files that a text file lists, one path a line, in that order."""
    text = spark.read.text(list_path, wholetext=True).first()
    paths = [p for line in (text[0] if text else "").splitlines() if (p := line.split("#")[0].strip())]
    order = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "name string, base long")
    files = spark.read.format("binaryFile").load(paths).select("content", F.regexp_replace("path", "^file:/*", "/").alias("name"))
    return _images(files.join(order, "name").select("content", "base"), decode_png)


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """Text rows `frame cluster [dist]`."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> '' AND value NOT LIKE '#%'")
    return rows.select(parts[0].cast("long").alias("frame_id"), parts[1].cast("long").alias("cluster_id"), F.get(parts, F.lit(2)).cast("double").alias("dist"))


def read_dcc(spark: SparkSession, path: str) -> DataFrame:
    """Text rows `i j dist`, measured pairs only."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].cast("long").alias("i"), parts[1].cast("long").alias("j"), parts[2].cast("double").alias("dist"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """`KEY: value` lines as (key, value)."""
    return spark.read.text(path).where("value RLIKE '^[A-Za-z_ ]+:'").select(F.trim(F.split("value", ":", 2)[0]).alias("key"), F.trim(F.split("value", ":", 2)[1]).alias("value"))


def read_log_histogram(spark: SparkSession, path: str, block: str) -> DataFrame:
    """The rows of numbers between `STATS_<block>_START` and `STATS_<block>_END` of a run log, as arrays."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    ends = lines.agg(F.max(F.when(F.col("line") == f"STATS_{block}_START", F.col("at"))).alias("low"), F.max(F.when(F.col("line") == f"STATS_{block}_END", F.col("at"))).alias("high"))
    inside = lines.join(F.broadcast(ends), (F.col("at") > F.col("low")) & (F.col("at") < F.col("high")))
    return inside.select(F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.cast("long")).alias("row"))


def load_anchors(membership: DataFrame, frames: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(cluster_id, anchor): the table given, or the first member of each cluster."""
    if anchors is not None:
        return anchors.select("cluster_id", "anchor")
    first = membership.where("cluster_id >= 0").groupBy("cluster_id").agg(F.min("frame_id").alias("frame_id"))
    return first.join(frames, "frame_id").select("cluster_id", F.col("data").alias("anchor"))
