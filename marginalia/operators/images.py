"""Images: header inspection, read policy and frame arithmetic. Pixels are never decoded here."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of a read: bytes of a file, megapixels, long edge of a still and of a frame, frames.
MOST_BYTES, MOST_MEGAPIXELS, STILL_EDGE, FRAME_EDGE, MOST_FRAMES = 25 << 20, 50.0, 2576, 1280, 8
# Extensions that can be read, and the types that pass through as they are.
READABLE = ("png", "jpg", "jpeg", "gif", "webp", "heic", "tiff", "tif", "bmp")
NATIVE = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}

INSPECTION = T.StructType([
    T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("frames", T.IntegerType()), T.StructField("delays", T.ArrayType(T.DoubleType())),
])


def inspect_bytes(data: bytes | None) -> tuple | None:
    """(format, width, height, frames, delays in seconds) from an image's header; null for other data."""
    try:
        if not data:
            return None
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return ("png", *struct.unpack(">II", data[16:24]), 1, None)
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return ("bmp", w, abs(h), 1, None)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return _gif(data)
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(data)
        if data[4:8] == b"ftyp":
            return _heic(data)
    except (struct.error, IndexError):
        return None
    return None


def _webp(data: bytes) -> tuple | None:
    """Lossy, lossless and extended files; an extended one lists its frames with delays."""
    kind = data[12:16]
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", data[26:30])
        return ("webp", w & 0x3FFF, h & 0x3FFF, 1, None)
    if kind == b"VP8L":
        bits = struct.unpack("<I", data[21:25])[0]
        return ("webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 1, None)
    if kind != b"VP8X":
        return None
    three = lambda at: int.from_bytes(data[at : at + 3], "little")
    at, delays = 12, []
    while at + 8 <= len(data):
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        if data[at : at + 4] == b"ANMF":
            delays.append(three(at + 8 + 12) / 1000)
        at += 8 + size + (size & 1)
    return ("webp", three(24) + 1, three(27) + 1, max(len(delays), 1), delays if len(delays) > 1 else None)


def _tiff(data: bytes) -> tuple | None:
    """Width and height of the first directory, frames by the chain of directories (a loop ends it)."""
    e = "<" if data[:2] == b"II" else ">"
    at, size, seen = struct.unpack(e + "I", data[4:8])[0], {}, set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(e + "H", data[at : at + 2])[0]
        for i in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind = struct.unpack(e + "HH", data[i : i + 4])
            if tag in (256, 257):
                size.setdefault(tag, struct.unpack(e + ("H" if kind == 3 else "I"), data[i + 8 : i + (10 if kind == 3 else 12)])[0])
        at = struct.unpack(e + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return ("tiff", size[256], size[257], len(seen), None) if len(size) == 2 else None


def _heic(data: bytes) -> tuple | None:
    """The largest of the images whose extents the file's item properties give (tiles and thumbnails are smaller)."""
    best, at = None, data.find(b"ispe")
    while at >= 0:
        w, h = struct.unpack(">II", data[at + 8 : at + 16])
        best = max(best or (0, 0), (w, h), key=lambda x: x[0] * x[1])
        at = data.find(b"ispe", at + 4)
    return ("heic", *best, 1, None) if best else None


def _gif(data: bytes) -> tuple:
    w, h, flags = struct.unpack("<HHB", data[6:11])
    at = 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    frames, delays, delay = 0, [], 0.0

    def blocks(at: int) -> int:
        while data[at]:
            at += data[at] + 1
        return at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                delay = struct.unpack("<H", data[at + 4 : at + 6])[0] / 100
            at = blocks(at + 2)
        elif data[at] == 0x2C:
            local = data[at + 9]
            at = blocks(at + 11 + (3 << ((local & 7) + 1) if local & 128 else 0))
            frames, delay = frames + 1, (delays.append(delay), 0.0)[1]
        else:
            break
    return ("gif", w, h, max(frames, 1), delays if frames > 1 else None)


def _jpeg(data: bytes) -> tuple | None:
    at = 2
    while at + 9 < len(data):
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return ("jpeg", w, h, 1, None)
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


@F.pandas_udf(INSPECTION)
def inspect(data: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Header inspection of a binary column, in Arrow batches."""
    for s in data:
        yield pd.DataFrame([inspect_bytes(x) or (None,) * 5 for x in s], columns=INSPECTION.names)


def sample_indices(total: Column, most: int = MOST_FRAMES) -> Column:
    """Evenly spaced frame numbers, first and last included, halves rounded up; all if there are no more than most."""
    every = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    if most < 2:
        return F.when(total > most, F.array(F.lit(0))).otherwise(every)
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.round(i * (total - 1) / F.lit(float(most - 1))).cast("int"))
    return F.when(total > most, spread).otherwise(every)


def frame_offset(delays: Column, index: Column) -> Column:
    """Seconds before a frame begins: the sum of the delays before it, of all delays past the end."""
    return F.aggregate(F.slice(delays, F.lit(1), F.greatest(F.lit(0), index)), F.lit(0.0), lambda a, x: a + x)


def duration(delays: Column) -> Column:
    return F.aggregate(delays, F.lit(0.0), lambda a, x: a + x)


def image_plan(images: DataFrame) -> DataFrame:
    """path, action, frames, offsets, mime, total_duration of images (path, ext, bytes, width, height, frames, delays):
    how each would be read. Actions: reject_size, reject_pixels, frames (a sampled animation), pass_through, re_encode."""
    ext = F.lower("ext")
    edge = F.greatest("width", "height")
    mp = F.col("width").cast("double") * F.col("height") / F.lit(1e6)
    moving = (ext == "gif") & (F.col("frames") > 1)
    native = ext.isin(*NATIVE) & (edge <= STILL_EDGE)
    action = F.when(F.col("bytes") > MOST_BYTES, "reject_size").when(mp > MOST_MEGAPIXELS, "reject_pixels").when(moving, "frames").when(native, "pass_through").otherwise("re_encode")
    df = images.withColumn("action", action)
    picked = F.when(F.col("action") == "frames", sample_indices(F.col("frames"))).when(~F.col("action").startswith("reject"), F.array(F.lit(0)))
    df = df.withColumn("picked", picked)
    offsets = F.when((F.col("action") == "frames") & F.col("delays").isNotNull(), F.transform("picked", lambda i: frame_offset(F.col("delays"), i)))
    types = F.create_map(*[F.lit(x) for kv in NATIVE.items() for x in kv])
    mime = F.when(F.col("action") == "pass_through", F.try_element_at(types, ext)).when(~F.col("action").startswith("reject"), "image/png")
    return df.select("path", "action", F.col("picked").alias("frames"), offsets.alias("offsets"), mime.alias("mime"), F.when(F.col("action") == "frames", duration(F.col("delays"))).alias("total_duration"))
