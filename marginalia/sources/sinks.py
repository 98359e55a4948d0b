"""Sinks on the driver's side: whole files replaced atomically, JSON documents, image imports, and the audit table."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import guards, images


def atomic_write(root: str, path: str, data: bytes, overwrite: bool = True) -> None:
    """Writes a guarded path beside its place and moves it there, so that readers see the old or the new file."""
    target = Path(guards.resolve(root, path))
    if target.exists() and not overwrite:
        raise guards.GuardError(f"exists: {path}")
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=target.parent, prefix=".", suffix=".part")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        if overwrite:
            os.replace(name, target)
        else:
            os.link(name, target)  # fails if the file came up meanwhile
    finally:
        if os.path.exists(name):
            os.unlink(name)


def write_json(root: str, path: str, value: object) -> None:
    """A JSON document, indented, keys sorted."""
    atomic_write(root, path, (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode())


def append_audit(calls: DataFrame, out_dir: str) -> None:
    """Appends (ts, operation, path, details) to the audit table, with the line a log file would hold."""
    line = guards.audit_line(F.col("ts"), F.col("operation"), F.col("path"), F.col("details"))
    calls.withColumn("line", line).write.mode("append").parquet(out_dir)


def read_instructions(path: str | None) -> str | None:
    """Custom instructions: the trimmed text of an optional file; null if there is none or it is empty."""
    if not path or not os.path.isfile(path):
        return None
    return Path(path).read_text(encoding="utf-8").strip() or None


def import_image(root: str, source: str, destination: str) -> tuple[str, int, int]:
    """Copies an image from outside the vault to a new ``.png`` under notes/; returns path, width, height.

    The source must be a regular file outside the root, within the limits of size and pixels, and of a known format. PNG
    files are taken as they are; others are re-encoded if the optional library Pillow is there.
    """
    place = os.path.realpath(source)
    base = os.path.realpath(root)
    if place == base or place.startswith(base + os.sep):
        raise guards.GuardError("the source lies inside the vault")
    if not os.path.isfile(place):
        raise guards.GuardError("the source is no regular file")
    if os.path.getsize(place) > images.MOST_BYTES:
        raise guards.GuardError("the file is too large")
    data = Path(place).read_bytes()
    seen = images.inspect_bytes(data)
    if seen is None or os.path.splitext(place)[1][1:].lower() not in images.READABLE:
        raise guards.GuardError("no readable image")
    kind, width, height = seen[:3]
    if width * height / 1e6 > images.MOST_MEGAPIXELS:
        raise guards.GuardError("the image has too many pixels")
    if kind != "png":
        try:
            import io

            from PIL import Image
        except ImportError as e:
            raise guards.GuardError("re-encoding needs the optional library Pillow") from e
        out = io.BytesIO()
        Image.open(io.BytesIO(data)).save(out, "PNG")
        data = out.getvalue()
    name = os.path.splitext(destination)[0] + ".png"
    atomic_write(root, guards.check_relative(name, ("notes",), ("png",)), data, overwrite=False)
    return name, width, height
