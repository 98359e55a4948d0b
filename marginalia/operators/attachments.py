"""Attachments: all files that are neither notes nor canvases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators.images import READABLE
from marginalia.operators.notes import in_directory

#: Extensions of notes and canvases.
CONTENT = ("md", "markdown", "canvas")


def list_attachments(files: DataFrame, directory: str = "notes", recursive: bool = True) -> DataFrame:
    """path, ext, size_bytes, readable, modified of files (path, size_bytes, modified); newest first, ties by path."""
    ext = F.lower(X.extension(F.col("path")))
    out = files.where(in_directory(F.col("path"), directory, recursive) & ~ext.isin(*CONTENT))
    return out.select("path", ext.alias("ext"), "size_bytes", ext.isin(*READABLE).alias("readable"), "modified").orderBy(F.desc("modified"), "path")
