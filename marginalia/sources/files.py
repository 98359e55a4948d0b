"""A file tree as a Spark data source: ``spark.read.format("vault").option("root", ...)``.

Spark's own file sources drop names that begin with ``_`` and empty files and match globs by case; a vault needs these. One
partition reads one directory's own files. Filters on path (prefix) and extension are taken over by the listing, so
directories that can't hold matches are not walked. Options: root, directory (relative), recursive (true), hidden
(false: components beginning with a dot are left out), content (true: read the bytes).
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

SCHEMA = "path string, full_path string, ext string, size bigint, modified timestamp, content binary"


@dataclass
class Directory(InputPartition):
    path: str


class VaultReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = os.path.realpath(options["root"])
        self.start = (options.get("directory") or "").strip("/")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.with_content = options.get("content", "true").lower() == "true"
        self.prefixes: list[str] = []
        self.extensions: set[str] | None = None
        full = os.path.realpath(os.path.join(self.root, self.start))
        if full != self.root and not full.startswith(self.root + os.sep):
            raise ValueError("the directory lies outside the root")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("ext",):
                self.extensions = {f.value} if self.extensions is None else self.extensions & {f.value}
            elif isinstance(f, In) and f.attribute == ("ext",):
                self.extensions = set(f.value) if self.extensions is None else self.extensions & set(f.value)
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        return self.hidden or not name.startswith(".")

    def partitions(self) -> list[Directory]:
        out, stack = [], [self.start]
        while stack:
            here = stack.pop()
            at = here + "/" if here else ""
            if not all(p.startswith(at) or at.startswith(p) for p in self.prefixes):
                continue
            try:
                entries = list(os.scandir(os.path.join(self.root, here)))
            except (FileNotFoundError, NotADirectoryError):
                continue
            if any(e.is_file() for e in entries):
                out.append(Directory(here))
            if self.recursive:
                stack += sorted(at + e.name for e in entries if e.is_dir(follow_symlinks=False) and self._wanted(e.name))
        return out or [Directory(self.start)]

    def read(self, partition: Directory) -> Iterator[tuple]:
        base = os.path.join(self.root, partition.path)
        try:
            entries = sorted(os.scandir(base), key=lambda e: e.name)
        except (FileNotFoundError, NotADirectoryError):
            return
        for e in entries:
            path = f"{partition.path}/{e.name}" if partition.path else e.name
            ext = os.path.splitext(e.name)[1][1:].lower()
            if not e.is_file() or not self._wanted(e.name) or not all(path.startswith(p) for p in self.prefixes) or (self.extensions is not None and ext not in self.extensions):
                continue
            info = e.stat()
            content = None
            if self.with_content:
                with open(e.path, "rb") as f:
                    content = f.read()
            yield path, e.path, ext, info.st_size, dt.datetime.fromtimestamp(info.st_mtime, dt.timezone.utc), content


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VaultReader:  # noqa: ANN001
        return VaultReader(self.options)


def vault_files(spark: SparkSession, root: str, directory: str = "", **options: object) -> DataFrame:
    """The files under root (see the module for the options). The root must be readable by every executor."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VaultSource)
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    return spark.read.format("vault").options(root=root, directory=directory, **given).load()


def text_notes(files: DataFrame, invalid: str = "skip") -> DataFrame:
    """path, content, modified of Markdown files. Bytes that are no UTF-8: ``skip`` the file, read it as ``empty``, or ``fail``."""
    notes = files.where(F.col("ext").isin("md", "markdown"))
    text = F.validate_utf8(F.col("content").cast("string")) if invalid == "fail" else F.try_validate_utf8(F.col("content").cast("string"))
    out = notes.select("path", (F.coalesce(text, F.lit("")) if invalid == "empty" else text).alias("content"), "modified")
    return out.where("content is not null") if invalid == "skip" else out
