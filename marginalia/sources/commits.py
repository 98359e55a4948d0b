"""The commit log of a working copy as a data source: ``spark.read.format("commits").option("root", ...)``.

Options: root, path (one file's log, renames not followed), since (ISO time), limit. One partition, read by plain git. A
log without commits has no rows; a folder that isn't a working copy is an error.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "hash string, date string, subject string"


def parse_log(text: str) -> list[tuple[str, str, str]]:
    """(hash, date, subject) of blocks of three lines; a block with an empty hash is skipped."""
    lines = text.split("\n")
    return [(lines[i].strip(), lines[i + 1], lines[i + 2]) for i in range(0, len(lines) - 2, 3) if lines[i].strip()]


class CommitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        command = ["git", "-C", o["root"], "log", "--format=%H%n%cI%n%s"]
        command += [f"--max-count={int(o['limit'])}"] if "limit" in o else []
        command += [f"--since={o['since']}"] if "since" in o else []
        command += ["--", o["path"]] if "path" in o else []
        done = subprocess.run(command, capture_output=True, text=True, check=False)
        if done.returncode and "does not have any commits" not in done.stderr:
            raise RuntimeError(f"git log failed: {done.stderr.strip()}")
        yield from parse_log(done.stdout)


class CommitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "commits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CommitReader:  # noqa: ANN001
        return CommitReader(self.options)


def commits(spark: SparkSession, root: str, **options: object) -> DataFrame:
    spark.dataSource.register(CommitSource)
    return spark.read.format("commits").options(root=root, **{k: str(v) for k, v in options.items()}).load()
