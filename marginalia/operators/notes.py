"""Notes: parsing, listing, metadata, tags, recent ones and batch reads. Rows need path, content and modified."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import text as X

#: Paths that one batch read serves; further ones are listed as skipped.
BATCH = 20


def parsed(notes: DataFrame) -> DataFrame:
    """notes with title, tags, created, custom_fields, body, word_count and links. Null content counts as empty."""
    content = F.coalesce("content", F.lit(""))
    df = notes.withColumn("_lines", F.split(content, "\n", -1)).withColumn("_bounds", X.frontmatter_bounds(F.col("_lines"), content))
    df = df.withColumns({"_fields": X.field_entries(X.frontmatter_lines(F.col("_lines"), F.col("_bounds"))), "body": X.body_text(F.col("_lines"), F.col("_bounds"), content)})
    fields = F.col("_fields")
    df = df.withColumns({
        "title": F.coalesce(X.field(fields, "title"), X.first_heading(F.col("body")), X.title_from_path(F.col("path"))),
        "tags": X.parse_tags(X.field(fields, "tags")), "created": X.field(fields, "created"), "custom_fields": X.custom_fields(fields),
        "word_count": X.word_count(F.col("body")), "links": X.flat_links(content),
    })
    return df.drop("_lines", "_bounds", "_fields")


def in_directory(path: Column, directory: str, recursive: bool = True) -> Column:
    """Whether a path lies in a directory, or directly in it, and no component is hidden."""
    root = directory.rstrip("/") + "/"
    inside = path.startswith(root) & ~path.rlike(r"(?:^|/)\.")
    return inside if recursive else inside & ~F.substr(path, F.lit(len(root) + 1)).contains("/")


def list_notes(notes: DataFrame, directory: str = "notes", recursive: bool = True, tag: str | None = None) -> DataFrame:
    """path, title, tags, modified, created; newest first, ties by path."""
    df = parsed(notes.where(in_directory(F.col("path"), directory, recursive) & F.lower(X.extension(F.col("path"))).isin("md", "markdown")))
    if tag is not None:
        df = df.where(F.array_contains("tags", tag.lower()))
    return df.select("path", "title", "tags", "modified", "created").orderBy(F.desc("modified"), "path")


def note_metadata(notes: DataFrame, path: str) -> DataFrame:
    return parsed(notes.where(F.col("path") == path)).select("path", "title", "tags", "created", "custom_fields", "word_count", "links", "modified")


def tag_counts(notes: DataFrame) -> DataFrame:
    """tag, n: how often each tag occurs over all notes; a tag repeated in a note counts again."""
    return parsed(notes).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def recent_notes(notes: DataFrame, now: dt.datetime, days: int = 7) -> DataFrame:
    """path, title, modified of notes modified within so many days before now; newest first."""
    since = F.lit(now - dt.timedelta(days=days)).cast(dict(notes.dtypes)["modified"])
    return parsed(notes.where(F.col("modified") >= since)).select("path", "title", "modified").orderBy(F.desc("modified"), "path")


def note_index(notes: DataFrame) -> DataFrame:
    """path, entry: the index entry of each note as JSON; the tags key is left out if there are none."""
    df = parsed(notes)
    return df.select("path", F.to_json(F.struct("path", F.when(F.size("tags") > 0, F.col("tags")).alias("tags"), "title")).alias("entry"))


def read_notes(spark: SparkSession, notes: DataFrame, paths: list[str]) -> DataFrame:
    """pos, path, content, word_count, error for the first BATCH paths in order, ``skipped`` for the rest."""
    schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("_want", T.StringType())])
    asked = spark.createDataFrame(list(enumerate(paths)), schema)
    got = parsed(notes.join(F.broadcast(asked.select(F.col("_want").alias("path")).distinct()), "path", "left_semi")).select(F.col("path").alias("_p"), "content", "word_count")
    late = F.col("pos") >= BATCH
    out = F.broadcast(asked).join(got, F.col("_want") == F.col("_p"), "left")
    error = F.when(late, "skipped").when(F.col("_p").isNull(), "not found")
    return out.select("pos", F.col("_want").alias("path"), *[F.when(~late, F.col(c)).alias(c) for c in ("content", "word_count")], error.alias("error")).orderBy("pos")


def read_counts(read: DataFrame) -> DataFrame:
    """asked, found, missing, skipped: how the paths of a batch read fared (see ``read_notes``)."""
    is_ = lambda e: F.count_if(F.col("error").eqNullSafe(F.lit(e)))
    return read.agg(F.count(F.lit(1)).alias("asked"), is_(None).alias("found"), is_("not found").alias("missing"), is_("skipped").alias("skipped"))
