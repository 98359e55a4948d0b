"""The driver's tables as the relations of a vault. The oracles build the same relations (see oracle_vault)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import table


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: path, content, modified."""
    path = F.concat(F.lit("notes/"), F.coalesce("source", F.lit("none")), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"), "modified")


def _placed(vault: str, path: str) -> F.Column:
    return F.concat(F.lit("notes/"), F.col(vault), F.substring(path, 6, 1 << 20))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live files of all vaults under one root, and the shared ones: path, size_bytes, modified."""
    own = table(spark, sf_dir, "vault_files").where("deleted_at is null").groupBy(_placed("vault_key", "file_path").alias("path")).agg(F.max("size_bytes").alias("size_bytes"), F.max("modified").alias("modified"))
    hub = table(spark, sf_dir, "hub_files").where("deleted_at is null").select(F.col("file_path").alias("path"), F.lit(None).cast("bigint").alias("size_bytes"), F.col("added_at").alias("modified"))
    return own.unionByName(hub)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links once each: link_id, source, target."""
    return table(spark, sf_dir, "parsed_links").where("target is not null").select("link_id", _placed("vault_key", "note_path").alias("source"), "target").distinct()


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference pages once each: path, page, label, text."""
    path = F.concat(F.lit("references/"), F.col("vault_key"), F.substring("ref_path", 11, 1 << 20))
    return table(spark, sf_dir, "ref_pages").select("page_id", path.alias("path"), F.col("page_number").alias("page"), F.col("book_label").alias("label"), "text").distinct()


def reference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the references and what is cached of them: path, size_bytes, modified; and path, title, author, pages,
    version, source_modified."""
    path = F.concat(F.lit("references/"), F.col("vault_key"), F.substring("ref_path", 11, 1 << 20))
    return table(spark, sf_dir, "cache_metadata").select(
        "cache_id", path.alias("path"), (F.col("cache_id") * 1000).alias("size_bytes"), (F.col("source_modified") + F.expr("make_dt_interval(0, 0, 0, cast(cache_id % 3 - 1 as int))")).alias("modified"),
        "title", "author", F.col("total_pages").alias("pages"), F.col("cache_version").alias("version"), "source_modified",
    ).distinct()


def canvases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canvas documents (a node on each line) as canvas files: path, content, modified. Edges lead from the node named like
    the document's id, which is never there, to itself."""
    body = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(",")), F.lit('"x":'), F.lit('"width":10,"height":10,"x":'))
    edge = F.concat(F.lit('],"edges":[{"id":"e1","fromNode":"'), F.col("doc_id").cast("string"), F.lit('","toNode":"'), F.col("doc_id").cast("string"), F.lit('"}]}'))
    path = F.concat(F.lit("notes/canvas/"), F.col("doc_id").cast("string"), F.lit(".canvas"))
    return table(spark, sf_dir, "documents").where("source = 'canvas' and text is not null").select(path.alias("path"), F.concat(F.lit('{"nodes":['), body, edge).alias("content"), "modified")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as versions of forty files in each vault."""
    op = F.when(F.col("doc_id") % 10 == 9, "delete").when(F.col("doc_id") % 10 == 0, "create").otherwise("update")
    path = F.concat(F.lit("notes/"), "vault_key", F.lit("/p"), (F.col("doc_id") % 40).cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("modified").alias("ts"), op.alias("op"), path.alias("path"), F.lit(None).cast("string").alias("new_path"), F.col("text").alias("content"),
        F.concat(op, F.lit(" "), path).alias("message"),
    )
