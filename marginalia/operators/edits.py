"""Edits of many files at once, as one plan: every edit of a table is judged and turned into the version row to append.

An edit is (pos, op, path, new_path, content, seq); op is one of create, replace, append, move, delete, revert. All are judged
against the state before the batch, so their order doesn't matter; a path that two edits touch makes an error of both.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.functions import text as X
from marginalia.operators.history import path_events, state


def numbered(rows: DataFrame, key: str, out: str, start: Column) -> DataFrame:
    """rows with numbers without gaps from start on. Rows are numbered within hash ranges of key, and the ranges' sums are
    carried on: no task holds all rows, and only a few thousand sums meet in one."""
    ranged = rows.withColumn("_r", F.shiftright(F.xxhash64(key), 52))
    sums = ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("_c"))
    sums = sums.select("_r", F.coalesce(F.sum("_c").over(W.partitionBy(F.lit(1)).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(W.partitionBy("_r").orderBy(key))
    # At most 4096 sums, as the ranges are the hash's first twelve bits.
    return ranged.join(F.broadcast(sums), "_r").withColumn(out, (start + F.col("_before") + inner - 1).cast("bigint")).drop("_r", "_before")


def edited(versions: DataFrame, edits: DataFrame, now: dt.datetime) -> DataFrame:
    """pos, op, path, new_path, content, message, error of each edit: what its version row holds, or why it can't be made
    (content and message are null then).

    Errors: ``path twice``, ``exists``, ``no such file``, ``destination exists``, ``no such version``, ``unknown operation``. New
    notes get front matter unless they begin with it; what is appended begins on a new line; a deletion keeps the content and
    names the file's place in the trash. Null contents count as empty.
    """
    touched = edits.select(F.explode(F.array_compact(F.array("path", "new_path"))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("path", F.lit(True).alias("_twice"))
    live = state(versions).select("path", F.col("content").alias("_old"), F.lit(True).alias("_is"))
    rows = edits.join(live, "path", "left").join(live.select(F.col("path").alias("new_path"), F.lit(True).alias("_taken")), "new_path", "left")
    rows = rows.join(touched, "path", "left").join(touched.select(F.col("path").alias("new_path"), F.col("_twice").alias("_also")), "new_path", "left")
    asked = edits.where("op = 'revert'").select("pos", "path", F.col("seq").alias("_upto"))
    back = path_events(versions).join(asked, "path").where("seq <= _upto").groupBy("pos").agg(F.max(F.struct("seq", "live", "content")).alias("_l"))
    rows = rows.join(back.where("_l.live").select("pos", F.col("_l.content").alias("_then"), F.lit(True).alias("_was")), "pos", "left")

    op, body, old = F.col("op"), F.coalesce("content", F.lit("")), F.coalesce("_old", F.lit(""))
    known = op.isin("create", "replace", "append", "move", "delete", "revert")
    error = (
        F.when(F.coalesce("_twice", "_also", F.lit(False)), "path twice").when(~F.coalesce(known, F.lit(False)), "unknown operation").when((op == "create") & F.col("_is"), "exists")
        .when((op == "revert") & F.col("_was").isNull(), "no such version").when(~op.isin("create", "revert") & F.col("_is").isNull(), "no such file")
        .when((op == "move") & F.col("_taken") & (F.lower("path") != F.lower("new_path")), "destination exists")
    )
    head = X.new_frontmatter(X.title_from_path(F.col("path")), F.lit(f"{now:%Y-%m-%d}"), F.array().cast("array<string>"))
    made = F.when(X.trim_space(body).startswith("---"), body).otherwise(F.concat(head, F.lit("\n"), body))
    text = F.when(op == "create", made).when(op == "replace", body).when(op == "append", F.concat(old, F.lit("\n"), body)).when(op == "revert", F.col("_then")).otherwise(F.col("_old"))
    trash = X.trash_name(F.lit(now).cast("timestamp_ntz"), F.col("path"))
    message = (
        F.when(op == "move", F.concat(F.lit("Move "), "path", F.lit(" to "), "new_path")).when(op == "delete", F.concat(F.lit("Delete "), "path", F.lit(" to "), trash))
        .when(op == "revert", F.concat(F.lit("Revert "), "path", F.lit(" to "), F.col("seq").cast("string"))).when(op == "create", F.concat(F.lit("Create "), "path")).otherwise(F.concat(F.lit("Update "), "path"))
    )
    rows = rows.withColumn("error", error)
    fine = F.col("error").isNull()
    return rows.select("pos", "op", "path", "new_path", F.when(fine, text).alias("content"), F.when(fine, message).alias("message"), "error")


def version_rows(versions: DataFrame, edits: DataFrame, now: dt.datetime) -> DataFrame:
    """The version rows of all edits that can be made, numbered on from the last version: one append to the versions."""
    last = versions.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_b"))
    kind = F.when(F.col("op").isin("replace", "append"), "update").otherwise(F.col("op"))
    rows = edited(versions, edits, now).where("error is null").withColumn("op", kind).join(F.broadcast(last))
    rows = numbered(rows, "path", "seq", F.col("_b") + 1)
    return rows.select("seq", F.lit(now).cast(dict(versions.dtypes)["ts"]).alias("ts"), "op", "path", "new_path", "content", "message")
