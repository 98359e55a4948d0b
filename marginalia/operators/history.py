"""History and edits as append-only versions.

A version is (seq, ts, op, path, new_path, content, message); op is one of create, update, move, delete, revert, snapshot.
The state of the vault at any time is what the versions up to it leave. Edits return the version rows to append, after
checking the whole batch, so a batch is applied as one append or not at all.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from marginalia.functions import text as X

BATCH = 20
VERSION = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("op", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("new_path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("message", T.StringType()),
])


class EditError(ValueError):
    """An edit that can't be made; nothing of its batch is."""


def path_events(versions: DataFrame) -> DataFrame:
    """path, seq, live, content: what each version leaves of each path it touches. A move ends one path and begins another;
    its row carries the content."""
    ends = versions.where("op = 'move'").select("path", "seq", F.lit(False).alias("live"), F.lit(None).cast("string").alias("content"))
    rows = versions.where("op <> 'move'").select("path", "seq", (F.col("op") != "delete").alias("live"), "content")
    begins = versions.where("op = 'move'").select(F.col("new_path").alias("path"), "seq", F.lit(True).alias("live"), "content")
    return rows.unionByName(ends).unionByName(begins)


def state(versions: DataFrame, upto: int | None = None) -> DataFrame:
    """path, content, seq: the live files after all versions, or those up to a number."""
    v = versions if upto is None else versions.where(F.col("seq") <= upto)
    last = path_events(v).groupBy("path").agg(F.max(F.struct("seq", "live", "content")).alias("l"))
    return last.where("l.live").select("path", F.col("l.content").alias("content"), F.col("l.seq").alias("seq"))


def file_history(versions: DataFrame, path: str, max_entries: int = 10) -> DataFrame:
    """seq, ts, op, message of a path, newest first; a rename is not followed."""
    hit = versions.where((F.col("path") == path) | (F.col("new_path") == path))
    return hit.select("seq", "ts", "op", "message").orderBy(F.desc("ts"), F.desc("seq")).limit(max(0, max_entries))


def changelog(versions: DataFrame, max_entries: int = 20, since: str | None = None) -> DataFrame:
    """seq, ts, op, path, message of the vault, newest first, from an ISO time on if one is given."""
    v = versions if since is None else versions.where(F.col("ts") >= F.lit(since).cast(dict(versions.dtypes)["ts"]))
    return v.select("seq", "ts", "op", "path", "message").orderBy(F.desc("ts"), F.desc("seq")).limit(max(0, max_entries))


def file_at(versions: DataFrame, path: str, seq: int) -> DataFrame:
    """path, content of one file as of a version."""
    return state(versions.where((F.col("path") == path) | (F.col("new_path") == path)), seq).where(F.col("path") == path).select("path", "content")


def files_changed(versions: DataFrame, seq: int) -> DataFrame:
    return versions.where(F.col("seq") == seq).select(F.explode(F.array_compact(F.array("path", "new_path"))).alias("path")).distinct()


def dirty(versions: DataFrame, files: DataFrame) -> DataFrame:
    """path, change: how files (path, content) differ from the recorded state: added, changed, removed."""
    old = state(versions).select("path", F.col("content").alias("_o"), F.lit(True).alias("_was"))
    both = files.select("path", F.col("content").alias("_n"), F.lit(True).alias("_is")).join(old, "path", "full")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def patched(content: Column, patches: Column) -> Column:
    """(text, error, applied) of an array of (old_text, new_text) applied in order.

    Each old text must occur exactly once when its turn comes; equal texts are skipped; an empty old text is not found.
    The first error stops the rest and keeps the text.
    """

    def step(s: Column, p: Column) -> Column:
        old, new = p["old_text"], p["new_text"]
        n = F.when(F.length(old) > 0, (F.length(s["text"]) - F.length(F.replace(s["text"], old, F.lit("")))) / F.length(old)).otherwise(0)
        skip = s["error"].isNotNull() | (old == new)
        error = F.when(skip, s["error"]).when(n == 0, "not found").when(n > 1, "ambiguous")
        return F.struct(F.when(skip | error.isNotNull(), s["text"]).otherwise(F.replace(s["text"], old, new)).alias("text"), error.alias("error"), (s["applied"] + F.when(skip | error.isNotNull(), 0).otherwise(1)).alias("applied"))

    start = F.struct(content.alias("text"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("applied"))
    return F.aggregate(patches, start, step)


def patch_notes(notes: DataFrame, ops: DataFrame) -> DataFrame:
    """path, content, error, applied of notes (path, content) under ops (path, patches): a batch of 1 to 20 patches each.
    On an error the content is null, as nothing is written."""
    df = ops.join(notes.select("path", "content"), "path", "left")
    size = F.size("patches")
    df = df.withColumn("_r", patched(F.coalesce("content", F.lit("")), F.when(size <= BATCH, F.col("patches"))))
    error = F.when(~size.between(1, BATCH), "1 to 20 patches").when(F.col("content").isNull(), "no such file").otherwise(F.col("_r.error"))
    return df.select("path", F.when(error.isNull(), F.col("_r.text")).alias("content"), error.alias("error"), F.when(error.isNull(), F.col("_r.applied")).otherwise(0).alias("applied"))


def move_conflicts(moves: DataFrame, files: DataFrame) -> DataFrame:
    """pos, code of what forbids a batch of moves (pos, source, destination) among files (path): batch size, same source or
    destination twice (regardless of case), a source that is also a destination, a missing source, a taken destination
    (unless only its case changes). No rows: the batch may go."""
    n = moves.agg(F.count(F.lit(1)).alias("n")).where(~F.col("n").between(1, BATCH)).select(F.lit(None).cast("int").alias("pos"), F.lit("1 to 20 moves").alias("code"))
    low = moves.withColumns({"_s": F.lower("source"), "_d": F.lower("destination")})
    out = n
    for col, code in (("_s", "source twice"), ("_d", "destination twice")):
        twice = low.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(col))).where("_n > 1").select("pos", F.lit(code).alias("code"))
        out = out.unionByName(twice)
    both = low.join(low.select(F.col("_d").alias("_o"), F.col("pos").alias("_p")), (F.col("_s") == F.col("_o")) & (F.col("pos") != F.col("_p")), "left_semi").select("pos", F.lit("source is a destination").alias("code"))
    gone = low.join(files.select(F.col("path").alias("source")), "source", "left_anti").select("pos", F.lit("missing source").alias("code"))
    taken = low.where("_s <> _d").join(files.select(F.col("path").alias("destination")), "destination", "left_semi").select("pos", F.lit("destination exists").alias("code"))
    return out.unionByName(both).unionByName(gone).unionByName(taken)


def _version(spark: SparkSession, versions: DataFrame, rows: list[tuple], now: dt.datetime) -> DataFrame:
    seq = (versions.agg(F.max("seq")).first()[0] or 0) + 1
    return spark.createDataFrame([(seq + i, now, *r) for i, r in enumerate(rows)], VERSION)


def _content(versions: DataFrame, path: str) -> str | None:
    got = state(versions.where((F.col("path") == path) | (F.col("new_path") == path))).where(F.col("path") == path).limit(1).collect()
    return got[0]["content"] if got else None


def create(versions: DataFrame, path: str, content: str, now: dt.datetime, tags: list[str] = ()) -> DataFrame:
    """A new note; front matter is added unless the content begins with it."""
    if _content(versions, path) is not None:
        raise EditError(f"exists: {path}")
    if not content.strip().startswith("---"):
        clean = [t.strip().lower() for t in tags]
        title = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].replace("-", " ").replace("_", " ")
        head = ["---", f"title: {title}", f"created: {now:%Y-%m-%d}", *([f"tags: [{', '.join(clean)}]"] if clean else []), "---"]
        content = "\n".join(head) + "\n\n" + content
    return _version(versions.sparkSession, versions, [("create", path, None, content, f"Create {path}")], now)


def update(versions: DataFrame, path: str, content: str, now: dt.datetime, mode: str = "replace") -> DataFrame:
    """A note replaced, or appended to on a new line; any other mode replaces."""
    old = _content(versions, path)
    if old is None:
        raise EditError(f"no such file: {path}")
    return _version(versions.sparkSession, versions, [("update", path, None, f"{old}\n{content}" if mode == "append" else content, f"Update {path}")], now)


def delete(versions: DataFrame, path: str, now: dt.datetime, others: DataFrame | None = None) -> DataFrame:
    """A tombstone; the message names the file's place in the trash. others (path): files without versions, such as attachments,
    that can be deleted as well."""
    old = _content(versions, path)
    if old is None and (others is None or others.where(F.col("path") == path).isEmpty()):
        raise EditError(f"no such file: {path}")
    trash = f"{now:%Y-%m-%dT%H-%M-%SZ}_{path.rsplit('/', 1)[-1]}"
    return _version(versions.sparkSession, versions, [("delete", path, None, old, f"Delete {path} to {trash}")], now)


def move(versions: DataFrame, moves: list[tuple[str, str]], now: dt.datetime) -> DataFrame:
    """A batch of moves, all or none."""
    spark = versions.sparkSession
    files = state(versions)
    asked = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(moves)], "pos int, source string, destination string")
    bad = move_conflicts(asked, files).limit(1).collect()
    if bad:
        raise EditError(f"{bad[0]['code']} ({bad[0]['pos']})")
    got = {r["path"]: r["content"] for r in files.join(F.broadcast(asked.select(F.col("source").alias("path"))), "path", "left_semi").collect()}
    return _version(spark, versions, [("move", s, d, got[s], f"Move {s} to {d}") for s, d in moves], now)


def revert(versions: DataFrame, path: str, seq: int, now: dt.datetime) -> DataFrame:
    """A file's content of an earlier version as a new one."""
    got = file_at(versions, path, seq).limit(1).collect()
    if not got:
        raise EditError(f"{path} does not exist in version {seq}")
    return _version(versions.sparkSession, versions, [("revert", path, None, got[0]["content"], f"Revert {path} to {seq}")], now)


def snapshot(versions: DataFrame, files: DataFrame, now: dt.datetime) -> DataFrame:
    """Version rows that bring the recorded state to files (path, content), numbered in ranges of paths' hashes."""
    from marginalia.operators.edits import numbered

    base = versions.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_b"))
    diff = dirty(versions, files).join(files.select("path", "content"), "path", "left").join(F.broadcast(base))
    rows = numbered(diff, "path", "seq", F.col("_b") + 1)
    return rows.select("seq", F.lit(now).cast("timestamp").alias("ts"), F.when(F.col("change") == "removed", "delete").otherwise("snapshot").alias("op"), "path", F.lit(None).cast("string").alias("new_path"), "content", F.concat(F.lit("Snapshot "), "change").alias("message"))


def log_message(c: Column) -> Column:
    return X.message_line(c)
