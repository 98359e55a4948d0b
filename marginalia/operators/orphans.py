"""References to files that are missing, deleted or not there yet.

References and file names become one stream of events by key: a file's addition and removal, and each reference at its
time. The stream is co-partitioned and sorted by key and time and merged in one linear pass, where running sums over the
files' validity intervals tell what a reference meets: ``live`` (no finding), else ``deleted``, else ``late``, else ``missing``.

A key that holds a large part of all rows is split by spans of thirty days, and such a span, where it holds many rows, by
finer ones: a span's running sums start from what earlier spans of its key add up to, which comes from sums already
aggregated by key and span. So no task holds a key's whole history, nor a hot month; only rows of one key at nearly the
same instant meet in one.

Names compare trimmed, NFC-composed and without case. A null or empty name, an external one (http, https, mailto) and
a reference without time or id is none. A reference without vault meets only the files that all vaults share.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from marginalia.session import bounded, cut, utc_date, utc_micros

#: Rows of one key in thirty days from which on these days are split, and parts they are split into at most.
HOT_SPAN, MOST_PARTS = 20_000, 4096
_SPAN = 30 * 86_400_000_000

_EXTERNAL = r"(?i)^\s*(?:https?:|mailto:)"


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    nfc = unicodedata.normalize
    return s.map(lambda x: None if x is None else nfc("NFC", nfc("NFC", x).casefold()))


def fold_name(col: Column) -> Column:
    """A name trimmed, in composed form and without case; only names beyond ASCII go through Python."""
    bare = F.regexp_replace(col, r"^[\s\p{Z}]+|(?<![\s\p{Z}])[\s\p{Z}]++$", "")
    plain = bare.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, F.lower(bare)).otherwise(_compose(F.when(~plain, bare)))


def file_keys(folded: Column) -> Column:
    """The keys by which a file can be named: its whole path, its name and, of a ``.md`` file, its name without ending."""
    name = F.trim(F.substring_index(folded, "/", -1))
    stem = F.when(name.endswith(".md"), F.concat(F.lit("s|"), F.regexp_replace(name, r"\.md$", "")))
    return F.filter(F.array(F.concat(F.lit("p|"), folded), F.concat(F.lit("n|"), name), stem), lambda x: x.isNotNull())


def target_key(folded: Column) -> Column:
    """The key a link target looks for: a file name if its last component has an extension, else a note's name."""
    name = F.trim(F.substring_index(folded, "/", -1))
    return F.concat(F.when(name.rlike(r"\.[^.]+$"), "n|").otherwise("s|"), name)


def reference_states(references: DataFrame, files: DataFrame, shared: DataFrame) -> DataFrame:
    """tbl, ref_id, pos, state, ref_month of the references that meet no live file.

    references: tbl, ref_id, pos, vault_key, key, at (microseconds), ref_month; files: vault_key, file_path, added, deleted
    (microseconds); shared: file_path, added, deleted, of files that every vault has.
    """
    scoped = lambda: F.concat_ws("\u0001", "vault_key", "key")
    month = F.floor(F.col("at") / F.lit(_SPAN)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    sides = files.where("vault_key is not null and file_path is not null and added is not null").withColumn("key", F.explode(file_keys(fold_name(F.col("file_path")))))
    sides = sides.withColumn("key", scoped())
    sound = F.col("deleted").isNull() | (F.col("deleted") > F.col("added"))
    came = sides.select("key", F.col("added").alias("at"), F.when(sound, 1).otherwise(0).cast("bigint").alias("live"), zero.alias("gone"), F.lit(1).cast("bigint").alias("came"))
    went = sides.where("deleted is not null").select("key", F.col("deleted").alias("at"), F.when(sound, -1).otherwise(0).cast("bigint").alias("live"), F.lit(1).cast("bigint").alias("gone"), zero.alias("came"))
    changes = cut(came.unionByName(went).withColumn("month", month))
    asked = cut(references.withColumn("own", F.col("key")).withColumn("key", F.when(F.col("vault_key").isNotNull(), scoped()).otherwise(F.lit("\u0001"))).withColumn("month", month).drop("vault_key"))

    # Thirty days of a key with many rows are cut into finer spans of equal length.
    rows = changes.select("key", "month").unionByName(asked.select("key", "month")).groupBy("key", "month").agg(F.count(F.lit(1)).alias("_n"))
    hot = bounded(rows.where(F.col("_n") > HOT_SPAN).select("key", "month", F.least(F.lit(MOST_PARTS), F.ceil(F.col("_n") / F.lit(HOT_SPAN)) * 4).cast("bigint").alias("_p")))
    part = F.floor((F.col("at") - F.col("month") * F.lit(_SPAN)) / F.lit(_SPAN) * F.coalesce("_p", F.lit(1)))
    spanned = lambda df: df.join(hot, ["key", "month"], "left").withColumn("bucket", (F.col("month") * F.lit(MOST_PARTS) + part).cast("bigint")).drop("_p", "month")
    changes, asked = spanned(changes), spanned(asked)

    # What earlier buckets of a key add up to, and its additions in all, from sums by key and bucket.
    sums = changes.groupBy("key", "bucket").agg(F.sum("live").alias("live"), F.sum("gone").alias("gone"), F.sum("came").alias("came"), F.lit(0).alias("refs"))
    sums = sums.unionByName(asked.groupBy("key", "bucket").agg(F.lit(0).cast("bigint").alias("live"), F.lit(0).cast("bigint").alias("gone"), F.lit(0).cast("bigint").alias("came"), F.lit(1).alias("refs")))
    before = W.partitionBy("key").orderBy("bucket").rangeBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        "key", "bucket", "refs", *[F.coalesce(F.sum(x).over(before), zero).alias(x) for x in ("live", "gone", "came")], F.sum("came").over(W.partitionBy("key")).alias("all")
    ).where("refs = 1").drop("refs")

    none = lambda t: F.lit(None).cast(t)
    cols = ("tbl string", "ref_id bigint", "pos bigint", "ref_month string", "own string")
    blank = [none(x.split()[1]).alias(x.split()[0]) for x in cols]
    events = (
        carried.select("key", "bucket", F.lit(0).alias("turn"), none("bigint").alias("at"), "live", "gone", "came", "all", *blank)
        .unionByName(changes.select("key", "bucket", F.lit(1).alias("turn"), "at", "live", "gone", "came", zero.alias("all"), *blank))
        .unionByName(asked.select("key", "bucket", F.lit(2).alias("turn"), "at", zero.alias("live"), zero.alias("gone"), zero.alias("came"), zero.alias("all"), *[x.split()[0] for x in cols]))
    )
    merge = W.partitionBy("key", "bucket").orderBy(F.col("at").asc_nulls_first(), "turn").rowsBetween(W.unboundedPreceding, 0)
    met = events.select("turn", "at", *[x.split()[0] for x in cols], *[F.sum(x).over(merge).alias(x) for x in ("live", "gone", "came", "all")]).where("turn = 2")

    common = shared.where("file_path is not null and added is not null").withColumn("_own", F.explode(file_keys(fold_name(F.col("file_path")))))
    common = common.groupBy("_own").agg(F.collect_list(F.struct("added", "deleted")).alias("_spans"))
    met = met.join(bounded(common), F.col("own") == F.col("_own"), "left")
    spans = F.coalesce("_spans", F.array().cast("array<struct<added:bigint,deleted:bigint>>"))
    at = F.col("at")
    live = (F.col("live") > 0) | F.exists(spans, lambda x: (x["added"] <= at) & (x["deleted"].isNull() | (x["deleted"] > at)))
    gone = (F.col("gone") > 0) | F.exists(spans, lambda x: F.coalesce(x["deleted"] <= at, F.lit(False)))
    late = (F.col("all") > F.col("came")) | F.exists(spans, lambda x: x["added"] > at)
    state = F.when(gone, "deleted").when(late, "late").otherwise("missing")
    return met.where(~live).select("tbl", "ref_id", "pos", state.alias("state"), "ref_month").dropDuplicates(["tbl", "ref_id", "pos"])


def found_orphans(links: DataFrame, resolutions: DataFrame, canvas_nodes: DataFrame, files: DataFrame, hub_files: DataFrame) -> DataFrame:
    """tbl, ref_id, pos, state, ref_month: one row per reference to a file that isn't live at the reference's time.

    Only the columns needed are read, so extra ones don't matter; empty tables give no rows; a record that arrives again
    unchanged counts once.
    """

    def asked(tbl: str, df: DataFrame, key: str, at: str, name: Column, pos: Column, by: str) -> DataFrame:
        rows = df.select(
            F.lit(tbl).alias("tbl"), F.col(key).cast("bigint").alias("ref_id"), pos.cast("bigint").alias("pos"), "vault_key", name.alias("_name"),
            F.lit(by).alias("_by"), utc_micros(df, at).alias("at"), F.date_format(utc_date(df, at), "yyyy-MM").alias("ref_month"),
        )
        return rows.where(F.col("ref_id").isNotNull() & F.col("at").isNotNull() & F.col("_name").rlike(r"[^\s\p{Z}]") & ~F.col("_name").rlike(_EXTERNAL))

    listed = resolutions.select("resolution_id", "vault_key", "resolved_at", F.posexplode("matches").alias("_pos", "_match"))
    refs = (
        asked("parsed_links", links, "link_id", "seen_at", F.col("target"), F.lit(0), "t")
        .unionByName(asked("resolutions", listed, "resolution_id", "resolved_at", F.col("_match"), F.col("_pos") + 1, "p"))
        .unionByName(asked("canvas_nodes", canvas_nodes.where("node_type = 'file'"), "node_row_id", "seen_at", F.col("label"), F.lit(0), "p"))
        .withColumn("_folded", fold_name(F.col("_name")))
    )
    refs = refs.withColumn("key", F.when(F.col("_by") == "p", F.concat(F.lit("p|"), "_folded")).otherwise(target_key(F.col("_folded")))).drop("_name", "_by", "_folded")
    span = lambda df: [utc_micros(df, "added_at").alias("added"), utc_micros(df, "deleted_at").alias("deleted")]
    return reference_states(refs, files.select("vault_key", "file_path", *span(files)), hub_files.select("file_path", *span(hub_files)))
