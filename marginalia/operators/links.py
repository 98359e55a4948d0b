"""The link graph: extraction, ranked resolution and backlinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.functions import text as X

_WIKI, _MARKED = r"!?\[\[[^\]]+\]\]", r"!?\[[^\]]*\]\([^)]+\)"


def _after(c: Column, mark: str) -> Column:
    return F.when(F.instr(c, mark) > 0, F.substr(c, F.instr(c, mark)))


def _wiki_parts(inner: Column) -> tuple[Column, Column, Column]:
    alias = X.trim_blank(F.substr(_after(inner, "|"), F.lit(2)))
    bare = F.substring_index(inner, "|", 1)
    return X.trim_blank(F.substring_index(bare, "#", 1)), _after(bare, "#"), F.when(alias != "", alias)


def percent_decoded(c: Column) -> Column:
    """Percent escapes undone; text with an invalid one stays as it is."""
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def extract_links(notes: DataFrame) -> DataFrame:
    """path, pos, target, subpath, alias, is_embed, raw: one row per link of a note (path, content), wiki links first.

    External links (http, https, mailto) and empty targets are left out.
    """
    def found(pattern: str, wiki: bool) -> Column:
        return F.transform(F.regexp_extract_all("content", F.lit(f"({pattern})"), F.lit(1)), lambda r: F.struct(F.lit(wiki).alias("wiki"), r.alias("raw")))

    raws = F.concat(found(_WIKI, True), found(_MARKED, False))
    df = notes.select("path", F.posexplode(raws).alias("pos", "_l")).select("path", "pos", F.col("_l.wiki").alias("_w"), F.col("_l.raw").alias("raw"))
    wt, ws, wa = _wiki_parts(F.regexp_extract("raw", r"^!?\[\[([^\]]+)\]\]$", 1))
    url = F.regexp_replace(X.trim_blank(F.regexp_extract("raw", r"^!?\[[^\]]*\]\(([^)]+)\)$", 1)), r"(?s) .*$", "")
    shown = F.regexp_extract("raw", r"^!?\[([^\]]*)\]", 1)
    df = df.where(F.col("_w") | ~F.lower(url).rlike(r"^(?:https?://|mailto:)"))
    df = df.select(
        "path", "pos", F.when(F.col("_w"), wt).otherwise(X.trim_blank(percent_decoded(F.substring_index(url, "#", 1)))).alias("target"),
        F.when(F.col("_w"), ws).otherwise(_after(url, "#")).alias("subpath"), F.when(F.col("_w"), wa).otherwise(F.when(shown != "", shown)).alias("alias"),
        F.col("raw").startswith("!").alias("is_embed"), "raw",
    )
    return df.where("target <> ''")


def proximity(path: Column, source: Column) -> Column:
    """Leading path components two paths share; 0 without a source."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    same = F.zip_with(parts(path), parts(source), lambda a, b: F.coalesce(a == b, F.lit(False)))
    run = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")))
    return F.coalesce(run["n"], F.lit(0))


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """link_id, match, rank of links (link_id, source, target) among files (path): every match, best first.

    A target with an extension names whole file names, one without ``.md`` notes; case doesn't matter. If the target has
    folders and some matches lie at that very path (case matters), only these stay. Then: more leading components shared
    with the source, shorter path, path. The join is on a key (kind, name), so a popular name is a skewed key that
    adaptive execution splits; rows carry only names.
    """
    name = X.file_name(F.col("path"))
    keys = F.filter(F.array(F.concat(F.lit("n|"), F.lower(name)), F.when(F.lower(X.extension(F.col("path"))) == "md", F.concat(F.lit("s|"), F.lower(X.stem(F.col("path")))))), lambda k: k.isNotNull())
    named = files.select(F.col("path").alias("match"), F.explode(keys).alias("_k"))
    last = F.try_element_at(F.filter(F.split("target", "/"), lambda x: x != ""), F.lit(-1))
    asked = links.where(F.size(F.filter(F.split("target", "/"), lambda x: x != "")) > 0)
    asked = asked.withColumn("_ext", last.rlike(r"^.+\.[^.]+$")).withColumn("_k", F.concat(F.when(F.col("_ext"), "n|").otherwise("s|"), F.lower(last)))
    want = F.concat("target", F.when(F.col("_ext"), "").otherwise(".md"))
    pathed = F.size(F.filter(F.split("target", "/"), lambda x: x != "")) > 1
    hits = asked.join(named, "_k").withColumn("_hit", pathed & ((F.col("match") == F.concat(F.lit("notes/"), want)) | F.col("match").endswith(F.concat(F.lit("/"), want))))
    per_link = W.partitionBy("link_id")
    hits = hits.withColumn("_any", F.max("_hit").over(per_link)).where("_hit or not _any")
    best = per_link.orderBy(F.desc(proximity(F.col("match"), F.col("source"))), F.length("match"), "match")
    return hits.select("link_id", "match", F.row_number().over(best).alias("rank"))


def best_matches(links: DataFrame, files: DataFrame) -> DataFrame:
    """source, target, match: of each different pair of links (source, target) the file (path) that ``resolve_links`` ranks first.

    Files leave their best candidate (shorter path, then path) under every folder above them, by each key they can be asked
    by; a link looks up its own folders, and the deepest with a candidate wins. So a name that many files bear and many links
    ask for is met once for each link and folder, never file by link.
    """
    parts = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "/"), lambda x: x != "")
    above = lambda p: F.transform(F.sequence(F.lit(0), F.size(p)), lambda n: F.array_join(F.slice(p, F.lit(1), n), "/"))
    name = F.lower(X.file_name(F.col("path")))
    by_name = F.array(F.concat(F.lit("n|"), name), F.when(F.lower(X.extension(F.col("path"))) == "md", F.concat(F.lit("s|"), F.lower(X.stem(F.col("path"))))))
    steps = F.split("path", "/")
    by_path = F.when(F.size(steps) > 2, F.transform(F.sequence(F.lit(2), F.size(steps) - 1), lambda n: F.concat(F.lit("w|"), F.array_join(F.slice(steps, F.size(steps) - n + 1, n), "/"))))
    keys = F.array_compact(F.concat(by_name, F.coalesce(by_path, F.array().cast("array<string>"))))
    under = files.select("path", F.explode(keys).alias("_k"), parts(F.col("path")).alias("_p")).select("path", "_k", F.explode(above(F.col("_p"))).alias("_d"))
    under = under.groupBy("_k", "_d").agg(F.min(F.struct(F.length("path").alias("n"), F.col("path").alias("match"))).alias("_b"))

    asked = links.select("source", "target").distinct().withColumn("_t", parts(F.col("target"))).where(F.size("_t") > 0)
    last = F.element_at("_t", -1)
    ext = last.rlike(r"^.+\.[^.]+$")
    looks = F.array_compact(F.array(F.concat(F.when(ext, "n|").otherwise("s|"), F.lower(last)), F.when(F.size("_t") > 1, F.concat(F.lit("w|"), "target", F.when(ext, "").otherwise(".md")))))
    asked = asked.select("source", "target", F.explode(looks).alias("_k"), parts(F.col("source")).alias("_p")).select("source", "target", "_k", F.posexplode(above(F.col("_p"))).alias("_depth", "_d"))
    # A target's own folders, where they lead to a file, go before its name alone.
    order = F.struct(F.col("_k").startswith("w|").alias("whole"), "_depth")
    return asked.join(under, ["_k", "_d"]).groupBy("source", "target").agg(F.max_by("_b.match", order).alias("match"))


def backlinks(notes: DataFrame, files: DataFrame, only: str | None = None) -> DataFrame:
    """target, path, raw, is_embed: every link of a ``.md`` note whose best match is target. Repeats and self-links stay.

    only: one target; links that don't bear its name aren't resolved then.
    """
    edges = extract_links(notes.where(F.lower(X.extension(F.col("path"))) == "md"))
    if only is not None:
        name = only.rsplit("/", 1)[-1].lower()
        names = [name, name.removesuffix(".md")] if name.endswith(".md") else [name]
        edges = edges.where(F.lower(F.try_element_at(F.filter(F.split("target", "/"), lambda x: x != ""), F.lit(-1))).isin(names))
    best = best_matches(edges.select(F.col("path").alias("source"), "target"), files)
    best = best.select(F.col("source").alias("path"), F.col("target"), "match")
    found = edges.join(best, ["path", "target"]).select(F.col("match").alias("target"), "path", "raw", "is_embed")
    return found if only is None else found.where(F.col("target") == F.lit(only))


def canonical_target(files: DataFrame, name: str) -> str | None:
    """The one path a backlink query means: the exact path, else the best match of the name; null if there is none."""
    bare = name.strip()
    spark = files.sparkSession
    if files.where(F.col("path") == bare).limit(1).count():
        return bare
    link = spark.createDataFrame([(1, None, bare.removeprefix("notes/"))], "link_id int, source string, target string")
    got = resolve_links(link, files).where("rank = 1").limit(1).collect()
    return got[0]["match"] if got else None


def find_backlinks(notes: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """path, raw, is_embed of the links that lead to one file, by path and raw text."""
    target = canonical_target(files, name)
    if target is None:
        return backlinks(notes.limit(0), files).select("path", "raw", "is_embed")
    return backlinks(notes, files, target).select("path", "raw", "is_embed").orderBy("path", "raw")
