"""Canvas files (JSON graphs of nodes and edges): parsing, validation, summaries, search.

Rows are (path, content, ...). JSON is read into VARIANT, whose schema tells real strings and numbers from others, as a
number where a string is required makes a canvas invalid. The content itself is never rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.functions import text as X

# Fixed values of the canvas format.
NODE_TYPES = ("text", "file", "link", "group")
SIDES, ENDS, STYLES = ("top", "right", "bottom", "left"), ("none", "arrow"), ("cover", "ratio", "repeat")
COLOR = r"^(?:[1-6]|#(?:[0-9A-Fa-f]{3}|[0-9A-Fa-f]{6}))$"
NUMBERS = r"^(?:BIGINT|DOUBLE|DECIMAL.*|FLOAT)$"


def _kind(v: Column, path: str) -> Column:
    """Type of a member of an object: its VARIANT type, VOID for null, or null where there is none."""
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> Column:
    """A member's value if it is really a string."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def parsed(canvases: DataFrame) -> DataFrame:
    """canvases with ``_v`` (VARIANT, null for malformed JSON), ``_nodes`` and ``_edges`` (arrays of VARIANT; null where the
    member is absent or not an array of objects)."""
    v = F.try_parse_json("content")
    df = canvases.withColumn("_v", v)

    def members(name: str) -> Column:
        got = F.try_variant_get("_v", f"$.{name}", "array<variant>")
        whole = F.forall(got, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
        return F.when(whole, got)

    return df.withColumns({"_nodes": members("nodes"), "_edges": members("edges")})


def canvas_nodes(canvases: DataFrame) -> DataFrame:
    """path, pos, id, type, label, text, file, v of every node whose id and type are strings."""
    df = parsed(canvases).select("path", F.posexplode("_nodes").alias("pos", "v"))
    v = F.col("v")
    df = df.select("path", "pos", "v", *[_text(v, f"$.{k}").alias(k) for k in ("id", "type", "text", "label", "file", "url")]).where("id is not null and type is not null")
    first = F.coalesce(F.try_element_at(F.filter(F.split("text", r"[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"), lambda x: x != ""), F.lit(1)), F.lit(""))
    cut = F.when(F.length(first) > 60, F.concat(F.substring(first, 1, 60), F.lit("…"))).otherwise(first)
    brief = F.when(F.col("type") == "group", F.coalesce("label", F.lit("(group)"))).when(F.col("type") == "file", F.coalesce("file", F.lit(""))).when(F.col("type") == "link", F.coalesce("url", F.lit(""))).when(F.col("type") == "text", cut).otherwise("")
    return df.withColumn("brief", brief)


def canvas_edges(canvases: DataFrame) -> DataFrame:
    """path, pos, id, from_node, to_node, v of every edge."""
    df = parsed(canvases).select("path", F.posexplode("_edges").alias("pos", "v"))
    v = F.col("v")
    return df.select("path", "pos", "v", _text(v, "$.id").alias("id"), _text(v, "$.fromNode").alias("from_node"), _text(v, "$.toNode").alias("to_node"))


def canvas_summary(canvases: DataFrame) -> DataFrame:
    """path, node_count, edge_count, breakdown: counts of all members, and of node types by count, then name."""
    df = parsed(canvases)
    types = F.filter(F.transform(F.coalesce("_nodes", F.array().cast("array<variant>")), lambda n: _text(n, "$.type")), lambda t: t.isNotNull())
    df = df.withColumn("_t", types)
    tally = F.transform(F.array_distinct("_t"), lambda t: F.struct((-F.size(F.filter("_t", lambda x: x == t))).alias("n"), t.alias("type")))
    shown = F.transform(F.array_sort(tally), lambda s: F.struct(s["type"].alias("type"), (-s["n"]).cast("int").alias("count")))
    none = F.lit(0)
    return df.select("path", F.coalesce(F.size("_nodes"), none).alias("node_count"), F.coalesce(F.size("_edges"), none).alias("edge_count"), shown.alias("breakdown"))


def list_canvases(canvases: DataFrame) -> DataFrame:
    """The summary of each canvas with its modification time, newest first."""
    return canvas_summary(canvases).join(canvases.select("path", "modified"), "path").orderBy(F.desc("modified"), "path")


def read_canvas(canvases: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """pos, id, type, label, warning of one canvas's nodes; file nodes whose file is missing are flagged."""
    nodes = canvas_nodes(canvases.where(F.col("path") == path))
    return missing_files(nodes, files).select("pos", "id", "type", F.col("brief").alias("label"), "warning").orderBy("pos")


def missing_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes with a warning where a file node's file isn't among files (path)."""
    there = files.select(F.col("path").alias("_there")).distinct()
    df = nodes.join(there, F.col("file") == F.col("_there"), "left")
    return df.withColumn("warning", F.when((F.col("type") == "file") & F.col("_there").isNull(), "file not found")).drop("_there")


def search_canvases(canvases: DataFrame, query: str, max_results: int = 20) -> DataFrame:
    """path, pos, id, type, field, snippet, total: one hit per node, in its text or else its label, by path and position;
    total counts all hits before the limit. An empty query or a limit below one finds nothing."""
    nodes = canvas_nodes(canvases if query and max_results > 0 else canvases.where(F.lit(False)))
    in_text, in_label = X.canvas_snippet(F.col("text"), query or ""), X.canvas_snippet(F.col("label"), query or "")
    hits = nodes.withColumns({"_t": in_text, "_l": in_label}).where("_t is not null or _l is not null")
    hits = hits.select("path", "pos", "id", "type", F.when(F.col("_t").isNotNull(), "text").otherwise("label").alias("field"), F.coalesce("_t", "_l").alias("snippet"))
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return F.broadcast(total).join(hits).orderBy("path", "pos").limit(max(0, max_results)).select("path", "pos", "id", "type", "field", "snippet", "total")


def violations(canvases: DataFrame) -> DataFrame:
    """path, stage, pos, part, code, ref: all that makes a canvas invalid.

    stage 0 a document that isn't an object, 1 a node and 2 an edge out of shape, 3 a node id used before, 4 an edge to a
    node that isn't there (part 0 its start, 1 its end). Ordered by stage, pos, part, the first is what a strict reader
    reports; a canvas without rows is valid. Graph checks are made of canvases in shape only.
    """
    df = parsed(canvases)
    kind = F.schema_of_variant("_v")
    shape = lambda n: F.col("_v").isNotNull() & ~F.coalesce(_kind(F.col("_v"), f"$.{n}").isin("VOID"), F.lit(True)) & F.col(f"_{n}").isNull()
    none = F.lit(None).cast("string")
    broken = df.where(F.col("_v").isNull() | ~kind.startswith("OBJECT") | shape("nodes") | shape("edges")).select("path", F.lit(0).alias("stage"), F.lit(0).alias("pos"), F.lit(0).alias("part"), F.lit("malformed").alias("code"), none.alias("ref"))
    v = F.col("v")
    has = lambda k: _kind(v, f"$.{k}").isNotNull() & (_kind(v, f"$.{k}") != "VOID")
    text = lambda k: _text(v, f"$.{k}")
    optional = lambda k, ok: has(k) & ~F.coalesce(ok(text(k)), F.lit(False))
    is_text = lambda c: c.isNotNull()
    color = optional("color", lambda c: c.rlike(COLOR))
    needs = {"text": "text", "file": "file", "link": "url"}
    node_code = F.when(text("id").isNull(), "id")
    for k in ("x", "y", "width", "height"):
        node_code = node_code.when(~F.coalesce(_kind(v, f"$.{k}").rlike(NUMBERS), F.lit(False)), k)
    node_code = node_code.when(color, "color").when(text("type").isNull(), "type")
    for t, k in needs.items():
        node_code = node_code.when((text("type") == t) & text(k).isNull(), k)
    node_code = node_code.when((text("type") == "file") & optional("subpath", lambda c: c.startswith("#")), "subpath")
    for k in ("label", "background"):
        node_code = node_code.when((text("type") == "group") & optional(k, is_text), k)
    node_code = node_code.when((text("type") == "group") & optional("backgroundStyle", lambda c: c.isin(*STYLES)), "backgroundStyle").when(~text("type").isin(*NODE_TYPES), "unknown type")
    nodes = df.select("path", F.posexplode("_nodes").alias("pos", "v")).select("path", "pos", node_code.alias("code"), text("id").alias("id"))
    edge_code = F.when(text("id").isNull(), "id").when(text("fromNode").isNull(), "fromNode").when(text("toNode").isNull(), "toNode")
    for k in ("fromSide", "toSide"):
        edge_code = edge_code.when(optional(k, lambda c: c.isin(*SIDES)), k)
    for k in ("fromEnd", "toEnd"):
        edge_code = edge_code.when(optional(k, lambda c: c.isin(*ENDS)), k)
    edge_code = edge_code.when(optional("label", is_text), "label").when(color, "color")
    edges = df.select("path", F.posexplode("_edges").alias("pos", "v")).select("path", "pos", edge_code.alias("code"), text("id").alias("id"), text("fromNode").alias("f"), text("toNode").alias("t"))
    misshapen = nodes.where("code is not null").select("path", F.lit(1).alias("stage"), "pos", F.lit(0).alias("part"), "code", F.col("id").alias("ref")).unionByName(
        edges.where("code is not null").select("path", F.lit(2).alias("stage"), "pos", F.lit(0).alias("part"), "code", F.col("id").alias("ref"))
    )
    bad = broken.unionByName(misshapen)
    good = bad.select("path").distinct()
    again = nodes.withColumn("_n", F.row_number().over(W.partitionBy("path", "id").orderBy("pos"))).where("_n > 1").select("path", F.lit(3).alias("stage"), "pos", F.lit(0).alias("part"), F.lit("duplicate id").alias("code"), F.col("id").alias("ref"))
    ends = edges.select("path", "pos", F.posexplode(F.array("f", "t")).alias("part", "ref"))
    lost = ends.join(nodes.select("path", F.col("id").alias("ref")).distinct(), ["path", "ref"], "left_anti").select("path", F.lit(4).alias("stage"), "pos", "part", F.lit("dangling edge").alias("code"), "ref")
    return bad.unionByName(again.unionByName(lost).join(good, "path", "left_anti"))


def canvas_contents(canvases: DataFrame) -> DataFrame:
    """path, node_count, edge_count, content of canvases (path, content): the counts next to the text as it is."""
    return canvas_summary(canvases).select("path", "node_count", "edge_count").join(canvases.select("path", "content"), "path")
