"""Queries of the vault's own operators over the driver's tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import attachments, canvas, edits, guards, history, images, links, notes, references, search
from marginalia.plans import vault_views as V
from marginalia.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]
NOW = dt.datetime(2025, 12, 31)
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def search_notes_single(s: SparkSession, d: str) -> DataFrame:
    """One term, best twenty."""
    return search.search_notes(V.notes(s, d), "the")


@query
def search_notes_multi(s: SparkSession, d: str) -> DataFrame:
    """Two terms that must both occur."""
    return search.search_notes(V.notes(s, d), "Canal, the", 50)


@query
def search_notes_repeated_token(s: SparkSession, d: str) -> DataFrame:
    """A repeated term counts again."""
    return search.search_notes(V.notes(s, d), "map map", 30)


@query
def note_frontmatter(s: SparkSession, d: str) -> DataFrame:
    df = notes.parsed(V.notes(s, d))
    return df.select("path", "title", "created", F.array_join("tags", ",").alias("tags"), F.size(F.map_keys("custom_fields")).cast("bigint").alias("n_custom"), F.length("body").cast("bigint").alias("body_chars"))


@query
def note_word_count(s: SparkSession, d: str) -> DataFrame:
    return notes.parsed(V.notes(s, d)).select("path", F.col("word_count").cast("bigint").alias("word_count"))


@query
def note_links_flat(s: SparkSession, d: str) -> DataFrame:
    return notes.parsed(V.notes(s, d)).where(F.size("links") > 0).select("path", F.array_join("links", "\n").alias("links"))


@query
def link_edges(s: SparkSession, d: str) -> DataFrame:
    return links.extract_links(V.notes(s, d)).select("path", F.col("pos").cast("bigint").alias("pos"), "target", "subpath", "alias", "is_embed", "raw")


@query
def resolve_links_ranked(s: SparkSession, d: str) -> DataFrame:
    """Every match of every link, best first."""
    return links.resolve_links(V.links(s, d), V.files(s, d)).select("link_id", "match", F.col("rank").cast("bigint").alias("rank"))


@query
def resolve_ambiguous(s: SparkSession, d: str) -> DataFrame:
    """Links with several matches and how many."""
    return resolve_links_ranked(s, d).groupBy("link_id").agg(F.count(F.lit(1)).alias("matches")).where("matches > 1")


@query
def dangling_links(s: SparkSession, d: str) -> DataFrame:
    """Links without any match."""
    return V.links(s, d).join(resolve_links_ranked(s, d).select("link_id").distinct(), "link_id", "left_anti").select("link_id", "target")


@query
def backlinks_all(s: SparkSession, d: str) -> DataFrame:
    """Number of links that lead to each file, from the text of all notes."""
    return links.backlinks(V.notes(s, d), V.files(s, d)).groupBy("target").agg(F.count(F.lit(1)).alias("links"), F.count_if("is_embed").alias("embeds"))


@query
def backlinks_to_one(s: SparkSession, d: str) -> DataFrame:
    return links.find_backlinks(V.notes(s, d), V.files(s, d), "Home")


@query
def list_notes_by_dir(s: SparkSession, d: str) -> DataFrame:
    return notes.list_notes(V.notes(s, d), "notes/meeting", recursive=False).select("path", "title", "modified")


@query
def list_notes_by_tag(s: SparkSession, d: str) -> DataFrame:
    return notes.list_notes(V.notes(s, d), tag="Botany").select("path", "title", "modified")


@query
def tag_counts(s: SparkSession, d: str) -> DataFrame:
    return notes.tag_counts(V.notes(s, d))


@query
def recent_notes(s: SparkSession, d: str) -> DataFrame:
    return notes.recent_notes(V.notes(s, d), NOW, 30)


@query
def note_index(s: SparkSession, d: str) -> DataFrame:
    return notes.note_index(V.notes(s, d))


@query
def title_from_path(s: SparkSession, d: str) -> DataFrame:
    return V.files(s, d).select("path", X.title_from_path(F.col("path")).alias("title"), X.extension(F.col("path")).alias("ext"))


@query
def reference_search_capped(s: SparkSession, d: str) -> DataFrame:
    """Pages that hold a term, at most three of each reference."""
    rows = V.pages(s, d).select("path", F.lit(None).cast("string").alias("title"), F.col("page_id").alias("part"), F.col("text").alias("content"))
    return search.search_references(rows, "the canal", 200, 3).select("path", "part", "snippet", "score")


@query
def reference_page_of_match(s: SparkSession, d: str) -> DataFrame:
    """Whole references by their marked text, with the page of the first match."""
    text = references.marked_text(V.pages(s, d)).select("path", F.lit(None).cast("string").alias("title"), F.lit(0).alias("part"), "content")
    return search.search_references(text, "canal", 1000, 3).select("path", F.col("page").cast("bigint").alias("page"), "score")


@query
def reference_in_doc_pages(s: SparkSession, d: str) -> DataFrame:
    return search.pages_with(V.pages(s, d), "Canal", 5)


@query
def reference_index_text(s: SparkSession, d: str) -> DataFrame:
    return references.marked_text(V.pages(s, d)).select("path", "kind", F.md5("content").alias("digest"))


@query
def reference_labels(s: SparkSession, d: str) -> DataFrame:
    """References with printed labels that differ from page numbers, and how many."""
    one = V.pages(s, d).groupBy("path", "page").agg(F.max("label").alias("label"))
    return references.page_labels(one).select("path", F.size(F.map_keys("labels")).cast("bigint").alias("labels"))


@query
def reference_label_lookup(s: SparkSession, d: str) -> DataFrame:
    return references.page_of_label(V.pages(s, d), "3").select("path", F.col("page").cast("bigint").alias("page"))


@query
def reference_list(s: SparkSession, d: str) -> DataFrame:
    files = V.reference_files(s, d)
    return references.list_references(files.select("path", "size_bytes"), files.select("path", "title", "author", "pages"))


@query
def cache_staleness(s: SparkSession, d: str) -> DataFrame:
    files = V.reference_files(s, d)
    return references.cache_state(files.select("path", "modified"), files.select("path", "version", "source_modified"))


@query
def canvas_counts(s: SparkSession, d: str) -> DataFrame:
    return canvas.canvas_summary(V.canvases(s, d)).select("path", F.col("node_count").cast("bigint").alias("node_count"), F.col("edge_count").cast("bigint").alias("edge_count"))


@query
def canvas_type_breakdown(s: SparkSession, d: str) -> DataFrame:
    return canvas.canvas_summary(V.canvases(s, d)).select("path", F.inline("breakdown")).select("path", "type", F.col("count").cast("bigint").alias("n"))


@query
def canvas_briefs(s: SparkSession, d: str) -> DataFrame:
    return canvas.canvas_nodes(V.canvases(s, d)).select("path", F.col("pos").cast("bigint").alias("pos"), "id", "type", F.col("brief").alias("label"))


@query
def canvas_search(s: SparkSession, d: str) -> DataFrame:
    return canvas.search_canvases(V.canvases(s, d), "Tin Box", 100).select("path", F.col("pos").cast("bigint").alias("pos"), "id", "field", "snippet", "total")


@query
def canvas_violations(s: SparkSession, d: str) -> DataFrame:
    return canvas.violations(V.canvases(s, d)).select("path", "code", F.col("part").cast("bigint").alias("part"), "ref")


@query
def canvas_missing_files(s: SparkSession, d: str) -> DataFrame:
    """File nodes of the node table whose file doesn't live in their vault."""
    nodes = table(s, d, "canvas_nodes").where("node_type = 'file' and label is not null").select("node_row_id", F.lit("file").alias("type"), F.concat(F.lit("notes/"), "vault_key", F.substring("label", 6, 1 << 20)).alias("file")).distinct()
    return canvas.missing_files(nodes, V.files(s, d)).where("warning is not null").select("node_row_id", "file", "warning")


@query
def attachment_list(s: SparkSession, d: str) -> DataFrame:
    return attachments.list_attachments(V.files(s, d))


@query
def version_latest(s: SparkSession, d: str) -> DataFrame:
    return history.state(V.versions(s, d)).select("path", "seq", F.md5("content").alias("digest"))


@query
def version_as_of(s: SparkSession, d: str) -> DataFrame:
    """The vault as of the version in the middle of its history."""
    v = V.versions(s, d)
    return history.state(v, _middle(v)).select("path", "seq")


def _middle(versions: DataFrame) -> int:
    return (versions.agg(F.max("seq")).first()[0] or 0) // 2


@query
def file_history(s: SparkSession, d: str) -> DataFrame:
    return history.file_history(V.versions(s, d), "notes/v000/p7.md").select("seq", "ts", "op", "message")


@query
def changelog_since(s: SparkSession, d: str) -> DataFrame:
    return history.changelog(V.versions(s, d), 50, "2024-01-01 00:00:00")


@query
def patch_apply(s: SparkSession, d: str) -> DataFrame:
    """Two patches on every document: the second sees the first's result."""
    docs = V.notes(s, d).where("content is not null").select("path", "content")
    patches = F.array(F.struct(F.lit("canal").alias("old_text"), F.lit("river bank").alias("new_text")), F.struct(F.lit("the river").alias("old_text"), F.lit("a river").alias("new_text")))
    return history.patch_notes(docs, docs.select("path", patches.alias("patches"))).select("path", "error", F.col("applied").cast("bigint").alias("applied"), F.md5("content").alias("digest"))


@query
def batch_move_conflicts(s: SparkSession, d: str) -> DataFrame:
    """What forbids a batch of twenty moves over all files."""
    rows = [(i, f"notes/hub/{'Inbox' if i % 3 else 'Sources'}{i if i > 4 else ''}.md", f"notes/{'Home' if i < 2 else f'moved/{i}'}.md") for i in range(20)]
    moves = s.createDataFrame(rows, "pos int, source string, destination string")
    return history.move_conflicts(moves, V.files(s, d)).select(F.col("pos").cast("bigint").alias("pos"), "code")


@query
def frame_sampling(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", (F.col("doc_id") % 60).cast("int").alias("frames"))
    return docs.select("doc_id", F.array_join(F.transform(images.sample_indices(F.col("frames")), lambda i: i.cast("string")), ",").alias("picked"))


def _image_rows(s: SparkSession, d: str) -> DataFrame:
    """Image files with made-up sizes, frames and delays (in hundredths of a second)."""
    f = V.files(s, d).where(F.lower(X.extension(F.col("path"))).isin(*images.READABLE) & F.col("size_bytes").isNotNull())
    n, frames = F.col("size_bytes"), (F.col("size_bytes") % 30 + 1).cast("int")
    delays = F.transform(F.sequence(F.lit(1), frames), lambda i: ((n + i) % 7 + 1) / F.lit(100.0))
    return f.select("path", F.lower(X.extension(F.col("path"))).alias("ext"), n.alias("bytes"), (n % 9000).cast("int").alias("width"), (n % 7000).cast("int").alias("height"), frames.alias("frames"), delays.alias("delays"))


@query
def image_plans(s: SparkSession, d: str) -> DataFrame:
    """How each image would be read, with the frames picked and where they begin, in hundredths of a second."""
    hundredths = lambda c: F.round(c * 100).cast("bigint")
    listed = lambda c: F.array_join(c.cast("array<string>"), ",")
    plan = images.image_plan(_image_rows(s, d))
    return plan.select("path", "action", "mime", listed(F.col("frames")).alias("frames"), listed(F.transform("offsets", hundredths)).alias("offsets"), hundredths(F.col("total_duration")).alias("duration"))


@query
def animation_frames(s: SparkSession, d: str) -> DataFrame:
    """All images as if they were animations: sampled frames and their offsets."""
    plan = images.image_plan(_image_rows(s, d).withColumns({"ext": F.lit("gif"), "width": F.lit(100), "height": F.lit(100)}))
    return plan.where("action = 'frames'").select("path", F.posexplode(F.arrays_zip("frames", "offsets")).alias("pos", "_f")).select("path", F.col("pos").cast("bigint").alias("pos"), F.col("_f.frames").cast("bigint").alias("frame"), F.round(F.col("_f.offsets") * 100).cast("bigint").alias("offset"))


def _edits(s: SparkSession, d: str, op: str, paths: int = 80) -> DataFrame:
    """Notes as edits of one sort: pos, op, path, new_path, content, seq, one for each path."""
    v = V.versions(s, d)
    path = F.concat(F.lit("notes/"), "vault_key", F.lit("/p"), (F.col("note_id") % paths).cast("string"), F.lit(".md"))
    rows = table(s, d, "notes").where("note_id is not null").groupBy(path.alias("path")).agg(F.min(F.struct("note_id", "vault_key", "content")).alias("_n"))
    new = F.when(F.lit(op) == "move", F.concat(F.lit("notes/"), F.col("_n.vault_key"), F.lit("/p"), (F.col("_n.note_id") % 7 + 36).cast("string"), F.lit("/m"), F.col("_n.note_id").cast("string"), F.lit(".md")))
    return rows.select(F.col("_n.note_id").alias("pos"), F.lit(op).alias("op"), "path", new.alias("new_path"), F.col("_n.content").alias("content"), F.lit(_middle(v)).alias("seq"))


def _edited(s: SparkSession, d: str, op: str) -> DataFrame:
    return edits.edited(V.versions(s, d), _edits(s, d, op), NOW).select("pos", "path", "new_path", F.md5("content").alias("digest"), "message", "error")


@query
def edit_create(s: SparkSession, d: str) -> DataFrame:
    """Every note as a new file: what is written, or why not."""
    return _edited(s, d, "create")


@query
def edit_replace(s: SparkSession, d: str) -> DataFrame:
    return _edited(s, d, "replace")


@query
def edit_append(s: SparkSession, d: str) -> DataFrame:
    return _edited(s, d, "append")


@query
def edit_move(s: SparkSession, d: str) -> DataFrame:
    return _edited(s, d, "move")


@query
def edit_delete(s: SparkSession, d: str) -> DataFrame:
    return _edited(s, d, "delete")


@query
def edit_revert(s: SparkSession, d: str) -> DataFrame:
    """Every path back to the middle of the history."""
    return _edited(s, d, "revert")


@query
def state_after_edits(s: SparkSession, d: str) -> DataFrame:
    """The vault after a batch of moves and then one of new notes."""
    v = V.versions(s, d)
    # Each batch is written before the next one reads the versions, as appending to their table does.
    v = v.unionByName(cut(edits.version_rows(v, _edits(s, d, "move"), NOW)))
    v = v.unionByName(cut(edits.version_rows(v, _edits(s, d, "create"), NOW)))
    return history.state(v).select("path", F.md5("content").alias("digest"))


@query
def version_changes(s: SparkSession, d: str) -> DataFrame:
    """The paths that the last version of a batch of moves touches."""
    v = V.versions(s, d)
    rows = edits.version_rows(v, _edits(s, d, "move"), NOW)
    return v.unionByName(rows).where("op = 'move'").select(F.explode(F.array("path", "new_path")).alias("path")).distinct()


@query
def vault_snapshot(s: SparkSession, d: str) -> DataFrame:
    """Versions that bring the middle of the history to the newest state, and whether their numbers are without gaps."""
    v = V.versions(s, d)
    m = _middle(v)
    rows = history.snapshot(v.where(F.col("seq") <= m), history.state(v).select("path", "content"), NOW)
    return rows.groupBy("op", "message").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"), F.count_if(F.col("content").isNull()).alias("blank"))


@query
def file_at_version(s: SparkSession, d: str) -> DataFrame:
    """One file as of the middle of the history."""
    v = V.versions(s, d)
    return history.file_at(v, "notes/v000/p7.md", _middle(v)).select("path", F.md5("content").alias("digest"))


@query
def batch_read(s: SparkSession, d: str) -> DataFrame:
    """Twenty-five paths, of which some are missing and the last five are skipped."""
    paths = [f"notes/{('journal', 'meeting', 'reading')[i % 3]}/doc-{i * 7}.md" for i in range(25)]
    return notes.read_notes(s, V.notes(s, d), paths).select(F.col("pos").cast("bigint").alias("pos"), "path", F.col("word_count").cast("bigint").alias("word_count"), F.md5("content").alias("digest"), "error")


@query
def batch_read_counts(s: SparkSession, d: str) -> DataFrame:
    """How many of the paths of a batch read were found, missing or skipped."""
    paths = [f"notes/{('journal', 'meeting', 'reading')[i % 3]}/doc-{i * 7}.md" for i in range(25)]
    return notes.read_counts(notes.read_notes(s, V.notes(s, d), paths))


@query
def reference_cached_texts(s: SparkSession, d: str) -> DataFrame:
    """The texts among the files of a cache folder: pages, a whole text, files of other names, placeholders, unknown folders."""
    pages, n = V.pages(s, d).where("page is not null"), F.col("page")
    name = F.when(n % 7 == 0, "page_labels.json").when(n % 7 == 1, "search_text.txt").when(n % 7 == 2, "page_x.txt").otherwise(F.concat(F.lit("page_"), n.cast("string"), F.lit(".txt")))
    folder = F.when(n % 11 == 10, F.lit("unknown")).otherwise(X.cache_key(F.col("path")))
    files = pages.select(F.concat_ws("/", F.lit("cache"), folder, name).alias("path"), F.when(n % 5 == 0, F.concat(F.lit("[OldMCP: none] "), "text")).otherwise(F.col("text")).alias("content"))
    got = references.cached_texts(files, pages.select("path").distinct().withColumn("title", F.lit(None).cast("string")))
    return got.select("path", F.col("part").cast("bigint").alias("part"), F.md5("content").alias("digest"))


@query
def canvas_read(s: SparkSession, d: str) -> DataFrame:
    """Every canvas with its counts and its own text."""
    c = V.canvases(s, d)
    return canvas.canvas_contents(c).select("path", F.col("node_count").cast("bigint").alias("node_count"), F.col("edge_count").cast("bigint").alias("edge_count"), F.md5("content").alias("digest"))


@query
def reference_pages_read(s: SparkSession, d: str) -> DataFrame:
    """Pages of the first reference: by query, label, number, range and the first ones."""
    pages = V.pages(s, d)
    path = pages.agg(F.min("path")).first()[0] or ""
    asked = {"query": {"query": "THE", "max_pages": 50}, "label": {"book_page": "3"}, "page": {"page": 2}, "range": {"page_range": "2-4"}, "first": {}, "bad range": {"page_range": "x", "max_pages": 99}}
    out = None
    for how, args in asked.items():
        part = references.select_pages(pages, path, **args).select(F.lit(how).alias("how"), F.col("page").cast("bigint").alias("page"), "label", F.md5("text").alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def reference_cache_build(s: SparkSession, d: str) -> DataFrame:
    """The text cache after an incremental build over all references, with an outline entry for each third page."""
    files = V.reference_files(s, d)
    pages = V.pages(s, d).where("page is not null")
    outline = pages.where("page % 3 = 0").select("path", F.col("page_id").alias("pos"), F.coalesce("label", F.lit("")).alias("title"), "page")
    cache = files.select("path", F.lit("fullText").alias("kind"), F.col("pages").cast("bigint").alias("pages"), F.coalesce("title", F.lit("")).alias("content"), "version", "source_modified")
    built = references.build_cache(files.groupBy("path").agg(F.max("modified").alias("modified")), cache, pages, outline)
    return built.select("path", "kind", "pages", F.md5("content").alias("digest"), F.col("version").cast("bigint").alias("version"))


@query
def audit_by_operation(s: SparkSession, d: str) -> DataFrame:
    """Operations in the log documents, and whether they write."""
    lines = table(s, d, "documents").where("source = 'log' and text is not null").select(F.explode(F.split("text", "\n")).alias("line"))
    ops = lines.select(F.regexp_extract("line", r"^[0-9TZ:\-]+ \| ([A-Z]+) +\| ", 1).alias("operation")).where("operation <> ''")
    writes = [k for k, v in guards.OPERATIONS.items() if v]
    return ops.groupBy("operation").agg(F.count(F.lit(1)).alias("n")).withColumn("writes", F.col("operation").isin(*writes))


@query
def path_guard(s: SparkSession, d: str) -> DataFrame:
    """Every link target judged as a path under the notes folder."""
    rows = table(s, d, "parsed_links").select("link_id", "target").distinct()
    return rows.select("link_id", guards.path_problem(F.col("target"), ["notes"], ["md", "markdown"]).alias("problem"))


@query
def sanitize_message(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "search_results").select("result_id", X.message_line(F.col("snippet")).alias("message"), X.safe_ref(F.col("title")).alias("ref")).distinct()


@query
def byte_format(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "vault_files").where("size_bytes is not null").select("file_id", X.human_bytes(F.col("size_bytes") * 37).alias("shown")).distinct()


@query
def cache_keys(s: SparkSession, d: str) -> DataFrame:
    return V.reference_files(s, d).select("path", X.cache_key(F.col("path")).alias("key"), X.png_name(F.col("path")).alias("png"))


@query
def dirty_files(s: SparkSession, d: str) -> DataFrame:
    """How the newest state differs from that of an earlier version."""
    v = V.versions(s, d)
    return history.dirty(v.where(F.col("seq") <= _middle(v)), history.state(v).select("path", "content"))
