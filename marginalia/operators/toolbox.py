"""The operations of a vault by name: a registry with a read-only gate and an audit trail.

``Vault`` holds the relations; ``call`` runs an operation and returns a DataFrame. Unknown names, missing arguments and
domain errors come back as one row (error), as a batch of calls shouldn't end at the first bad one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import attachments, canvas, guards, history, images, links, notes, references, search


@dataclass
class Vault:
    """versions: all edits; files: path, size_bytes, modified; pages, cache, outline, images: see their operators."""

    spark: SparkSession
    versions: DataFrame
    files: DataFrame | None = None
    pages: DataFrame | None = None
    cache: DataFrame | None = None
    outline: DataFrame | None = None
    images: DataFrame | None = None
    root: str | None = None
    read_only: bool = False
    clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc)
    audit: list[tuple] = field(default_factory=list)

    def texts(self, *extensions: str) -> DataFrame:
        """Live files of some extensions with content and the time of their last version."""
        now = history.state(self.versions)
        when = self.versions.select("seq", F.col("ts").alias("modified"))
        return now.where(F.lower(X.extension(F.col("path"))).isin(*extensions)).join(when, "seq").select("path", "content", "modified")

    @property
    def notes(self) -> DataFrame:
        return self.texts("md", "markdown")

    @property
    def canvases(self) -> DataFrame:
        return self.texts("canvas")

    def all_files(self) -> DataFrame:
        """Live files: those with versions, and the others that no version has deleted since."""
        own = history.state(self.versions).join(self.versions.select("seq", F.col("ts").alias("modified")), "seq").select("path", F.octet_length("content").cast("bigint").alias("size_bytes"), "modified")
        return own if self.files is None else own.unionByName(self.other_files())

    def other_files(self) -> DataFrame:
        """path, size_bytes, modified of the files without versions; none of them if there is no such table."""
        rows = self.need("files").select("path", "size_bytes", "modified")
        return rows.join(self.versions.where("op = 'delete'").select("path").distinct(), "path", "left_anti")

    def need(self, name: str) -> DataFrame:
        """One of the optional relations; an error of the request if this vault lacks it."""
        got = getattr(self, name)
        if got is None:
            raise history.EditError(f"this vault has no {name}")
        return got

    def append(self, rows: DataFrame) -> DataFrame:
        """Takes new version rows over; on storage this is one append to the versions table."""
        self.versions = self.versions.unionByName(rows)
        return rows


def _note(path: str) -> str:
    return guards.check_relative(path, ("notes",), ("md", "markdown"))


def _directory(directory: str | None) -> str | None:
    if directory is not None and (directory.startswith("/") or ".." in directory.split("/")):
        raise guards.GuardError(f"outside the vault: {directory}")
    return directory


def _canvas(path: str) -> str:
    return guards.check_relative(path, ("notes",), ("canvas",))


def _valid_canvas(v: Vault, path: str, content: str) -> str:
    bad = canvas.violations(v.spark.createDataFrame([(path, content)], "path string, content string")).orderBy("stage", "pos", "part").limit(1).collect()
    if bad:
        raise history.EditError(f"{bad[0]['code']}: {bad[0]['ref']}")
    return content


def _patch(v: Vault, path: str, patches: list[dict]) -> DataFrame:
    ops = v.spark.createDataFrame([(path, [(p["old_text"], p["new_text"]) for p in patches])], "path string, patches array<struct<old_text:string,new_text:string>>")
    got = history.patch_notes(v.notes, ops).collect()[0]
    if got["error"]:
        raise history.EditError(got["error"])
    return v.append(history.update(v.versions, path, got["content"], v.clock())) if got["applied"] else v.versions.limit(0)


def _update(v: Vault, path: str, content: str | None = None, mode: str = "replace", patches: list[dict] | None = None) -> DataFrame:
    path = _note(path)
    if mode == "patch":
        return _patch(v, path, patches or [])
    if content is None:
        raise history.EditError("content is missing")
    return v.append(history.update(v.versions, path, content, v.clock(), mode))


def _create_canvas(v: Vault, path: str, content: str) -> DataFrame:
    path, content = _canvas(path), _valid_canvas(v, path, content)
    if history._content(v.versions, path) is not None:
        raise history.EditError(f"exists: {path}")
    return v.append(history._version(v.spark, v.versions, [("create", path, None, content, f"Create {path}")], v.clock()))


def _resolve(v: Vault, link: str, source: str | None = None) -> DataFrame:
    parsed = links.extract_links(v.spark.createDataFrame([("", link)], "path string, content string")).select("target").limit(1).collect()
    target = parsed[0]["target"] if parsed else link.split("|")[0].split("#")[0].strip()
    one = v.spark.createDataFrame([(1, source, target)], "link_id int, source string, target string")
    return links.resolve_links(one, v.all_files().where(F.col("path").startswith("notes/"))).select("rank", "match").orderBy("rank")


def _reference_texts(v: Vault) -> DataFrame:
    titles = v.need("pages").select("path").distinct().withColumn("title", F.lit(None).cast("string")) if v.cache is None else v.cache.select("path", "title")
    return references.marked_text(v.need("pages"), v.outline).join(titles, "path", "left").select("path", "title", F.lit(0).alias("part"), "content")


def _add_image(v: Vault, source: str, destination: str) -> DataFrame:
    from marginalia.sources.sinks import import_image

    if v.root is None:
        raise guards.GuardError("this vault has no folder")
    return v.spark.createDataFrame([import_image(v.root, source, destination)], "path string, width int, height int")


#: name: (operation class, function of the vault and arguments).
TOOLS: dict[str, tuple[str, Callable[..., DataFrame]]] = {
    "read_note": ("READ", lambda v, path: v.notes.where(F.col("path") == _note(path))),
    "read_notes": ("READ", lambda v, paths: notes.read_notes(v.spark, v.notes, paths)),
    "list_notes": ("LIST", lambda v, directory="notes", recursive=True, tag=None: notes.list_notes(v.notes, _directory(directory), recursive, tag)),
    "get_note_metadata": ("METADATA", lambda v, path: notes.note_metadata(v.notes, _note(path))),
    "search_notes": ("SEARCH", lambda v, query, max_results=20: search.search_notes(v.notes, query, max_results)),
    "read_canvas": ("READ", lambda v, path: canvas.read_canvas(v.canvases, v.all_files(), _canvas(path))),
    "list_canvas": ("LIST", lambda v, directory="notes", recursive=True: canvas.list_canvases(v.canvases.where(notes.in_directory(F.col("path"), _directory(directory), recursive)))),
    "search_canvas": ("SEARCH", lambda v, query, max_results=20: canvas.search_canvases(v.canvases, query, max_results)),
    "list_attachments": ("LIST", lambda v, directory="notes", recursive=True: attachments.list_attachments(v.all_files(), _directory(directory), recursive)),
    "resolve_link": ("READ", lambda v, link, **kw: _resolve(v, link, kw.get("from"))),
    "find_backlinks": ("SEARCH", lambda v, path: links.find_backlinks(v.notes, v.all_files(), path)),
    "create_note": ("CREATE", lambda v, path, content, tags=(): v.append(history.create(v.versions, _note(path), content, v.clock(), tags))),
    "update_note": ("UPDATE", _update),
    "move_note": ("MOVE", lambda v, source, destination: v.append(history.move(v.versions, [(_note(source), _note(destination))], v.clock()))),
    "move_notes": ("MOVE", lambda v, moves: v.append(history.move(v.versions, [(_note(m["source"]), _note(m["destination"])) for m in moves], v.clock()))),
    "delete_note": ("DELETE", lambda v, path: v.append(history.delete(v.versions, _note(path), v.clock()))),
    "create_canvas": ("CREATE", _create_canvas),
    "update_canvas": ("UPDATE", lambda v, path, content: v.append(history.update(v.versions, _canvas(path), _valid_canvas(v, path, content), v.clock()))),
    "delete_canvas": ("DELETE", lambda v, path: v.append(history.delete(v.versions, _canvas(path), v.clock()))),
    "delete_attachment": ("DELETE", lambda v, path: v.append(history.delete(v.versions, guards.check_relative(path, ("notes",)), v.clock(), None if v.files is None else v.other_files()))),
    "add_image": ("CREATE", _add_image),
    "note_history": ("HISTORY", lambda v, path, max_entries=10: history.file_history(v.versions, guards.check_relative(path, ("notes",)), max_entries)),
    "revert_note": ("UPDATE", lambda v, path, commit: v.append(history.revert(v.versions, _note(path), int(commit), v.clock()))),
    "vault_changelog": ("HISTORY", lambda v, max_entries=20, since=None: history.changelog(v.versions, max_entries, since)),
    "list_references": ("LIST", lambda v, directory=None: references.list_references(v.need("files"), v.need("cache"), _directory(directory))),
    "read_reference": ("READ", lambda v, path, page=None, book_page=None, page_range=None, query=None, max_pages=5: references.select_pages(v.need("pages"), guards.check_relative(path, ("references",), ("pdf",)), query, book_page, page, page_range, max_pages)),
    "search_references": ("SEARCH", lambda v, query, max_results=10, max_per_document=3: search.search_references(_reference_texts(v), query, max_results, max_per_document)),
    "get_reference_metadata": ("METADATA", lambda v, path: references.list_references(v.need("files"), v.need("cache")).where(F.col("path") == guards.check_relative(path, ("references",), ("pdf",))).join(references.page_labels(v.need("pages")), "path", "left")),
    "read_image": ("READ", lambda v, path: images.image_plan(v.need("images").where(F.col("path") == guards.check_relative(path, ("notes", "references"), images.READABLE)))),
    "resource_index": ("RESOURCE", lambda v: notes.note_index(v.notes)),
    "resource_recent": ("RESOURCE", lambda v: notes.recent_notes(v.notes, v.clock())),
    "resource_tags": ("RESOURCE", lambda v: notes.tag_counts(v.notes)),
    "resource_references": ("RESOURCE", lambda v: references.list_references(v.need("files"), v.need("cache"))),
}


def call(v: Vault, name: str, **args: object) -> DataFrame:
    """Runs an operation; whatever goes wrong with the request comes back as a row with an error."""
    failed = lambda e: v.spark.createDataFrame([(str(e),)], "error string")
    if name not in TOOLS:
        return failed(f"unknown operation {name}")
    operation, run = TOOLS[name]
    v.audit.append((v.clock(), operation, str(args.get("path") or args.get("source") or ""), name))
    if not guards.allowed(operation, v.read_only):
        return failed("the vault is read-only")
    try:
        return run(v, **args)
    except (guards.GuardError, history.EditError, TypeError, ValueError, KeyError, AttributeError) as e:
        return failed(e)


def audit_table(v: Vault) -> DataFrame:
    """ts, operation, path, details of the calls so far, to be appended to the audit table."""
    return v.spark.createDataFrame(v.audit, "ts timestamp, operation string, path string, details string")
