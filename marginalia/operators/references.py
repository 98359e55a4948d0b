"""Paged references: listing, metadata, page selection, page-marked text and the text cache.

Page rows are (path, page, label, text); extraction itself needs an optional PDF library (see sources.pages).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X

#: Below so many pages the whole text is cached, else the first PART_PAGES pages and the outline.
FULL_PAGES, PART_PAGES = 200, 30
#: Version from which on a cache entry is valid; pages per read by default and at most.
CACHE_VERSION, DEFAULT_PAGES, MOST_PAGES = 3, 5, 20


def list_references(files: DataFrame, cache: DataFrame, directory: str | None = None) -> DataFrame:
    """path, title, author, pages, size_mb of PDF files (path, size_bytes) with cached metadata (path, title, author, pages),
    the file's name where there is no title; by path. Hidden files are listed too; a directory with ``..`` lists nothing."""
    root = "references/" + (directory.strip("/") + "/" if directory else "")
    pdf = files.where(F.col("path").startswith(root) & (F.lower(X.extension(F.col("path"))) == "pdf") & F.lit(".." not in (directory or "")))
    meta = cache.select("path", F.col("title").alias("_t"), "author", "pages")
    out = pdf.join(meta, "path", "left")
    title = F.when(X.trim_space(F.coalesce("_t", F.lit(""))) != "", F.col("_t")).otherwise(X.stem(F.col("path")))
    return out.select("path", title.alias("title"), "author", "pages", (F.col("size_bytes") / F.lit(1048576.0)).alias("size_mb")).orderBy("path")


def page_labels(pages: DataFrame) -> DataFrame:
    """path, labels: page numbers to printed labels, dropped where every label is just the page's number."""
    named = pages.where("label is not null").groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "label")))).alias("labels"), F.bool_and(F.col("label") == F.col("page").cast("string")).alias("_plain"))
    return named.where("not _plain").select("path", "labels")


def page_of_label(pages: DataFrame, label: str) -> DataFrame:
    """path, page: the first page with a printed label; without one the label itself if it is a number of a page."""
    hit = F.min(F.when(F.col("label") == label, F.col("page")))
    number = F.min(F.when(F.col("page").cast("string") == label, F.col("page")))
    return pages.groupBy("path").agg(F.coalesce(hit, number).alias("page")).where("page is not null")


def select_pages(pages: DataFrame, path: str, query: str | None = None, book_page: str | None = None, page: int | None = None, page_range: str | None = None, max_pages: int = DEFAULT_PAGES) -> DataFrame:
    """page, label, text of one reference, in order: the pages that hold query, else that with the label, else the page,
    else the range, else the first ones; at most max_pages, never more than MOST_PAGES."""
    most = max(0, min(max_pages, MOST_PAGES))
    own = pages.where(F.col("path") == path)
    if query:
        own = own.where(F.lower("text").contains(query.lower()))
    elif book_page is not None:
        own = own.join(F.broadcast(page_of_label(own, book_page).select(F.col("page").alias("_p"))), F.col("page") == F.col("_p"), "left_semi")
    elif page is not None:
        own = own.where(F.col("page") == page)
    elif page_range is not None:
        total = own.agg(F.max("page")).first()[0] or 0
        lo, hi = X.page_range(page_range, total)
        own = own.where(F.col("page").between(lo, hi))
    return own.select("page", "label", "text").orderBy("page").limit(most)


def marked_text(pages: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """path, kind, content: each reference's text with page markers: all of it below FULL_PAGES pages, else the first
    PART_PAGES; the outline's entries (path, pos, title, page) follow with markers of their own.

    Pages are counted apart from their texts, so texts are moved once.
    """
    counts = pages.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    mark = lambda p, t: F.concat(F.lit("--- Page "), p.cast("string"), F.lit(" ---\n"), F.coalesce(t, F.lit("")))
    body = pages.select("path", F.struct(F.lit(0).alias("k"), F.col("page").alias("p"), mark(F.col("page"), F.col("text")).alias("t")).alias("s"))
    if outline is not None:
        body = body.unionByName(outline.select("path", F.struct(F.lit(1).alias("k"), F.col("pos").alias("p"), mark(F.col("page"), F.col("title")).alias("t")).alias("s")))
    kept = body.join(counts, "path").where((F.col("_n") < FULL_PAGES) | (F.col("s.k") == 1) | (F.col("s.p") <= PART_PAGES))
    text = kept.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n\n").alias("content"), F.max("_n").alias("_n"))
    return text.select("path", F.when(F.col("_n") < FULL_PAGES, "fullText").otherwise("tocOnly").alias("kind"), "content")


#: The columns of the text cache.
CACHE = "path string, kind string, pages long, content string, version int, source_modified timestamp"


def build_cache(files: DataFrame, cache: DataFrame, pages: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """The text cache (see CACHE) brought up to date with files (path, modified): fresh entries stay, the others are built from
    pages and outline, and entries of files that are gone go. A file without pages has no entry.

    Of several fresh entries of one path that of the newest source stays.
    """
    todo = uncached(files, cache).select("path", F.col("modified").alias("source_modified"))
    wanted = pages.join(todo, "path", "left_semi")
    built = marked_text(wanted, None if outline is None else outline.join(wanted.select("path").distinct(), "path", "left_semi"))
    counts = wanted.groupBy("path").agg(F.count(F.lit(1)).alias("pages"))
    built = built.join(counts, "path").join(todo, "path").select("path", "kind", "pages", "content", F.lit(CACHE_VERSION).alias("version"), "source_modified")
    fresh = cache_state(files, cache).where("fresh").select("path")
    kept = cache.where(F.col("version") >= CACHE_VERSION).join(fresh, "path", "left_semi")
    kept = kept.groupBy("path").agg(F.max_by(F.struct("kind", F.col("pages").cast("bigint").alias("pages"), "content", "version", "source_modified"), F.struct("source_modified", "version")).alias("_e"))
    return kept.select("path", "_e.*").unionByName(built)


def cache_state(files: DataFrame, cache: DataFrame) -> DataFrame:
    """path, fresh: whether a reference (path, modified) has a cache entry (path, version, source_modified) of a valid version
    that is as new as the file, in whole seconds."""
    second = lambda c: F.date_trunc("second", c)
    best = cache.where(F.col("version") >= CACHE_VERSION).groupBy("path").agg(F.max("source_modified").alias("_m"))
    out = files.join(best, "path", "left")
    return out.select("path", F.coalesce(second(F.col("modified")) <= second(F.col("_m")), F.lit(False)).alias("fresh"))


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The references whose text has to be extracted (again): what an incremental cache build works on."""
    return files.join(cache_state(files, cache).where("fresh").select("path"), "path", "left_anti")


def strategy(pages: Column) -> Column:
    return F.when(pages < FULL_PAGES, F.struct(F.lit("fullText").alias("kind"), F.lit(None).cast("int").alias("pages"))).otherwise(F.struct(F.lit("tocOnly").alias("kind"), F.lit(PART_PAGES).alias("pages")))


#: What stands at the head of a cached text that an older version left in place of an extraction.
PLACEHOLDER = r"^\[[A-Z]\w*MCP:"


def cached_texts(cache_files: DataFrame, known: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """path, title, part, content of the text files of a cache folder (path, content), ready to be searched.

    Of each entry's folder, named by its key, only ``search_text.txt`` (part 0) and ``page_<number>.txt`` hold text; those that begin
    with a placeholder, or whose folder belongs to none of known (path, title), are left out.
    """
    name = X.file_name(F.col("path"))
    part = F.when(name == "search_text.txt", F.lit(0)).otherwise(F.regexp_extract(name, r"^page_([0-9]+)\.txt$", 1).try_cast("int"))
    rows = cache_files.select(F.element_at(F.split("path", "/"), -2).alias("_key"), part.alias("part"), "content").where("part is not null and content is not null")
    owners = known.select("path", "title", X.cache_key(F.col("path")).alias("_key"))
    return rows.where(~F.col("content").rlike(placeholder)).join(owners, "_key").select("path", "title", "part", "content")
