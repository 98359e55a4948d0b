"""Scanned pages repaired into continuous readable paragraphs, and the noise found on the way.

1. Pages are cut to lines, with look-alike characters unified first so that only recognition errors remain.
2. Running titles: at the head and foot of pages, lines are masked (digits, roman numbers and separators away, glyphs by
   their strokes) and grouped within their reference; a masked line that comes back on other pages, or is the reference's
   known title, is a header. Lines that only give a number near the page's are page numbers.
3. Words are counted over all running text, grouped by a *stroke skeleton*: each glyph is written as the strokes that
   recognition confuses (m as three, rn as three, cl as d, 0 as o ...), so every confusable spelling of a word falls in
   one group whatever stands around it. In a group a rare form that turns from a frequent one by a known confusion is a
   misreading of it, if it is far rarer, or if the words around it support the frequent form.
4. A line's last word goes on in the next text line (of the page, or of the next page) if it ends in a cut mark and the
   joined word is the better supported one; a compound cut at its own hyphen is not.
5. The text is put together by windows over the lines: cut words joined, lines to paragraphs.

Null and empty texts have no lines and no rows. Records that arrive again count once. Statistics cover all pages.
"""

from __future__ import annotations

import re
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from marginalia.llm.unify import with_canonical
from marginalia.session import bounded, cut

# What recognition makes of a piece of a word.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("a", "@"), ("t", "f"), ("f", "t"), ("o", "0"), ("s", "5"), ("n", "ri"), ("ri", "n"), ("i", "1"), ("l", "1"), ("d", "cl"), ("cl", "d"), ("l", "|"), ("i", "|"),
    ("u", "ii"), ("ii", "u"), ("h", "b"), ("b", "h"), ("g", "9"), ("q", "9"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("vv", "w"), ("b", "6"), ("in", "m"), ("m", "in"), ("i", "l"), ("l", "i"),
    ("li", "h"), ("n", "u"), ("u", "n"), ("z", "2"), ("i", "!"), ("l", "!"), ("b", "8"), ("h", "li"), ("g", "q"), ("q", "g"),
)
# The strokes of glyphs that are confused; every side of a confusion has the same strokes.
STROKES = {"e": "c", "@": "a", "f": "t", "0": "o", "5": "s", "1": "i", "l": "i", "|": "i", "!": "i", "r": "i", "9": "g", "q": "g", "2": "z",
           "n": "ii", "u": "ii", "h": "ii", "b": "ii", "6": "ii", "8": "ii", "m": "iii", "w": "vv", "d": "ci"}
CUT_MARKS = "-¬=­‐‑"
_LETTER = r"\p{L}\p{M}\p{N}@|!"
_ROMAN = r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"


def strokes(word: Column) -> Column:
    """The stroke skeleton of a word, without case: equal for all its confusable spellings."""
    one = {k: v for k, v in STROKES.items() if len(v) == 1}
    out = F.translate(F.lower(word), "".join(one), "".join(one.values()))
    for k, v in STROKES.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def strokes_of(word: str) -> str:
    """The same for one word in Python."""
    return "".join(STROKES.get(c, c) for c in word.lower())


def turns_into(right: str, read: str, most: int = 3) -> bool:
    """Whether reading ``right`` with at most so many known confusions gives ``read`` (both in lower case)."""
    pairs: dict[str, list[str]] = {}
    for a, b in CONFUSIONS:
        pairs.setdefault(a, []).append(b)
    states = {(0, 0): 0}
    for i in range(len(right) + 1):
        for (p, j), used in [x for x in states.items() if x[0][0] == i]:
            if p < len(right) and j < len(read) and right[p] == read[j]:
                states[(p + 1, j + 1)] = min(used, states.get((p + 1, j + 1), most + 1))
            if used < most:
                for n in (1, 2):
                    for b in pairs.get(right[p : p + n], ()) if p + n <= len(right) else ():
                        if read.startswith(b, j):
                            key = (p + n, j + len(b))
                            states[key] = min(used + 1, states.get(key, most + 1))
    return (len(right), len(read)) in states and right != read


@F.pandas_udf(T.BooleanType())
def _turns(right: pd.Series, read: pd.Series) -> pd.Series:
    return pd.Series([turns_into(a, b) for a, b in zip(right, read)], dtype=bool)


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, field_name, ref, page_number, lines of both fields of pages, one copy of each record; lines holds the number and the
    text of the lines that aren't blank, look-alike characters unified."""
    fields = F.inline(F.array(F.struct(F.lit("text").alias("field_name"), F.col("text").alias("_x")), F.struct(F.lit("extracted_text").alias("field_name"), F.col("extracted_text").alias("_x"))))
    ref = F.concat_ws("\u0001", F.coalesce("vault_key", F.lit("")), F.coalesce("ref_path", F.lit("")))
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("bigint").alias("page_id"), ref.alias("ref"), F.col("page_number").cast("int").alias("page_number"), fields)
    rows = rows.where(F.col("_x").rlike(r"[^\s\p{Z}]")).dropDuplicates(["page_id", "field_name"])
    # A soft hyphen is a character without width, but at a line's end it is a cut mark: the canonical form drops it.
    rows = with_canonical(rows, "_x", "_c")
    bare = lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|(?<![\s\p{Z}])[\s\p{Z}]++$", "")
    lines = F.transform(F.split("_c", "\n"), lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), bare(x).alias("line")))
    return rows.select("page_id", "field_name", "ref", "page_number", F.filter(lines, lambda x: x["line"] != "").alias("lines"))


def _number(text: Column) -> Column:
    """The number that a token of digits gives, digits misread as letters put right; null if it gives none."""
    digits = F.translate(text, "lIi|OoSsBZ", "1111005582")
    return F.when(text.rlike(r"^[0-9lIi|OoSsBZ]{1,4}$") & text.rlike(r"[0-9]|^[lI|OS]+$"), digits.try_cast("int"))


def edge_lines(rows: DataFrame, titles: DataFrame | None = None, least_pages: int = 2) -> DataFrame:
    """page_id, field_name, edges of pages (see page_rows) that have any: the numbers of the lines that are no running text, each with
    its kind, ``header`` or ``page_number``. Only the two outer lines on either side of a page are looked at.

    titles: ref, title of the references' metadata, which makes a header of a line that occurs on one page only.
    """
    n, at = F.size("lines"), lambda i: F.get("lines", i - 1)
    outer = F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: (i <= 2) | (i > n - 2)), lambda i: F.struct(i.alias("_top"), (n - i + 1).alias("_end"), at(i)["line_no"].alias("line_no"), at(i)["line"].alias("line")))
    lines = rows.where(n > 0).select("page_id", "field_name", "ref", "page_number", F.inline(outer))
    bare = F.regexp_replace("line", r"^(?i:page|seite|p\.|pg\.|s\.)\s*", "")
    bare = F.regexp_replace(bare, r"\s*(?i:of|von|/)\s*[0-9lIi|OoSs]{1,4}$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[^\p{L}\p{N}|]+|[^\p{L}\p{N}|]+$", ""), r"^(?i:page|seite|p\.|pg\.|s\.)\s*", "")
    shape = F.col("line").rlike(r"^[\s\[\](){}·•.|\-–—_*~=]*(?i:page|seite|p\.|pg\.|s\.)?\s*[\p{L}\p{N}|]{1,7}(?i:\s*(?:of|von|/)\s*[0-9li|os]{1,4})?[\s\[\](){}·•|\-–—_*~=]*$")
    number = F.coalesce(_number(bare), F.when(F.lower(bare).rlike(rf"^{_ROMAN}$") & (bare != ""), F.lit(0)))
    # The number is read off lines of its shape only; those are short.
    lines = lines.withColumn("_shape", shape).withColumns({"_bare": F.when(F.col("_shape"), bare), "_number": F.when(F.col("_shape"), number)})
    page_at = F.coalesce(F.col("page_number"), F.col("_number"))
    # All digits misread as letters count only near the page's own number.
    near = (F.col("_number") == 0) | (F.col("_bare").rlike("[0-9]") & (F.col("_number") <= page_at + 50)) | (F.abs(F.col("_number") - page_at) <= 30)
    is_number = F.coalesce(F.col("_shape") & F.col("_number").isNotNull() & near, F.lit(False))
    # The masked line: outer numbers and separators away, then by strokes.
    title = F.regexp_replace(F.lower("line"), rf"^(?:[0-9]{{1,4}}|[ivxlc]{{1,6}})\s*(?:[·•|–—\-]\s*|\s{{2,}}|\s)|(?<!\s)(?:\s*[·•|–—\-]\s*|\s{{2,}}|\s)(?:[0-9il|o]{{1,4}}|[ivxlc]{{1,6}})$", "")
    open_end = ~F.col("line").rlike(r"[.!?…;:,\-¬=]$")
    lines = lines.withColumn("_num", is_number).withColumn("_mask", F.when(open_end & ~F.col("_num"), F.xxhash64(_masked(title))))
    lines = cut(lines.select("page_id", "field_name", "ref", "line_no", "line", "_top", "_end", "_num", "_mask", open_end.alias("_open")))
    repeated = lines.where("_mask is not null").groupBy("ref", "_mask").agg(F.count_distinct("page_id").alias("_pages")).where(F.col("_pages") >= least_pages)
    # A title that comes back in one reference is a title wherever it stands at an edge.
    known = repeated.select("_mask").distinct().withColumn("_known", F.lit(True))
    lines = lines.join(bounded(known), "_mask", "left")
    if titles is not None:
        named = titles.where("title is not null").select("ref", F.xxhash64(_masked(F.col("title"))).alias("_mask")).where("_mask is not null").distinct()
        lines = lines.join(bounded(named.withColumn("_named", F.lit(True))), ["ref", "_mask"], "left")
    else:
        lines = lines.withColumn("_named", F.lit(None).cast("boolean"))
    # Without another occurrence a line is a title by its look: all in capitals, or every longer word with a capital. What
    # begins such a line is taken once, so these patterns are linear over endless lines.
    capitals = ~F.col("line").rlike(r"\p{Ll}") & F.col("line").rlike(r"^(?>.*?\p{Lu}[^\p{L}]).*\p{Lu}\p{Lu}")
    cased = ~F.col("line").rlike(r"(?<![\p{L}\p{N}@|'’\-])\p{Ll}[\p{L}\p{N}@|]{4,}") & F.col("line").rlike(r"^(?>.*?(?:^|\s)[\p{Lu}0-9|][\p{L}\p{N}@|]{3}).*\s[\p{Lu}0-9|][\p{L}\p{N}@|]{3}")
    is_title = ~F.col("_num") & F.col("_open") & (F.coalesce("_known", "_named", F.lit(False)) | capitals | cased)
    lines = lines.withColumn("_edge", F.when(is_title, "header").when(F.col("_num"), "page_number")).where("_edge is not null")
    # The second line from an edge counts only if the first is no running text itself.
    held = lines.groupBy("page_id", "field_name").agg(F.collect_list(F.struct("line_no", F.col("_edge").alias("edge"), "_top", "_end")).alias("_l"))
    first, last = F.exists("_l", lambda x: x["_top"] == 1), F.exists("_l", lambda x: x["_end"] == 1)
    ok = F.filter("_l", lambda x: (x["_top"] == 1) | (x["_end"] == 1) | ((x["_top"] == 2) & first) | ((x["_end"] == 2) & last))
    return held.select("page_id", "field_name", F.transform(ok, lambda x: F.struct(x["line_no"].alias("line_no"), x["edge"].alias("edge"))).alias("edges")).where(F.size("edges") > 0)


def _masked(title: Column) -> Column:
    """A title's strokes with single spaces between its words; null if it is too short to tell titles apart."""
    out = F.trim(F.regexp_replace(strokes(title), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(out) >= 6, out)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"([{_LETTER}]*[\p{{L}}@][{_LETTER}]*)"), F.lit(1))


def running_text(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The running text lines of pages with what is cut at their ends.

    ``_mark`` the cut mark that ends the line, ``_tail`` the piece of the last word before it, ``_next`` the first piece of
    the next running line, ``_w`` the words of the line without its cut pieces, in lower case, ``_compounds`` those with hyphens in
    their own case. Neighbours of the same page
    come from the page's own array of lines; only pages' ends meet in a join.
    """
    pages = rows.join(edges, ["page_id", "field_name"], "left")
    kept = F.filter("lines", lambda x: ~F.coalesce(F.exists("edges", lambda e: e["line_no"] == x["line_no"]), F.lit(False)))
    pages = pages.select("page_id", "field_name", "ref", "page_number", kept.alias("_k")).where(F.size("_k") > 0)
    at = lambda i: F.get("_k", i)
    each = F.transform(F.sequence(F.lit(0), F.size("_k") - 1), lambda i: F.struct(at(i)["line_no"].alias("line_no"), at(i)["line"].alias("line"), at(i - 1)["line"].alias("_pl"), at(i + 1)["line"].alias("_nl")))
    text = pages.select("page_id", "field_name", "ref", "page_number", F.inline(each))
    mark = lambda c: F.regexp_extract(F.right(c, F.lit(2)), rf"[\p{{L}}\p{{N}}@|!]([{CUT_MARKS}])$", 1)
    head = lambda c: F.regexp_extract(c, rf"^[^{_LETTER}]*([{_LETTER}]+)", 1)
    text = text.withColumns({"_mark": mark(F.col("line")), "_first": F.col("_pl").isNull(), "_last": F.col("_nl").isNull()})
    # The next page's first and the previous page's last running line, of the same field if it has one, else of text.
    end = lambda c, name: F.max(F.struct((F.col("field_name") == "text").alias("t"), F.col("page_id").alias("i"), c.alias(name), F.col("field_name").alias("f")))
    firsts = pages.groupBy("ref", (F.col("page_number") - 1).alias("page_number")).agg(end(head(at(F.lit(0))["line"]), "h").alias("_np"))
    lasts = pages.groupBy("ref", (F.col("page_number") + 1).alias("page_number")).agg(end(mark(F.element_at("_k", -1)["line"]), "m").alias("_pp"))
    text = text.join(firsts, ["ref", "page_number"], "left").join(lasts, ["ref", "page_number"], "left")
    text = text.withColumns({
        "_tail": F.when(F.col("_mark") != "", F.regexp_extract("line", rf"([{_LETTER}]+)[{CUT_MARKS}]$", 1)), "_next": F.when(F.col("_last"), F.col("_np.h")).otherwise(head(F.col("_nl"))),
        "_cut_before": F.when(F.col("_first"), F.coalesce(F.col("_pp.m"), F.lit(""))).otherwise(mark(F.col("_pl"))) != "",
    })
    inner = F.when(F.col("_mark") != "", F.regexp_replace("line", rf"[{_LETTER}]+[{CUT_MARKS}]$", "")).otherwise(F.col("line"))
    inner = F.when(F.col("_cut_before"), F.regexp_replace(inner, rf"^[^{_LETTER}]*[{_LETTER}]+", "")).otherwise(inner)
    # Words and compounds are taken here, once; the inner text itself isn't needed any more.
    compounds = F.when(F.col("_inner").contains("-"), F.regexp_extract_all("_inner", F.lit(r"([\p{L}\p{M}\p{N}@|]+(?:-[\p{L}\p{M}\p{N}@|]+){1,20})"), F.lit(1)))
    text = text.withColumn("_inner", inner).withColumns({"_w": _words(F.lower("_inner")), "_compounds": compounds})
    return text.drop("_inner", "_cut_before", "_pl", "_nl", "_np", "_pp")


def word_counts(text: DataFrame) -> DataFrame:
    """word, n: how often each word occurs in running text, in lower case, cut pieces aside."""
    return text.select(F.explode("_w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def misreadings(text: DataFrame, counts: DataFrame, ratio: int = 12, supported: int = 4, least: int = 3) -> DataFrame:
    """word, right: the misread forms among all words of running text (lower case) and the form they stand for.

    A form counts as misread if a form of its skeleton that turns into it by known confusions is ``ratio`` times as
    frequent (and occurs ``least`` times), or ``supported`` times as frequent and seen between the same neighbours.
    """
    counts = counts.withColumn("sk", strokes(F.col("word")))
    right = counts.where((F.col("n") >= least) & ~F.col("word").rlike(r"[0-9@|!]")).select("sk", F.col("word").alias("right"), F.col("n").alias("rn"))
    pairs = counts.join(right, "sk").where((F.col("word") != F.col("right")) & (F.col("rn") >= supported * F.col("n")))
    pairs = cut(pairs.where(_turns("right", "word")))
    # A form with digits or signs is no word of its own once a spelling in letters exists.
    clear = (F.col("rn") >= ratio * F.col("n")) | F.col("word").rlike(r"[0-9@|!]")
    sure, doubtful = pairs.where(clear), pairs.where(~clear).select("word", "right", "n", "rn")
    # The neighbours are needed of the doubtful forms and their counterparts only.
    asked = doubtful.select(F.explode(F.array("word", "right")).alias("word")).distinct()
    words = text.select("_w")
    near = F.transform("_w", lambda x, i: F.struct(x.alias("word"), F.coalesce(F.get("_w", i - 1), F.lit("")).alias("l"), F.coalesce(F.get("_w", i + 1), F.lit("")).alias("r")))
    seen = words.select(F.explode(near).alias("_n")).select("_n.word", "_n.l", "_n.r").join(bounded(asked), "word", "left_semi").groupBy("word", "l", "r").agg(F.count(F.lit(1)).alias("c"))
    at = doubtful.select("word", "right").join(seen, "word")
    also = seen.select(F.col("word").alias("right"), "l", "r")
    backed = at.join(also, ["right", "l", "r"], "left_semi").groupBy("word", "right").agg(F.sum("c").alias("_b"))
    more = doubtful.join(backed, ["word", "right"]).where("2 * _b >= n").select("word", "right", "rn")
    return sure.select("word", "right", "rn").unionByName(more).groupBy("word").agg(F.max_by("right", "rn").alias("right"))


def cut_words(text: DataFrame, counts: DataFrame, least: int = 2) -> DataFrame:
    """page_id, field_name, line_no of the lines whose last word goes on in the next text line.

    Marks other than the plain hyphen are always cuts. After a plain hyphen the joined word and the compound are compared
    by their counts over all running text, both by stroke skeleton, as either half may be misread; where neither is known
    (as when the next page is missing), a first half known from compounds is a compound's.
    """
    joined = counts.groupBy(strokes(F.col("word")).alias("_k")).agg(F.sum("n").alias("_joined"))
    compound = text.select(F.explode("_compounds").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    whole = compound.groupBy(strokes(F.regexp_replace("w", "-", "")).alias("_k")).agg(F.sum("n").alias("_compound"))
    firsts = compound.groupBy(strokes(F.substring_index("w", "-", 1)).alias("_t")).agg(F.sum("n").alias("_firsts"))
    ends = text.where("_mark <> ''").select("page_id", "field_name", "line_no", "_mark", strokes(F.col("_tail")).alias("_t"), strokes(F.concat(F.col("_tail"), F.coalesce("_next", F.lit("")))).alias("_k"), F.col("_next").isNotNull().alias("_has"))
    ends = ends.join(joined, "_k", "left").join(whole, "_k", "left").join(firsts, "_t", "left")
    j, c = F.coalesce("_joined", F.lit(0)), F.coalesce("_compound", F.lit(0))
    is_cut = F.when(F.col("_mark") != "-", True).when(F.col("_has") & (j + c >= least), j >= c).otherwise(F.coalesce("_firsts", F.lit(0)) < least)
    return ends.where(is_cut).select("page_id", "field_name", "line_no")


def _prepared(pages: DataFrame, cache: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges of pages, running text, word counts; each is written once, as several steps read it."""
    titles = None
    if cache is not None:
        titles = cache.select(F.concat_ws("\u0001", F.coalesce("vault_key", F.lit("")), F.coalesce("ref_path", F.lit(""))).alias("ref"), "title")
    rows = cut(page_rows(pages))
    edges = cut(edge_lines(rows, titles))
    text = cut(running_text(rows, edges))
    return edges, text, cut(word_counts(text))


def found_noise(pages: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(page_id, field_name, line_no, kind): one row per noisy line and kind of noise in it."""
    edges, text, counts = _prepared(pages, cache)
    key = ("page_id", "field_name", "line_no")
    outer = edges.select("page_id", "field_name", F.inline("edges")).select(*key, F.col("edge").alias("kind"))
    cuts = cut_words(text, counts).withColumn("kind", F.lit("hyphen"))
    words = text.select(*key, F.explode(F.array_distinct("_w")).alias("word"))
    wrong = words.join(bounded(misreadings(text, counts).select("word")), "word", "left_semi").select(*key).distinct().withColumn("kind", F.lit("misread"))
    return outer.unionByName(cuts).unionByName(wrong)


def _corrected(text: DataFrame, wrong: DataFrame) -> DataFrame:
    """page_id, field_name, line_no, fixed: the lines that hold misread words, with these put right (first letter's case kept)."""
    key = ("page_id", "field_name", "line_no")
    parts = text.select(*key, F.explode(F.array_distinct("_w")).alias("word")).join(bounded(wrong), "word", "left_semi")
    lines = text.select(*key, "line").join(parts.select(*key).distinct(), list(key), "left_semi")
    pieces = lines.select(*key, F.posexplode(F.regexp_extract_all("line", F.lit(rf"([{_LETTER}]+|[^{_LETTER}]+)"), F.lit(1))).alias("_i", "_v"))
    pieces = pieces.withColumn("word", F.lower("_v")).join(bounded(wrong), "word", "left")
    capital = F.col("_v").rlike(r"^\p{Lu}") | (F.col("_v").rlike(r"^[^\p{L}]") & (F.col("_i") == 0))
    put = F.when(F.col("right").isNull(), F.col("_v")).when(F.col("_v").rlike(r"\p{Lu}\p{Lu}"), F.upper("right")).when(capital, F.concat(F.upper(F.substring("right", 1, 1)), F.substring("right", 2, 1 << 20))).otherwise(F.col("right"))
    return pieces.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", put.alias("v")))), lambda x: x["v"]), "").alias("fixed"))


def repaired_pages(pages: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(page_id, field_name, text): each page's running text as continuous paragraphs, parted by an empty line.

    Headers and page numbers are gone, misread words put right, cut words joined; a word that goes on on the next page is
    whole on the page where it begins and missing where it ends. Pages without running text give no row.
    """
    lines, text, counts = _prepared(pages, cache)
    key = ["page_id", "field_name", "line_no"]
    text = text.join(cut_words(text, counts).withColumn("_cut", F.lit(True)), key, "left").join(_corrected(text, misreadings(text, counts)), key, "left")
    rows = text.select(*key, "ref", "page_number", F.coalesce("fixed", "line").alias("_l"), "_mark", F.coalesce("_cut", F.lit(False)).alias("_cut"), "_next", "_first", "_last")
    ends = rows.where("_last and _cut").select("ref", (F.col("page_number") + 1).alias("page_number"), F.lit(True).alias("_taken")).distinct()
    rows = rows.join(ends, ["ref", "page_number"], "left").drop("ref", "page_number")
    # A gap in the line numbers is an empty line, which parts paragraphs unless it cuts a word.
    order = W.partitionBy("page_id", "field_name").orderBy("line_no")
    gap = (F.col("line_no") - F.lag("line_no").over(order) > 1) & (F.lag("_mark").over(order) == "")
    rows = rows.withColumn("_gap", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("_para", F.sum("_gap").over(order.rowsBetween(W.unboundedPreceding, 0)))
    body = F.when(F.col("_cut"), F.regexp_replace("_l", rf"[{CUT_MARKS}]$", "")).otherwise(F.col("_l"))
    body = F.when(F.col("_cut") & F.col("_last"), F.concat(body, F.coalesce("_next", F.lit("")))).otherwise(body)
    body = F.when(F.col("_first") & F.coalesce("_taken", F.lit(False)), F.regexp_replace(body, rf"^[^{_LETTER}]*[{_LETTER}]+[^{_LETTER}\s]*\s*", "")).otherwise(body)
    rows = rows.withColumn("_body", F.concat(body, F.when(F.col("_mark") != "", "").otherwise(" ")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[c[1]]), "")
    paras = rows.groupBy("page_id", "field_name", "_para").agg(F.trim(joined(("line_no", "_body"))).alias("_p")).where("_p <> ''")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_para", "_p"))), lambda x: x["_p"]), "\n\n")
    return paras.groupBy("page_id", "field_name").agg(whole.alias("text"))
