"""Column expressions over note text. All are built-in expressions; none needs Python at run time.

Lengths and positions count code points. Where case is ignored, both sides are lower-cased.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space within a line, and all white space including line ends (character classes without brackets).
BLANK = r"\p{Zs}\t"
SPACE = BLANK + r"\n\x0B\f\r\x{85}\x{2028}\x{2029}"


def trim_blank(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANK}]+|(?<![{BLANK}])[{BLANK}]++$", "")


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|(?<![{SPACE}])[{SPACE}]++$", "")


def query_terms(query: str | None) -> list[str]:
    """Lower-cased runs of letters, marks and numbers with at least two characters; repeats kept."""
    import unicodedata

    runs, cur = [], ""
    for ch in (query or "").lower() + " ":
        if unicodedata.category(ch)[0] in "LMN":
            cur += ch
        else:
            runs.append(cur)
            cur = ""
    return [x for x in runs if len(x) >= 2]


def occurrences(haystack: Column, needle: str) -> Column:
    """Non-overlapping occurrences; 0 for an empty needle."""
    if not needle:
        return F.lit(0)
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("bigint")


def frontmatter_bounds(lines: Column, content: Column) -> Column:
    """The first two line numbers (from 0) that hold just ``---``, if the trimmed content begins with ``---``."""
    marks = F.filter(F.transform(lines, lambda x, i: F.when(trim_blank(x) == "---", i)), lambda i: i.isNotNull())
    return F.when(trim_space(content).startswith("---") & (F.size(marks) >= 2), F.slice(marks, 1, 2))


def frontmatter_lines(lines: Column, bounds: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(bounds.isNull(), empty).otherwise(F.slice(lines, bounds[0] + 2, bounds[1] - bounds[0] - 1))


def body_text(lines: Column, bounds: Column, content: Column) -> Column:
    """Content without its front matter; what precedes the opening line is lost, as is the closing line."""
    rest = F.array_join(F.slice(lines, bounds[1] + 2, F.greatest(F.size(lines) - bounds[1] - 1, F.lit(0))), "\n")
    return F.when(bounds.isNull(), content).otherwise(rest)


def field_entries(fm_lines: Column) -> Column:
    """key, value of each line with a colon: key trimmed and in lower case, value trimmed; later duplicates win."""
    kept = F.filter(F.transform(fm_lines, trim_blank), lambda x: x.contains(":"))
    pairs = F.transform(kept, lambda x: F.struct(F.lower(trim_blank(F.substring_index(x, ":", 1))).alias("k"), trim_blank(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    return F.filter(pairs, lambda p: p["k"] != "")


def field(entries: Column, key: str) -> Column:
    """The last value of a key, null if it does not occur."""
    return F.try_element_at(F.transform(F.filter(entries, lambda p: p["k"] == key), lambda p: p["v"]), F.lit(-1))


def custom_fields(entries: Column) -> Column:
    """All other keys with their last values, as a map."""
    rest = F.filter(entries, lambda p: ~p["k"].isin("title", "tags", "created"))
    keys = F.array_distinct(F.transform(rest, lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.element_at(F.transform(F.filter(rest, lambda p: p["k"] == k), lambda p: p["v"]), -1))
    return F.map_from_arrays(keys, last)


def parse_tags(raw: Column) -> Column:
    """Outer brackets away, split at commas, trimmed, in lower case, empty ones dropped; order and repeats kept."""
    bare = F.regexp_replace(trim_blank(F.coalesce(raw, F.lit(""))), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.lower(trim_blank(x))), lambda x: x != "")


def first_heading(body: Column) -> Column:
    """Text of the first line that begins with ``# `` once trimmed."""
    heads = F.filter(F.transform(F.split(body, "\n"), trim_blank), lambda x: x.startswith("# "))
    return F.try_element_at(F.transform(heads, lambda x: trim_blank(F.substr(x, F.lit(3)))), F.lit(1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, if something stands on both of its sides; else empty."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def title_from_path(path: Column) -> Column:
    return F.translate(stem(path), "-_", "  ")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")).cast("int")


def flat_links(content: Column) -> Column:
    """Interiors of all wiki links, then targets of all Markdown links that aren't http or https."""
    wiki = F.regexp_extract_all(content, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    marked = F.regexp_extract_all(content, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    return F.concat(wiki, F.filter(marked, lambda x: ~x.rlike(r"^https?://")))


def human_bytes(n: Column) -> Column:
    """Bytes in B, KB, MB (base 1024, one decimal, a tie to the even digit)."""
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / F.lit(1024.0), 1)))
        .otherwise(F.format_string("%.1f MB", F.bround(n / F.lit(1024.0 * 1024.0), 1)))
    )


def new_frontmatter(title: Column, created: Column, tags: Column) -> Column:
    """A front matter block; tags are trimmed and in lower case, their line is left out if there are none."""
    clean = F.transform(tags, lambda t: F.lower(trim_blank(t)))
    lines = F.array(F.lit("---"), F.concat(F.lit("title: "), title), F.concat(F.lit("created: "), created))
    tag_line = F.when(F.size(clean) > 0, F.array(F.concat(F.lit("tags: ["), F.array_join(clean, ", "), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_join(F.concat(lines, tag_line, F.array(F.lit("---"))), "\n"), F.lit("\n"))


def search_snippet(content: Column, terms: list[str], before: int = 60, length: int = 150) -> Column:
    """A window around the first listed term that occurs; line ends become spaces, cuts are marked by dots."""
    low = F.lower(content)
    at = F.coalesce(*[F.when(low.contains(t), F.instr(low, t) - 1) for t in terms], F.lit(-1))
    start = F.greatest(F.lit(0), at - before)
    piece = F.replace(trim_space(F.substring(content, start + 1, F.lit(length))), F.lit("\n"), F.lit(" "))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), piece, F.when(start + length < F.length(content), "...").otherwise(""))
    return F.when(at < 0, trim_space(F.substring(content, 1, length))).otherwise(cut)


def page_of_match(content: Column, term: str) -> Column:
    """The page whose marker stands nearest before the first occurrence of a term; null without one."""
    at = F.instr(F.lower(content), term)
    head = F.substring(content, F.lit(1), at - 1)
    last = F.regexp_extract(head, r"(?s)^.*--- Page (.*?)$", 1)
    return F.when((at > 0) & head.contains("--- Page "), F.regexp_extract(F.concat(last, F.substr(content, at)), r"(?s)^(.*?) ---", 1).try_cast("int"))


def canvas_snippet(text: Column, needle: str, around: int = 40) -> Column:
    """Lines trimmed and joined by `` / ``, a window around the first match regardless of case; null without one."""
    flat = F.array_join(F.filter(F.transform(F.split(text, r"\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"), trim_blank), lambda x: x != ""), " / ")
    at = F.instr(F.lower(flat), needle.lower()) - 1
    lo = F.greatest(F.lit(0), at - around)
    hi = F.least(F.length(flat), at + len(needle) + around)
    piece = trim_blank(F.substring(flat, lo + 1, hi - lo))
    return F.when(F.lit(bool(needle)) & (at >= 0), F.concat(F.when(lo > 0, "…").otherwise(""), piece, F.when(hi < F.length(flat), "…").otherwise("")))


def message_line(c: Column) -> Column:
    """A commit message on one line, of letters, numbers, spaces and ``-_./[]():,`` only."""
    return F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), r"[^\p{L}\p{M}\p{N} \-_./\[\]():,]", "")


def safe_ref(c: Column) -> Column:
    """A revision name of letters, digits and ``-_/.`` only."""
    return F.regexp_replace(c, r"[^\p{L}\p{M}0-9\-_/.]", "")


def trash_name(at: Column, path: Column) -> Column:
    return F.concat(F.replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(":"), F.lit("-")), F.lit("_"), file_name(path))


def cache_key(path: Column) -> Column:
    """Name of a document's cache entry: the first 16 bytes of its path's SHA-256, in hex."""
    return F.substring(F.sha2(path, 256), 1, 32)


def png_name(path: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit(".png"))


def page_range(text: str | None, total: int) -> tuple[int, int]:
    """``a-b`` or ``a`` within 1..total; anything else gives the first ten pages. An inverted range is empty."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", text or "")
    if not m:
        return 1, min(total, 10)
    lo = max(1, int(m[1]))
    return lo, min(total, int(m[2] or m[1]))
