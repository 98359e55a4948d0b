"""Several values packed in one field, split into one row per value with its position.

1. A value becomes a *skeleton*: ordinary text is masked (``a`` one word, ``b`` several), every delimiter, quote, bracket
   and line mark stays. One skeleton character stands for one token of the value, so places carry over.
2. Splitting rules are resolved once per *distinct* skeleton (the only Python step): the token spans of the items.
3. The rules go back to the values, broadcast if there are few enough of them, and each item is cut out by position.

Grammar
-------
* Items are separated by ``, ; | • ·``, their full-width forms, ``、``, tabs, line ends, `` / `` with spaces, and in tags by a
  space before ``#``. Several delimiters in one value all separate.
* Outer brackets, list marks (``- ``, ``* ``) at a line's start and, in tags, leading ``#`` are removed.
* An item that opens with a quote and closes before a delimiter is taken whole, doubled quotes and backslash escapes
  undone. Quotes elsewhere (``o'clock``) are text.
* ``people``: a comma separates only where every side is quoted or has several words; else "Surname, Given" is one value.
* Null, empty, blank and bracket-only values give no row. Positions count the non-empty items, repeats kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import BROADCAST_ROWS, bounded, cut

#: Rules of the most frequent skeletons that are broadcast where there are too many skeletons for all.
FREQUENT_RULES = 10_000

_SPACE = r"[[^\S\n\t]\p{Z}]++"
_SPECIAL = r"\[\]\"'“”‘’\\;；|,，、/•·#*\-\n\t"
_ORDINARY = rf"[^\s\p{{Z}}{_SPECIAL}]"
# Repetitions of groups are bounded, as Java's matcher recurses over them; a longer run just takes several tokens.
_WORD = rf"{_ORDINARY}++(?:['’\-/*#]{_ORDINARY}++){{0,12}}+"
#: One token: a run of words parted by single spaces, a line end, a run of blanks, or any single character.
_TOKEN = rf"(?s){_WORD}(?: {_WORD}){{0,12}}+|\r?\n|(?:{_SPACE})|."

ITEM = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("q", T.StringType())]))
_PAIRS = {'"': '"', "'": "'", "“": "”", "‘": "’"}
_DELIMITERS = set(",，;；、|•·\n\t")


def tokens(value: Column) -> Column:
    """The value's tokens; joined they give it back."""
    return F.regexp_extract_all(value, F.lit(f"({_TOKEN})"), F.lit(1))


def skeleton(parts: Column) -> Column:
    """One character for each token: a one word, b several, _ blanks; line ends, tabs and special characters stay."""

    def mask(t: Column) -> Column:
        return (
            F.when(t.rlike(r"^\r?\n$"), "\n")
            .when(t == "\t", "\t")
            .when(t.rlike(r"^[\s\p{Z}]+$"), "_")
            .when(t.rlike(rf"^[{_SPECIAL}]$"), t)
            .when(t.contains(" "), "b")
            .otherwise("a")
        )

    return F.array_join(F.transform(parts, mask), "")


def split_skeleton(sk: str, mode: str) -> list[tuple[int, int, str]]:
    """(start, length, quote) of each item of a skeleton; quote is '' for plain text. mode: tags, people or list."""
    lo, hi = 0, len(sk)
    blank = "_\n\t"
    while lo < hi and sk[lo] in blank:
        lo += 1
    while hi > lo and sk[hi - 1] in blank:
        hi -= 1
    if hi - lo >= 2 and sk[lo] == "[" and sk[hi - 1] == "]":
        lo, hi = lo + 1, hi - 1

    def delimiter(k: int) -> bool:
        if k >= hi or sk[k] in _DELIMITERS:
            return True
        return sk[k] == "/" and 0 < k < hi - 1 and sk[k - 1] == "_" and sk[k + 1] == "_"

    items: list[tuple[int, int, str, str]] = []  # start, length, quote, delimiter before
    k, before, line_start = lo, "", True
    while k <= hi:
        while k < hi and sk[k] == "_":
            k += 1
        if line_start and k + 1 < hi and sk[k] in "-*•" and sk[k + 1] == "_":
            k += 2
        if mode == "tags":
            while k < hi and sk[k] == "#":
                k += 1
        start, quote, end = k, "", -1
        if k < hi and sk[k] in _PAIRS:
            close, j = _PAIRS[sk[k]], k + 1
            while j < hi:
                if sk[j] == "\\":
                    j += 2
                    continue
                if sk[j] == close:
                    if close == '"' and j + 1 < hi and sk[j + 1] == close:
                        j += 2
                        continue
                    after = j + 1
                    while after < hi and sk[after] == "_":
                        after += 1
                    if delimiter(after) or (mode == "tags" and sk[after] == "#"):
                        quote, end = sk[k], j
                        items.append((k + 1, j - k - 1, quote, before))
                        k = after
                        break
                j += 1
        if end < 0:
            while not delimiter(k):
                if sk[k] == "\\" and k + 1 < hi:
                    k += 2
                    continue
                if mode == "tags" and sk[k] == "_" and k + 1 < hi and sk[k + 1] == "#":
                    break
                k += 1
            items.append((start, min(k, hi) - start, "", before))
        if k >= hi:
            break
        before, line_start = sk[k], sk[k] == "\n"
        k += 1
    if mode == "people":
        items = _people(sk, items)
    return [(s, n, q) for s, n, q, _ in items if n > 0]


def _people(sk: str, items: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Items parted by commas are joined to "Surname, Given" unless each of them is a full name by itself."""
    out: list[tuple[int, int, str, str]] = []
    group: list[tuple[int, int, str, str]] = []

    def close() -> None:
        filled = [x for x in group if sk[x[0] : x[0] + x[1]].strip("_")]
        whole = all(q or "b" in sk[s : s + n] or "_" in sk[s : s + n].strip("_") for s, n, q, _ in filled)
        if whole or len(filled) < 2:
            out.extend(filled)
        elif len(filled) % 2:
            out.append((filled[0][0], filled[-1][0] + filled[-1][1] - filled[0][0], "", filled[0][3]))
        else:
            for a, b in zip(filled[::2], filled[1::2]):
                out.append((a[0], b[0] + b[1] - a[0], "", a[3]))
        group.clear()

    for x in items:
        if group and x[3] not in (",", "，"):
            close()
        group.append(x)
    close()
    return out


@F.pandas_udf(ITEM)
def _resolve(sk: pd.Series, mode: pd.Series) -> pd.Series:
    return pd.Series([[{"s": s + 1, "n": n, "q": q} for s, n, q in split_skeleton(a, b)] for a, b in zip(sk, mode)])


def _item_text(parts: Column, rule: Column, tags: Column) -> Column:
    raw = F.array_join(F.slice(parts, rule["s"], rule["n"]), "")
    raw = F.when(rule["q"] == '"', F.replace(raw, F.lit('""'), F.lit('"'))).otherwise(raw)
    raw = F.when(raw.contains("\\"), F.regexp_replace(raw, r"\\([^\p{L}\p{N}])", "$1")).otherwise(raw)
    raw = F.regexp_replace(raw, r"^[\s\p{Z}]+|(?<![\s\p{Z}])[\s\p{Z}]++$", "")
    return F.when(tags, F.regexp_replace(raw, r"^#+\s*", "")).otherwise(raw)


def split_packed(fields: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(…, field_name, pos, item) of rows (…, field_name, mode, value): one row per packed value, in order.

    mode is ``tags``, ``people`` or ``list``. Other columns are kept. Very long values are split like others; the number of
    distinct skeletons, against max_rows, decides between a broadcast of the rules and a shuffled join of the rare ones.
    """
    keep = [x for x in fields.columns if x not in ("mode", "value")]
    work = fields.where(F.col("value").isNotNull() & F.col("value").rlike(r"[^\s\p{Z}]")).withColumn("_parts", tokens(F.col("value")))
    work = work.withColumn("_sk", skeleton(F.col("_parts"))).drop("value")
    counts = work.groupBy(F.col("_sk").alias("_rsk"), F.col("mode").alias("_rmode")).agg(F.count(F.lit(1)).alias("_n"))
    rules = cut(counts.withColumn("_rule", _resolve("_rsk", "_rmode")))
    same = (F.col("_sk") == F.col("_rsk")) & (F.col("mode") == F.col("_rmode"))
    joined = work.join(bounded(rules, max_rows), same)
    if rules.count() > max_rows:
        # Most rows have one of a few skeletons, so these rules are broadcast and only rare skeletons are shuffled.
        top = F.broadcast(cut(rules.orderBy(F.desc("_n"), "_rsk", "_rmode").limit(FREQUENT_RULES)))
        joined = work.join(top, same).unionByName(work.join(top, same, "left_anti").join(rules.hint("merge"), same))
    items = F.filter(F.transform("_rule", lambda r: _item_text(F.col("_parts"), r, F.col("mode") == "tags")), lambda x: x != "")
    return joined.select(*keep, F.posexplode(items).alias("_pos", "item")).select(*keep, (F.col("_pos") + 1).cast("bigint").alias("pos"), "item")


#: The list-like custom fields and how each is split.
LIST_FIELDS = {"aliases": "list", "topics": "list", "sources": "list", "people": "people"}


def found_items(notes: DataFrame) -> DataFrame:
    """note_id, field_name, pos, item of the tags and the list-like custom fields of notes, each record once.

    A note that arrives again unchanged counts once. Null maps, null values and notes without id give no row.
    """
    named = [F.struct(F.lit("tags").alias("field_name"), F.lit("tags").alias("mode"), F.col("tags").alias("value"))]
    named += [F.struct(F.lit(k).alias("field_name"), F.lit(m).alias("mode"), F.try_element_at("custom_fields", F.lit(k)).alias("value")) for k, m in LIST_FIELDS.items()]
    fields = notes.where("note_id is not null").select(F.col("note_id").cast("bigint").alias("note_id"), F.inline(F.array(*named)))
    return split_packed(fields.where("value is not null").distinct())
