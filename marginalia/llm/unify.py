"""One consistent form of text that looks the same but differs in its characters.

A quick check over normalization properties (one anchored class, evaluated in the JVM) tells the texts without any
unstable character, which pass untouched and cost no Python. In the others only the unstable segments, widened to the
context that decides about them (a base letter and its marks, the neighbours of a joiner, a whole word), are brought to
their canonical form and spliced into the unchanged rest.

Kinds
-----
``form``       letters or digits in another width or presentation (full-width, mathematical, ligatures, presentation forms)
``accent``     a letter and its mark kept apart although one character exists
``invisible``  characters without width, except joiners, selectors and tags within an emoji
``space``      a space that isn't the ordinary one
``lookalike``  a foreign letter inside an otherwise Latin word

Whole words of another script, and signs that look different from plain text (powers, fractions, number signs,
typographic quotes and dots, roman or circled numerals), stay as they are and are no case; the canonical form is composed
throughout (NFC), so canonically equal texts have one form. Null and empty texts have
no case; a text of any length is one pass.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets that look like a Latin letter, by the letter they look like.
LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ", "K": "КΚᏦ",
    "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꮢ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ",
    "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ", "a": "аαɑ", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "f": "ƒ", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ",
    "k": "κк", "l": "ӏ", "m": "м", "n": "ոп", "o": "оοօ", "p": "рρ", "q": "ԛզ", "r": "гᴦ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝѡա", "x": "хχ",
    "y": "уγү", "z": "ᴢ",
}
# Letters of the Lisu script that look like Latin capitals.
LISU = {"A": "ꓮ", "B": "ꓐ", "C": "ꓚ", "D": "ꓓ", "E": "ꓰ", "F": "ꓝ", "G": "ꓖ", "H": "ꓧ", "I": "ꓲ", "J": "ꓙ", "K": "ꓗ", "L": "ꓡ", "M": "ꓟ", "N": "ꓠ", "O": "ꓳ", "P": "ꓑ", "R": "ꓣ", "S": "ꓢ", "T": "ꓔ", "U": "ꓴ", "V": "ꓦ", "W": "ꓪ", "X": "ꓫ", "Y": "ꓬ", "Z": "ꓜ"}
_LATIN_OF = {c: latin for table in (LOOKALIKES, LISU) for latin, chars in table.items() for c in chars}

# Ranges of characters without width (default ignorable code points).
INVISIBLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
# Ranges of characters that make or take part in an emoji.
EMOJI = ((0x23, 0x23), (0x2A, 0x2A), (0x30, 0x39), (0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x203C), (0x2049, 0x2049), (0x20E3, 0x20E3), (0x2122, 0x2122), (0x2139, 0x2139), (0x2190, 0x21FF), (0x2300, 0x27BF), (0x2934, 0x2935), (0x2B00, 0x2BFF), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3299), (0x1F000, 0x1FBFF))

# Ranges that hold no unstable character. The quick check looks for anything beyond them: few ranges keep it
# cheap, and what it passes on needlessly is settled by the exact classes.
STABLE = ((0x00, 0x7F), (0xA1, 0xAC), (0xAE, 0x17E), (0x2010, 0x2027), (0x2030, 0x205E), (0x2190, 0x2328), (0x232B, 0x2ADB), (0x2ADD, 0x2BFF), (0x3001, 0x3029), (0x3030, 0x3098), (0x309B, 0x3130), (0x3190, 0x9FFF), (0xAC00, 0xD7A3), (0x1F000, 0x1FAFF))

_FORM_TAGS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def _class(ranges, java: bool = False) -> str:
    esc = (lambda p: f"\\x{{{p:X}}}") if java else (lambda p: f"\\U{p:08X}")
    return "".join(esc(a) if a == b else f"{esc(a)}-{esc(b)}" for a, b in ranges)


@cache
def _properties() -> tuple[dict[str, str], str, list[int]]:
    """Canonical letters of other forms, the class of these letters, and all unstable code points."""
    forms, singles = {}, []
    for p in range(0xA0, 0x20000):
        ch = chr(p)
        kind, tag = unicodedata.category(ch), unicodedata.decomposition(ch).split(" ")[0]
        if kind in ("Lu", "Ll", "Lt", "Lo", "Lm", "Nd") and (tag in _FORM_TAGS or (tag == "<compat>" and 0xFB00 <= p <= 0xFB4F) or p == 0x17F):
            to = unicodedata.normalize("NFKC", ch)
            if all(unicodedata.category(x)[0] in "LNM" for x in to):
                forms[ch] = to
        elif kind[0] == "L" and tag and tag[0] != "<" and unicodedata.normalize("NFC", ch) != ch and len(unicodedata.normalize("NFC", ch)) == 1:
            forms[ch] = unicodedata.normalize("NFC", ch)
        if unicodedata.combining(ch):
            singles.append(p)
    forms = {k: v for k, v in forms.items() if not 0xAC00 <= ord(k) <= 0xD7FF and not 0xF900 <= ord(k) <= 0xFAFF}
    spaces = [p for p in range(0xA0, 0x3001) if unicodedata.category(chr(p)) == "Zs"]
    form_class = _class(_ranges(sorted(map(ord, forms))))
    every = sorted({*map(ord, forms), *singles, *spaces, *map(ord, _LATIN_OF), *(p for a, b in INVISIBLE for p in range(a, b + 1))})
    return forms, form_class, every


@cache
def unsettled() -> list[int]:
    """The code points whose quick check for the composed form isn't Yes: those that it changes, and those that may join or
    move before what precedes them (marks, second characters of composites, vowels and final consonants of Hangul)."""
    seconds = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    out = []
    for p in (*range(0xA0, 0xD800), *range(0xE000, 0x30000)):
        parts = unicodedata.decomposition(chr(p)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            seconds.add(int(parts[1], 16))
        if unicodedata.combining(chr(p)) or not unicodedata.is_normalized("NFC", chr(p)):
            out.append(p)
    return sorted({*out, *seconds})


def unstable(col: Column) -> Column:
    """Whether a text holds any character that the operator may have to touch: the quick check."""
    return col.rlike(f"[^{_class(STABLE, java=True)}]")


class Unifier:
    """Segment-wise canonical form of one text.

    latin_of: letters that look like a Latin one, with that one; any public table of confusable letters can be given.
    """

    def __init__(self, latin_of: dict[str, str] | None = None) -> None:
        self.latin_of = latin_of = _LATIN_OF if latin_of is None else latin_of
        self.forms, form_class, _ = _properties()
        invisible, emoji = _class(INVISIBLE), _class(EMOJI)
        self.form = regex.compile(f"[{form_class}]+")
        # A joiner, selector or tag stays where an emoji precedes it and, for the joiner, follows it.
        self.invisible = regex.compile(
            rf"(?P<kept>(?<=[{emoji}])️(?:‍(?=[{emoji}]))?|(?<=[{emoji}])‍(?=[{emoji}])|(?<=[{emoji}\U000E0020-\U000E007E])[\U000E0020-\U000E007F]+)|[{invisible}]"
        )
        self.space = regex.compile(r"[^\P{Zs} ]")
        self.accent = regex.compile(r"\p{L}\p{M}+")
        # A segment is a character with all that may compose with it or that its composed form changes.
        loose = _class(_ranges(unsettled()))
        self.loose = regex.compile(f"[^{loose}]?[{loose}]+")
        keys = "".join(latin_of)
        self.foreign = regex.compile(f"[{keys}]")
        self.word = regex.compile(r"[\p{L}\p{M}]+")
        self.latin = regex.compile(rf"(?![{keys}])\p{{Latin}}")
        self.other = regex.compile(rf"(?![{keys}])[^\P{{L}}\p{{Latin}}]")

    def __call__(self, text: str) -> tuple[str, list[str]]:
        """The canonical form of a text and the kinds of disguise found in it."""
        kinds: set[str] = set()
        latin_of = self.latin_of

        def drop(m: regex.Match) -> str:
            if m["kept"]:
                return m[0]
            kinds.add("invisible")
            return ""

        def letters(m: regex.Match) -> str:
            kinds.add("form")
            return "".join(self.forms[c] for c in m[0])

        def blank(m: regex.Match) -> str:
            kinds.add("space")
            return " "

        def compose(m: regex.Match) -> str:
            to = unicodedata.normalize("NFC", m[0])
            if len(to) < len(m[0]):
                kinds.add("accent")
            return to

        def latin(m: regex.Match) -> str:
            word = m[0]
            if not self.foreign.search(word) or not self.latin.search(word) or self.other.search(word):
                return word
            kinds.add("lookalike")
            return self.foreign.sub(lambda x: latin_of[x[0]], word)

        text = self.invisible.sub(drop, text)
        text = self.form.sub(letters, text)
        text = self.space.sub(blank, text)
        text = self.accent.sub(compose, text)
        # What is left, such as signs with one composed form or letters of other scripts, is no disguise but has one form too.
        if not unicodedata.is_normalized("NFC", text):
            text = self.loose.sub(lambda m: unicodedata.normalize("NFC", m[0]), text)
        if self.foreign.search(text):
            text = self.word.sub(latin, text)
        return text, sorted(kinds)


_UNIFIER: list[Unifier] = []


def unifier() -> Unifier:
    if not _UNIFIER:
        _UNIFIER.append(Unifier())
    return _UNIFIER[0]


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))]))
def _unify(s: pd.Series) -> pd.DataFrame:
    run = unifier()
    return pd.DataFrame([(None, None) if x is None else run(x) for x in s], columns=["text", "kinds"])


def with_canonical(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the canonical form of a text column; null stays null, stable texts are passed on unchanged in the JVM."""
    col, check = F.col(text), F.col("_unstable")
    df = df.withColumn("_unstable", unstable(col))
    return df.withColumn(out, F.when(check, _unify(F.when(check, col))["text"]).otherwise(col)).drop("_unstable")


def _unstable_rows(sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """tbl, row_id, _text of all records whose text doesn't pass the quick check."""
    out = None
    for name, rows, key, text in sources:
        part = rows.select(F.lit(name).alias("tbl"), F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("_text"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("row_id").isNotNull() & unstable(F.col("_text")))


def found_disguises(sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """tbl, row_id, kind: one row per record and kind of disguise in it, each record once.

    sources lists (table name, rows, id column, text column). Only those columns are read. Texts that pass the quick
    check are filtered out before Python sees them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unify = unifier()
        for batch in batches:
            got = [(t, i, k) for t, i, x in zip(*(c.to_pylist() for c in batch.columns)) for k in unify(x)[1]]
            cols = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()))], ["tbl", "row_id", "kind"])

    return _unstable_rows(sources).mapInArrow(run, "tbl string, row_id bigint, kind string").distinct()


def canonical_forms(sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """tbl, row_id, canonical: the canonical form of every text that differs from it, each record once; sources as in
    ``found_disguises``. A text that isn't listed is its own canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unify = unifier()
        for batch in batches:
            got = [(t, i, c) for t, i, x in zip(*(c.to_pylist() for c in batch.columns)) if (c := unify(x)[0]) != x]
            cols = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()))], ["tbl", "row_id", "canonical"])

    return _unstable_rows(sources).mapInArrow(run, "tbl string, row_id bigint, canonical string").distinct()
