"""Documents that hold template residue, stand-in text, error pages or script notices instead of content.

The texts are read once: code (fences, back-ticks), formulas and lone quoted markers are masked out, whatever looks like a
retained slot is wrapped, digits are masked, and the text is cut to units (lines and sentences). The units are written;
all else works on them.

Slots. A *frame* is two tokens on the left and two on the right, line and sentence ends included. Frames are taken around
every retained-looking piece (a variable name in some template syntax, a program's empty value, a rule of underscores or
dots, a blank left before a comma). Then all records are aligned on these frames: whatever stands between the same two
sides in any record, at most ``most_words`` tokens, is a filler, and a frame whose fillers vary while its sides agree is an
induced slot. A record is residue if its filler of an induced slot is

* a variable name in an unmistakable syntax (also where its name is used that way in several frames), or in a weaker
  syntax if the name is so used or the slot has others;
* the bare name of a variable that stands in the same slot in such a syntax (``FIRSTNAME``, ``Your name``): a default;
* a program's empty value, if the slot has other values of that sort (or, for values that mean nothing else, other fillers);
* a rule, a blank before a comma, or nothing at all. A slot with nothing in it counts if it is known from variable names or
  empty values and the joint doesn't read on: if both halves of it also stand elsewhere in other words, it is no case.

Frames without a letter need a variable name. A default that doesn't name its variable can't be told from a value.

Pages. A unit that repeats over documents and there goes with the furniture of a site (menus, references, "try again
later") or with units that say so themselves belongs to a whole-page template. A page is an error page or script notice
if all its units belong to such templates, are furniture or say so; or if it is headed by a status code and comes back
as a whole, but for its codes and numbers, in any language. Prose that mentions an error has other units and is no case.

Stand-in text is known by its vocabulary (share of filler words), by being nothing but one phrase of any length over and
over, or by being a phrase that other documents repeat that way.

Kinds, one for each document, the first that holds: script, error, filler, placeholder. Null, empty and blank texts are no
case, nor are rows without id; copies and repeated rows are judged alike; an empty table gives no rows. All statistics cover
all documents and whole texts; only the key and text columns are read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import bounded, cut

_NAME = r"[A-Za-z][A-Za-z0-9_.\-]*(?: [A-Za-z0-9_.\-]+){0,3}"
# Template syntaxes around a variable name, those that mean nothing else first.
STRONG = (
    rf"\{{\{{[\s#/^>&~-]*{_NAME}\s*\}}\}}", rf"\$\{{\s*{_NAME}\s*\}}", rf"<%[=\-]?\s*{_NAME}\s*%>", rf"\{{%\s*{_NAME}\s*%\}}", rf"%%{_NAME}%%", rf"@@{_NAME}@@",
    rf"<<\s*{_NAME}\s*>>", rf"<{_NAME} (?:goes )?here>", rf"\[(?i:insert|your|enter|add) {_NAME} (?i:here)\]", r"\bXX_[A-Z][A-Z0-9_]*_XX\b",
)
WEAK = (rf"(?<!\[)\[{_NAME}\](?![\](])", rf"(?<![{{\\$%\w])\{{{_NAME}\}}(?!\}})", r"\$[A-Z][A-Z0-9_]*\$", r"#[A-Z][A-Z0-9_]*#", r"\b__[A-Z][A-Z0-9_]*?__\b")
# What programs print for no value.
UNMISTAKABLE = (r"\[object Object\]", r"Invalid Date", r"null null", r"#N/A", r"#REF!", r"#VALUE!")
EMPTY_VALUES = (r"\[object Object\]", r"\bInvalid Date\b", r"\bnull null\b", r"\bundefined\b", r"\bnull\b", r"\bNaN\b", r"\bNone\b", r"\bnil\b", r"#N/A", r"#REF!", r"#VALUE!")
# Words of the usual stand-in Latin, of keyboard play, and stand-in phrases.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
PLAY = "foo bar baz qux quux asdf asdfg asdfgh jkl qwer qwert qwerty zxcv blah bla xxx yyy zzz test testing abc lorem ipsum".split()
PHRASES = (
    "placeholder paragraph", "placeholder text", "placeholder", "your text goes here", "your text here", "text goes here", "content goes here", "text text text", "sample text", "dummy text", "dummy content",
    "sample content", "write something here", "type something here", "insert text here", "add text here", "blindtext", "filler text", "lorem ipsum", "content coming soon", "text text", "text",
)
# What error pages, script notices and the furniture of a site say.
ERROR = (
    r"\b(?:error|status|code|http)\W{0,3}(?:code|status)?\W{0,3}\d{3}\b|^\W*\d{3}\b\W*(?:error|not found|forbidden|gone|unauthori[sz]ed|bad gateway|bad request|service unavailable|internal server error|gateway time-?out|too many requests|request timeout)?\W*$"
    r"|(?:page|site|document|file|address|url)\b.*\b(?:not be found|not found|not exist|no longer exists?|has moved|was removed|unavailable)|^\W*(?:page |file )?(?:not found|forbidden|bad gateway|service unavailable|internal server error|gateway time-?out|gone)\W*$"
    r"|\baccess (?:is |was )?denied\b|\bdo(?:es)? not have permission|\btoo many requests\b|\bconnection (?:timed out|was reset|refused)|\btimed out before\b|\bsomething went wrong\b|\bupstream\b|\bserver (?:error|is busy|did not)|\bslow down\b|\btemporarily unavailable|\bunexpected error"
    r"|nicht gefunden|no encontrad|introuvable|non trovat|\bsession (?:has )?expired|\bdown for maintenance|\bcan'?t seem to find|\bunder maintenance|\boops\b"
    r"|\b\d{3} (?:not found|forbidden|gone|unauthori[sz]ed|bad gateway|bad request|service unavailable|internal server error|gateway time-?out)\b"
)
# Every alternative above holds one of these.
ERROR_NEEDS = (
    "444", "not found", "not be found", "not exist", "no longer exist", "has moved", "was removed", "unavailable", "forbidden", "bad gateway", "internal server error", "time-out", "timeout", "gone", "denied", "permission",
    "too many requests", "connection", "timed out before", "went wrong", "upstream", "server", "slow down", "unexpected error", "gefunden", "encontrad", "introuvable", "trovat", "expired", "maintenance", "seem to find", "oops",
)
SCRIPT = r"\bjava ?scripts?\b|\bscripts?\b.*\b(?:browser|navigateur|navegador|allowed|enabled?|disabled|run|on|cookies)\b|\b(?:browser|navigateur|navegador|enable|activez|aktivieren|run|allow)\b.*\bscripts?\b"
FURNITURE = (
    r"^(?:menu|search|home|login|sign in|contact|imprint|privacy|skip to .*|home \|.*|.*\| about|©.*|reference: .*|ref(?:erence)? .*|request \S+ at .*|request \S+.*|path /.*|try again.*|go back.*|check the address.*|we have been notified.*|"
    r"turn it on.*|reload.*|please try .*|please wait.*|contact .*|wait a .*|back to .*|return to .*|if .* (?:persists|continues).*|.*all rights reserved.*|powered by .*|[-=_*|·\s]*)$"
)


def _where(text: Column, signs: str, pattern: str, to: str) -> Column:
    """A pattern replaced in the texts that hold one of some characters: looking for these is far cheaper."""
    return F.when(reduce(or_, (F.contains(text, F.lit(c)) for c in signs)), F.regexp_replace(text, pattern, to)).otherwise(text)


def _masked(docs: DataFrame) -> DataFrame:
    """id, text of documents without code, formulas and lone quoted markers."""
    text = F.col("text")
    docs = docs.select("id", _where(text, "`~", r"(?s)```.*?(?:```|$)|~~~.*?(?:~~~|$)", " \u0002 ").alias("text"))
    docs = docs.select("id", _where(text, "`", r"`[^`\n]*`", " \u0002 ").alias("text"))
    docs = docs.select("id", _where(text, "\\", r"\$[^$\n]*\\[^$\n]*\$|\\[A-Za-z]+(?:\{[^}\n]*\}){1,20}", " \u0002 ").alias("text"))
    quoted = (r"[\"“”'‘’][^\"“”'‘’\n\s]{0,3}\s*(?:" + "|".join(STRONG) + r")\s*[^\"“”'‘’\n\s]{0,3}[\"“”'‘’]")
    return docs.select("id", _where(text, "{<%@[_", quoted, " \u0002 ").alias("text"))


# Wraps of a retained piece, an edge of a unit, a line that goes on, a piece masked out, nothing before a comma.
_OPEN, _CLOSE, _EDGE, _ON, _OUT, _GAP = "\ue000", "\ue001", "\u0005", "\u0004", "\u0002", "\u0006"
_RULE = r"_{3,}(?![A-Za-z])|\.{4,}"
_TOKEN = rf"{_OPEN}[^{_CLOSE}]*{_CLOSE}|[\p{{L}}\p{{M}}\p{{N}}_]+|[^\s\p{{L}}\p{{M}}\p{{N}}_]"


def text_units(docs: DataFrame) -> DataFrame:
    """id, units of documents (id, text): the lines and sentences of each text, in one scan.

    Retained-looking pieces are wrapped, digits masked (status codes as 444), code masked out. A unit ends in a mark if its line
    goes on or, after a colon, if a list follows.
    """
    # The first characters spare most places the alternatives.
    pieces = r"(?=[{$<%@\[#_XNIun.])(?:" + "|".join((*STRONG, *WEAK, *EMPTY_VALUES, _RULE)) + ")"
    text, docs = F.col("text"), _masked(docs)
    docs = docs.select("id", F.regexp_replace(text, f"({pieces})", f" {_OPEN}$1{_CLOSE} ").alias("text"))
    text = F.regexp_replace(text, r"(?<=[\p{L}\p{N}])[ \t]+(?=[,;](?:\s|$))", f" {_OPEN}{_GAP}{_CLOSE} ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?<![\d.:/-])[45]\d\d(?![\d:/-]|\.\d)", "\u0007"), r"\d+", "9")
    docs = docs.select("id", F.replace(text, F.lit("\u0007"), F.lit("444")).alias("text"))
    docs = docs.select("id", _where(F.col("text"), "\r", r"\r\n?", "\n").alias("text"))
    text = F.col("text")
    text = F.regexp_replace(text, r":[ \t]*\n\s*(?=(?:[-*+•|>]|\d+[.)])[ \t]+\S)", f": {_ON} {_EDGE} ")
    text = F.regexp_replace(text, r"\n(?=[ \t]*[^\s#])(?![^\n:]{1,40}:(?:\s|$))(?![ \t]*(?:[-*+•|>]|\d+[.)])(?:\s|$))", f" {_ON} {_EDGE} ")
    text = F.regexp_replace(text, r"[.!?…]+[\"”’)]*(?:\s+|$)|\n\s*", f" {_EDGE} ")
    units = F.filter(F.transform(F.split(text, _EDGE), lambda u: F.regexp_replace(u, r"^\s+|(?<!\s)\s++$", "")), lambda u: (u != "") & (u != _ON))
    return docs.select("id", F.transform(units, lambda u: F.regexp_replace(u, rf"(?<![:\s])\s*{_ON}$", "")).alias("units"))


def _windows(units: DataFrame, reach: int, step: int = 64) -> DataFrame:
    """id, t: the tokens of each unit between edges, in windows of ``step`` tokens and ``reach`` more on either side, so that an
    endless unit stays linear; most units are one window."""
    edge = F.array(F.lit(""), F.lit(_EDGE))
    one = _once(units.select("id", F.explode("units").alias("u")), ["id"], t=F.concat(edge, F.regexp_extract_all("u", F.lit(f"({_TOKEN})"), F.lit(1)), F.reverse(edge)))
    starts = F.sequence(F.lit(1), F.size("t"), F.lit(step))
    parts = F.when(F.size("t") <= step + reach, F.array("t")).otherwise(F.transform(starts, lambda j: F.slice("t", F.greatest(j - reach, F.lit(1)), step + 2 * reach)))
    return one.select("id", F.explode(parts).alias("t"))


def _sign(x: Column) -> Column:
    """A token in lower case; any retained piece is the same sign."""
    return F.when(x.startswith(_OPEN), _OPEN).otherwise(F.lower(x))


def slot_frames(units: DataFrame) -> DataFrame:
    """key, l2, l1, r1, r2 of the frames around all retained-looking pieces."""
    rows = _windows(units.select("id", F.filter("units", lambda u: u.contains(_OPEN)).alias("units")).where(F.size("units") > 0), 2).where(F.size("t") > 4)
    at = rows.select("t", F.explode(F.sequence(F.lit(2), F.size("t") - 3)).alias("_i")).where(F.get("t", F.col("_i")).startswith(_OPEN))
    sides = at.select(*[_sign(F.get("t", F.col("_i") + d)).alias(n) for n, d in (("l2", -2), ("l1", -1), ("r1", 1), ("r2", 2))]).distinct()
    return sides.select(F.concat_ws("\u0003", "l2", "l1", "r1", "r2").alias("key"), "l2", "l1", "r1", "r2")


def frame_fillers(units: DataFrame, frames: DataFrame, most_words: int = 6) -> DataFrame:
    """key, id, filler, on of all places of all units where a frame's sides meet: filler the tokens between them, or null
    and on ``left`` or ``right`` where only that side stands there and the other's first token follows at once.

    A frame is looked up by its sides that have a letter, by the left one if none has.
    """
    letter = lambda *c: F.concat_ws(" ", *c).rlike(r"\p{L}")
    # near2, near1: the side that is looked up, read towards the slot; far1, far2: the other side, read away from it.
    side = lambda left, *c: F.struct(F.lit(left).alias("left"), *[F.col(x).alias(n) for x, n in zip(c, ("near2", "near1", "far1", "far2"))])
    sides = F.filter(F.array(F.when(letter("l2", "l1") | ~letter("r1", "r2"), side(True, "l2", "l1", "r1", "r2")), F.when(letter("r1", "r2"), side(False, "r2", "r1", "l1", "l2"))), lambda x: x.isNotNull())
    anchors = frames.select("key", F.inline(sides)).withColumn("h", F.when(F.col("left"), F.xxhash64("near2", "near1")).otherwise(F.xxhash64("near1", "near2")))
    i, left, reach = F.col("i"), F.col("left"), most_words + 2
    at = lambda k: _sign(F.get("t", i + k))
    met = _windows(units, most_words + 4).select("id", "t", F.explode(F.sequence(F.lit(0), F.size("t") - 2)).alias("i"))
    met = met.withColumn("h", F.xxhash64(at(0), at(1))).join(bounded(anchors), "h")
    met = met.where(F.when(left, (at(0) == F.col("near2")) & (at(1) == F.col("near1"))).otherwise((at(0) == F.col("near1")) & (at(1) == F.col("near2"))))
    begin = F.greatest(i - reach, F.lit(0))
    near = F.when(left, F.slice("t", i + 1, reach + 2)).otherwise(F.reverse(F.slice("t", begin + 1, i + 2 - begin)))
    met = cut(met.select("key", "id", "left", "far1", "far2", near.alias("t")).distinct())
    met = met.withColumn("s", F.transform("t", _sign))
    get = lambda k: F.get("s", k)
    n = F.get(F.filter(F.sequence(F.lit(0), F.lit(most_words)), lambda k: (get(k + 2) == F.col("far1")) & (get(k + 3) == F.col("far2"))), F.lit(0))
    on = F.when((get(F.lit(2)) == F.col("far1")) & (get(F.lit(3)) != F.col("far2")), F.when(left, "left").otherwise("right"))
    met = _once(met, ["key", "id", "left", "t"], n=n, on=on)
    filler = F.slice("t", F.lit(3), F.col("n"))
    out = _once(met, ["key", "id"], filler=F.when(F.col("n").isNotNull(), F.array_join(F.when(left, filler).otherwise(F.reverse(filler)), " ")), on=F.when(F.col("n").isNull(), F.col("on")))
    return out.where("filler is not null or on is not null").distinct()


def _bare(name: Column) -> Column:
    """A variable's name as letters only, without what asks for it."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"^\W*(?:xx_)?(?:(?:insert|your|my|enter|add|the)[\s_\-.]+)*|(?:[\s_\-.]+(?:goes[\s_\-.]+)?here)?(?:_xx)?\W*$", ""), r"[^\p{L}\p{N}]+", "")


def residue_slots(units: DataFrame, least_docs: int = 2, least_fillers: int = 3) -> DataFrame:
    """id of the documents (id, units) with an unfilled slot.

    least_docs: documents in which the values that make a slot stand, at least; least_fillers: different ordinary fillers of a
    slot that is known by them alone.
    """
    frames = cut(slot_frames(units))
    if frames.isEmpty():
        return units.select("id").limit(0)
    inner = F.regexp_replace("filler", rf"^{_OPEN}|{_CLOSE}$", "")
    whole = F.col("filler").rlike(rf"^{_OPEN}[^{_OPEN}]*$") & F.col("filler").endswith(_CLOSE)
    is_ = lambda *p: inner.rlike(f"^(?:{'|'.join(p)})$")
    sort = (
        F.when(F.col("filler").isNull(), F.col("on")).when(F.col("filler") == "", "none")
        .when(whole & is_(*STRONG), "strong").when(whole & is_(*UNMISTAKABLE), "void").when(whole & is_(*EMPTY_VALUES), "empty").when(whole & (inner == _GAP), "gap").when(whole & is_(_RULE), "rule").when(whole, "weak")
        .when(F.col("filler").rlike(rf"[{_OPEN}{_ON}{_OUT}]"), "other").otherwise("plain")
    )
    value = F.when(sort.isin("strong", "weak"), _bare(inner)).when(sort.isin("void", "empty"), F.lower(inner)).when(sort == "plain", F.lower("filler"))
    hits = frame_fillers(units, frames).select("key", "id", sort.alias("sort"), value.alias("value"), F.col("key").rlike(r"\p{L}").alias("lettered"))
    hits = cut(hits.where("sort <> 'other'").where("sort not in ('strong', 'weak') or value <> ''"))

    mark = "sort in ('strong', 'void', 'empty') and (sort = 'strong' or lettered)"
    seen = hits.groupBy("key", "sort", "value").agg(F.count_distinct("id").alias("d"), F.first("lettered").alias("lettered"))
    marks = seen.where(mark).groupBy("key", "value").agg(F.sum("d").alias("d")).groupBy("key").agg(F.sum("d").alias("_md"), F.count(F.lit(1)).alias("_mv"))
    rest = seen.groupBy("key").agg(
        F.bool_or(F.col("sort") == "strong").alias("_strong"), F.count_if(F.col("sort") == "plain").alias("_plain"), F.bool_or(F.col("sort") == "left").alias("_a"), F.bool_or(F.col("sort") == "right").alias("_b"),
    )
    slots = rest.join(marks, "key", "left").select("key", "_strong", "_plain", (F.col("_a") & F.col("_b")).alias("_reads_on"), F.coalesce((F.col("_md") >= least_docs) & (F.col("_mv") >= 2), F.lit(False)).alias("_marked"))
    strong = seen.where("sort = 'strong'")
    names = strong.groupBy("value").agg(F.sum("d").alias("_nd"), F.count(F.lit(1)).alias("_nk")).select("value", ((F.col("_nd") >= least_docs) & (F.col("_nk") >= 2)).alias("_named"))
    own = strong.select("key", "value", F.lit(True).alias("_own"))

    judged = hits.withColumn("_name", F.when(F.col("sort") == "plain", _bare(F.col("value"))).otherwise(F.col("value")))
    judged = judged.join(bounded(slots), "key", "left").join(bounded(names.withColumnRenamed("value", "_name")), "_name", "left").join(bounded(own.withColumnRenamed("value", "_name")), ["key", "_name"], "left")
    named, filled, known = F.coalesce("_named", F.lit(False)), F.col("_plain") >= least_fillers, F.col("_strong") | (F.col("_plain") >= least_fillers)
    hit = (
        F.when(F.col("sort") == "strong", F.col("_marked") | named | (F.col("_plain") >= 2)).when(F.col("sort") == "weak", named | (F.col("_strong") & F.col("_marked")))
        .when(~F.col("lettered"), False).when(F.col("sort") == "void", F.col("_marked") | filled).when(F.col("sort") == "empty", F.col("_marked")).when(F.col("sort") == "rule", known)
        .when(F.col("sort") == "gap", known & ~F.col("_reads_on")).when(F.col("sort") == "plain", F.coalesce("_own", F.lit(False)))
        .when(F.col("sort") == "none", F.col("_marked") & ~F.col("_reads_on") & (F.size(F.filter(F.split("key", "\u0003"), lambda x: x != "")) >= 3))
    )
    return judged.where(hit).select("id").distinct()


def page_kinds(units: DataFrame, least_docs: int = 3, share: float = 0.3, least_pages: int = 5) -> DataFrame:
    """id, kind (``error`` or ``script``) of the documents (id, units) that are error pages or script notices, of any length.

    least_docs and share: how many of a unit's documents, at least, must show furniture or a unit that says so for the unit to
    belong to whole-page templates; least_pages: how often a whole page headed by a status code must come back.
    """
    furniture = lambda u: F.lower(u).rlike(FURNITURE)
    mask = lambda u: F.regexp_replace(F.lower(u), r"(?<![0-9a-z])[a-z]*+\d[0-9a-z]*+", "9")
    # No pattern is tried where none of the words stands that it needs.
    says_script = lambda u: F.contains(F.lower(u), F.lit("script")) & F.lower(u).rlike(SCRIPT)
    says_error = lambda u: reduce(or_, (F.contains(F.lower(u), F.lit(w)) for w in ERROR_NEEDS)) & F.lower(u).rlike(ERROR)
    plain = F.transform("units", lambda u: F.regexp_replace(u, rf"[{_OPEN}{_CLOSE}{_ON}{_GAP}]|^#{{1,6}}\s+", ""))
    work = _once(units, ["id"], _u=F.filter(plain, lambda u: u.rlike(r"[\p{L}\p{N}]"))).where(F.size("_u") > 0)
    # What each unit is, in one array for each document, with masked units as hashes.
    each = F.transform("_u", lambda u: F.struct(F.xxhash64(mask(u)).alias("m"), furniture(u).alias("f"), says_script(u).alias("s"), says_error(u).alias("e")))
    work = _once(work, ["id"], _a=each, _code=F.get("_u", F.lit(0)).rlike(r"^\W*444(?:\W|$)"))
    goes = lambda x: x["f"] | x["s"] | x["e"]
    work = cut(work.withColumn("_goes", F.exists("_a", goes)))
    core = work.select("_goes", F.explode(F.array_distinct(F.transform(F.filter("_a", lambda x: ~goes(x)), lambda x: x["m"]))).alias("m"))
    templates = core.groupBy("m").agg(F.count(F.lit(1)).alias("_c"), F.count_if("_goes").alias("_g")).where((F.col("_g") >= least_docs) & (F.col("_g") >= share * F.col("_c")))
    templates = bounded(templates.select("m", F.lit(True).alias("_page")))
    holds = F.col("f") | F.col("s") | F.col("e") | F.coalesce("_page", F.lit(False))
    # All units must hold, so the first one spares most documents the rest.
    begun = work.select("id", "_a", F.get("_a", F.lit(0)).alias("_x")).select("id", "_a", "_x.*").join(templates, "m", "left").where(holds).select("id", "_a")
    asked = begun.select("id", F.inline("_a")).join(templates, "m", "left")
    judged = asked.groupBy("id").agg((F.bool_and(holds) & F.bool_or(~F.col("f"))).alias("_all"), F.bool_or(F.col("s") & ~F.col("f")).alias("_script"))
    known = judged.where("_all").select("id", F.when(F.col("_script"), "script").otherwise("error").alias("kind"))
    headed = work.where("_code").select("id", F.xxhash64(F.transform("_a", lambda x: x["m"])).alias("_whole"))
    again = headed.groupBy("_whole").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_pages)
    return known.unionByName(headed.join(again, "_whole", "left_semi").select("id", F.lit("error").alias("kind")))


def _once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """df with columns that are computed once: filters on them stay above, as they come out of a generator."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def filler_docs(units: DataFrame, share: float = 0.8) -> DataFrame:
    """id of the documents (id, units) that are stand-in text beneath their title and front matter."""
    end = F.array_position(F.slice("units", F.lit(2), F.greatest(F.size("units") - 1, F.lit(0))), "---")
    body = F.when((F.get("units", F.lit(0)) == "---") & (end > 0), F.slice("units", end.cast("int") + 2, F.size("units"))).otherwise(F.col("units"))
    body = F.lower(F.array_join(F.filter(body, lambda u: ~u.rlike(r"^#{1,6}\s")), " "))
    work = _once(units, ["id"], _b=F.regexp_replace(body, rf"[{_OPEN}{_CLOSE}{_ON}{_GAP}]", " "))
    work = _once(work, ["id", "_b"], _w=F.regexp_extract_all("_b", F.lit(r"([\p{L}]+)"), F.lit(1))).where(F.size("_w") > 0)
    n, w = F.size("_w"), lambda i: F.get("_w", i)

    def known(vocabulary: list[str]) -> Column:
        has = lambda x: F.array_contains(F.array(*[F.lit(v) for v in vocabulary]), x)
        # Of so many first words one is in the vocabulary if the share is reached, which spares most texts the full count.
        begins = F.exists(F.slice("_w", F.lit(1), F.floor(n * (1 - share)).cast("int") + 1), has)
        return begins & (F.size(F.filter("_w", has)) >= share * n)

    phrases = "|".join(sorted(PHRASES, key=len, reverse=True))
    begins = F.col("_b").rlike(rf"^[\s.!?,;:…*_-]*+(?:{phrases})(?![\p{{L}}\p{{N}}])")
    only = begins & (F.regexp_replace("_b", rf"(?<![\p{{L}}\p{{N}}])(?:{phrases})(?![\p{{L}}\p{{N}}])|[\s.!?,;:…*_-]+", "") == "")
    # A text that is one phrase over and over, whatever it says, three times or more (a word five times); single words are
    # compared first, which leaves few places for the whole. And the same phrases standing alone.
    again = lambda p: (w(p) == w(0)) & (w(p + 1) == w(1)) & (w(n - 1) == w(n - 1 - p)) & (w(2 * p) == w(0)) & (F.slice("_w", F.lit(1), n - p) == F.slice("_w", p + 1, n - p))
    least = F.aggregate(F.sequence(F.lit(1), F.greatest((n / 3).cast("int"), F.lit(1))), F.lit(None).cast("int"), lambda at, p: F.when(at.isNotNull(), at).when(again(p), p))
    period = F.when(n >= 5, least)
    work = _once(work, ["id", "_w"], _p=period, _vocab=(known(LATIN) & (n >= 4)) | (known(PLAY) & (n >= 3)) | only)
    joined = lambda k: F.array_join(F.slice("_w", F.lit(1), k), " ")
    half = F.greatest(F.lit(1), (n / 2).cast("int"))
    twice = (n % 2 == 0) & (F.slice("_w", F.lit(1), half) == F.slice("_w", half + 1, half))
    sure = F.col("_vocab") | F.col("_p").isNotNull()
    alone = F.when(~sure, F.when(twice, F.array(F.xxhash64(joined(n)), F.xxhash64(joined(half)))).otherwise(F.array(F.xxhash64(joined(n)))))
    # Several steps read this, so it is written once: the texts stay behind, phrases as hashes.
    work = cut(work.select("id", sure.alias("_sure"), F.when(F.col("_p").isNotNull(), F.xxhash64(joined(F.col("_p")))).alias("_ph"), alone.alias("_alone")))
    learnt = work.where("_ph is not null").groupBy("_ph").agg(F.count_distinct("id").alias("_d")).where("_d >= 2").select("_ph")
    same = work.select("id", F.explode("_alone").alias("_ph")).join(bounded(learnt), "_ph", "left_semi")
    return work.where("_sure").select("id").unionByName(same.select("id")).distinct()


def found_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, kind): one row per document by what stands there instead of content."""
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null").where(F.col("text").rlike(r"[^\s\p{Z}]"))
    units = cut(text_units(docs))
    rank = F.when(F.col("kind") == "script", 1).when(F.col("kind") == "error", 2).when(F.col("kind") == "filler", 3).otherwise(4)
    every = page_kinds(units).unionByName(filler_docs(units).withColumn("kind", F.lit("filler"))).unionByName(residue_slots(units).withColumn("kind", F.lit("placeholder")))
    best = every.groupBy("id").agg(F.min(F.struct(rank.alias("r"), "kind")).alias("_k"))
    return best.select(F.col("id").alias("doc_id"), F.col("_k.kind").alias("kind"))
