"""Free-form moments brought to microseconds since the epoch.

An ordered cascade of anchored patterns rewrites each accepted value to one delimited line of parts
(``kind|year|month|...``); a value that no pattern accepts stays out. The parts are then assembled with strict
range checks. Everything is a built-in expression, so the whole operator stays in the JVM.

Policies
--------
* A zone in the value counts (offset, ``Z``, a known abbreviation, a bracketed or trailing IANA name); otherwise
  the record's default zone; without one the value has no moment.
* A local time that occurs twice means the first, one that is skipped moves forward by the gap (the rule of
  ``java.time`` for building an instant, which ``make_timestamp`` applies).
* Digits beyond microseconds are cut off. Missing parts are zero.
* ``a/b/yyyy`` follows the record's date order (``dmy`` or ``mdy``); a null order gives no moment. Dots are day first.
* Impossible dates, hours of 24 and more, and words give no moment. Null or empty values give no row.
* A weekday name is not checked against its date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import bounded

# English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Minutes east of UTC of common zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570,
    "ACDT": 630, "AEST": 600, "AEDT": 660, "LHST": 630, "LHDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180,
    "NST": -210, "NDT": -150, "BRT": -180, "ART": -180,
}

_FRACTION = r"(?:[.,](\d{1,12}))?"
_ZONE = r"(?:\s*(Z|z|[+\-−]\d{1,2}:?\d{2}|[+\-−]\d{2}|[A-Z]{2,5}|\[[A-Za-z0-9_+\-/]+\]|[A-Z][A-Za-z_]+/[A-Za-z0-9_+\-/]+))?"
_CLOCK = rf"(\d{{1,2}})[:h](\d{{2}})(?::(\d{{2}}){_FRACTION})?(?:\s*([AaPp])\.?[Mm]\.?)?(?:\s*(?:Uhr|uhr))?{_ZONE}"
_LATER = rf"(?:(?:[Tt]|[ ,]\s*|\s+at\s+){_CLOCK})?"
_DAYNAME = r"(?:[A-Za-z]{2,9}\.?,?\s+)?"
_MON = r"([A-Za-z]{3,9})\.?"

#: kind, anchored pattern, order of the groups as they go into y|mo|d|h|mi|s|fraction|am/pm|zone.
CASCADE: list[tuple[str, str, str]] = [
    ("iso", rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}}){_LATER}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("iso", rf"^(\d{{4}})(0[1-9]|1[0-2])([0-3]\d)(?:[Tt ]?([0-2]\d)([0-5]\d)(?:([0-5]\d){_FRACTION})?()?{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("ordinal", rf"^(\d{{4}})-()(\d{{3}}){_LATER}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("week", rf"^(\d{{4}})-?[Ww](\d{{2}})-?([1-7]){_LATER}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("slashed", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_LATER}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("iso", rf"^(\d{{1,2}})\.\s?(\d{{1,2}})\.\s?(\d{{4}}){_LATER}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("named", rf"^{_DAYNAME}(\d{{1,2}})(?:st|nd|rd|th)?[ -]{_MON}[ ,-]+(\d{{4}}){_LATER}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("named", rf"^{_DAYNAME}{_MON}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_LATER}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]
#: Digits of a plain count since the epoch, and its factor to microseconds (0: nanoseconds); 8, 12 and 14 digits may be dates above.
EPOCHS = ((r"^\d{9,10}(?:\.\d+)?$", 1_000_000), (r"^\d{12,13}$", 1_000), (r"^\d{16}$", 1), (r"^\d{19}$", 0))

_WRAP = r"^(?:[\s\p{Z}\"'“”‘’]|\[\[){1,60}+|(?:[\s\p{Z}\"'“”‘’]|\]\]){1,60}+$"
_FULL_MONTHS = "january february march april may june july august september october november december".split()


def _month_number(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(None).cast("int")
    for i, full in reversed(list(enumerate(_FULL_MONTHS, 1))):
        out = F.when(low.isin(full, full[:3], *(["sept"] if i == 9 else [])), F.lit(i)).otherwise(out)
    return out


def with_moment(df: DataFrame, value: str, zone: str, date_order: str, out: str) -> DataFrame:
    """df with the column out: microseconds since 1970-01-01 UTC of a free-form moment, null where it names none.

    value, zone and date_order name columns: the text, the default IANA zone of texts without one, and ``dmy`` or ``mdy``
    for slashed dates; all may be null. Empty and very long texts match no pattern. The work goes in steps, each over
    the columns of the one before, as one nested expression would repeat its inner parts. Helper columns start with
    ``_m_`` and are dropped again.
    """
    c = F.col
    text = c("_m_text")
    parts = F.lit(None).cast("string")
    for kind, pattern, order in reversed(CASCADE):
        parts = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, f"{kind}|{order}")).otherwise(parts)
    p = [F.get(c("_m_p"), i) for i in range(10)]
    num = lambda i: p[i].try_cast("int")
    df = df.withColumn("_m_text", F.regexp_replace(value, _WRAP, ""))
    df = df.withColumn("_m_p", F.split(parts, r"\|"))
    df = df.withColumns({"_m_kind": p[0], "_m_y": num(1), "_m_2": num(2), "_m_3": num(3), "_m_z": p[9]})

    kind = c("_m_kind")
    month = F.when(kind == "named", _month_number(p[2])).when((kind == "slashed") & (c(date_order) == "mdy"), c("_m_3")).when((kind == "slashed") & c(date_order).isNull(), F.lit(None).cast("int")).otherwise(c("_m_2"))
    day = F.when((kind == "slashed") & (c(date_order) == "mdy"), c("_m_2")).otherwise(c("_m_3"))
    midnight = lambda m, d: F.try_make_timestamp(c("_m_y"), F.lit(m), F.lit(d), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    day_of = lambda t: F.date_from_unix_date(F.floor(F.unix_micros(t) / F.lit(86_400_000_000)).cast("int"))
    half = F.lower(p[8])
    hour = (
        F.when(p[4] == "", F.lit(0))
        .when(half == "", F.when(num(4) < 24, num(4)))
        .when(num(4).between(1, 12), num(4) % 12 + F.when(half == "p", 12).otherwise(0))
    )
    shown = F.upper(F.regexp_replace(c("_m_z"), "−", "-"))
    digits = F.regexp_replace(shown, r"[^0-9]", "")
    df = df.withColumns({
        "_m_month": month, "_m_day": day, "_m_jan1": day_of(midnight(1, 1)), "_m_dec31": day_of(midnight(12, 31)), "_m_hour": hour,
        "_m_min": F.when(p[5] == "", F.lit(0)).otherwise(F.when(num(5) < 60, num(5))),
        "_m_sec": F.when(p[6] == "", F.lit(0)).otherwise(F.when(num(6) < 60, num(6))),
        "_m_micro": F.coalesce(F.rpad(F.substring(p[7], 1, 6), 6, "0").try_cast("bigint"), F.lit(0)),
        "_m_shown": shown, "_m_digits": F.when(F.length(digits) <= 2, F.concat(F.lpad(digits, 2, "0"), F.lit("00"))).otherwise(F.lpad(digits, 4, "0")),
    })

    # Ordinal and week dates: a day count from 1 January (from the Monday of ISO week 1), kept within its year.
    jan1, dec31 = c("_m_jan1"), c("_m_dec31")
    ordinal = F.when(c("_m_3").between(1, F.dayofyear(dec31)), F.date_add(jan1, c("_m_3") - 1))
    monday = F.date_add(jan1, 3 - F.weekday(F.date_add(jan1, 3)))
    weeks = F.weekofyear(F.date_add(dec31, -3))  # 28 December lies in the last ISO week
    week = F.when(c("_m_2").between(1, weeks), F.date_add(monday, (c("_m_2") - 1) * 7 + c("_m_3") - 1))
    df = df.withColumn("_m_date", F.when(kind == "ordinal", ordinal).when(kind == "week", week))
    counted = kind.isin("ordinal", "week")
    off_h, off_m = F.substring("_m_digits", 1, 2).try_cast("int"), F.substring("_m_digits", 3, 2).try_cast("int")
    known = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    offset = F.when(c("_m_shown").rlike(r"^[+-]"), F.when((off_h <= 18) & (off_m < 60), F.when(c("_m_shown").startswith("-"), -1).otherwise(1) * (off_h * 60 + off_m))).otherwise(
        F.try_element_at(known, F.regexp_replace("_m_shown", r"^\[|\]$", ""))
    )
    df = df.withColumns({
        "_m_yy": F.when(counted, F.year("_m_date")).otherwise(c("_m_y")), "_m_mm": F.when(counted, F.month("_m_date")).otherwise(c("_m_month")),
        "_m_dd": F.when(counted, F.dayofmonth("_m_date")).otherwise(c("_m_day")), "_m_off": offset,
    })
    # Without a zone shown the default holds, with an offset UTC, which the offset then corrects, else the zone named.
    tz = F.when(c("_m_z") == "", c(zone)).when(c("_m_off").isNotNull(), F.lit("UTC")).when(c("_m_z").contains("/"), F.regexp_replace("_m_z", r"^\[|\]$", ""))
    df = df.withColumn("_m_tz", tz)
    at = F.unix_micros(F.try_make_timestamp("_m_yy", "_m_mm", "_m_dd", "_m_hour", "_m_min", c("_m_sec").cast("decimal(8,6)"), "_m_tz"))
    result = at + c("_m_micro") - F.coalesce(c("_m_off"), F.lit(0)).cast("bigint") * F.when(c("_m_z") == "", 0).otherwise(60_000_000)
    whole = F.regexp_extract(text, r"^(\d+)", 1)
    for pattern, factor in EPOCHS:
        count = F.substring(whole, 1, 16).try_cast("bigint") if factor == 0 else whole.try_cast("bigint") * F.lit(factor)
        if factor == 1_000_000:
            count = count + F.coalesce(F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)$", 1), 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
        result = F.when(kind.isNull() & text.rlike(pattern), count).otherwise(result)
    df = df.withColumn(out, result.cast("bigint"))
    return df.drop(*[x for x in df.columns if x.startswith("_m_")])


def found_moments(sources: list[tuple[str, DataFrame, str, str]], vaults: DataFrame) -> DataFrame:
    """tbl, row_id, utc_us of every record whose field names a moment, each record once.

    sources lists (table name, rows, id column, value column); rows need vault_key for the lookup of the default zone and
    date order in vaults. An unknown vault has neither. Nulls, empty tables and extra columns are allowed: only the
    named columns are read. Of records that differ under one id the earliest moment stays.
    """
    lookup = bounded(vaults.where("vault_key is not null").groupBy(F.col("vault_key").alias("_vault")).agg(F.min("home_zone").alias("_zone"), F.min("date_order").alias("_order")))
    out = None
    for name, rows, key, value in sources:
        base = rows.select(F.lit(name).alias("tbl"), F.col("vault_key").alias("_v"), F.col(key).cast("bigint").alias("row_id"), F.col(value).alias("_text")).where("_text is not null and row_id is not null")
        out = base if out is None else out.unionByName(base)
    out = out.join(lookup, F.col("_v") == F.col("_vault"), "left")
    out = with_moment(out, "_text", "_zone", "_order", "utc_us")
    # The aggregate keeps the test for null above it; pushed below, it would compute every moment twice.
    return out.groupBy("tbl", "row_id").agg(F.min("utc_us").alias("utc_us")).where("utc_us is not null")
