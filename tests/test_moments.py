import datetime as dt

from marginalia.operators.moments import found_moments, with_moment

V = "vault_key string, home_zone string, date_order string"


def micros(spark, *rows):
    """Moments of (text, zone, order) rows; of a text alone under Europe/Berlin and dmy."""
    full = [(i, *(r if isinstance(r, tuple) else (r, "Europe/Berlin", "dmy"))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "i int, v string, z string, o string")
    return [r["out"] for r in with_moment(df, "v", "z", "o", "out").orderBy("i").collect()]


def utc(text):
    return int(dt.datetime.fromisoformat(text + "+00:00").timestamp()) * 1_000_000


def test_formats(spark):
    cases = [
        ("2023-11-02T05:04:51Z", "2023-11-02T05:04:51"), ("2024-07-01", "2024-06-30T22:00:00"), ("[[2024-01-01]]", "2023-12-31T23:00:00"), (' "2024-01-01 10:00"\n', "2024-01-01T09:00:00"),
        ("12/05/2016 17:55", "2016-05-12T15:55:00"), ("05 Feb 2016 04:58:07 CET", "2016-02-05T03:58:07"), ("1491805312", "2017-04-10T06:21:52"), ("2016-229", "2016-08-15T22:00:00"),
        ("2018-W10-7", "2018-03-10T23:00:00"), ("2020-W53-5", "2020-12-31T23:00:00"), ("2025-09-06 12:06am", "2025-09-05T22:06:00"), ("2019-02-27T08:33[Australia/Sydney]", "2019-02-26T21:33:00"),
        ("Sun, 22 Jul 2018 06:39:05 +0900", "2018-07-21T21:39:05"), ("24.9.2023, 14:08 Uhr", "2023-09-24T12:08:00"), ("September 12, 2018 7:30 PM", "2018-09-12T17:30:00"),
        ("Sun 12 Apr 2020, 3h29", "2020-04-12T01:29:00"), ("20240404T001113Z", "2024-04-04T00:11:13"), ("2022-03-13 01:57:18 -08:00", "2022-03-13T09:57:18"),
    ]
    got = micros(spark, *[text for text, _ in cases])
    assert {t: g for (t, _), g in zip(cases, got)} == {t: utc(w) for t, w in cases}


def test_fractions_are_cut(spark):
    got = micros(spark, "2021-10-02T05:38:10.798232956Z", "2021-10-02T05:38:10,5Z", "1608910477259726999")
    assert got == [utc("2021-10-02T05:38:10") + 798_232, utc("2021-10-02T05:38:10") + 500_000, 1608910477259726]


def test_ambiguous_and_skipped_local_times(spark):
    # The first of two; moved forward by the gap; a gap of half an hour.
    got = micros(spark, "2023-10-29 02:30", "2023-03-26 02:30", ("2021-10-03 02:10", "Australia/Lord_Howe", "dmy"))
    assert got == [utc("2023-10-29T00:30:00"), utc("2023-03-26T01:30:00"), utc("2021-10-02T15:40:00")]


def test_no_moment(spark):
    none = (None, "", "  ", "yesterday", "2023-02-30", "2021-02-29", "2019-366", "2021-W53-1", "25:61", "2024-13-05", "2024-01-01 24:00", "13:00 PM", "2024-01-01 13:00pm", "{{date}}", "Q2 2023", "x" * 100_000, "2024-01-01T10:00[No/Where]")
    got = micros(spark, *none, ("2024-01-01", None, "dmy"), ("01/02/2024", "UTC", None), ("2024-01-01T00:00Z", None, None))
    assert got == [None] * (len(none) + 2) + [utc("2024-01-01T00:00:00")]


def test_found_once_with_clashing_and_extra_columns(spark):
    vaults = spark.createDataFrame([("v", "UTC", "mdy"), ("v", "UTC", "mdy"), (None, "UTC", "dmy")], V)
    rows = spark.createDataFrame([(1, "v", "01/02/2024", "x"), (1, "v", "01/02/2024", "x"), (2, "w", "2024-01-01", "x"), (None, "v", "2024-01-01", "x"), (3, None, "2024-01-01T00:00Z", None)], "id long, vault_key string, t string, home_zone string")
    got = found_moments([("a", rows, "id", "t")], vaults).collect()
    assert sorted((r["row_id"], r["utc_us"]) for r in got) == [(1, utc("2024-01-02T00:00:00")), (3, utc("2024-01-01T00:00:00"))]
    assert found_moments([("a", rows.limit(0), "id", "t")], vaults.limit(0)).count() == 0
