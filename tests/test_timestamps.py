from datetime import UTC, datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filequarry.operators import timestamps as ts

SCHEMA = "raw string, tz string"
CASES = [
    ("2022-01-23T05:46:42.000+02:00", "UTC", "2022-01-23 03:46:42"),
    ("Sun, 30 Oct 2016 01:47:02 GMT", "Asia/Kolkata", "2016-10-30 01:47:02"),
    ("20130219T232315Z", "Europe/Berlin", "2013-02-19 23:23:15"),
    ("1572136820994", "Europe/Berlin", "2019-10-27 00:40:20.994000"),
    ("1378833600000000", "Europe/Berlin", "2013-09-10 17:20:00"),
    ("1332639840.000", "Europe/Berlin", "2012-03-25 01:44:00"),
    ("1640222323", None, "2021-12-23 01:18:43"),
    ("2016-05-23T05:49:00", "Europe/Berlin", "2016-05-23 03:49:00"),
    ("2018-07-06t20:52:03z", "Europe/Berlin", "2018-07-06 20:52:03"),
    ("12.03.2020 01:33:32", "America/New_York", "2020-03-12 05:33:32"),
    ("D:20200325063300+00'00'", "Europe/Berlin", "2020-03-25 06:33:00"),
    ("D:20190702101319-04'00'", "Europe/Berlin", "2019-07-02 14:13:19"),
    ("2018-03-25 03:50:44,000", "Europe/Berlin", "2018-03-25 01:50:44"),
    ("20220209004531", "UTC", "2022-02-09 00:45:31"),
    ("2015:01:22 22:51:33", "Australia/Sydney", "2015-01-22 11:51:33"),
    ("2022-01-21 08:50+01:00", "UTC", "2022-01-21 07:50:00"),
    ("Sun Oct 27 02:30:43 2019", "Europe/Berlin", "2019-10-27 00:30:43"),  # twice on that day: the first
    ("25.3.2012, 03:58 Uhr", "Europe/Berlin", "2012-03-25 01:58:00"),
    ("2015-07-03T13:48:16+02:00[Europe/Berlin]", "UTC", "2015-07-03 11:48:16"),
    ("2015-01-22 22:51:33 Europe/Berlin", "UTC", "2015-01-22 21:51:33"),
    ("09/16/2018 03:12:51 AM", "UTC", "2018-09-16 03:12:51"),
    ("4/14/15 5:00 pm", "UTC", "2015-04-14 17:00:00"),
    ("1/14/14 12:40 am", "UTC", "2014-01-14 00:40:00"),
    ("Wed Jul 22 05:08:34 CEST 2015", "UTC", "2015-07-22 03:08:34"),
    ("Sun Mar 08 04:16:31 EDT 2015", "UTC", "2015-03-08 08:16:31"),
    ("27. März 2016 00:44:24", "UTC", "2016-03-27 00:44:24"),
    ("Sat, 02 Mar 2013 20:21:16 +0100", "UTC", "2013-03-02 19:21:16"),
    ("2012-04-08T14:01:29.000-03:30", "UTC", "2012-04-08 17:31:29"),
    ("2020-02-29", "UTC", "2020-02-29 00:00:00"),
    ("2019-02-29", "UTC", None),
    ("2021-03-28 02:30:00", "Europe/Berlin", None),  # left out by the change of clocks
    ("31.02.2021 10:00:00", "UTC", None),
    ("2021-13-45T00:00:00", "UTC", None),
    ("0000-00-00 00:00:00", "UTC", None),
    ("2021-01-01 25:00:00", "UTC", None),
    ("13/40/20 1:00 pm", "UTC", None),
    ("4/14/15 13:00 pm", "UTC", None),
    ("D:", "UTC", None), ("", "UTC", None), ("n/a", "UTC", None), (None, "UTC", None), ("|" * 11, "UTC", None),
    ("2021-01-01 10:00:00", None, None), ("2021-01-01 10:00:00", "Nowhere/Town", None), ("x" * 100_000, "UTC", None),
]


def _micros(text):
    if text is None:
        return None
    return (datetime.fromisoformat(text) - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def test_formats(spark):
    df = spark.createDataFrame([(r, z) for r, z, _ in CASES], SCHEMA)
    got = {(r["raw"], r["tz"]): r["instant_us"] for r in ts.with_instant(df, "raw", "tz").collect()}
    assert got == {(r, z): _micros(want) for r, z, want in CASES}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.datetimes(datetime(1, 1, 2), datetime(9999, 12, 30)), min_size=20, max_size=60))
def test_day_arithmetic_is_the_calendar_s(spark, moments):
    df = spark.createDataFrame([(m.isoformat(timespec="microseconds"), "UTC") for m in moments], SCHEMA)
    got = [r["instant_us"] for r in ts.with_instant(df, "raw", "tz").collect()]
    assert got == [(m - datetime(1970, 1, 1)) // timedelta(microseconds=1) for m in moments]


def test_pairs(spark):
    schema = "rec_id bigint, device_id bigint, pool string, path string, fdate string, sort_date string, meta_data string, instant_us string, _tz string"
    rows = [
        (1, 1, "a", "p", "2020-01-01T11:00:00Z", None, '{"dcterms:created": 1577880000000}', "x", "y"),
        (2, 1, "a", "p", "2020-01-01 12:00:00", None, '{"dcterms:created": ["2020-01-01T12:00:00Z"]}', "x", "y"),
        (2, 1, "a", "p", "2020-01-01 12:00:00", None, None, "x", "y"),  # repeated row
        (3, 1, "a", "p", "2020-01-01T11:00:00Z", "n/a", "[]", "x", "y"),
        (4, 2, "a", "p", "2020-01-01T11:00:00+00:00", None, "no json", "x", "y"),
        (5, 1, None, None, "2020-01-01T11:00:00+00:00", None, None, "x", "y"),
    ]
    pools = spark.createDataFrame([("a", "Europe/Berlin"), (None, "UTC")], "pool string, tz string")
    got = {tuple(r) for r in ts.same_instant_pairs(spark.createDataFrame(rows, schema), pools).collect()}
    assert got == {("fdate", 1, 2), ("fdate", 2, 3), ("meta_data", 1, 2)}
    assert ts.same_instant_pairs(spark.createDataFrame([], schema), pools).count() == 0


def test_instants_are_aware():
    assert datetime.fromtimestamp(0, UTC).year == 1970


def test_copies_of_an_unchanged_file_do_not_meet(spark):
    """30,000 sightings that write one instant one way and one that writes it another: as many pairs, and no more rows joined."""
    n = 30_000
    rows = spark.range(n + 1).select(
        F.col("id").alias("rec_id"), F.lit(1).cast("bigint").alias("device_id"), F.lit("p").alias("path"), F.lit("a").alias("pool"), F.lit(None).cast("string").alias("meta_data"),
        F.when(F.col("id") == 77, "2024-05-01T12:00:00+00:00").otherwise("2024-05-01T12:00:00Z").alias("fdate"), F.lit(None).cast("string").alias("sort_date"),
    )
    pools = spark.createDataFrame([("a", "UTC")], "pool string, tz string")
    got = ts.same_instant_pairs(rows, pools)
    assert got.count() == n and got.where("rec_a = 77 or rec_b = 77").count() == n and got.where("rec_a >= rec_b").count() == 0
