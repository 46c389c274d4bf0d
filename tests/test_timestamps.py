"""Mixed timestamp forms, against Python's zoneinfo."""

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from sightline.functions.instants import utc_text, with_instant
from sightline.operators.timestamps import InstantDictionary
from sightline.session import work_path

STAMPS = [
    ("2026-01-08T11:51:32Z", None, "2026-01-08 11:51:32.000"),
    ("2026-01-08 16:08:03", "America/Chicago", "2026-01-08 22:08:03.000"),
    ("2026-10-25T02:25:29.747", "Europe/Berlin", "2026-10-25 00:25:29.747"),  # occurs twice: the earlier
    ("2026-03-29 02:30:00", "Europe/Berlin", "2026-03-29 01:30:00.000"),  # skipped: moved on
    ("2026-01-08T09:00:00+05:30", "Europe/Berlin", "2026-01-08 03:30:00.000"),
    ("09/Jan/2026:21:43:23 +0530", None, "2026-01-09 16:13:23.000"),
    ("Fri, 09 Jan 2026 21:28:08 GMT", "Asia/Tokyo", "2026-01-09 21:28:08.000"),
    ("20260109T021816Z", None, "2026-01-09 02:18:16.000"),
    ("16.01.2026 02:59", "Asia/Tokyo", "2026-01-15 17:59:00.000"),
    ("2026-01-12 13:16:26.636861+1100", None, "2026-01-12 02:16:26.636"),
    ("1767864504620", None, "2026-01-08 09:28:24.620"),
    ("1767864504", None, "2026-01-08 09:28:24.000"),
    ("1768345889.108", None, "2026-01-13 23:11:29.108"),
    ("  2026-01-08T11:51:32Z ", None, "2026-01-08 11:51:32.000"),
    ("2024-02-29T00:00:00Z", None, "2024-02-29 00:00:00.000"),
]
NONE = [("2026-01-08 16:08:03", None), ("2026-01-08 16:08:03", "Mars/Base"), ("0000-00-00 00:00:00", "UTC"), ("2026-02-30 10:00:00", "UTC"), ("2026-01-08 24:00:00", "UTC"), ("yesterday 10:15", "UTC"), ("", "UTC"), ("-", "UTC"), (None, "UTC"), ("x" * 50_000, "UTC"), ("9" * 400, None)]
DAYS = [
    ("2026-08-13", "de-DE", "2026-08-13"), ("03/04/2026", "en-US", "2026-03-04"), ("03/04/2026", "en-GB", "2026-04-03"), ("24.8.2026", "tr-TR", "2026-08-24"), ("20260323", "x", "2026-03-23"), ("46023", "x", "2026-01-01"),
    ("Mar 21, 2026", "x", "2026-03-21"), ("26 Oct 2026", None, "2026-10-26"), ("21-Mar-2026", "x", "2026-03-21"), ("2026/08/17", "en-US", "2026-08-17"), ("1774742400", "x", "2026-03-29"), ("2026-07-18T00:00:00Z", "x", "2026-07-18"),
    ("31/02/2026", "fr-FR", None), ("13/25/2026", "en-US", None), ("Week 12", "tr-TR", None), ("", "x", None), (None, None, None), ("n/a", "x", None),
]


def test_stamps(spark):
    df = spark.createDataFrame([(i, r, z) for i, (r, z, _) in enumerate(STAMPS)] + [(100 + i, r, z) for i, (r, z) in enumerate(NONE)], "i INT, r STRING, z STRING")
    got = {x.i: x.ms for x in with_instant(df, "r", "ms", zone="z").collect()}
    for i, (_, _, want) in enumerate(STAMPS):
        assert got[i] == int(datetime.fromisoformat(want).replace(tzinfo=timezone.utc).timestamp() * 1000 + 0.5), STAMPS[i]
    assert all(got[100 + i] is None for i in range(len(NONE)))


def test_days(spark):
    df = spark.createDataFrame([(i, r, z) for i, (r, z, _) in enumerate(DAYS)], "i INT, r STRING, z STRING")
    got = {x.i: x.t for x in with_instant(df, "r", "ms", locale="z", day_column=True).select("i", F.substring(utc_text(F.col("ms")), 1, 10).alias("t")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(DAYS)}


@pytest.mark.parametrize("zone", ["Europe/Lisbon", "America/Sao_Paulo", "Australia/Sydney", "Asia/Kolkata"])
def test_zones_through_a_year(spark, zone):
    times = [datetime(2026, 1, 1) + timedelta(hours=5.5 * k) for k in range(1600)]
    df = spark.createDataFrame([(k, t.strftime("%Y/%m/%d %H:%M:%S"), zone) for k, t in enumerate(times)], "i INT, r STRING, z STRING")
    got = {x.i: x.ms for x in with_instant(df, "r", "ms", zone="z").collect()}
    for k, t in enumerate(times):
        # fold 0 is the earlier of two instants, and in a gap the offset from before it, which moves the time on
        assert got[k] == int(t.replace(tzinfo=ZoneInfo(zone), fold=0).timestamp() * 1000)


def test_dictionary_is_incremental_and_keeps_rows(spark):
    d = InstantDictionary(spark, work_path(spark, "test-dictionary"), day_sources=("day",))
    rows = spark.createDataFrame([("t", "2026-01-08T11:51:32Z", None, 1, 7), ("t", "2026-01-08T11:51:32Z", None, 2, 7), ("t", None, "UTC", 3, 7), ("day", "03/04/2026", "en-US", 4, 7)], "source STRING, raw STRING, context STRING, k INT, utc_ms INT")
    got = {r.k: r.utc_ms for r in d.normalize(rows).collect()}
    assert got[1] == got[2] == 1767873092000 and got[3] is None and got[4] == 1772582400000
    assert d.entries().count() == 2
    d.update(rows.limit(0))
    d.update(spark.createDataFrame([("t", "?", "UTC"), ("t", "2026-01-08T11:51:32Z", None)], "source STRING, raw STRING, context STRING"))
    assert d.entries().count() == 3


def test_found_covers_every_unusual_value(spark, data):
    from sightline.plans.problems import p5_found

    rows = p5_found(spark, data).collect()
    assert len({(r.table_name, r.row_key) for r in rows}) == len(rows)
    raw = {r.request_id: r.logged_at for r in spark.read.parquet(f"{data}/crawler_requests.parquet").collect()}
    assert all(not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", raw[r.row_key]) for r in rows if r.table_name == "crawler_requests")
