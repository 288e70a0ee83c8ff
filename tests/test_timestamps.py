"""Mixed timestamps, against Python's own zone arithmetic."""

import datetime as dt
import zoneinfo

import pytest
from pyspark.sql import functions as F

from lodestone.functions.timestamps import read_moment
from lodestone.operators.zones import estimate_zones, normalise_timestamps

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


def micros(*parts, zone="UTC"):
    """By stepping through UTC: the first instant whose wall clock is the given time."""
    wall = dt.datetime(*parts)
    z = zoneinfo.ZoneInfo(zone)
    instant = wall.replace(tzinfo=z, fold=0)
    return int((instant - EPOCH) / dt.timedelta(microseconds=1))


CASES = [
    ("2025-03-08T10:20:30.123456789Z", None, micros(2025, 3, 8, 10, 20, 30, 123456)),
    ("1740872976.682", "desk", 1740872976682000),
    ("1741506597147", "desk", 1741506597147000),
    ("1776306425470002", "desk", 1776306425470002),
    ("20250922", "desk", micros(2025, 9, 22, zone="Europe/Berlin")),
    ("2025-10-26 02:30:00", "desk", micros(2025, 10, 26, 2, 30, zone="Europe/Berlin")),
    ("2025-03-30 02:30:00", "desk", micros(2025, 3, 30, 1, 30)),
    ("03/08/2026 3:00 AM", "east", micros(2026, 3, 8, 3, zone="America/New_York")),
    ("3/9/2026 03:53", "desk", micros(2026, 9, 3, 3, 53, zone="Europe/Berlin")),
    ("２０２５-０５-２５ １８:３７:２７Z", None, micros(2025, 5, 25, 18, 37, 27)),
    ("Tue, 25 Mar 2025 16:07:43 +0100", None, micros(2025, 3, 25, 15, 7, 43)),
    ("18. August 2025, 20:47 Uhr", None, micros(2025, 8, 18, 20, 47)),
    ("2025年2月26日 下午6:06", None, micros(2025, 2, 26, 18, 6)),
    ("2026年1月23日 上午12:40", None, micros(2026, 1, 23, 0, 40)),
    ("Jan 21, 2026 2:36 AM EST", "desk", micros(2026, 1, 21, 7, 36)),
    ("2025-10-29 05:29:13 America/Los_Angeles", "desk", micros(2025, 10, 29, 5, 29, 13, zone="America/Los_Angeles")),
    ("2026-01-20T03:26:57+11:00[Australia/Sydney]", None, micros(2026, 1, 19, 16, 26, 57)),
    ("2025-012T17:49:04Z", None, micros(2025, 1, 12, 17, 49, 4)),
    ("2026-W03-5T17:56:33Z", None, micros(2026, 1, 16, 17, 56, 33)),
    ("  2026-04-04T15:44:46Z\t", None, micros(2026, 4, 4, 15, 44, 46)),
]
NO_MOMENT = ["2025", "2025-Q3", "", None, "--", "25:61", "2025-13-04T10:00:00Z", "2026-02-30 09:15", "2025-11-05T27:10:00Z", "0000-00-00 00:00:00", "next Tuesday", "昨天晚上", "2025-366T00:00:00Z", "2025-01-01T00:00:00+25:00", "2025-01-01 10:00 Mars/Base", "13:00 AM"]


def channels(spark):
    return spark.createDataFrame([("desk", "Europe/Berlin", "dmy"), ("east", "America/New_York", "mdy")], "channel string, zone_name string, date_order string")


def test_notations_and_zones(spark):
    rows = [(i, t, ch, None, "x", "y") for i, (t, ch, _) in enumerate(CASES)] + [(100 + i, t, None, None, "x", "y") for i, t in enumerate(NO_MOMENT)]
    df = spark.createDataFrame(rows, "id int, timestamp string, channel string, created_at timestamp, zone_source string, `a.b` string")
    out = {r["id"]: r["utc_micros"] for r in normalise_timestamps(df, channels(spark)).collect()}
    assert len(out) == len(rows)
    for i, (text, _, wanted) in enumerate(CASES):
        assert out[i] == wanted, text
    assert [t for i, t in enumerate(NO_MOMENT) if out[100 + i] is not None] == []


def test_repeated_rows_stay_and_empty_tables_work(spark):
    df = spark.createDataFrame([("2025-01-01T00:00:00Z", None, None)] * 3, "timestamp string, channel string, created_at timestamp")
    assert normalise_timestamps(df, channels(spark)).count() == 3
    assert normalise_timestamps(df.where("false"), channels(spark)).count() == 0
    assert normalise_timestamps(df, channels(spark).where("false")).count() == 3


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/Chicago", "Asia/Tehran", "Pacific/Chatham"])
def test_missing_zone_is_estimated(spark, zone):
    z = zoneinfo.ZoneInfo(zone)
    rows = []
    for day in range(0, 365, 5):
        made = EPOCH + dt.timedelta(days=20000 + day, hours=day % 24)
        rows.append((made.astimezone(z).strftime("%Y-%m-%d %H:%M:%S"), "mystery", made + dt.timedelta(minutes=3 + day % 20)))
    rows += [("2025-01-01 00:00:00", "mystery", made + dt.timedelta(days=90))] * 5  # captured late
    df = spark.createDataFrame(rows, "timestamp string, channel string, created_at timestamp")
    out = normalise_timestamps(df, channels(spark))
    late = out.where(F.unix_micros("created_at") - F.col("utc_micros") > 3_600_000_000).count()
    assert late == 5
    assert {r["zone_source"] for r in out.select("zone_source").distinct().collect()} == {"estimated"}


def test_a_channel_that_moves_has_two_zones(spark):
    rows = []
    for day in range(300):
        z = zoneinfo.ZoneInfo("Asia/Tokyo" if day < 150 else "America/Bogota")
        made = EPOCH + dt.timedelta(days=20000 + day, hours=8 + day % 3, minutes=day % 50)
        rows.append((made.astimezone(z).strftime("%Y-%m-%d %H:%M:%S"), "moving", made + dt.timedelta(minutes=2 + day % 9), int((made - EPOCH) / dt.timedelta(microseconds=1)) // 1_000_000 * 1_000_000))
    rows += [("2025-01-01 00:00:00", "moving", None, None), (None, "moving", None, None)]
    df = spark.createDataFrame(rows, "timestamp string, channel string, created_at timestamp, wanted long")
    out = normalise_timestamps(df, channels(spark))
    assert out.count() == 302 and out.where("wanted is not null and utc_micros <=> wanted").count() == 300
    walls = df.where("wanted is not null").select("channel", F.expr("unix_micros(cast(timestamp as timestamp)) as wall_micros"), F.unix_micros("created_at").alias("ingest_micros"))
    found = estimate_zones(walls).orderBy(F.col("from_day").asc_nulls_first()).collect()
    assert [(r["from_day"], r["to_day"], r["violations"]) for r in found] == [(None, 20150, 0), (20150, None, 0)] and found[0]["estimated_zone"] == "Asia/Tokyo"
    noise = walls.withColumn("wall_micros", F.col("ingest_micros") + F.expr("pmod(xxhash64(ingest_micros), 4000) * 86400000000L"))
    assert [r["estimated_zone"] for r in estimate_zones(noise).collect()] == [None]


def test_estimate_of_nothing(spark):
    empty = spark.createDataFrame([], "channel string, wall_micros long, ingest_micros long")
    assert estimate_zones(empty).count() == 0


def test_unknown_text_never_raises():
    for text in ["\x00", "9" * 400, "1" * 19, "2025-01-01T00:00:00." + "9" * 300, "²⁰²⁵-01-01", "01/02/0000", "9999-12-31 23:59:59"]:
        read_moment(text, "dmy")
