"""Mixed timestamps to UTC, with missing zones estimated from ingestion times.

A channel whose zone isn't declared gets an *offset history*: zones of the database,
daylight saving included, one after another.  A local time after its own ingestion,
or long before it, violates a zone.  The history chosen has the fewest violations,
each change of zone counted as some of them.

The rows are counted once: by channel, day of ingestion, and the difference between
local and ingestion time in quarters of an hour, which tells for every zone whether
it fits.  What is compared with the zones is that table of counts, whose size depends
on channels and days, not on rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.timestamps import known_zones, parse_timestamp, wall_to_utc
from lodestone.session import cut

_MINUTE = 60_000_000
_QUARTER = 15 * _MINUTE
_DAY = 86_400_000_000
#: Days within which zones have histories (1970 to 2199).
_LAST_DAY = 84_005

#: Names for histories that several zones share, best known first; any other is named by the first zone in order.
PREFERRED = (
    "UTC", "Europe/London", "Europe/Berlin", "Europe/Helsinki", "Europe/Moscow", "Asia/Dubai", "Asia/Karachi", "Asia/Kolkata",
    "Asia/Kathmandu", "Asia/Dhaka", "Asia/Bangkok", "Asia/Shanghai", "Asia/Tokyo", "Australia/Adelaide", "Australia/Sydney",
    "Pacific/Auckland", "America/Sao_Paulo", "America/St_Johns", "America/Halifax", "America/New_York", "America/Chicago",
    "America/Denver", "America/Phoenix", "America/Los_Angeles", "America/Anchorage", "Pacific/Honolulu",
)


def distinct_histories(first_day: int, last_day: int, zones: Sequence[str] | None = None) -> list[tuple[str, int, int, int]]:
    """``(zone, from_day, to_day, quarters)``: the offsets, in quarters of an hour, of one zone for each history within the days.

    Days count from 1970 and are inclusive; an offset is that at noon UTC.
    """
    days = pd.to_datetime(np.arange(first_day, last_day + 1) * 24 + 12, unit="h", utc=True)
    named: dict[bytes, tuple[str, np.ndarray]] = {}
    order = {zone: n for n, zone in enumerate(PREFERRED)}
    for zone in sorted(zones or {*known_zones(), "UTC"}, key=lambda z: (order.get(z, len(order)), z)):
        local = days.tz_convert(zone).tz_localize(None) - days.tz_localize(None)
        quarters = np.floor_divide(local.total_seconds().to_numpy(), 900).astype(np.int64)
        named.setdefault(quarters.tobytes(), (zone, quarters))
    out = []
    for zone, quarters in named.values():
        starts = np.flatnonzero(np.concatenate(([True], quarters[1:] != quarters[:-1])))
        ends = np.concatenate((starts[1:] - 1, [len(quarters) - 1]))
        out += [(zone, first_day + int(a), first_day + int(b), int(quarters[a])) for a, b in zip(starts, ends, strict=True)]
    return out


def _counted(walls: DataFrame) -> DataFrame:
    """``channel, day, bin, n``: rows by day of ingestion and by how far the local time is ahead of it, in quarters rounded up."""
    rows = walls.where(F.col("channel").isNotNull() & F.col("wall_micros").isNotNull() & F.col("ingest_micros").isNotNull())
    day = F.floor(F.col("ingest_micros") / _DAY).cast("int")
    ahead = F.ceil((F.col("wall_micros") - F.col("ingest_micros")) / _QUARTER).cast("int")
    return rows.select("channel", day.alias("day"), ahead.alias("bin")).where(F.col("day").between(0, _LAST_DAY)).groupBy("channel", "day", "bin").agg(F.count(F.lit(1)).alias("n"))


def _daily_fit(walls: DataFrame, zones: Sequence[str] | None, max_delay_minutes: int) -> DataFrame:
    """``channel, day, zone, n, violations, delay_minutes`` for every history that differs from the others in the days at hand."""
    counted = cut(_counted(walls))
    span = counted.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    if span["a"] is None:
        return counted.select("channel", "day", F.lit(None).cast("string").alias("zone"), F.col("n"), F.col("n").alias("violations"), F.col("n").cast("double").alias("delay_minutes"))
    # A few runs of days for each of a few hundred zones.
    runs = counted.sparkSession.createDataFrame(distinct_histories(span["a"], span["b"], zones), "zone string, a int, b int, offset int")
    offsets = runs.select("zone", "offset", F.explode(F.sequence("a", "b")).alias("day"))
    met = counted.join(offsets, "day")
    fits = (F.col("bin") <= F.col("offset")) & (F.col("bin") > F.col("offset") - max_delay_minutes / 15)
    return met.groupBy("channel", "day", "zone").agg(
        F.sum("n").alias("n"), F.sum(F.when(fits, 0).otherwise(F.col("n"))).alias("violations"),
        F.sum(F.when(fits, F.col("n") * (F.col("offset") - F.col("bin")) * 15.0).otherwise(0.0)).alias("delay_minutes"),
    )


def zone_evidence(walls: DataFrame, candidates: Sequence[str] | None = None, max_delay_minutes: int = 60) -> DataFrame:
    """How well each zone fits each channel as a whole: ``channel, zone, rows, violations, delay_minutes``.

    ``walls`` has ``channel``, ``wall_micros`` and ``ingest_micros``; rows with a
    null in any of them are left out.  Without ``candidates`` all zones of the
    database are compared; of those that share their offsets on all days at hand one
    is named.  Delays are those of rows that don't violate, in quarters of an hour.
    """
    fit = _daily_fit(walls, candidates, max_delay_minutes)
    return fit.groupBy("channel", "zone").agg(F.sum("n").alias("rows"), F.sum("violations").alias("violations"), F.sum("delay_minutes").alias("delay_minutes"))


def _best_history(change_cost: float, most_violated: float):
    """For one channel (a row for each day and zone) the sequence of zones with the least cost."""

    def choose(fit: pd.DataFrame) -> pd.DataFrame:
        zones = np.array(sorted(fit["zone"].unique()))
        table = fit.pivot_table(index="day", columns="zone", values=["n", "violations", "delay_minutes"], aggfunc="sum")
        violated = table["violations"][zones].to_numpy()
        # Delays only decide between zones with as many violations.
        cost = violated + table["delay_minutes"][zones].to_numpy() / (60.0 * max(1.0, float(table["n"].to_numpy()[:, 0].sum())) * 1e3)
        days, rows = table.index.to_numpy(), table["n"].to_numpy()[:, 0]
        total, came_from = cost[0].copy(), np.zeros(cost.shape, dtype=np.int64)
        for day in range(1, len(days)):
            best = int(total.argmin())
            change = total[best] + change_cost < total
            came_from[day] = np.where(change, best, np.arange(len(zones)))
            total = np.where(change, total[best] + change_cost, total) + cost[day]
        path = np.empty(len(days), dtype=np.int64)
        path[-1] = int(total.argmin())
        for day in range(len(days) - 1, 0, -1):
            path[day - 1] = came_from[day][path[day]]
        starts = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
        out = []
        for n, start in enumerate(starts):
            end = starts[n + 1] if n + 1 < len(starts) else len(days)
            lost, seen = violated[np.arange(start, end), path[start]].sum(), rows[start:end].sum()
            zone = zones[path[start]] if lost <= most_violated * seen else None
            out.append((fit["channel"].iloc[0], zone, int(days[start]) if n else None, int(days[end]) if n + 1 < len(starts) else None, int(seen), int(lost)))
        return pd.DataFrame(out, columns=["channel", "estimated_zone", "from_day", "to_day", "rows", "violations"]).astype({"from_day": "Int32", "to_day": "Int32"})

    return choose


def estimate_zones(walls: DataFrame, candidates: Sequence[str] | None = None, max_delay_minutes: int = 60, change_cost: float = 10.0, most_violated: float = 0.5) -> DataFrame:
    """The best history of each channel: ``channel, estimated_zone, from_day, to_day, rows, violations``.

    One row for each stretch of days (from the first, up to but without the last;
    null where it is open), which together cover all days.  A change of zone costs as
    much as ``change_cost`` violations.  Where even the best zone violates more than
    ``most_violated`` of a stretch's rows the zone is null.
    """
    fit = _daily_fit(walls, candidates, max_delay_minutes)
    # A group has a row for each day and history of a channel, however many rows the channel has.
    return fit.groupBy("channel").applyInPandas(_best_history(change_cost, most_violated), "channel string, estimated_zone string, from_day int, to_day int, rows long, violations long")


def normalise_timestamps(
    rows: DataFrame,
    channels: DataFrame,
    text: str = "timestamp",
    channel: str = "channel",
    ingested: str = "created_at",
    candidates: Sequence[str] | None = None,
    most_broadcast: int = 100_000,
) -> DataFrame:
    """``rows`` with ``utc_micros`` (long) and ``zone_source`` added.

    ``channels`` (``channel, zone_name, date_order``) declares zones; where a
    channel has several rows the least zone holds.  Order of authority: epoch
    numbers, an offset or zone in the text, the declared zone, the estimated one.
    Rows without a channel, and channels with neither a declared nor an estimable
    zone, are read as UTC.  ``utc_micros`` is null where the text denotes no valid
    moment (null, empty, impossible dates or times, words).  All columns of
    ``rows`` are kept but an old ``utc_micros`` or ``zone_source``, which is
    replaced; no row is lost or repeated, and an empty input gives an empty result.

    The estimates are a few rows for each channel without a zone; they are counted, and
    broadcast up to ``most_broadcast`` rows, so that rows without a channel or with a
    hot one aren't shuffled.  Of ``channels`` Spark knows the size itself.
    """
    spark: SparkSession = rows.sparkSession
    zones = known_zones() + ["UTC"]
    declared = channels.where(F.col("channel").isNotNull()).groupBy(F.col("channel").alias("_channel")).agg(F.min(F.when(F.col("zone_name").isin(zones), F.col("zone_name"))).alias("_declared"), F.min("date_order").alias("_order"))
    base = rows.drop("utc_micros", "zone_source")
    read = base.withColumn("_channel", F.col(f"`{channel}`")).join(declared, "_channel", "left")

    # Rows of channels that declare no zone are parsed here once more, all others only below.
    open_rows = read.where(F.col("_declared").isNull() & F.col("_channel").isNotNull())
    if open_rows.isEmpty():
        estimated = spark.createDataFrame([], "_channel string, _estimated string, _from int, _to int")
    else:
        parsed = open_rows.select("_channel", parse_timestamp(F.col(f"`{text}`"), F.col("_order")).alias("_p"), F.unix_micros(F.col(f"`{ingested}`")).alias("ingest_micros"))
        walls = parsed.where("_p.offset_minutes is null and _p.zone is null").select(F.col("_channel").alias("channel"), F.col("_p.wall_micros").alias("wall_micros"), "ingest_micros")
        estimated = cut(estimate_zones(walls, candidates).select(F.col("channel").alias("_channel"), F.col("estimated_zone").alias("_estimated"), F.col("from_day").alias("_from"), F.col("to_day").alias("_to")))
    if estimated.count() <= most_broadcast:
        estimated = F.broadcast(estimated)

    p = parse_timestamp(F.col(f"`{text}`"), F.col("_order"))
    day = F.floor(F.coalesce(F.unix_micros(F.col(f"`{ingested}`")), F.col("_p.wall_micros")) / _DAY)
    within = (F.col("_from").isNull() | (F.col("_day") >= F.col("_from"))) & (F.col("_to").isNull() | (F.col("_day") < F.col("_to")))
    # Without a day the first stretch of the history holds.
    full = read.withColumn("_p", p).withColumn("_day", F.coalesce(day, F.lit(-(10**9)))).withColumnRenamed("_channel", "_own")
    full = full.join(estimated, (F.col("_own") == F.col("_channel")) & within, "left")
    utc, source = _converted(F.coalesce(F.col("_declared"), F.col("_estimated"), F.lit("UTC")))
    return full.select(*[F.col(f"`{c}`") for c in base.columns], utc.alias("utc_micros"), source.alias("zone_source"))


def _converted(zone_of_channel: Column) -> tuple[Column, Column]:
    """The instant of ``_p``, and what decided it."""
    wall, offset = F.col("_p.wall_micros"), F.col("_p.offset_minutes")
    zone = F.coalesce(F.col("_p.zone"), zone_of_channel)
    utc = F.coalesce(F.col("_p.epoch_micros"), F.when(offset.isNotNull(), wall - offset.cast("long") * _MINUTE).otherwise(wall_to_utc(wall, zone)))
    source = (
        F.when(utc.isNull(), None)
        .when(F.col("_p.epoch_micros").isNotNull(), "epoch")
        .when(offset.isNotNull() | F.col("_p.zone").isNotNull(), "text")
        .when(F.col("_declared").isNotNull(), "declared")
        .when(F.col("_estimated").isNotNull(), "estimated")
        .otherwise("utc")
    )
    return utc, source
