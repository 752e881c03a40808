"""Time rules of warm-ups, retries and timers as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_DAYS, STALE_DAYS = 7.0, 30.0


def topic_weight(edges: Column, active: Column, now: Column) -> Column:
    """Edges halved for every week since the last activity, counted in whole seconds; a future activity is now, none is a month ago."""
    seconds = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(active)) / 1_000_000))
    days = F.when(active.isNull(), F.lit(STALE_DAYS)).otherwise(seconds / 86_400.0)
    return edges * F.pow(F.lit(0.5), days / HALF_LIFE_DAYS)


def effective_quota(quota: Column, factor: Column) -> Column:
    """A backoff takes from the daily quota but leaves one."""
    return F.greatest(F.lit(1), quota - factor)


def interval_multiplier(factor: Column) -> Column:
    """Two to the power of the backoff, at most the largest long."""
    top = F.lit(2**63 - 1)
    return F.when(factor >= 63, top).otherwise(F.pow(F.lit(2.0), F.least(factor, F.lit(62))).cast("long"))


def local_date(now: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(now, zone), "yyyy-MM-dd")


def in_active_hours(now: Column, start_minute: int, end_minute: int, zone: str) -> Column:
    """Whether the minute of the local day lies in [start, end)."""
    at = F.from_utc_timestamp(now, zone)
    minute = F.hour(at) * 60 + F.minute(at)
    return (minute >= start_minute) & (minute < end_minute)


def cooldown_active(stored: Column, today: Column, days: int) -> Column:
    """Whether the stored date is fewer than ``days`` before today; a malformed date excludes nothing."""
    return F.coalesce(F.datediff(F.try_to_date(today, "yyyy-MM-dd"), F.try_to_date(stored, "yyyy-MM-dd")) < days, F.lit(False))


def retry_delay(base: Column, attempt: Column, most: int = 60) -> Column:
    """Seconds before an attempt: doubled each time, a minute at most."""
    return F.least(base * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(30))), F.lit(float(most)))


def timer_cadence(interval: Column, floor: Column) -> Column:
    """How often a timer looks: an eighth of its interval, at least a second, at most its floor or five minutes."""
    return F.greatest(F.lit(1.0), F.least(interval / 8, F.least(floor, F.lit(300.0))))


def jittered(interval: Column, draw: Column) -> Column:
    """The interval times 0.7 to 1.3, by a draw in [0, 1)."""
    return interval * (0.7 + 0.6 * draw)


def draw(*parts: Column, seed: int = 1) -> Column:
    """A uniform number in [0, 1) that only depends on ``parts``: the leading 48 bits of their digest, so that any engine can draw it."""
    text = F.concat_ws("|", *parts, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def day_slots(quota: Column, window: Column, *parts: Column) -> Column:
    """One second of the active day for each of ``quota`` windows of ``window`` seconds."""
    return F.transform(F.sequence(F.lit(0).cast("long"), quota.cast("long") - 1), lambda k: k * window + F.floor(draw(*parts, k.cast("string")) * window))
