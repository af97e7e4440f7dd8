"""Times as users write them, and parts of a subset named by the calendar."""

from __future__ import annotations

from calendar import isleap, monthrange
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient(text: Column) -> Column:
    """A date, a date and time, or either with an offset, as a timestamp; midnight if there is no time, null if it is none of these."""
    formats = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats))


def named_subset(now: datetime, n: str, m: str) -> tuple[int, int]:
    """n of m, either a number or named: hourly, daily, weekly, monthly of a day, week, month or year."""
    day = now.timetuple().tm_yday - 1
    days, year = monthrange(now.year, now.month)[1], 365 + isleap(now.year)
    part = {"hourly": day * 24 + now.hour, "daily": day, "weekly": now.isocalendar().week - 1, "monthly": now.month - 1}
    # How many parts a named period has.
    whole = {
        ("hourly", "day"): 24, ("hourly", "week"): 168, ("hourly", "month"): 24 * days, ("hourly", "year"): 24 * year,
        ("daily", "week"): 7, ("daily", "month"): days, ("daily", "year"): year,
        ("weekly", "month"): 4, ("weekly", "year"): 52, ("monthly", "year"): 12,
    }
    alone = {"month_hours": 24 * days, "year_hours": 24 * year, "month_days": days, "year_days": year}
    count = whole.get((n, m)) or alone.get(m) or int(m)
    return (part[n] if n in part else int(n)) % count, count
