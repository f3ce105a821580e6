"""Dates as text and as timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_timestamp(c: Column) -> Column:
    """An ISO text, with Z or an offset, as a timestamp; null if it is none."""
    return F.try_to_timestamp(c)


def rfc2822(c: Column, otherwise: Column) -> Column:
    """A feed's date as a timestamp; otherwise, where it is missing or does not parse (S4). Pass the run's time, never the wall clock."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{2,9},?\s+", ""), r"(?i)\s+(GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")), otherwise)


def listing_date(c: Column) -> Column:
    """A date as "Mar 4, 2026", or null."""
    return F.try_to_timestamp(F.trim(c), F.lit("MMM d, yyyy"))


def iso_week(c: Column) -> Column:
    """The ISO year and week, as 2026-W05."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def fresh(ts: Column, known: Column, run_ts: Column, hours: int | None) -> Column:
    """Whether a row passes the age filter: no limit, no real date, or not older than hours before the run."""
    return F.lit(True) if hours is None else ~known | (ts >= run_ts - F.expr(f"INTERVAL {hours} HOURS"))
