"""Columns over timestamps that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(ts: Column, unit: str = "SECOND") -> Column:
    """Whole units from 1970-01-01 to a timestamp, as its clock shows it."""
    return F.timestamp_diff(unit, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts.cast("timestamp_ntz"))
