"""Times without a zone, as they stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zoneless_micros(t: Column) -> Column:
    """Microseconds from 1970-01-01 00:00:00 to a timestamp_ntz, whatever the session's zone (casts and timestampdiff go through it)."""
    second = F.call_function("date_part", F.lit("SECOND"), t)  # a decimal with microseconds
    day = F.unix_date(F.to_date(t)).cast("bigint") * 86_400_000_000
    return day + F.hour(t).cast("bigint") * 3_600_000_000 + F.minute(t).cast("bigint") * 60_000_000 + (second * 1_000_000).cast("bigint")
