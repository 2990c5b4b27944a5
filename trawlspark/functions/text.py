"""Byte sizes and durations as readable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Units of sizes, by thousands.
_UNITS = ["kB", "MB", "GB", "TB", "PB", "EB"]


def format_bytes(n: Column) -> Column:
    """Bytes below 1,000 as they are, else one decimal in the largest unit that the size reaches."""
    out = F.concat(n.cast("string"), F.lit(" b "))
    for power, unit in enumerate(_UNITS, start=1):
        size = 10 ** (3 * power)
        out = F.when(n >= size, F.format_string(f"%.1f {unit}", n.cast("double") / float(size))).otherwise(out)
    return out


def format_elapsed(ms: Column) -> Column:
    """``1d 2h 3m 4s``; milliseconds only below one second."""

    def part(value: Column, unit: str) -> Column:
        return F.when(value > 0, F.concat(value.cast("string"), F.lit(unit)))

    def whole(divisor: int) -> Column:
        return F.floor(ms / divisor)

    parts = F.concat_ws(
        " ",
        part(whole(86400000), "d"),
        part(whole(3600000) % 24, "h"),
        part(whole(60000) % 60, "m"),
        part(whole(1000) % 60, "s"),
    )
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(parts)
