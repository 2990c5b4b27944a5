"""Small Column helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Reusing a Python ``Column`` copies its whole expression tree at each use,
    so staged computations would grow exponentially. A one-element
    ``transform`` names the value instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(text: Column) -> Column:
    """Strip all characters up to U+0020 at both ends (``trim`` strips spaces only)."""
    return F.regexp_replace(text, r"^[\x00-\x20]++|[\x00-\x20]++$", "")


def joined(parts: Column, sep: str = "") -> Column:
    return F.array_join(parts, sep)
