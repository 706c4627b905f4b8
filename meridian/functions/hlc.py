"""Hybrid logical clock: 48 bits of wall milliseconds and a 16-bit counter, packed so that numbers order as times."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WALL, _COUNT = (1 << 48) - 1, (1 << 16) - 1


def pack(wall_ms: Column, counter: Column) -> Column:
    return F.shiftleft(wall_ms.cast("long").bitwiseAND(F.lit(_WALL)), 16).bitwiseOR(counter.cast("long").bitwiseAND(F.lit(_COUNT)))


def wall(hlc: Column) -> Column:
    return F.shiftrightunsigned(hlc.cast("long"), 16)


def counter(hlc: Column) -> Column:
    return hlc.cast("long").bitwiseAND(F.lit(_COUNT))


def millis(ts: Column) -> Column:
    """Whole milliseconds of a timestamp, rounded down."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1000)).cast("long")


class Clock:
    """The driver's clock. now() always grows; a full counter carries into the wall part."""

    def __init__(self, millis: Callable[[], int] | None = None):
        self.millis = millis or (lambda: time.time_ns() // 1_000_000)
        self.last = 0

    def now(self, n: int = 1) -> int:
        """The first of n stamps that follow one another, all later than any before."""
        first = max(self.last + 1, (self.millis() & _WALL) << 16)
        self.last = first + n - 1
        return first

    def update(self, remote: int) -> int:
        """Takes notice of a remote stamp; the next ones are later than it."""
        self.last = max(self.last, remote)
        return self.now()
