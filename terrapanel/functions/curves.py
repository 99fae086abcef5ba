"""Numbers along a space-filling curve: near places get near numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each byte with a zero between its bits.
_SPREAD = [sum((b >> k & 1) << 2 * k for k in range(8)) for b in range(256)]


def _spread(c: Column, size: int) -> Column:
    table = F.array(*[F.lit(v).cast("long") for v in _SPREAD])
    at = lambda k: F.shiftleft(F.element_at(table, (F.shiftright(c, 8 * k).bitwiseAND(F.lit(255)) + 1).cast("int")), 16 * k)
    out = at(0)
    for k in range(1, size):
        out = out + at(k)
    return out


def morton(x: Column, y: Column, size: int = 2) -> Column:
    """Interleaved bits of two whole columns of ``size`` bytes each (3 at most), y's above x's."""
    return _spread(x.cast("long"), size) + F.shiftleft(_spread(y.cast("long"), size), 1)


def steps(value: Column, low: float, high: float, size: int = 2) -> Column:
    """The value's place from 0 to 2^(8 size) - 1 between the bounds; values beyond count as the bounds, NULL as the lower one."""
    top = (1 << 8 * size) - 1
    share = (value - F.lit(float(low))) / F.lit(float(high - low) or 1.0)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0)))) * top).cast("long")


def box_ranges(x0: int, y0: int, x1: int, y1: int, size: int = 2, most: int = 32) -> list[tuple[int, int]]:
    """Ranges of Morton numbers (both ends included), ``most`` at most, that hold all places of a box of steps (ends included) and few others.

    Squares of the curve are split while they lie partly in the box and there
    is room; neighbouring ones are joined.
    """
    top = 8 * size
    done: list[tuple[int, int]] = []
    open_ = [(0, 0, top, 0)]  # corner, level, first number
    while open_ and len(open_) + len(done) + 3 <= most:
        x, y, level, first = open_.pop(0)
        side = 1 << level
        if x > x1 or y > y1 or x + side <= x0 or y + side <= y0:
            continue
        if level == 0 or (x >= x0 and y >= y0 and x + side - 1 <= x1 and y + side - 1 <= y1):
            done.append((first, first + (1 << 2 * level) - 1))
            continue
        half = side >> 1
        open_ += [(x + dx * half, y + dy * half, level - 1, first + ((2 * dy + dx) << 2 * (level - 1))) for dy in (0, 1) for dx in (0, 1)]
    meets = lambda x, y, level: not (x > x1 or y > y1 or x + (1 << level) <= x0 or y + (1 << level) <= y0)
    done += [(first, first + (1 << 2 * level) - 1) for x, y, level, first in open_ if meets(x, y, level)]
    out: list[tuple[int, int]] = []
    for low, high in sorted(done):
        if out and out[-1][1] + 1 == low:
            out[-1] = out[-1][0], high
        else:
            out.append((low, high))
    return out
