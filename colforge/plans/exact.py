"""Sums of doubles that do not depend on order, buckets or cores.

Every finite double is a whole number of steps of some power of two. One aggregate finds a step that divides all cells of a
column; the cells become whole decimals of that step, whose sums are exact and merge in any order, and one rounding at the
end gives the double nearest to the true sum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECIMAL_BITS = 126  # below 10^38


@dataclass(frozen=True)
class Grid:
    """Cells are whole multiples of 2^-bits."""

    bits: int

    def whole(self, value: Column) -> Column:
        """The cell in steps, as decimal(38,0): three parts of 42 bits, each an exact whole double."""
        y = value.cast("double") * F.lit(2.0**self.bits)
        top = (y * F.lit(2.0**-84)).cast("long")  # towards zero, so that what remains is exact
        rest = y - top.cast("double") * F.lit(2.0**84)
        middle = (rest * F.lit(2.0**-42)).cast("long")
        low = (rest - middle.cast("double") * F.lit(2.0**42)).cast("long")
        wide = lambda part, factor: (part.cast("decimal(19,0)") * F.lit(Decimal(factor))).cast("decimal(38,0)")
        return (wide(top, 1 << 84) + wide(middle, 1 << 42) + low.cast("decimal(38,0)")).cast("decimal(38,0)")

    def double(self, steps: Column) -> Column:
        return steps.cast("double") * F.lit(2.0**-self.bits)


def grids(df: DataFrame, columns: Sequence[str]) -> dict[str, Grid]:
    """A grid per column, from one aggregate. NaN and infinite cells, and cells so far apart that a sum could pass 126 bits
    (a factor of about 10^20 between the largest total and the smallest cell's last digit), are refused."""
    cells = {c: F.col(f"`{c}`").cast("double") for c in columns}
    figures = []
    for c, x in cells.items():
        size = F.when(x != 0, F.abs(x))
        figures += [F.min(size), F.max(size), F.count_if(F.isnan(x) | (F.abs(x) == F.lit(math.inf)))]
    got = df.agg(F.count("*").alias("rows"), *[f.alias(f"f{i}") for i, f in enumerate(figures)]).first()
    out = {}
    for i, c in enumerate(columns):
        least, most, odd = got[1 + 3 * i], got[2 + 3 * i], got[3 + 3 * i]
        if odd:
            raise ValueError(f"no exact sum: {c} has {odd} NaN or infinite cells")
        if least is None:
            out[c] = Grid(0)
            continue
        bits = 53 - math.frexp(least)[1]
        if math.frexp(most)[1] + bits + math.ceil(math.log2(got["rows"] + 1)) > DECIMAL_BITS or not -960 < bits < 960:
            raise ValueError(f"no exact sum: the cells of {c} lie too far apart ({least!r} to {most!r})")
        out[c] = Grid(bits)
    return out


def exact_totals(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per group (or for the whole table): `<column>_total`, the double nearest to the true sum, and `<column>_mean`, that
    total over the number of cells. NULL cells are left out; without cells both are NULL."""
    grid = grids(df, columns)
    sums = [F.sum(g.whole(F.col(f"`{c}`"))).alias(f"__s{i}") for i, (c, g) in enumerate(grid.items())]
    counts = [F.count(F.col(f"`{c}`")).alias(f"__n{i}") for i, c in enumerate(columns)]
    found = df.groupBy(*by).agg(*sums, *counts)
    total = {c: g.double(F.col(f"__s{i}")) for i, (c, g) in enumerate(grid.items())}
    means = [F.try_divide(total[c], F.col(f"__n{i}")).alias(f"{c}_mean") for i, c in enumerate(columns)]
    return found.select(*by, *[t.alias(f"{c}_total") for c, t in total.items()], *means)
