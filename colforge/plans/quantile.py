"""Exact medians and other ranks without sorting or shuffling the table.

An approximate percentile gives a narrow band, exact counts prove that the wanted rank lies in it, and
the band shrinks until its distinct values fit a small answer. Every round is one aggregate for all columns.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND_VALUES = 10_000
SMALL_TABLE = 100_000
ACCURACY = 10_000
SLACK = 10 / ACCURACY


@dataclass
class _Target:
    """One rank (from 0) of one column. It lies between `least` and `most`; `low` to `high` is looked at next."""

    column: str
    rank: int
    least: float
    most: float
    low: float
    high: float

    def band(self) -> Column:
        return F.col(self.column).between(self.low, self.high)


def exact_medians(df: DataFrame, columns: Sequence[str], small: int = SMALL_TABLE, band_values: int = BAND_VALUES) -> dict[str, float | None]:
    """The median (mean of the two middle values) of each numeric column; NULL and NaN cells are left out."""
    names = [f"c{i}" for i in range(len(columns))]
    typed = [F.col(c).cast("double") for c in columns]
    values = df.select(*[F.when(~F.isnan(c), c).alias(n) for n, c in zip(names, typed)])
    counts = values.agg(*[F.count(n).alias(n) for n in names]).first()
    if max(counts, default=0) <= small:
        return dict(zip(columns, values.agg(*[F.median(n) for n in names]).first()))
    found = _middle_values(values, names, counts, band_values)
    return {c: sum(found[n]) / len(found[n]) if found[n] else None for c, n in zip(columns, names)}


def exact_integer_medians(df: DataFrame, columns: Sequence[str], band_values: int = BAND_VALUES) -> dict[str, Decimal | None]:
    """The median of each integer column with all its digits; NULL cells are left out.

    As doubles the middle values are found as above. Doubles keep the order of 64-bit integers but take up to 1024 of them
    for one, so the cells at a middle value are counted by their own value, and those below it tell the rank.
    """
    names = [f"c{i}" for i in range(len(columns))]
    exact = df.select(*[F.col(f"`{c}`").cast("long").alias(n) for n, c in zip(names, columns)])
    values = exact.select(*[F.col(n).cast("double").alias(n) for n in names])
    counts = values.agg(*[F.count(n).alias(n) for n in names]).first()
    near = {n: set(found) for n, found in _middle_values(values, names, counts, band_values).items()}
    wanted = [(n, d) for n, ds in near.items() for d in ds]
    if not wanted:
        return dict.fromkeys(columns)
    below = exact.agg(*[F.count_if(F.col(n).cast("double") < F.lit(d)).alias(f"b{i}") for i, (n, d) in enumerate(wanted)]).first()
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.when(F.col(n).cast("double") == F.lit(d), F.col(n)).alias("v")) for i, (n, d) in enumerate(wanted)])
    same = exact.select(F.explode(cells).alias("p")).where("p.v IS NOT NULL").groupBy("p.i", "p.v").count().collect()
    out = {}
    for c, n in zip(columns, names):
        picked = []
        for rank in ((counts[n] - 1) // 2, counts[n] // 2) if counts[n] else ():
            for i, (name, _) in enumerate(wanted):
                at = below[i]
                for _, v, times in sorted(r for r in same if name == n and r[0] == i):
                    if at <= rank < at + times:
                        picked.append(v)
                    at += times
        out[c] = Decimal(sum(picked)) / 2 if picked else None
    return out


def exact_at_ranks(df: DataFrame, ranks: dict[str, int], band_values: int = BAND_VALUES) -> dict[str, float]:
    """The value at a rank (from 0, below the number of its values) of each double column; NULL cells are left out, NaN is refused."""
    names = {f"c{i}": c for i, c in enumerate(ranks)}
    values = df.select(*[F.when(F.isnan(f"`{c}`"), F.raise_error(F.lit("NaN has no rank"))).otherwise(F.col(f"`{c}`")).cast("double").alias(n) for n, c in names.items()])
    counts = values.agg(*[F.count(n).alias(n) for n in names]).first()
    if short := [c for n, c in names.items() if not 0 <= ranks[c] < counts[n]]:
        raise ValueError(f"no such rank in {short}")
    found = _values_at(values, [(n, ranks[c]) for n, c in names.items()], counts, band_values)
    return {c: found[n][0] for n, c in names.items()}


def _middle_values(values: DataFrame, names: Sequence[str], counts, band_values: int) -> dict[str, list[float]]:
    """The one or two distinct ranks in the middle of each column, as values."""
    wanted = [(n, rank) for n in names for rank in ({(counts[n] - 1) // 2, counts[n] // 2} if counts[n] else ())]
    return {n: [] for n in names} | (_values_at(values, wanted, counts, band_values) if wanted else {})


def _values_at(values: DataFrame, wanted: Sequence[tuple[str, int]], counts, band_values: int) -> dict[str, list[float]]:
    """The values of the columns at their wanted ranks."""
    names = list(dict.fromkeys(n for n, _ in wanted))
    ranks = {n: [rank for m, rank in wanted if m == n] for n in names}
    near = {n: [max(0.0, min(r) / counts[n] - SLACK), min(1.0, max(r) / counts[n] + SLACK)] for n, r in ranks.items()}
    start = values.agg(*[F.struct(F.min(n), F.max(n), F.percentile_approx(n, near[n], ACCURACY)).alias(n) for n in names]).first()
    targets = []
    for n, rank in wanted:
        least, most, (low, high) = start[n]
        targets.append(_Target(n, rank, least, most, low, high))

    found: dict[str, list[float]] = {n: [] for n in names}
    while targets:
        facts = values.agg(*[_facts(t).alias(f"t{i}") for i, t in enumerate(targets)]).first()
        few, wide, missed = [], [], []
        for t, (below, inside, distinct) in zip(targets, facts):
            if t.rank < below:
                t.most = math.nextafter(t.low, -math.inf)
                t.low, t.high = t.least, t.most
                missed.append(t)
            elif t.rank >= below + inside:
                t.least = math.nextafter(t.high, math.inf)
                t.low, t.high = t.least, t.most
                missed.append(t)
            elif t.low == t.high:
                found[t.column].append(t.low)
            else:
                t.least, t.most = t.low, t.high
                (few if distinct <= band_values else wide).append((t, below, inside))
        if few:
            for (t, _, _), v in zip(few, _read(values, few)):
                found[t.column].append(v)
        if wide:
            _shrink(values, wide)
        targets = missed + [t for t, _, _ in wide]
    return found


def _facts(t: _Target) -> Column:
    distinct = F.approx_count_distinct(F.when(t.band(), F.col(t.column)))
    return F.struct(F.count_if(F.col(t.column) < t.low), F.count_if(t.band()), distinct)


def _shrink(values: DataFrame, wide: list) -> None:
    """A narrower guess from the approximate percentiles of the band; where that does not narrow, halve it."""
    wanted = []
    for i, (t, below, inside) in enumerate(wide):
        at = (t.rank - below) / inside
        span = [min(1.0, max(0.0, at - SLACK)), min(1.0, max(0.0, at + SLACK))]
        wanted.append(F.percentile_approx(F.when(t.band(), F.col(t.column)), span, ACCURACY).alias(f"t{i}"))
    for (t, _, _), (low, high) in zip(wide, values.agg(*wanted).first()):
        if (low, high) == (t.low, t.high):
            bottom, top = max(low, -sys.float_info.max), min(high, sys.float_info.max)
            middle = bottom / 2 + top / 2
            high = middle if low <= middle < high else low
        t.low, t.high = low, high


def _read(values: DataFrame, few: list) -> list[float]:
    """Count the distinct values of the bands (few, by the check before) and walk to the ranks."""
    pairs = F.array(
        *[F.struct(F.lit(i).alias("i"), F.when(t.band(), F.col(t.column)).alias("v")) for i, (t, _, _) in enumerate(few)]
    )
    counted = values.select(F.explode(pairs).alias("p")).filter("p.v IS NOT NULL").groupBy("p.i", "p.v").count().collect()
    out = []
    for i, (t, below, _) in enumerate(few):
        at = below
        for _, v, count in sorted(r for r in counted if r[0] == i):
            at += count
            if t.rank < at:
                out.append(v)
                break
    return out
