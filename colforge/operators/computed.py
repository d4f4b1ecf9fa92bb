"""Computed columns: deltas, running totals, ratios, shares, moving averages, z-scores, row ids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colforge.plans.exact import grids
from colforge.plans.ordered import OrderedScan, Previous, RowIndex, RunningSum, Runs
from colforge.session import materialize

NULL_MODES = ("propagate", "skip", "zero")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def timestamp_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]


def _listed(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _check(df: DataFrame, columns: Sequence[str], outs: Sequence[str], nulls: str = "propagate") -> None:
    if nulls not in NULL_MODES:
        raise ValueError(f"nulls must be one of {NULL_MODES}, not {nulls!r}")
    if len(columns) != len(outs):
        raise ValueError(f"{len(columns)} columns but {len(outs)} output names")
    numeric = numeric_columns(df)
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"no such column: {c}")
        if c not in numeric:
            raise ValueError(f"not a numeric column: {c}")
    for o in outs:
        if not o or o in df.columns or list(outs).count(o) > 1:
            raise ValueError(f"output name is empty or taken: {o!r}")


@dataclass
class Request:
    """One computed column. `kind` is a name in `KINDS`."""

    kind: str
    columns: list[str]
    out: str
    nulls: str = "propagate"
    options: dict = field(default_factory=dict)


# --- ordered kinds: features of one shared scan ---------------------------------------------------


def _delta_parts(r: Request):
    x = F.col(r.columns[0])
    if r.nulls == "zero":
        x = F.coalesce(x, F.lit(0))
    prev = Previous(x, x.isNotNull() if r.nulls == "skip" else None)
    return {r.out: prev}, lambda res, x=x: F.try_subtract(x, res[r.out])


def _cumsum_parts(r: Request):
    x = F.col(r.columns[0])
    if r.nulls == "zero":
        x = F.coalesce(x, F.lit(0))
    return {r.out: RunningSum(x, "total" if r.nulls == "skip" else "null")}, lambda res: res[r.out]


def _fill_parts(r: Request):
    x = F.col(r.columns[0])
    return {r.out: Previous(x, x.isNotNull())}, lambda res: F.coalesce(x, res[r.out])


def _row_id_parts(r: Request):
    return {r.out: RowIndex()}, lambda res: res[r.out]


def _run_id_parts(r: Request):
    key = F.struct(*r.columns)
    return {r.out: Runs(key, lambda p, c: ~p.eqNullSafe(c), initial=lambda s: F.lit(True))}, lambda res: res[r.out]


ORDERED = {
    "delta": _delta_parts,
    "cumsum": _cumsum_parts,
    "fill_forward": _fill_parts,
    "row_id": _row_id_parts,
    "run_id": _run_id_parts,
}


# --- public operators -----------------------------------------------------------------------------


def _ordered(df: DataFrame, requests: Sequence[Request], order_by, partition_by, buckets=None) -> DataFrame:
    scan = OrderedScan(df, order_by, partition_by, buckets)
    features, derive = {}, {}
    for r in requests:
        parts, make = ORDERED[r.kind](r)
        features |= parts
        derive[r.out] = make
    return scan.add(features, derive)


def delta(df, columns, out=None, *, order_by, partition_by=(), nulls="propagate", buckets=None) -> DataFrame:
    """`x - x of the row before`, for one or many columns in one pass; the first row is NULL.

    `nulls`: "propagate" (NULL if either side is), "skip" (against the last non-NULL value), "zero".
    """
    columns = _listed(columns)
    outs = [f"delta_{c}" for c in columns] if out is None else _listed(out)
    _check(df, columns, outs, nulls)
    requests = [Request("delta", [c], o, nulls) for c, o in zip(columns, outs)]
    return _ordered(df, requests, order_by, partition_by, buckets)


def delta_from_first(df, column, out=None, *, order_by) -> DataFrame:
    """`x - x of the very first row`."""
    out = out or f"delta_first_{column}"
    _check(df, [column], [out])
    key = F.struct(*_listed(order_by))
    first = df.agg(F.min_by(F.struct(F.col(column).alias("v")), key).alias("first")).select("first.v").scalar()
    return df.withColumn(out, F.try_subtract(F.col(column), first))


def delta_offset(df, column, offset, out=None, *, order_by, partition_by=(), buckets=None) -> DataFrame:
    """`x - x of the row `offset` places before`."""
    out = out or f"delta{offset}_{column}"
    _check(df, [column], [out])
    if offset < 1:
        raise ValueError("offset must be at least 1")
    scan = OrderedScan(df, order_by, partition_by, buckets)
    return scan.sliding(offset, lambda w: {out: F.try_subtract(F.col(column), F.lag(column, offset).over(w))}, [column])


def cumulative_sum(df, column, out=None, *, order_by, partition_by=(), nulls="propagate", buckets=None, exact=False) -> DataFrame:
    """Running total. A NULL row stays NULL ("propagate") or shows the total so far ("skip", "zero").

    Sums of doubles are rounded at every step, so their last digits depend on the number of buckets. `exact` adds without
    rounding and gives, for each row, the double nearest to the true total, whatever the buckets (see `plans.exact`).
    """
    out = out or f"cumsum_{column}"
    _check(df, [column], [out], nulls)
    if not exact or not isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return _ordered(df, [Request("cumsum", [column], out, nulls)], order_by, partition_by, buckets)
    grid, steps = grids(df, [column])[column], f"__steps_{out}"
    whole = df.withColumn(steps, grid.whole(F.col(f"`{column}`")))
    summed = _ordered(whole, [Request("cumsum", [steps], out, nulls)], order_by, partition_by, buckets)
    return summed.drop(steps).withColumn(out, grid.double(F.col(f"`{out}`")))


def fill_forward(df, column, out, *, order_by, partition_by=(), buckets=None) -> DataFrame:
    """The value, or the last non-NULL one before it."""
    return _ordered(df, [Request("fill_forward", [column], out)], order_by, partition_by, buckets)


def moving_average(df, column, out=None, window=5, *, order_by, partition_by=(), nulls="propagate", buckets=None) -> DataFrame:
    """Mean of the non-NULL values among this row and the `window - 1` before; short windows at the start."""
    out = out or f"moving_avg_{column}"
    _check(df, [column], [out], nulls)
    if window < 1:
        raise ValueError("window must be at least 1")
    x = F.coalesce(F.col(column), F.lit(0)) if nulls == "zero" else F.col(column)

    def columns(w):
        mean = F.avg(x).over(w.rowsBetween(-(window - 1), 0))
        return {out: F.when(F.col(column).isNotNull(), mean) if nulls == "propagate" else mean}

    if window == 1:
        return df.withColumn(out, x.cast("double"))
    return OrderedScan(df, order_by, partition_by, buckets).sliding(window - 1, columns, [column])


def _nulls_filled(df, column, nulls, order_by) -> tuple[DataFrame, Column, list[str]]:
    """The column under the null mode; "skip" needs the row order."""
    if nulls == "skip":
        if order_by is None:
            raise ValueError('nulls="skip" uses the last value before, so it needs order_by')
        helper = f"__filled_{column}"
        return materialize(fill_forward(df, column, helper, order_by=order_by)), F.col(helper), [helper]
    x = F.col(column)
    return df, (F.coalesce(x, F.lit(0)) if nulls == "zero" else x), []


def percent_of_total(df, column, out=None, *, nulls="propagate", order_by=None) -> DataFrame:
    """`x / sum(x) * 100`; NULL when x is NULL or the sum is 0. One extra aggregate, no shuffle of the rows."""
    out = out or f"pct_{column}"
    _check(df, [column], [out], nulls)
    df, x, helpers = _nulls_filled(df, column, nulls, order_by)
    total = df.agg(F.sum(x).cast("double").alias("total")).scalar()
    return df.withColumn(out, F.try_divide(x.cast("double"), total) * 100).drop(*helpers)


def ratio(df, numerator, denominator, out=None, *, nulls="propagate") -> DataFrame:
    """`numerator / denominator` as double; NULL when either is NULL or the denominator is 0."""
    out = out or f"{numerator}_per_{denominator}"
    _check(df, [numerator, denominator], [out, f"__{out}"], nulls)
    a, b = F.col(numerator), F.col(denominator)
    if nulls == "zero":
        a, b = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
    return df.withColumn(out, F.try_divide(a.cast("double"), b.cast("double")))


def z_score(df, column, out=None, *, nulls="propagate", order_by=None) -> DataFrame:
    """`(x - mean) / population standard deviation`; NULL when there is no spread."""
    out = out or f"zscore_{column}"
    _check(df, [column], [out], nulls)
    df, x, helpers = _nulls_filled(df, column, nulls, order_by)
    moments = df.agg(F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd")).alias("m")).scalar()
    return df.withColumn(out, F.try_divide(x - moments["mean"], moments["sd"])).drop(*helpers)


def row_id(df, out="row_id", *, order_by, group_columns=(), buckets=None) -> DataFrame:
    """Dense row number from 0. With `group_columns`, `<out>_group` counts from 1 and
    rises whenever those columns, taken together, differ from the row before.
    """
    requests = [Request("row_id", [], out)]
    if group_columns:
        requests.append(Request("run_id", _listed(group_columns), f"{out}_group"))
    return _ordered(df, requests, order_by, (), buckets)


def time_parts(df, column, parts=("hour", "minute", "second"), prefix=None) -> DataFrame:
    """Calendar and clock fields of a timestamp as `<column>_<part>`."""
    prefix = column if prefix is None else prefix
    return df.withColumns({f"{prefix}_{p}": F.date_part(F.lit(p), F.col(column)).cast("long") for p in parts})


def time_between(df, start, end, out, unit="SECOND") -> DataFrame:
    """Whole units from `start` to `end`."""
    return df.withColumn(out, F.timestamp_diff(unit, F.col(start), F.col(end)))


def expression(df, text, out) -> DataFrame:
    """A column from an SQL expression."""
    return df.withColumn(out, F.expr(text))


KINDS = (*ORDERED, "moving_average", "delta_offset", "delta_from_first", "percent_of_total", "ratio", "z_score", "expression")


def compute(df: DataFrame, requests: Sequence[Request], *, order_by, partition_by=()) -> DataFrame:
    """Apply requests in order; a later one may read an earlier output.

    Neighbouring ordered requests share one pass. Before a second pass the rows are written once to the
    shared folder, so the work does not double with every step.
    """
    pending: list[Request] = []
    passes = 0

    def flush():
        nonlocal df, passes
        if pending:
            if passes:
                df = materialize(df)
            df = _ordered(df, pending, order_by, partition_by)
            passes += 1
            pending.clear()

    for r in requests:
        if r.kind not in KINDS:
            raise ValueError(f"unknown kind {r.kind!r}; one of {KINDS}")
        if r.kind in ORDERED:
            if any(c in {p.out for p in pending} for c in r.columns):
                flush()
            checked = [c for c in r.columns if r.kind in ("delta", "cumsum")]
            _check(df, checked, [r.out] * len(checked), r.nulls)
            pending.append(r)
            continue
        flush()
        column = r.columns[0] if r.columns else None
        if r.kind in ("moving_average", "delta_offset"):
            if passes:
                df = materialize(df)
            passes += 1
            if r.kind == "moving_average":
                df = moving_average(df, column, r.out, order_by=order_by, partition_by=partition_by, nulls=r.nulls, **r.options)
            else:
                df = delta_offset(df, column, out=r.out, order_by=order_by, partition_by=partition_by, **r.options)
        elif r.kind == "delta_from_first":
            df = delta_from_first(df, column, r.out, order_by=order_by)
        elif r.kind == "percent_of_total":
            df = percent_of_total(df, column, r.out, nulls=r.nulls, order_by=order_by)
        elif r.kind == "z_score":
            df = z_score(df, column, r.out, nulls=r.nulls, order_by=order_by)
        elif r.kind == "ratio":
            df = ratio(df, *r.columns, r.out, nulls=r.nulls)
        else:
            df = expression(df, r.options["text"], r.out)
    flush()
    return df


def output_name(table: str, kind: str, columns: Sequence[str]) -> str:
    """Default name of the derived table."""
    joined = "_".join(columns)
    return f"{table}_delta_{joined}" if kind == "delta" else f"{table}_with_{joined}"
