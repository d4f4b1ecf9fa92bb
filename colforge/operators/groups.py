"""Group ids from rules over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colforge.functions.timeparse import duration_seconds, seconds_of
from colforge.plans.ordered import OrderedScan, Runs
from colforge.session import broadcast_if_small, materialize

NO_GROUP = -1


@dataclass(frozen=True)
class Rule:
    """`kind`: value_change, value_equals, is_empty, composite or time_gap.

    With `reset` the output is the row's place inside its group, from 0, instead of the group id.
    """

    kind: str
    column: str | Sequence[str]
    out: str
    value: Any = None
    reset: bool = False


def value_change(column: str, out="group_id", reset=False) -> Rule:
    """Id from 0, one more whenever the value differs from the row before (NULL equals NULL)."""
    return Rule("value_change", column, out, reset=reset)


def value_equals(column: str, value, out="group_id", reset=False) -> Rule:
    """Runs of rows equal to `value`, numbered from 1; other rows get -1."""
    return Rule("value_equals", column, out, value, reset)


def is_empty(column: str, out="group_id", reset=False) -> Rule:
    """Every first empty row of a run starts a block; blocks count from 0."""
    return Rule("is_empty", column, out, reset=reset)


def composite(columns: Sequence[str], out="group_id", reset=False) -> Rule:
    """Id from 0, one more whenever any of the columns differs from the row before."""
    return Rule("composite", tuple(columns), out, reset=reset)


def time_gap(column: str, threshold, out="group_id", reset=False) -> Rule:
    """Id from 0, one more when more than `threshold` passed since the last time."""
    return Rule("time_gap", column, out, threshold, reset)


def empty(column: Column, data_type: T.DataType) -> Column:
    """NULL, or '' in a text column."""
    return (column.isNull() | (column == "")) if isinstance(data_type, T.StringType) else column.isNull()


def _matches(df: DataFrame, rule: Rule) -> Column:
    """Equal to the wanted value, compared in the column's own type."""
    c, kind = F.col(rule.column), df.schema[rule.column].dataType
    if rule.value is None:
        return c.isNull()
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        # Whole and decimal numbers keep all their digits; a value that such a column cannot hold matches nothing.
        try:
            number = Decimal(str(int(rule.value) if isinstance(rule.value, bool) else rule.value).strip())
        except InvalidOperation:
            return F.lit(False)
        if not number.is_finite() or (isinstance(kind, T.IntegralType) and number != number.to_integral_value()):
            return F.lit(False)
        text = format(number.to_integral_value() if isinstance(kind, T.IntegralType) else number, "f")
        wanted = F.lit(text).try_cast("decimal(38,0)" if isinstance(kind, T.IntegralType) else f"decimal(38,{min(18, max(kind.scale, 0))})")
        return F.coalesce(c.cast(_wide(kind)) == wanted, F.lit(False))
    wanted = F.lit(rule.value)
    return F.coalesce(c == wanted.try_cast("double" if isinstance(kind, T.NumericType) else kind), F.lit(False))


def _wide(kind: T.DataType) -> str:
    return "decimal(38,0)" if isinstance(kind, T.IntegralType) else kind.simpleString()


def _feature(df: DataFrame, rule: Rule):
    """The run feature of a rule, and the functions that give its id and its place-in-group."""
    name = rule.out
    place = lambda r: r[f"{name}.position"]
    if rule.kind in ("value_change", "composite"):
        columns = [rule.column] if isinstance(rule.column, str) else rule.column
        return Runs(F.struct(*columns), lambda p, c: ~p.eqNullSafe(c)), (lambda r: r[name]), place
    if rule.kind == "value_equals":
        hit = _matches(df, rule)
        none = F.lit(NO_GROUP).cast("long")
        runs = Runs(hit, lambda p, c: c & ~p, initial=lambda s: s)
        return (
            runs,
            lambda r: F.when(hit, r[name]).otherwise(none),
            lambda r: F.when(hit, place(r)).otherwise(none),
        )
    if rule.kind == "is_empty":
        blank = empty(F.col(rule.column), df.schema[rule.column].dataType)
        runs = Runs(blank, lambda p, c: c & ~p, initial=lambda s: s)
        # Rows before the first blank share block 0 with it, so the place counts through from row 0 there.
        return (
            runs,
            lambda r: F.greatest(r[name] - 1, F.lit(0)),
            lambda r: F.when(r[name] <= 1, r[f"{name}.index"]).otherwise(place(r)),
        )
    if rule.kind == "time_gap":
        limit = duration_seconds(rule.value)
        seconds = seconds_of(F.col(rule.column), df.schema[rule.column].dataType)
        none = F.lit(NO_GROUP).cast("long")
        runs = Runs(seconds, lambda p, c: (c - p) > limit, valid=seconds.isNotNull())
        pick = lambda make: (lambda r: F.when(seconds.isNotNull(), make(r)).otherwise(none))
        return runs, pick(lambda r: r[name]), pick(place)
    raise ValueError(f"unknown rule: {rule.kind!r}")


def add_groups(df: DataFrame, rules: Rule | Sequence[Rule], *, order_by, partition_by=(), buckets=None) -> DataFrame:
    """Add one id column per rule, all in one pass. Rules that read an earlier rule's output get a new pass."""
    rules = [rules] if isinstance(rules, Rule) else list(rules)
    waiting, later = [], []
    for rule in rules:
        read = {rule.column} if isinstance(rule.column, str) else set(rule.column)
        ready = not later and not (read & {w.out for w in waiting})
        (waiting if ready else later).append(rule)
    taken = [r.out for r in waiting]
    for rule in waiting:
        read = [rule.column] if isinstance(rule.column, str) else rule.column
        for c in read:
            if c not in df.columns:
                raise ValueError(f"no such column: {c}")
        if not rule.out or rule.out in df.columns or taken.count(rule.out) > 1:
            raise ValueError(f"output name is empty or taken: {rule.out!r}")
    features, derive = {}, {}
    for rule in waiting:
        runs, number, place = _feature(df, rule)
        features[rule.out] = runs
        derive[rule.out] = place if rule.reset else number
    done = OrderedScan(df, order_by, partition_by, buckets).add(features, derive)
    return add_groups(materialize(done), later, order_by=order_by, partition_by=partition_by) if later else done


def hierarchy(df, block: Rule, group: Rule, *, order_by, sequence="sequence") -> DataFrame:
    """Block id, group id restarting in every block, and the row's place in its group.

    One ordered pass: a group also ends where its block ends, so groups get numbers that run through;
    the number of a block's first group (one row per block) is then subtracted.
    """
    if block.kind not in ("value_change", "composite", "is_empty") or group.kind not in ("value_change", "composite"):
        raise ValueError("blocks need a rule that covers every row, and groups a value change")
    columns = [group.column] if isinstance(group.column, str) else list(group.column)
    outer, number, _ = _feature(df, block)
    state = F.struct(outer.state.alias("b"), F.struct(*columns).alias("g"))
    inner = Runs(state, lambda p, c: outer.starts(p["b"], c["b"]) | ~p["g"].eqNullSafe(c["g"]))
    derive = {block.out: number, "__g": lambda r: r["__g"], sequence: lambda r: r["__g.position"]}
    numbered = materialize(OrderedScan(df, order_by).add({block.out: outer, "__g": inner}, derive))
    first = numbered.groupBy(block.out).agg(F.min("__g").alias("__first"))
    return (
        numbered.join(broadcast_if_small(first), block.out)
        .withColumn(group.out, F.col("__g") - F.col("__first"))
        .select(*df.columns, block.out, group.out, sequence)
    )


def group_statistics(df, group_column) -> DataFrame:
    """One row: rows in groups, groups, and the smallest, largest and mean group. Rows with -1 stand outside."""
    sizes = df.filter(F.col(group_column) != NO_GROUP).groupBy(group_column).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("groups"),
        F.min("n").alias("min_size"),
        F.max("n").alias("max_size"),
        F.avg("n").alias("avg_size"),
    )
