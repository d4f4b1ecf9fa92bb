"""Ordered scan: row-order operators without moving the table into one task.

A window without partition keys would pull every row into a single task. Here the order key is cut
into buckets of similar size (boundaries come from a sample and become literals, so a recomputed task
sees the same buckets). Each bucket is worked on alone, then one summary row per bucket tells the next
buckets what came before:

    rows -> bucket -> local window        -> join -> result
                  \\-> summary per bucket -> prefix over buckets /

The wide rows are shuffled once. With partition keys the summary has one row per (bucket, key), so a
key that owns a third of the table is still spread over many tasks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"
ROWS_PER_BUCKET = 10_000_000
MIN_ROWS_PER_BUCKET = 1_000
SAMPLE_PER_BUCKET = 30
FILE_ORDER = ("__file", "__row")


def with_file_order(df: DataFrame) -> DataFrame:
    """Add the position in the Parquet files as two columns, usable as `order_by=FILE_ORDER`."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def comparable(column: Column, data_type: T.DataType) -> Column:
    """The order key in a form that has an exact JSON literal and the same order."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(data_type, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), column)
    if isinstance(data_type, T.DateType):
        return F.unix_date(column)
    if isinstance(data_type, T.BooleanType):
        return column.cast("int")
    return column


# --- features -------------------------------------------------------------------------------------


@dataclass
class Stage:
    """Columns one feature needs in each step; every name gets the feature's own prefix."""

    inputs: dict[str, Column] = field(default_factory=dict)
    local: list[dict[str, Column]] = field(default_factory=list)
    summary: dict[str, Column] = field(default_factory=dict)
    carry: list[dict[str, Column]] = field(default_factory=list)
    carried: list[str] = field(default_factory=list)
    ordered_summary: bool = False


class RunningSum:
    """Sum of the rows up to and including this one. NULL rows add nothing.

    `on_null`: "null" leaves the result of a NULL row empty, "total" gives it the total so far.
    """

    def __init__(self, value: Column, on_null: str = "null"):
        self.value, self.on_null = value, on_null

    def plan(self, p: str, scan: OrderedScan) -> Stage:
        return Stage(
            inputs={f"{p}v": self.value},
            local=[{f"{p}sum": F.sum(f"{p}v").over(scan.up_to_here)}],
            summary={f"{p}total": F.sum(f"{p}v")},
            carry=[{f"{p}before": F.sum(f"{p}total").over(scan.earlier_buckets)}],
            carried=[f"{p}before"],
        )

    def result(self, p: str, scan: OrderedScan) -> Column:
        here = F.col(f"{p}sum")
        if not scan.plain:
            before = F.col(f"{p}before")
            here = F.coalesce(before + here, here, before)
        return here if self.on_null == "total" else F.when(F.col(f"{p}v").isNotNull(), here)


class RowIndex:
    """Dense position from 0."""

    def plan(self, p: str, scan: OrderedScan) -> Stage:
        return Stage(
            local=[{f"{p}n": F.row_number().over(scan.local)}],
            summary={f"{p}rows": F.count(F.lit(1))},
            carry=[{f"{p}before": F.sum(f"{p}rows").over(scan.earlier_buckets)}],
            carried=[f"{p}before"],
        )

    def result(self, p: str, scan: OrderedScan) -> Column:
        before = F.coalesce(scan.carried(f"{p}before"), F.lit(0))
        return (before + F.col(f"{p}n") - F.lit(1)).cast("long")


class Previous:
    """Value of the closest earlier row where `valid` holds (default: the row before)."""

    def __init__(self, value: Column, valid: Column | None = None):
        self.value, self.valid = value, valid

    def plan(self, p: str, scan: OrderedScan) -> Stage:
        cell = F.struct(self.value.alias("v"))
        if self.valid is not None:
            cell = F.when(self.valid, cell)
        return Stage(
            inputs={f"{p}cell": cell},
            local=[{f"{p}prev": scan.previous(f"{p}cell", self.valid is None)}],
            summary={f"{p}last": F.max_by(f"{p}cell", F.when(F.col(f"{p}cell").isNotNull(), scan.key))},
            carry=[{f"{p}before": F.last(f"{p}last", ignorenulls=True).over(scan.earlier_buckets)}],
            carried=[f"{p}before"],
        )

    def result(self, p: str, scan: OrderedScan) -> Column:
        return F.coalesce(F.col(f"{p}prev"), scan.carried(f"{p}before"))["v"]


class Runs:
    """Count run starts. A row starts a run when `starts(previous state, own state)` is true.

    Only rows with `valid` take part. `initial(state)` says whether the very first valid row counts.
    The result is the count of starts so far; `position` is the row's place since the last start
    and `index` its place in the whole order, both from 0.
    """

    def __init__(
        self,
        state: Column,
        starts: Callable[[Column, Column], Column],
        initial: Callable[[Column], Column] = lambda s: F.lit(False),
        valid: Column | None = None,
    ):
        self.state, self.starts, self.initial, self.valid = state, starts, initial, valid

    def plan(self, p: str, scan: OrderedScan) -> Stage:
        cell = F.struct(self.state.alias("v"))
        if self.valid is not None:
            cell = F.when(self.valid, cell)
        here, prev = F.col(f"{p}cell"), F.col(f"{p}prev")
        # Without buckets no earlier part can decide about the first row, so it is decided here.
        first = self.initial(here["v"]) if scan.plain else F.lit(False)
        starts = F.when(here.isNotNull(), F.when(prev.isNotNull(), self.starts(prev["v"], here["v"])).otherwise(first))
        at = F.when(here.isNotNull(), scan.key)
        seam = F.when(
            F.col(f"{p}head").isNotNull(),
            F.when(F.col(f"{p}tail").isNotNull(), self.starts(F.col(f"{p}tail")["v"], F.col(f"{p}head")["v"])).otherwise(
                self.initial(F.col(f"{p}head")["v"])
            ),
        )
        offset = F.coalesce(F.sum(f"{p}rows").over(scan.earlier_buckets), F.lit(0))
        return Stage(
            inputs={f"{p}cell": cell},
            local=[
                {
                    f"{p}prev": scan.previous(f"{p}cell", self.valid is None),
                    f"{p}n": F.row_number().over(scan.local),
                },
                {f"{p}start": F.coalesce(starts, F.lit(False)).cast("int")},
                {
                    f"{p}count": F.sum(f"{p}start").over(scan.up_to_here),
                    f"{p}at": F.max(F.when(F.col(f"{p}start") == 1, F.col(f"{p}n"))).over(scan.up_to_here),
                    f"{p}first": F.min(F.when(here.isNotNull(), F.col(f"{p}n"))).over(scan.up_to_here),
                },
            ],
            summary={
                f"{p}rows": F.count(F.lit(1)),
                f"{p}changes": F.sum(f"{p}start"),
                f"{p}head": F.min_by(f"{p}cell", at),
                f"{p}end": F.max_by(f"{p}cell", at),
                f"{p}last_at": F.max(f"{p}at"),
                f"{p}head_at": F.min(f"{p}first"),
            },
            carry=[
                {
                    f"{p}tail": F.last(f"{p}end", ignorenulls=True).over(scan.earlier_buckets),
                    f"{p}offset": offset,
                },
                {f"{p}seam": F.coalesce(seam, F.lit(False)).cast("int")},
                {
                    f"{p}base": F.sum(F.col(f"{p}changes") + F.col(f"{p}seam")).over(scan.earlier_buckets),
                    f"{p}since": F.last(
                        F.col(f"{p}offset")
                        + F.coalesce(F.col(f"{p}last_at"), F.when(F.col(f"{p}seam") == 1, F.col(f"{p}head_at"))),
                        ignorenulls=True,
                    ).over(scan.earlier_buckets),
                },
            ],
            carried=[f"{p}offset", f"{p}seam", f"{p}base", f"{p}since"],
            ordered_summary=True,
        )

    def result(self, p: str, scan: OrderedScan) -> Column:
        zero = F.lit(0)
        seam = F.when(F.col(f"{p}first").isNotNull(), F.coalesce(scan.carried(f"{p}seam"), zero)).otherwise(zero)
        return (F.col(f"{p}count") + seam + F.coalesce(scan.carried(f"{p}base"), zero)).cast("long")

    def index(self, p: str, scan: OrderedScan) -> Column:
        return (F.coalesce(scan.carried(f"{p}offset"), F.lit(0)) + F.col(f"{p}n") - F.lit(1)).cast("long")

    def position(self, p: str, scan: OrderedScan) -> Column:
        zero = F.lit(0)
        offset = F.coalesce(scan.carried(f"{p}offset"), zero)
        start = F.coalesce(
            offset + F.col(f"{p}at"),
            F.when(scan.carried(f"{p}seam") == 1, offset + F.col(f"{p}first")),
            scan.carried(f"{p}since"),
            F.lit(1),
        )
        return (offset + F.col(f"{p}n") - start).cast("long")


class _Results(dict):
    """Feature results by name, built when they are asked for."""

    def __init__(self):
        super().__init__()
        self.makers: dict[str, Callable[[], Column]] = {}

    def __missing__(self, name):
        self[name] = self.makers[name]()
        return self[name]


# --- scan -----------------------------------------------------------------------------------------


class OrderedScan:
    """`df` in the order of `order_by` (ascending, NULLs first), optionally per `partition_by`.

    `order_by` has to be a total order for a repeatable result; add a tie-breaker such as an id or the
    file position (`with_file_order`). `buckets` fixes the number of buckets, else it follows the row count.
    """

    def __init__(
        self,
        df: DataFrame,
        order_by: str | Sequence[str],
        partition_by: str | Sequence[str] = (),
        buckets: int | None = None,
        rows: int | None = None,
    ):
        self.df = df
        self.order_by = [order_by] if isinstance(order_by, str) else list(order_by)
        self.partition_by = [partition_by] if isinstance(partition_by, str) else list(partition_by)
        if not self.order_by:
            raise ValueError("order_by needs at least one column")
        missing = [c for c in self.order_by + self.partition_by if c not in df.columns]
        if missing:
            raise ValueError(f"no such column: {', '.join(missing)}")

        self.bounds: list[tuple] = []
        if not (self.partition_by and buckets is None and self._keys_are_small()):
            rows = df.count() if rows is None else rows
            cores = df.sparkSession.sparkContext.defaultParallelism
            default = max(math.ceil(rows / ROWS_PER_BUCKET), min(cores, math.ceil(rows / MIN_ROWS_PER_BUCKET)))
            self.bounds = self._sample_bounds(buckets or default, rows)
        self.buckets = len(self.bounds) + 1
        # Without boundaries every key (or the whole table) is known to fit one task: plain windows do.
        self.plain = not self.bounds

        self.key = F.struct(*self.order_by)
        self.local = Window.partitionBy(*self._group).orderBy(*self.order_by)
        self.up_to_here = self.local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.before_here = self.local.rowsBetween(Window.unboundedPreceding, -1)
        # One row per bucket (and key): the single-task window without keys is bounded by the bucket count.
        across = Window.partitionBy(*self.partition_by).orderBy(BUCKET)
        self.across = across
        self.earlier_buckets = across.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def _group(self) -> list[str]:
        return self.partition_by if self.plain else [BUCKET, *self.partition_by]

    def _keys_are_small(self) -> bool:
        """Plain keyed windows are cheaper, but only while no single key outgrows a task."""
        largest = self.df.groupBy(*self.partition_by).count().agg(F.max("count")).first()[0]
        return (largest or 0) <= ROWS_PER_BUCKET

    def _sample_bounds(self, buckets: int, rows: int) -> list[tuple]:
        if buckets <= 1 or rows == 0:
            return []
        wanted = buckets * SAMPLE_PER_BUCKET
        types = {f.name: f.dataType for f in self.df.schema.fields}
        keys = self.df.select(*[comparable(F.col(c), types[c]).alias(f"k{i}") for i, c in enumerate(self.order_by)])
        if wanted < rows:
            keys = keys.sample(fraction=min(1.0, wanted / rows), seed=7)
        names = keys.columns
        # The sample holds about SAMPLE_PER_BUCKET rows per bucket, so one task can number it.
        w = Window.orderBy(*names)
        numbered = keys.withColumn("slot", F.ntile(buckets).over(w)).withColumn("before", F.lag("slot").over(w))
        picked = numbered.filter(F.col("slot") != F.col("before")).select(*names)
        self._key_types = [f.dataType.simpleString() for f in keys.schema.fields]
        return list(dict.fromkeys(tuple(r) for r in picked.collect()))

    def previous(self, name: str, every_row: bool) -> Column:
        """The column one row before, or its last non-NULL value before."""
        return F.lag(name).over(self.local) if every_row else F.last(name, ignorenulls=True).over(self.before_here)

    def carried(self, name: str) -> Column:
        """A column that came from earlier buckets; there are none in a plain scan."""
        return F.lit(None) if self.plain else F.col(name)

    def bucket(self) -> Column:
        """Number of boundaries that are not above the row's key, by binary search in a literal array."""
        types = {f.name: f.dataType for f in self.df.schema.fields}
        cols = [comparable(F.col(c), types[c]) for c in self.order_by]
        # The first key alone is enough while it differs between all boundaries.
        leading = [b[0] for b in self.bounds]
        width = 1 if None not in leading and len(set(leading)) == len(leading) else len(cols)
        # `from_json` of a literal folds to a literal, so the boundaries cost one lookup per step.
        if width == 1:
            key, kind = cols[0], self._key_types[0]
            text = json.dumps([_jsonable(v) for v in leading])
        else:
            key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])
            kind = f"struct<{','.join(f'k{i}:{t}' for i, t in enumerate(self._key_types))}>"
            text = json.dumps([{f"k{i}": _jsonable(v) for i, v in enumerate(b)} for b in self.bounds])
        literal = F.from_json(F.lit(text), f"array<{kind}>")
        n = len(self.bounds)
        steps = [1 << i for i in reversed(range(n.bit_length()))]
        found = F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda at, step: F.when(
                (at + step <= n) & (F.get(literal, at + step - 1) <= key), at + step
            ).otherwise(at),
        )
        return found if width > 1 else F.when(key.isNull(), F.lit(0)).otherwise(found)

    def placed(self, df: DataFrame) -> DataFrame:
        """One shuffle: bucket i becomes partition i. Keyed windows cluster on the keys instead."""
        return df if self.plain else df.repartitionById(self.buckets, F.col(BUCKET))

    def based(self, inputs: dict[str, Column] | None = None) -> DataFrame:
        df = self.df.withColumns(inputs) if inputs else self.df
        return df if self.plain else df.withColumn(BUCKET, self.bucket())

    def _join(self, rows: DataFrame, summary: DataFrame) -> DataFrame:
        """Attach per-bucket columns. They may be as wide as the user's values, so they are placed like the rows, which
        stay where they are; adaptive execution broadcasts them where they turn out small."""
        renamed = summary.select(
            *[F.col(c).alias(f"__r_{c}") if c in self._group else F.col(c) for c in summary.columns]
        )
        renamed = renamed.repartitionById(self.buckets, F.col(f"__r_{BUCKET}"))
        on = [rows[BUCKET] == renamed[f"__r_{BUCKET}"]]
        on += [rows[c].eqNullSafe(renamed[f"__r_{c}"]) for c in self.partition_by]
        return rows.join(renamed, reduce(lambda a, b: a & b, on), "left").drop(*[f"__r_{c}" for c in self._group])

    def add(self, features: dict[str, object], derive: dict[str, Callable[[dict[str, Column]], Column]] | None = None) -> DataFrame:
        """Add one column per feature, all in the same pass.

        With `derive`, the given functions of the feature results become the columns instead;
        a run feature `f` also offers `f.position` and `f.index`.
        """
        plans, results = {}, _Results()
        for i, (name, feature) in enumerate(features.items()):
            p = f"__f{i}_"
            plans[name] = feature.plan(p, self)
            results.makers[name] = lambda f=feature, p=p: f.result(p, self)
            if isinstance(feature, Runs):
                results.makers[f"{name}.position"] = lambda f=feature, p=p: f.position(p, self)
                results.makers[f"{name}.index"] = lambda f=feature, p=p: f.index(p, self)
        stages = list(plans.values())
        inputs = {k: v for s in stages for k, v in s.inputs.items()}
        based = self.based(inputs)
        rows = self._run_local(self.placed(based), stages)

        carried = [c for s in stages for c in s.carried]
        if not self.plain:
            rows = self._join(rows, self._carry(based, inputs, stages, carried))
        keep = self.df.columns
        if derive is None:
            derive = {name: (lambda r, name=name: r[name]) for name in features}
        added = {name: make(results) for name, make in derive.items()}
        return rows.select(*[F.col(f"`{c}`") for c in keep if c not in added], *[c.alias(n) for n, c in added.items()])

    def _run_local(self, rows: DataFrame, stages: list[Stage]) -> DataFrame:
        depth = max((len(s.local) for s in stages), default=0)
        for level in range(depth):
            columns = {k: v for s in stages if level < len(s.local) for k, v in s.local[level].items()}
            rows = rows.withColumns(columns)
        return rows

    def _carry(self, based: DataFrame, inputs: dict, stages: list[Stage], carried: list[str]) -> DataFrame:
        narrow = based.select(*dict.fromkeys([*self._group, *self.order_by, *inputs]))
        if any(s.ordered_summary for s in stages):
            narrow = self._run_local(self.placed(narrow), stages)
        summary = narrow.groupBy(*self._group).agg(*[v.alias(k) for s in stages for k, v in s.summary.items()])
        for level in range(max(len(s.carry) for s in stages)):
            columns = {k: v for s in stages if level < len(s.carry) for k, v in s.carry[level].items()}
            summary = summary.withColumns(columns)
        return summary.select(*self._group, *carried)

    def sliding(self, size: int, columns: Callable[[object], dict[str, Column]], needs: Sequence[str]) -> DataFrame:
        """Window functions that look back at most `size` rows; `needs` names the columns they read.

        Each bucket borrows copies of the last `size` rows before it (from several buckets if they are
        short). `columns` gets the window and returns the new columns.
        """
        keep = self.df.columns
        if self.plain:
            return self.df.withColumns(columns(self.local))
        based = self.based()
        narrow = based.select(*dict.fromkeys([*self._group, *self.order_by, *needs]))
        backwards = Window.partitionBy(*self._group).orderBy(*[F.col(c).desc() for c in self.order_by])
        tails = narrow.withColumn("__back", F.row_number().over(backwards)).filter(F.col("__back") <= size)

        # For each bucket: which earlier buckets end less than `size` rows before it starts.
        ends = narrow.groupBy(*self._group).agg(F.count(F.lit(1)).alias("__n"))
        ends = ends.withColumn("__end", F.sum("__n").over(self.across.rowsBetween(Window.unboundedPreceding, 0)))
        ends = ends.withColumn("__target", F.lead(BUCKET).over(self.across))
        near = Window.partitionBy(*self.partition_by).orderBy("__end").rangeBetween(-(size - 1), 0)
        ends = ends.withColumn("__from", F.collect_list(F.struct(F.col(BUCKET).alias("b"), F.col("__end").alias("e"))).over(near))
        loans = (
            ends.filter(F.col("__target").isNotNull())
            .select("__target", "__end", *self.partition_by, F.explode("__from").alias("__s"))
            .select(
                F.col("__s.b").alias("__l_" + BUCKET),
                *[F.col(c).alias(f"__l_{c}") for c in self.partition_by],
                "__target",
                (F.col("__end") - F.col("__s.e")).alias("__gap"),
            )
        )
        on = [tails[BUCKET] == loans[f"__l_{BUCKET}"]]
        on += [tails[c].eqNullSafe(loans[f"__l_{c}"]) for c in self.partition_by]
        on += [F.col("__back") - 1 + F.col("__gap") < size]
        halo = (
            tails.join(loans, reduce(lambda a, b: a & b, on))
            .withColumn(BUCKET, F.col("__target"))
            .select(*narrow.columns, F.lit(True).alias("__halo"))
        )
        rows = based.withColumn("__halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
        added = columns(self.local)
        rows = self.placed(rows).withColumns(added).filter(~F.col("__halo"))
        return rows.select(*keep, *added)


def _jsonable(value):
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else ("NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity")
    if isinstance(value, (bytes, bytearray)):
        import base64

        return base64.b64encode(value).decode()
    return str(value)
