"""Duplicate groups of rows.

Every group is folded to one small row before groups are compared, so neither a huge group nor a huge
class of equal groups is ever collected in one place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colforge.functions.rows import row_hash, without
from colforge.operators.groups import empty
from colforge.plans.ordered import OrderedScan, RowIndex, Runs
from colforge.session import broadcast_if_small, materialize

FULL, FIRST_ROW = "full", "first_row"


def _fold(place: Column, content: Column) -> list[Column]:
    """Two independent 64-bit sums of (place, content) hashes, combined by xor: order-aware, mergeable
    map-side, constant memory per group."""
    return [
        F.bit_xor(F.xxhash64(place, content)).alias("sig_a"),
        F.bit_xor(F.xxhash64(content, F.lit("second"), place)).alias("sig_b"),
        F.count(F.lit(1)).alias("rows"),
    ]


def _signature() -> Column:
    return F.concat_ws("-", F.hex("sig_a"), F.hex("sig_b"), F.col("rows").cast("string"))


class DuplicateGroups:
    """Groups of rows (by `group_column`) with equal content.

    `mode`: "full" compares all rows of a group in order, "first_row" only its first row.
    `ignore`: column names or `*` patterns that do not count as content. Rows without a group are skipped.
    `keep`: which group of a class stays in `clean()`: "first" by row order, or "min_id_text".
    With `null_equals_null=False` a group with a NULL in its content equals no other group.
    """

    def __init__(
        self,
        df: DataFrame,
        group_column: str,
        *,
        order_by: str | Sequence[str],
        ignore: Sequence[str] = (),
        mode: str = FULL,
        keep: str = "first",
        null_equals_null: bool = True,
    ):
        if group_column not in df.columns:
            raise ValueError(f"no such column: {group_column}")
        if mode not in (FULL, FIRST_ROW) or keep not in ("first", "min_id_text"):
            raise ValueError("mode is full or first_row, keep is first or min_id_text")
        self.df, self.group = df, group_column
        self.order_by = [order_by] if isinstance(order_by, str) else list(order_by)
        self.mode, self.keep, self.null_equals_null = mode, keep, null_equals_null
        self.content = [c for c in without(df, ignore) if c != group_column]
        if not self.content:
            raise ValueError("no column left to compare")

    @cached_property
    def groups(self) -> DataFrame:
        """One row per group: group, signature, rows, first_key, last_key."""
        any_null = F.greatest(*[F.col(c).isNull() for c in self.content], F.lit(False))
        narrow = self.df.filter(F.col(self.group).isNotNull()).select(
            F.col(self.group).alias("group"),
            *[F.col(c).alias(f"k{i}") for i, c in enumerate(self.order_by)],
            row_hash(self.content).alias("content"),
            any_null.alias("has_null"),
        )
        keys = [f"k{i}" for i in range(len(self.order_by))]
        key = F.struct(*keys)
        ends = [F.min(key).alias("first_key"), F.max(key).alias("last_key")]
        if self.mode == FULL:
            placed = OrderedScan(narrow, keys, "group").add({"place": RowIndex()})
            folded = placed.groupBy("group").agg(
                *_fold(F.col("place"), F.col("content")), F.max("has_null").alias("has_null"), *ends
            )
            signature = _signature()
        else:
            first = F.min_by(F.struct("content", "has_null"), key)
            folded = narrow.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), first.alias("f"), *ends)
            folded = folded.select("group", "rows", "first_key", "last_key", "f.content", "f.has_null")
            signature = F.col("content")
        if not self.null_equals_null:
            signature = F.when(F.col("has_null"), F.concat_ws("-", signature, F.col("group").cast("string"))).otherwise(signature)
        return materialize(folded.select("group", signature.alias("signature"), "rows", "first_key", "last_key"))

    @property
    def _patterns(self) -> DataFrame:
        """One row per distinct content."""
        rank = F.struct("first_key", "group") if self.keep == "first" else F.struct(F.col("group").cast("string"), "group")
        return self.groups.groupBy("signature").agg(
            F.count(F.lit(1)).alias("groups"),
            F.sum("rows").alias("rows"),
            F.min(F.col("rows")).alias("group_size"),
            F.min(rank).getField("group").alias("first_group"),
        )

    def classes(self) -> DataFrame:
        """Contents shared by more than one group: signature, first_group, groups, rows, group_size."""
        return self._patterns.filter("groups > 1")

    def members(self) -> DataFrame:
        """Every group of every class: signature, first_group, group, rows, first_key, last_key, kept."""
        classes = self.classes().select("signature", "first_group")
        return self.groups.join(classes, "signature").withColumn("kept", F.col("group") == F.col("first_group"))

    def statistics(self) -> DataFrame:
        """One row: groups, unique contents, classes, rows and groups in classes, rows a clean table drops."""
        dup = F.col("groups") > 1
        first = self.groups.select(F.col("group").alias("first_group"), F.col("rows").alias("kept_rows"))
        kept = self.classes().join(first, "first_group").agg(F.coalesce(F.sum("kept_rows"), F.lit(0))).scalar()
        dup_rows = F.coalesce(F.sum(F.when(dup, F.col("rows"))), F.lit(0))
        return self._patterns.agg(
            F.coalesce(F.sum("groups"), F.lit(0)).alias("groups"),
            F.count(F.lit(1)).alias("unique_groups"),
            F.count_if(dup).alias("classes"),
            F.coalesce(F.sum(F.when(dup, F.col("groups"))), F.lit(0)).alias("groups_in_classes"),
            dup_rows.alias("rows_in_classes"),
        ).withColumn("dropped_rows", F.col("rows_in_classes") - kept)

    def clean(self) -> DataFrame:
        """The table without the later copies; rows without a group stay."""
        losers = self.members().filter("NOT kept").select(F.col("group").alias("__loser"))
        losers = broadcast_if_small(losers)
        return self.df.join(losers, F.col(self.group) == F.col("__loser"), "left_anti")

    def frequency(self) -> DataFrame:
        """How many contents occur once, twice, …: copies, patterns, groups, percent of all groups."""
        total = self.groups.agg(F.count(F.lit(1))).scalar()
        counts = self._patterns.groupBy(F.col("groups").alias("copies")).agg(F.count(F.lit(1)).alias("patterns"))
        return counts.withColumn("groups", F.col("copies") * F.col("patterns")).withColumn(
            "percent", F.try_divide(F.col("groups") * 100.0, total)
        )


def marker_blocks(df: DataFrame, marker: str, *, order_by, out="block", place=None, buckets=None) -> DataFrame:
    """Number blocks from 0; each row with an empty marker starts one. Rows before the first block are dropped."""
    hit = empty(F.col(marker), df.schema[marker].dataType)
    runs = Runs(hit, lambda p, c: c, initial=lambda s: s)
    derive = {out: lambda r: r["__b"] - 1}
    if place:
        derive[place] = lambda r: r["__b.position"]
    return OrderedScan(df, order_by, (), buckets).add({"__b": runs}, derive).filter(F.col(out) >= 0)


class DuplicateBlocks(DuplicateGroups):
    """Duplicate blocks found by an empty marker column; the place in the block comes from the same pass."""

    def __init__(self, df: DataFrame, marker: str, *, order_by, ignore=("*time*",), keep="first"):
        order_by = [order_by] if isinstance(order_by, str) else list(order_by)
        content = without(df, ignore)
        blocked = marker_blocks(df, marker, order_by=order_by, place="__place")
        super().__init__(blocked, "block", order_by=order_by, ignore=["__place", *ignore], keep=keep)
        self.content = content

    @cached_property
    def groups(self) -> DataFrame:
        key = F.struct(*self.order_by)
        folded = self.df.groupBy(F.col("block").alias("group")).agg(
            *_fold(F.col("__place"), row_hash(self.content)), F.min(key).alias("first_key"), F.max(key).alias("last_key")
        )
        return materialize(folded.select("group", _signature().alias("signature"), "rows", "first_key", "last_key"))

    def clean(self) -> DataFrame:
        return super().clean().drop("block", "__place")


def identical_runs(df: DataFrame, *, order_by, ignore: Sequence[str] = (), buckets=None) -> DataFrame:
    """Runs of more than one equal row in a row: run, signature, rows, first_key, last_key."""
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    content = [c for c in without(df, ignore) if c not in order_by]
    narrow = df.select(*order_by, row_hash(content).alias("signature"))
    runs = Runs(F.col("signature"), lambda p, c: p != c)
    key = F.struct(*order_by)
    numbered = OrderedScan(narrow, order_by, (), buckets).add({"run": runs})
    sized = numbered.groupBy("run").agg(
        F.min("signature").alias("signature"),
        F.count(F.lit(1)).alias("rows"),
        F.min(key).alias("first_key"),
        F.max(key).alias("last_key"),
    )
    return sized.filter("rows > 1")


def run_statistics(runs: DataFrame) -> DataFrame:
    """One row: runs, smallest, largest and mean run, rows in runs, contents that come back in another run."""
    again = runs.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.min("rows").alias("lo"), F.max("rows").alias("hi"))
    return again.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("runs"),
        F.min("lo").alias("min_size"),
        F.max("hi").alias("max_size"),
        F.try_divide(F.sum("rows"), F.sum("n")).alias("avg_size"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_in_runs"),
        F.count_if(F.col("n") > 1).alias("repeated_contents"),
    )
