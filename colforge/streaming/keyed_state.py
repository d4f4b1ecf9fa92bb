"""Running figures per key over micro-batches, with the keys' state in Spark's state store.

A micro-batch goes two ways. Its rows are numbered and summed by the batch ordered scan, which spreads a hot key over
tasks. Beside them every task folds its rows to one line per key (last value, sum), and only these lines are shuffled to
the stateful operator, which keeps one small value per key: it gives out what the key stood at before the batch and
stores what it stands at after it. So a batch writes the state of the keys it holds and of no other, a key of any size
costs the stateful task one line per input task, and a key that stays away longer than `idle_ms` leaves the store.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from colforge.plans.ordered import OrderedScan, Previous, RunningSum
from colforge.session import materialize

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_ROWS = "spark.sql.streaming.noDataMicroBatches.enabled"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
LAST, TOTAL, CARRY = "__last", "__total", "__carry"


class _Standing(StatefulProcessor):
    """Per key: the last value and the total. Gives them out as they stood before the batch."""

    def __init__(self, order: Sequence[str], state: T.StructType, idle_ms: int | None):
        self.order, self.schema, self.idle_ms = list(order), state, idle_ms
        self.whole = isinstance(state[TOTAL].dataType, T.LongType)

    def init(self, handle) -> None:
        self.state = handle.getValueState("standing", self.schema, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        before = self.state.get() if self.state.exists() else None
        last, total = (before[0], before[1]) if before is not None else (None, None)
        newest = value = add = None
        for row in rows:
            place = tuple((row[c] is not None, row[c]) for c in self.order)
            if newest is None or _after(place, newest):
                newest, value = place, row[LAST]
            if row[TOTAL] is not None:
                add = row[TOTAL] if add is None else add + row[TOTAL]
        if add is not None and self.whole:
            add = int(add)
        after = total if add is None else add if total is None else total + add
        if self.whole and after is not None and not -(2**63) <= after < 2**63:
            raise OverflowError(f"the total of key {tuple(key)} leaves 64 bits")
        self.state.update((value, after))
        yield Row(**{f"__k{i}": k for i, k in enumerate(key)}, **{LAST: last, TOTAL: total})

    def close(self) -> None:
        pass


def _after(a: tuple, b: tuple) -> bool:
    """Whether place `a` comes behind `b`; a NULL comes before every value."""
    for (there, x), (known, y) in zip(a, b):
        if there != known:
            return there
        if there and x != y:
            return x > y
    return False


def _fold(keys: int, order: int, kind: pa.DataType):
    """The rows of a task to one line per key: its last place and value, and the sum."""
    behind = [f"__o{i}" for i in range(order)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t.append_column(TOTAL, t[LAST].cast(kind))
            held = t if held is None else pa.concat_tables([held, t])
            held = _last_of(held, keys, behind)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return fold


def _last_of(t: pa.Table, keys: int, behind: list[str]) -> pa.Table:
    names = [f"__k{i}" for i in range(keys)]
    t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in behind], null_placement="at_start"))
    some = pc.ScalarAggregateOptions(skip_nulls=True, min_count=1)
    places = t.append_column("__at", pa.array(range(len(t)), pa.int64()))
    done = places.group_by(names, use_threads=False).aggregate([("__at", "max"), (TOTAL, "sum", some)])
    sums = done[f"{TOTAL}_sum"].cast(t.schema.field(TOTAL).type)
    return t.take(done["__at_max"]).set_column(t.schema.get_field_index(TOTAL), TOTAL, sums)


def keyed_totals(stream: DataFrame, value: str, *, keys: Sequence[str], order_by: Sequence[str], output: str, idle_ms: int | None = None):
    """A writer that adds, per key, `delta` to the row before and the running `total`, across micro-batches.

    Rows are expected in order from batch to batch; `order_by` orders them inside a batch and has to be unique per key.
    NULL is a key like any other; a NULL value has no delta and no total and adds nothing, and the row behind it has no
    delta. `value` is a whole number (total: 64 bits, beyond them the query fails), a double or a decimal.

    With `idle_ms` a key that got no row for that long (by the clock) starts anew: no delta, total from zero.
    Output goes to `output/batch=<id>`, so a batch that is repeated after a failure overwrites its own rows; the store
    then gives the same carry again, since it goes back to the version of the batch before. Start it with `drain`,
    or inside `state_store`.
    """
    keys, order_by = list(keys), list(order_by)
    kind = stream.schema[value].dataType
    if isinstance(kind, T.IntegralType):
        total, added, arrow = T.LongType(), T.DecimalType(38, 0), pa.decimal128(38, 0)
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        total, added, arrow = T.DoubleType(), T.DoubleType(), pa.float64()
    elif isinstance(kind, T.DecimalType):
        total = added = T.DecimalType(38, kind.scale)
        arrow = pa.decimal128(38, kind.scale)
    else:
        raise ValueError(f"{value} is no number")
    named = {f"__k{i}": F.col(k) for i, k in enumerate(keys)}
    behind = {f"__o{i}": F.col(c) for i, c in enumerate(order_by)}
    narrow = stream.select(*(c.alias(n) for n, c in (named | behind).items()), F.col(value).alias(LAST))
    partial = T.StructType([*narrow.schema.fields, T.StructField(TOTAL, added)])
    state = T.StructType([T.StructField(LAST, kind), T.StructField(TOTAL, total)])
    carried = T.StructType([*(T.StructField(n, stream.schema[k].dataType) for n, k in zip(named, keys)), *state.fields])
    lines = narrow.mapInArrow(_fold(len(keys), len(order_by), arrow), partial)
    stood = lines.groupBy(*named).transformWithState(
        _Standing(list(behind), state, idle_ms), carried, "Append", "ProcessingTime" if idle_ms else "None"
    )
    # One micro-batch brings the rows and what their keys stood at; both branches read the same offsets.
    both = stream.withColumn(CARRY, F.lit(False)).unionByName(stood.withColumn(CARRY, F.lit(True)), allowMissingColumns=True)
    columns = stream.columns

    def process(batch: DataFrame, batch_id: int) -> None:
        stored = materialize(batch)
        rows = stored.where(~F.col(CARRY)).select(*columns)
        scan = OrderedScan(rows, order_by, keys)
        placed = scan.add({"__prev": Previous(F.struct(value)), "__sum": RunningSum(F.col(value).cast(total), "total")})
        carry = stored.where(CARRY).select(*named, LAST, TOTAL)
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for n, k in zip(named, keys)))
        prior = F.when(F.col("__prev").isNotNull(), F.col(f"__prev.{value}")).otherwise(F.col(LAST))
        running = (F.coalesce(F.col(TOTAL), F.lit(0).cast(total)) + F.col("__sum")).cast(total)
        done = placed.join(carry, same, "left").select(
            *columns, F.try_subtract(F.col(value), prior).alias("delta"), F.when(F.col(value).isNotNull(), running).alias("total")
        )
        done.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return both.writeStream.foreachBatch(process).outputMode("append")


@contextmanager
def state_store(spark):
    """Settings for queries started inside; what the session had comes back after.

    Stateful processors need the RocksDB store; with its change log a batch writes the changed keys only. Batches without rows are off: with idle times Spark would ask for
    another one after each, so that work on what is available now would never end.
    """
    wanted = {PROVIDER: ROCKS, CHANGELOG: "true", NO_ROWS: "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(spark, writer, checkpoint: str) -> None:
    """Work through everything available now and stop; a later call goes on from the checkpoint."""
    with state_store(spark):
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
