"""Running figures per key from the state store: against a plain loop, over restarts, with idle keys and a hot key."""

import glob
import os
import random
import time
from decimal import Decimal

import pytest

from colforge.streaming import keyed_state


@pytest.fixture(autouse=True)
def two_state_tasks(spark):
    """Each state partition is a Python worker and a store; two are enough to tell keys apart."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain(batches):
    last, total, out = {}, {}, {}
    for batch in batches:
        for i, k, v in sorted(batch):
            delta = None if v is None or last.get(k) is None else v - last[k]
            last[k] = v
            if v is not None:
                total[k] = total.get(k, 0) + v
            out[i] = (delta, total[k] if v is not None else None)
    return out


def run(spark, folder, batches, schema="i long, k string, v long", **options):
    """One drain per batch: every batch but the first starts from the checkpoint of a stopped query."""
    for part, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).repartition(3).write.parquet(f"{folder}/in/part{part}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in/*")
        writer = keyed_state.keyed_totals(stream, "v", keys=["k"], order_by=["i"], output=f"{folder}/out", **options)
        keyed_state.drain(spark, writer, f"{folder}/cp")
    return {r.i: (r.delta, r.total) for r in spark.read.parquet(f"{folder}/out").collect()}


def rows(n, seed, key):
    r = random.Random(seed)
    return [(seed * 10_000 + i, key(r), r.choice([None, 1, 5, -9, 2**40])) for i in range(n)]


def test_equals_a_plain_loop_over_restarts_with_null_and_hot_keys(spark, tmp_path):
    key = lambda r: r.choice(["hot", "hot", "hot", None, *"abcdefgh"])
    batches = [rows(300, s, key) for s in range(3)]
    assert run(spark, str(tmp_path), batches) == plain(batches)


def test_only_the_keys_of_a_batch_are_written(spark, tmp_path):
    batches = [[(i, f"k{i}", 1) for i in range(200)], [(1000, "k7", 2)], [(1001, "k7", 4), (1002, "new", 1)]]
    got = run(spark, str(tmp_path), batches)
    assert got[1000] == (1, 3) and got[1001] == (2, 7) and got[1002] == (None, 1)
    # A batch brings the state of its own keys: one row per key that it holds.
    assert spark.read.parquet(f"{tmp_path}/out/batch=2").count() == 2
    with keyed_state.state_store(spark):
        state = spark.read.format("statestore").option("stateVarName", "standing")
        assert state.load(f"{tmp_path}/cp").count() == 201
        changes = state.option("readChangeFeed", True).option("changeStartBatchId", 2).load(f"{tmp_path}/cp")
        assert sorted(r.key["__k0"] for r in changes.select("key").collect()) == ["k7", "new"]


def test_idle_keys_expire(spark, tmp_path):
    first = [[(1, "a", 5), (2, "b", 7)]]
    run(spark, str(tmp_path), first, idle_ms=1500)
    time.sleep(3)
    spark.createDataFrame([(3, "a", 1)], "i long, k string, v long").write.parquet(f"{tmp_path}/in/later")
    stream = spark.readStream.schema("i long, k string, v long").parquet(f"{tmp_path}/in/*")
    writer = keyed_state.keyed_totals(stream, "v", keys=["k"], order_by=["i"], output=f"{tmp_path}/out", idle_ms=1500)
    keyed_state.drain(spark, writer, f"{tmp_path}/cp")
    got = {r.i: (r.delta, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (None, 5), 2: (None, 7), 3: (None, 1)}


def test_a_repeated_batch_gives_the_same_rows(spark, tmp_path):
    batches = [[(1, "a", 5), (2, None, 7)], [(3, "a", 1), (4, None, 2)]]
    want = run(spark, str(tmp_path), batches)
    # As after a crash between writing rows and closing the batch: its commit is not there.
    last = max(int(n) for n in os.listdir(f"{tmp_path}/cp/commits") if n.isdigit())
    for path in glob.glob(f"{tmp_path}/cp/commits/*{last}*") + glob.glob(f"{tmp_path}/cp/commits/.*{last}*"):
        os.unlink(path)
    stream = spark.readStream.schema("i long, k string, v long").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in/*")
    writer = keyed_state.keyed_totals(stream, "v", keys=["k"], order_by=["i"], output=f"{tmp_path}/out")
    keyed_state.drain(spark, writer, f"{tmp_path}/cp")
    assert {r.i: (r.delta, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want == plain(batches)


@pytest.mark.parametrize("kind, one, two", [("double", 1.5, 2.25), ("decimal(12,2)", Decimal("1.10"), Decimal("2.05"))])
def test_other_numbers(spark, tmp_path, kind, one, two):
    batches = [[(1, "a", one)], [(2, "a", two)]]
    assert run(spark, str(tmp_path), batches, f"i long, k string, v {kind}") == {1: (None, one), 2: (two - one, one + two)}


def test_folded_lines_do_not_grow_with_the_rows(spark):
    import pyarrow as pa

    t = pa.table({"__k0": ["x", None] * 5000, "__o0": list(range(10000)), "__last": [1] * 10000})
    fold = keyed_state._fold(1, 1, pa.decimal128(38, 0))
    out = pa.Table.from_batches(list(fold(iter(t.to_batches(max_chunksize=1000))))).to_pylist()
    assert sorted((r["__o0"], int(r["__total"])) for r in out) == [(9998, 5000), (9999, 5000)]
