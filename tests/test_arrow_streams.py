"""Arrow streams are split at their batches: dictionaries, compression, positions, cut files, finer times."""

import datetime as dt
import io

import pyarrow as pa
import pytest

from colforge.sources import arrow_ipc


@pytest.fixture
def arrow(spark):
    arrow_ipc.register(spark)
    return lambda **o: spark.read.format("arrow_ipc").option("layout", "stream").options(**o)


def write(path, batches, options=None):
    with pa.OSFile(str(path), "wb") as f, pa.ipc.new_stream(f, batches[0].schema, options=options) as w:
        for b in batches:
            w.write_batch(b)


def words(*columns):
    return [pa.record_batch({"i": pa.array([i, None], pa.int64()), "w": pa.array(c).dictionary_encode()}) for i, c in enumerate(columns)]


@pytest.mark.parametrize("codec", [None, "lz4", "zstd"])
def test_one_part_per_batch_with_dictionaries_and_compression(arrow, tmp_path, codec):
    options = pa.ipc.IpcWriteOptions(compression=codec, emit_dictionary_deltas=True)
    write(tmp_path / "a.arrows", words(["x", "y"], ["x", "y"], ["x", "z"], ["q", "x"], [None, "x"]), options)
    df = arrow(part_bytes="1", position="true").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 5
    got = sorted((r["__batch"], r["__row"], r.i, r.w) for r in df.collect())
    assert got == [(b, k, b if k == 0 else None, w) for b, ws in enumerate([["x", "y"], ["x", "y"], ["x", "z"], ["q", "x"], [None, "x"]]) for k, w in enumerate(ws)]


def test_small_batches_share_a_part_and_numbers_go_on(arrow, tmp_path):
    write(tmp_path / "a.arrows", [pa.record_batch({"i": [k]}) for k in range(50)])
    df = arrow(position="true").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 1
    assert sorted((r["__batch"], r.i) for r in df.collect()) == [(k, k) for k in range(50)]


def test_streams_without_batches_and_empty_batches(arrow, tmp_path):
    schema = pa.schema([("i", pa.int64())])
    with pa.OSFile(str(tmp_path / "a.arrows"), "wb") as f, pa.ipc.new_stream(f, schema):
        pass
    write(tmp_path / "b.arrows", [pa.record_batch({"i": pa.array([], pa.int64())}), pa.record_batch({"i": pa.array([7], pa.int64())})])
    assert [r.i for r in arrow(part_bytes="1").load(str(tmp_path)).collect()] == [7]


def test_old_streams_and_cut_streams():
    sink = io.BytesIO()
    batch = pa.record_batch({"i": list(range(100))})
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(use_legacy_format=True)) as w:
        w.write_batch(batch)
        w.write_batch(batch)
    data = sink.getvalue()
    kinds = [m.kind for m in arrow_ipc.stream_messages(pa.BufferReader(data))]
    assert kinds == [arrow_ipc.SCHEMA, arrow_ipc.BATCH, arrow_ipc.BATCH]
    with pytest.raises(ValueError, match="cut off"):
        arrow_ipc.stream_messages(pa.BufferReader(data[:-40]))


def test_nanoseconds_are_refused_or_cut(arrow, tmp_path):
    fine = pa.record_batch({"t": pa.array([1_700_000_000_123_456_789], pa.timestamp("ns"))})
    whole = pa.record_batch({"t": pa.array([1_700_000_000_123_456_000], pa.timestamp("ns"))})
    write(tmp_path / "fine.arrows", [fine])
    write(tmp_path / "whole.arrows", [whole])
    at = dt.datetime(2023, 11, 14, 22, 13, 20, 123456)
    assert arrow().load(str(tmp_path / "whole.arrows")).first().t == at
    assert arrow(nanoseconds="cut").load(str(tmp_path / "fine.arrows")).first().t == at
    with pytest.raises(Exception, match="does not fit into microseconds"):
        arrow().load(str(tmp_path / "fine.arrows")).collect()
