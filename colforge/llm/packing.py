"""Best-fit packing of documents into sequences, planned by a configuration linear program.

A configuration is a multiset of lengths that fits a sequence. The program (as few sequences as cover the histogram of
lengths) is solved by multiplicative weights: each phase prices the lengths, a knapsack table finds the best
configuration around every length, lengths covered too often become cheaper. The average of the phases is rounded to
whole sequences, what is left over is placed best-fit, largest first, also on the histogram.

The plan works on at most `capacity` counts, whatever the number of documents, so it is made on the driver. Pieces
are then numbered within their length and meet their slot by (length, number), spread over all tasks.

Null texts are empty and take one token, the end id. Rows with equal or null doc_id are packed each for itself; the
order among pieces of equal length is free. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colforge.llm.common import by_batch, materialize, prepare
from colforge.llm.encoder import encoder

PHASES = 24
LEARNING_RATE = 0.6


@dataclass
class Plan:
    """Runs of equal sequences: run k has `copies[k]` sequences from `first[k]` on, each holding `lengths[k]` in order."""

    copies: list[int]
    lengths: list[tuple[int, ...]]

    @property
    def sequences(self) -> int:
        return sum(self.copies)

    def slots(self) -> dict[str, np.ndarray]:
        """Sorted by (length, from): pieces `start` .. `start + copies - 1` of a length go to sequences first, first + 1, ..."""
        rows, first = [], 0
        for copies, lengths in zip(self.copies, self.lengths):
            offset = 0
            for length in lengths:
                rows.append((length, copies, first, offset))
                offset += length
            first += copies
        table = np.array(rows, np.int64).reshape(-1, 4)
        table = table[np.argsort(table[:, 0], kind="stable")]
        length, copies, first, offset = table.T
        total = np.cumsum(copies) - copies
        new = np.r_[True, length[1:] != length[:-1]] if len(length) else np.zeros(0, bool)
        start = total - np.repeat(total[new], np.diff(np.r_[np.flatnonzero(new), len(length)])) if len(length) else total
        return {"length": length, "start": start, "first": first, "offset": offset}


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value per capacity, and the index of the length to take first (-1: none)."""
    value, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, room, "right"))
        value[room], take[room] = value[room - 1], -2
        if n:
            found = prices[:n] + value[room - lengths[:n]]
            k = int(found.argmax())
            if found[k] > value[room]:
                value[room], take[room] = found[k], k
    return value, take


def _around(k: int, lengths: np.ndarray, take: np.ndarray, capacity: int) -> tuple[int, ...]:
    """The best configuration that holds length k, as sorted indices."""
    held, room = [k], capacity - int(lengths[k])
    while room > 0:
        t = int(take[room])
        if t == -2:
            room -= 1
        elif t < 0:
            break
        else:
            held.append(t)
            room -= int(lengths[t])
    return tuple(sorted(held, reverse=True))


def solve(histogram: dict[int, int], capacity: int, phases: int = PHASES) -> dict[tuple[int, ...], float]:
    """Fractional covering of the histogram: sequences per configuration (tuples of lengths)."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], float)
    weights = np.ones(len(lengths))
    out: dict[tuple[int, ...], float] = {}
    for _ in range(phases):
        value, take = _knapsack(lengths, weights * lengths / capacity, capacity)
        covered = np.zeros(len(lengths))
        for k in range(len(lengths) - 1, -1, -1):
            if covered[k] >= counts[k] - 1e-9:
                continue
            held = _around(k, lengths, take, capacity)
            times = (counts[k] - covered[k]) / held.count(k)
            for i in held:
                covered[i] += times
            config = tuple(int(lengths[i]) for i in held)
            out[config] = out.get(config, 0.0) + times / phases
        # Lengths that are covered more than asked become cheaper, the others relatively dearer.
        over = np.minimum(covered / counts - 1, 4.0)
        weights *= np.exp(-LEARNING_RATE * over / 4)
        weights /= weights.max()
        weights = np.maximum(weights, 0.05)
    return out


def plan(histogram: dict[int, int], capacity: int, phases: int = PHASES) -> Plan:
    """Whole sequences for every counted piece."""
    left = {k: v for k, v in histogram.items() if v}
    copies, lengths = [], []
    if capacity in left:
        copies.append(left.pop(capacity))
        lengths.append((capacity,))
    by_seed: dict[int, list] = {}
    for config, times in solve(left, capacity, phases).items() if left else ():
        by_seed.setdefault(max(config), []).append((capacity - sum(config), config, times))
    # Whole numbers by carrying the fraction on within the configurations of one largest length.
    chosen = []
    for seed in by_seed.values():
        carried = 0.0
        for waste, config, times in sorted(seed):
            whole = int(carried + times)
            carried += times - whole
            if whole:
                chosen.append((waste, config, whole))
    for _, config, whole in sorted(chosen, key=lambda c: (c[0], -max(c[1]))):
        need = {x: config.count(x) for x in set(config)}
        whole = min(whole, *(left.get(x, 0) // n for x, n in need.items()))
        if whole:
            copies.append(whole)
            lengths.append(config)
            for x, n in need.items():
                left[x] -= n * whole
    runs = _best_fit(left, capacity, list(zip(lengths, copies)))
    return Plan([n for _, n in runs], [config for config, _ in runs])


def _best_fit(left: dict[int, int], capacity: int, begun: list[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Largest first into the fullest sequence that has room, begun ones included, for groups of equal sequences at once."""
    by_room: list[list] = [[] for _ in range(capacity + 1)]
    for held, many in begun:
        by_room[capacity - sum(held)].append((held, many))
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        n = left[length]
        while n:
            room = next((r for r in range(length, capacity) if by_room[r]), None)
            if room is None:
                each = min(n, capacity // length)
                whole = n // each
                by_room[capacity - each * length].append(((length,) * each, whole))
                n -= whole * each
                continue
            held, many = by_room[room].pop()
            each = min(room // length, max(1, n // many))
            used = min(many, n // each)
            if many > used:
                by_room[room].append((held, many - used))
            by_room[room - each * length].append((held + (length,) * each, used))
            n -= used * each
    return [group for groups in by_room for group in groups]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; texts are read where they lie, without a shuffle."""
    prepare(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")
    step = 4 * capacity

    def cut(batch: pa.RecordBatch):
        rows = []
        for doc_id, tokens in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1).to_pylist())):
            tokens += end
            for piece, at in enumerate(range(0, len(tokens), step)):
                part = tokens[at : at + step]
                rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_batch(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    held = materialize(pieces(docs, tokenizer, capacity, end_id).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1024))))
    counts = materialize(held.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = plan(histogram, capacity).slots() if histogram else {k: np.zeros(0, np.int64) for k in ("length", "start", "first", "offset")}
    # Numbers within a length: local ones in 1024 parts of it (a length may hold a third of all pieces), then the parts' totals.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")
    local = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = held.withColumn("number", F.row_number().over(local).cast("long")).join(base, ["length", "part"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") - 1 + F.col("base")).alias("number"))
    shared = held.sparkSession.sparkContext.broadcast(slots)  # a bounded number of runs, from at most `capacity` lengths

    def place(batch: pa.RecordBatch):
        s = shared.value
        length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
        first = np.searchsorted(s["length"], length, "left")
        key = s["length"] << np.int64(44) | s["start"]
        at = np.maximum(np.searchsorted(key, length << np.int64(44) | number, "right") - 1, first)
        sequence = s["first"][at] + number - s["start"][at]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(s["offset"][at])], names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(by_batch(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
