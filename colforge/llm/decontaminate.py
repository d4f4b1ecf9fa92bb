"""Benchmark decontamination by spaced seeds.

A mask looks at some of the next tokens and ignores the rest, so a replaced token under a gap does not hide a shared
passage. Every token position of every benchmark item and of every document gives one hash per mask. Documents' hashes
meet a Bloom filter of the benchmark's hashes (fixed size, whatever the benchmark) while the texts are read in place;
only positions that pass leave the task, with the tokens around them. These are joined to the benchmark's hashes, and
each pair of document and item on one diagonal is verified: the best run of aligned tokens, where a match counts 1 and
a replaced token costs SUBSTITUTION.

A document is contaminated by an item when such a run has at least `least` matching tokens, or 80 % of the item's
tokens where the item is shorter. Tokens are runs of letters and digits (characters beyond ASCII belong to tokens),
A-Z as a-z. Items shorter than the widest mask are looked up whole, exactly; items of fewer than SHORTEST tokens, null
items and null or empty texts match nothing. Rows with equal doc_id or item_id count together; rows with a null id are
found and reported under null. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colforge.llm.common import by_batch, materialize, mix, prepare
from colforge.llm.words import ALPHANUMERIC, column_words, small_batches

# Each mask has weight 6; together they see through replacements at every second, third, fourth, fifth place or beyond.
MASKS = ("111111", "11011011", "10101010101", "1110111", "11110011", "1101001011", "1001001001001001")
SHORTEST = 5
SUBSTITUTION = 1.5
FILTER_BITS = 1 << 25
FILTER_HASHES = 3


def _offsets(masks: list[str]) -> list[np.ndarray]:
    return [np.flatnonzero(np.array(list(m)) == "1") for m in masks]


def _seeds(words: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """Hash under one mask for every position where the whole mask fits."""
    n = len(words) - int(offsets[-1])
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for k in offsets:
        out = (out + words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def _filter_places(seeds: np.ndarray) -> np.ndarray:
    """Bits of the filter, one row per hash."""
    shift = np.arange(FILTER_HASHES, dtype=np.uint64)[:, None] * np.uint64(21)
    return (mix(seeds)[None] >> shift).astype(np.int64) % FILTER_BITS


def index(items: DataFrame, least: int) -> tuple[DataFrame, DataFrame, np.ndarray, list[str], int]:
    """Benchmark tokens per item, its seeds, the filter, the masks in use, and the number of tokens of the longest item."""

    def tokens(batch: pa.RecordBatch):
        words, at = column_words(batch.column(1), ALPHANUMERIC)
        n = np.diff(at)
        held = [words[at[k] : at[k + 1]].tobytes() for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(held, pa.binary())], names=["item_id", "n", "tokens"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    held = materialize(rows.mapInArrow(by_batch(tokens), "item_id long, n long, tokens binary").where(F.col("n") >= SHORTEST).withColumn("item", F.xxhash64("item_id", "tokens")))
    widest = max(map(len, MASKS))
    short = sorted(r["n"] for r in held.where(F.col("n") < widest).select("n").distinct().collect())  # fewer than `widest` rows
    masks = [*MASKS, *("1" * n for n in short)]
    offsets = _offsets(masks)

    def seed(batch: pa.RecordBatch):
        item, n, data = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        out = []
        for k in range(batch.num_rows):
            words = np.frombuffer(data[k].as_buffer(), np.uint64)
            for m, places in enumerate(offsets):
                if m >= len(MASKS) and len(masks[m]) != n[k]:
                    continue
                seeds = _seeds(words, places, m)
                out += [(s, item[k], p) for p, s in enumerate(seeds.view(np.int64).tolist())]
        columns = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["seed", "item", "place"])

    seeds = materialize(held.select("item", "n", "tokens").mapInArrow(by_batch(seed), "seed long, item long, place long"))

    def bits(batch: pa.RecordBatch):
        places = np.unique(_filter_places(batch.column(0).to_numpy().view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(places >> 3, pa.int64()), pa.array(1 << (places & 7), pa.int64())], names=["byte", "bit"])

    got = seeds.select("seed").mapInArrow(by_batch(bits), "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    bloom = np.zeros(FILTER_BITS >> 3, np.uint8)  # at most so many rows were fetched
    bloom[got["byte"].to_numpy()] = got["bits"].to_numpy().astype(np.uint8)
    longest = held.agg(F.max("n")).first()[0] or 0
    return held, seeds, bloom, masks, int(longest)


def _best_run(same: np.ndarray) -> tuple[int, int, int]:
    """(matches, start, end) of the run with the highest score."""
    score = np.cumsum(np.where(same, 1.0, -SUBSTITUTION))
    before = np.minimum.accumulate(np.r_[0.0, score[:-1]])
    end = int((score - before).argmax())
    start = int(np.r_[0.0, score[: end + 1]][: end + 1].argmin())
    return int(same[start : end + 1].sum()), start, end + 1


def contaminated(docs: DataFrame, items: DataFrame, least: int = 10) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, matched, doc_start, doc_end, item_start (in tokens)."""
    spark = prepare(docs.sparkSession)
    held, seeds, bloom, masks, longest = index(items, least)
    shared = spark.sparkContext.broadcast(bloom)
    offsets = _offsets(masks)

    def look(batch: pa.RecordBatch):
        bits = shared.value
        for part in small_batches(batch, 1):
            words, at = column_words(part.column(1), ALPHANUMERIC)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for m, places in enumerate(offsets):
                hashes = _seeds(words, places, m)
                if not len(hashes):
                    continue
                at_bits = _filter_places(hashes)
                passed = np.flatnonzero(reduce(np.logical_and, [bits[row >> 3] >> (row & 7) & 1 for row in at_bits]))
                # Not those that reach into the next text.
                passed = passed[np.searchsorted(at, passed, "right") == np.searchsorted(at, passed + places[-1], "right")]
                found.append((passed, hashes[passed]))
            if not found or not sum(len(p) for p, _ in found):
                continue
            place, seed = np.concatenate([p for p, _ in found]), np.concatenate([s for _, s in found])
            order = np.argsort(place, kind="stable")
            place, seed = place[order], seed[order]
            doc = np.searchsorted(at, place, "right") - 1
            # Hits whose surroundings overlap share one stretch of tokens.
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > 2 * longest)])
            ids = part.column(0).to_pylist()
            rows = []
            for lo, hi in zip(new, np.r_[new[1:], len(place)]):
                d = int(doc[lo])
                start, end = max(int(at[d]), int(place[lo]) - longest), min(int(at[d + 1]), int(place[hi - 1]) + longest + 1)
                hits = [{"seed": s, "place": p} for s, p in zip(seed[lo:hi].view(np.int64).tolist(), (place[lo:hi] - at[d]).tolist())]
                rows.append((ids[d], start - int(at[d]), words[start:end].tobytes(), hits))
            columns = list(zip(*rows))
            kind = pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], kind)],
                names=["doc_id", "first", "tokens", "hits"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stretches = rows.mapInArrow(by_batch(look), "doc_id long, first long, tokens binary, hits array<struct<seed:long,place:long>>")
    stretches = materialize(stretches.withColumn("stretch", F.xxhash64("doc_id", "first", "tokens")))
    hits = stretches.select("stretch", F.explode("hits").alias("h")).select("stretch", "h.seed", "h.place")
    pairs = hits.join(seeds.withColumnRenamed("place", "at"), "seed").select("stretch", "item", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    pairs = pairs.join(stretches.select("stretch", "doc_id", "first", "tokens").dropDuplicates(["stretch"]), "stretch")
    pairs = pairs.join(held.dropDuplicates(["item"]).select("item", "item_id", F.col("tokens").alias("wanted")), "item")

    def verify(batch: pa.RecordBatch):
        out = []
        tokens, wanted = batch.column(4), batch.column(5)
        for k, (doc_id, item_id, first, diagonal) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
            text, item = np.frombuffer(tokens[k].as_buffer(), np.uint64), np.frombuffer(wanted[k].as_buffer(), np.uint64)
            # Item token i lies beside the document's token i + diagonal.
            lo, hi = max(0, first - diagonal), min(len(item), first + len(text) - diagonal)
            if lo >= hi:
                continue
            same = item[lo:hi] == text[lo + diagonal - first : hi + diagonal - first]
            matched, start, end = _best_run(same)
            if matched >= min(least, -(-8 * len(item) // 10)):
                out.append((doc_id, item_id, matched, lo + start + diagonal, lo + end + diagonal, lo + start))
        columns = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "matched", "doc_start", "doc_end", "item_start"])

    schema = "doc_id long, item_id long, matched long, doc_start long, doc_end long, item_start long"
    runs = pairs.select("doc_id", "item_id", "first", "diagonal", "tokens", "wanted").mapInArrow(by_batch(verify), schema)
    best = F.max(F.struct("matched", (-F.col("doc_start")).alias("s"), (-F.col("doc_end")).alias("e"), (-F.col("item_start")).alias("i"))).alias("b")
    best = runs.groupBy("doc_id", "item_id").agg(best)
    return best.select("doc_id", "item_id", "b.matched", (-F.col("b.s")).alias("doc_start"), (-F.col("b.e")).alias("doc_end"), (-F.col("b.i")).alias("item_start"))
