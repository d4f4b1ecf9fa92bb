"""Near-duplicate documents by SetSketch registers: band, estimate by likelihood, verify on the full sets.

A document's set holds its distinct shingles of `words` words (the whole sequence when it is shorter). A register is
the exponentially spaced, truncated minimum of one hash over the set: floor(1 - log_BASE(minimum of exponential
variables)), so two sketches merge by the larger register and equal registers are as likely as the sets are similar.

1. One pass over the texts makes sketches and a 128-bit signature of each set. Equal sets form a class under their
   smallest doc_id; only classes go on.
2. Bands of ROWS registers are hashed; classes that share a band are candidates. A band can hold any number of classes,
   so their pairs are never listed: its members are compared with PIVOTS of them, and each member keeps, per pivot
   order, the most similar pivot whose estimate may reach the threshold. These pairs are verified on the full sets and
   joined to components. Members in one component need no further comparison.
3. Groups tied by bands that still hold several components are compared completely, sketch against sketch, in blocks of
   bounded size: members outside the group's largest component against all members. Within a block the pairs that may
   reach the threshold are verified on the full sets, most similar first; pairs that verified links of the block already
   join are passed over. A block returns at most one link per member, whatever the number of similar pairs.

The estimate maximises the joint likelihood of larger, smaller and equal registers given both set sizes. A pair is put
aside when it lies MARGIN (over four standard deviations) below the threshold; with BANDS x ROWS registers a pair at
similarity 0.8 shares no band with probability 3e-6. Shingles count as equal when their 64-bit hashes are.

Null and empty texts have no set and are linked with nothing. Rows with equal doc_id share one component. Rows with a
null doc_id are not compared: their component is null and they are kept. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colforge.llm.common import by_batch, components, materialize, mix, prepare
from colforge.llm.words import BY_SPACE, column_words, small_batches

ROWS, BANDS = 6, 42
REGISTERS = ROWS * BANDS
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 2
MARGIN = 0.11
PIVOTS = 2
BLOCK = 2048
BLOCK_BYTES = 12 << 20
# Rows of one array of hashes that are held at a time, times REGISTERS.
HASHED_AT_ONCE = 1024

_random = np.random.default_rng(3)
_FACTORS = _random.integers(0, 1 << 64, REGISTERS, np.uint64) | np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 64, REGISTERS, np.uint64)
_BAND_FACTORS = _random.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of all words if there are fewer."""
    n = min(size, len(words))
    if not n:
        return words
    runs = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        runs = mix(runs + words[k : len(words) - n + 1 + k] * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(runs)


def registers(items: np.ndarray) -> np.ndarray:
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(items), HASHED_AT_ONCE):
        hashed = items[start : start + HASHED_AT_ONCE, None] * _FACTORS
        hashed ^= hashed >> np.uint64(31)
        hashed += _SHIFTS
        np.minimum(least, hashed.min(0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LARGEST + 1).astype("<u2")


def bands(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.reshape(BANDS, ROWS).astype(np.uint64)
    return mix(mix((rows * _BAND_FACTORS).sum(1)) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def estimate(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely similarity, from the numbers of registers of a above and below those of b, and the set sizes."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    equal = REGISTERS - larger - smaller
    chance = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        p, q = np.maximum(chance(u - v * j), 1e-12), np.maximum(chance(v - u * j), 1e-12)
        return larger * np.log(p) + smaller * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood has one top
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = likelihood(a) > likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _similar(a, b, n_a, n_b, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates, and which pairs may reach the threshold."""
    guess = estimate((a > b).sum(-1), (a < b).sum(-1), n_a.astype(float), n_b.astype(float))
    return guess, (guess >= threshold - MARGIN) & (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-6)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (size of the set), two signature halves, registers (null without a set)."""

    def make(batch: pa.RecordBatch):
        for part in small_batches(batch, 1):
            hashes, at = column_words(part.column(1), BY_SPACE)
            n, one, two, held = [], [], [], []
            for k in range(part.num_rows):
                items = shingles(hashes[at[k] : at[k + 1]], words)
                n.append(len(items))
                one.append(int(items.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(mix(items).sum(dtype=np.uint64).view(np.int64)))
                held.append(registers(items).tobytes() if len(items) else None)
            arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "s1", "s2", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_batch(make), "doc_id long, n long, s1 long, s2 long, sketch binary")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those with 100 * intersection >= percent * union, on the full sets."""

    def check(batch: pa.RecordBatch):
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
    both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(by_batch(check), "a long, b long")


def _pivot_pairs(members: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): each member with the most similar pivot of its bands, for each of PIVOTS orders of the classes."""
    first = [F.min(F.struct(F.xxhash64("doc_id", F.lit(t)), "doc_id")).alias(f"p{t}") for t in range(PIVOTS)]
    pivots = members.groupBy("band").agg(*first)
    turns = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), F.col(f"p{t}.doc_id").alias("b")) for t in range(PIVOTS)])).alias("p")
    pairs = members.join(pivots, "band").select(F.col("doc_id").alias("a"), turns).select("a", "p.turn", "p.b").where("a <> b").distinct()
    pairs = pairs.join(classes.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    pairs = pairs.join(classes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")

    def compare(batch: pa.RecordBatch):
        a, turn, b, sa, sb, na, nb = batch.columns
        guess, near = _similar(_sketches(sa), _sketches(sb), na.to_numpy(), nb.to_numpy(), threshold)
        yield pa.RecordBatch.from_arrays([a, turn, b, pa.array(guess)], names=["a", "turn", "b", "guess"]).filter(pa.array(near))

    near = pairs.select("a", "turn", "b", "sa", "sb", "na", "nb").mapInArrow(by_batch(compare), "a long, turn int, b long, guess double")
    best = near.groupBy("a", "turn").agg(F.max_by("b", F.struct("guess", "b")).alias("b"))
    return best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


class _Joined:
    """Which labels of a block its links have joined."""

    def __init__(self):
        self._up: dict[int, int] = {}

    def root(self, label: int) -> int:
        while (up := self._up.get(label, label)) != label:
            self._up[label] = self._up.get(up, up)
            label = up
        return label

    def join(self, a: int, b: int) -> None:
        self._up[self.root(a)] = self.root(b)


def _remaining_links(members: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame | None:
    """(a, b): verified links that join all components which a complete comparison joins; None when no band is mixed."""
    mixed = members.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("doc_id").alias("least")).where("low < high")
    open_members = materialize(members.join(mixed.select("band", "least"), "band").select("doc_id", "label", "least"))
    if open_members.isEmpty():
        return None
    groups = components(open_members.select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    rows = open_members.select("doc_id", "label").distinct().join(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("grp")), "doc_id")
    rows = rows.join(classes.select("doc_id", "n", "sketch"), "doc_id")
    rows = materialize(rows.join(sets.select("doc_id", "items"), "doc_id"))
    largest = rows.groupBy("grp", "label").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    largest = largest.groupBy("grp").agg(F.max(F.struct("c", "label", "w")).alias("m"), F.sum("c").alias("all"), F.sum("w").alias("weight"))
    largest = largest.select("grp", F.col("m.label").alias("main"), "all", "weight", (F.col("all") - F.col("m.c")).alias("rest"), (F.col("weight") - F.col("m.w")).alias("rest_weight"))
    # Blocks are bounded by members and by the bytes of their sets.
    blocks = lambda n, w: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(w) * 8 / BLOCK_BYTES)).cast("int")
    rows = rows.join(largest, "grp")
    own = lambda n, w: F.pmod(F.xxhash64("doc_id"), blocks(n, w)).cast("int")
    each = lambda n, w: F.explode(F.sequence(F.lit(0), blocks(n, w) - 1))
    columns = ["doc_id", "label", "n", "sketch", "items", (F.col("label") == F.col("main")).alias("is_main")]
    left = rows.where("rest > 0").select("grp", own("all", "weight").alias("i"), each("rest", "rest_weight").alias("j"), *columns)
    right = rows.where("label <> main").select("grp", each("all", "weight").alias("i"), own("rest", "rest_weight").alias("j"), *columns)
    right = right.toDF(*right.columns)  # columns of its own: both sides come from the same rows

    def compare(_key, ours: pa.Table, probes: pa.Table) -> pa.Table:
        a, b, joined = [], [], _Joined()
        if ours.num_rows and probes.num_rows:
            ids, label, n, main = (ours[c].to_numpy() for c in ("doc_id", "label", "n", "is_main"))
            all_sketches, items = _sketches(ours["sketch"]), ours["items"]
            for doc, lab, size, data, own in zip(*(probes[c].to_pylist() for c in ("doc_id", "label", "n", "sketch", "items"))):
                # Two members outside the largest component would meet twice.
                at = np.flatnonzero((label != lab) & (main | (ids < doc)) & (np.minimum(n, size) >= threshold * np.maximum(n, size) - 1e-6))
                if not len(at):
                    continue
                guess, near = _similar(all_sketches[at], np.frombuffer(data, "<u2"), n[at], np.full(len(at), size), threshold)
                at, guess = at[near], guess[near]
                own = np.frombuffer(own, np.uint64)
                for k in at[np.argsort(-guess, kind="stable")].tolist():
                    if joined.root(int(label[k])) == joined.root(lab):
                        continue
                    other = np.frombuffer(items[k].as_py(), np.uint64)
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(other) - common):
                        joined.join(int(label[k]), lab)
                        a.append(doc)
                        b.append(int(ids[k]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.groupBy("grp", "i", "j").cogroup(right.groupBy("grp", "i", "j")).applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id that links reach), kept."""
    spark = prepare(docs.sparkSession)
    threshold = percent / 100
    sketched = materialize(sketch(docs, words))
    known = sketched.where("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.any_value("sketch").alias("sketch"))
    classes = materialize(classes)

    @F.arrow_udf("array<long>")
    def band_keys(column: pa.Array) -> pa.Array:
        return pa.array([bands(s) for s in _sketches(column)], pa.list_(pa.int64()))

    banded = classes.select("doc_id", F.explode(band_keys("sketch")).alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    members = materialize(banded.join(shared, "band"))
    candidates = members.select("doc_id").distinct()

    def full(batch: pa.RecordBatch):
        for part in small_batches(batch, 1):
            hashes, at = column_words(part.column(1), BY_SPACE)
            items = [shingles(hashes[at[k] : at[k + 1]], words).tobytes() for k in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.binary())], names=["doc_id", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(candidates, "doc_id", "left_semi")
    sets = materialize(texts.mapInArrow(by_batch(full), "doc_id long, items binary").where("length(items) > 0"))

    links = materialize(_verify(_pivot_pairs(members, classes, threshold), sets, percent))
    labels = components(links)
    named = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    labelled = materialize(members.join(named, "doc_id", "left").select("doc_id", "band", F.coalesce("label", "doc_id").alias("label")))
    more = _remaining_links(labelled, classes, sets, threshold, percent)
    if more is not None:
        more = materialize(more)
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    by_set = ["n", "s1", "s2"]
    named = classes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(*by_set, F.coalesce("component", "doc_id").alias("component_id"))
    rows = known.drop("sketch").join(named, by_set).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = sketched.select("doc_id", F.col("n").alias("n_shingles")).join(rows, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
