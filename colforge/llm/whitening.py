"""Embedding whitening by spectrum slicing.

Vectors become whole numbers (floor of each entry times SCALE); every distinct one counts once in the fit. Their
covariance is small (dimension x dimension), so its leading eigenvalues are found on the driver: the signs of D in
LDL^T = V - shift I count the eigenvalues above any shift (Sylvester), bisection on these counts isolates each leading
eigenvalue, Rayleigh quotient iteration takes over from there, and two last counts just beside the result prove its
number. Eigenvalues closer together than rounding are taken as one multiple eigenvalue with any orthonormal basis.

The rows are read for their usual length, for the distinct vectors (one shuffle of narrow binary keys, combined before it)
and for the result; sums (exact integers), centred products and the covariance of the whitened vectors come from the
distinct ones. Tasks send one row per dimension, summed on executors; the driver gets one row per dimension.

Null vectors, vectors with null or non-finite entries, and entries whose whole number leaves 64 bits take no part. Vectors
of another length than most (ties: the longer) have no place in the covariance and take no part either; empty vectors
count as such. Repeated rows and ids are answered row by row, a null id stays null. Components without variance beyond
rounding (fewer distinct vectors than components, constant dimensions) are left out; without any, and for an empty table,
there are no rows. `deviation` is null where it leaves 64 bits. Only the id and the vector are read, so other columns
cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colforge.llm.common import by_batch, materialize, prepare

SCALE = 256
SUM_LIMIT = 2.0**62
EPS = 2.0**-52


# --- spectrum of a symmetric matrix ---------------------------------------------------------------


class Shifted:
    """LDL^T of a symmetric matrix with pivots of size 1 and 2 (Bunch and Kaufman), for counts and solves."""

    ALPHA = (1 + 17**0.5) / 8

    def __init__(self, matrix: np.ndarray):
        a, n = matrix.copy(), len(matrix)
        self.order, self.blocks, self.lower = np.arange(n), [], np.eye(n)
        tiny = EPS * max(float(np.abs(a).max(initial=0)), 1e-300)
        k = 0
        while k < n:
            size, swap = self._pivot(a, k)
            for at, other in swap:
                a[[at, other], :] = a[[other, at], :]
                a[:, [at, other]] = a[:, [other, at]]
                self.lower[[at, other], :k] = self.lower[[other, at], :k]
                self.order[[at, other]] = self.order[[other, at]]
            block = a[k : k + size, k : k + size].copy()
            if size == 1 and abs(block[0, 0]) < tiny:
                block[0, 0] = tiny  # a shift on an eigenvalue counts as just below it
            rest = slice(k + size, n)
            left = np.linalg.solve(block, a[k : k + size, rest]).T
            a[rest, rest] -= left @ block @ left.T
            self.lower[rest, k : k + size] = left
            self.blocks.append(block)
            k += size

    def _pivot(self, a: np.ndarray, k: int):
        column = np.abs(a[k + 1 :, k])
        if not len(column) or not column.any():
            return 1, []
        r = k + 1 + int(column.argmax())
        most = column[r - k - 1]
        if abs(a[k, k]) >= self.ALPHA * most:
            return 1, []
        other = np.abs(a[k:, r])
        other[r - k] = 0
        beside = other.max()
        if abs(a[k, k]) * beside >= self.ALPHA * most * most:
            return 1, []
        if abs(a[r, r]) >= self.ALPHA * beside:
            return 1, [(k, r)]
        return 2, [(k + 1, r)] if r != k + 1 else []

    def above(self) -> int:
        """Eigenvalues of the matrix above 0: D has as many."""
        return sum(int((np.linalg.eigvalsh(b) > 0).sum()) if len(b) == 2 else int(b[0, 0] > 0) for b in self.blocks)

    def solve(self, right: np.ndarray) -> np.ndarray:
        x, k, n = right[self.order].astype(float), 0, len(right)
        for j in range(n):
            x[j + 1 :] -= np.multiply.outer(self.lower[j + 1 :, j], x[j]) if x.ndim > 1 else self.lower[j + 1 :, j] * x[j]
        for b in self.blocks:
            x[k : k + len(b)] = np.linalg.solve(b, x[k : k + len(b)])
            k += len(b)
        for j in range(n - 1, -1, -1):
            x[j] -= self.lower[j + 1 :, j] @ x[j + 1 :]
        out = np.empty_like(x)
        out[self.order] = x
        return out


def leading(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    n = len(v)
    wanted = min(wanted, n)
    identity, size = np.eye(n), float(np.abs(v).sum(1).max(initial=0))
    if not wanted or not size:
        return np.zeros(wanted), identity[:, :wanted]
    near = 8 * n * EPS * size  # closer than this, two eigenvalues cannot be told apart
    counted: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counted:
            counted[shift] = Shifted(v - shift * identity).above()
        return counted[shift]

    counted[size * 1.01], counted[-size * 1.01] = 0, n  # Gershgorin
    values, vectors = [], np.zeros((n, 0))
    random = np.random.default_rng(5)
    while len(values) < wanted:
        k = len(values)  # eigenvalue number k, from 0: `above` is at most k beyond it and more than k below
        while True:
            high = min(s for s, c in counted.items() if c <= k)
            low = max(s for s, c in counted.items() if c > k)
            alone = counted[low] == k + 1 and counted[high] == k
            # Alone in a narrow slice, an eigenvalue is nearer to its middle than all others.
            if high - low <= near or alone and high - low <= 0.05 * abs(high + low) / 2:
                break
            above((low + high) / 2)
        many = max(1, counted[low] - k)
        basis = random.normal(size=(n, many))
        shifted = Shifted(v - (low + high) / 2 * identity)
        for _ in range(3):  # inverse iteration; what is found already is kept out
            basis = shifted.solve(basis)
            basis -= vectors @ (vectors.T @ basis)
            basis = np.linalg.qr(basis)[0]
        if many == 1:
            x = basis[:, 0]
            value = float(x @ v @ x)
            for _ in range(12):
                if np.linalg.norm(v @ x - value * x) <= 2 * n * EPS * size:
                    break
                y = Shifted(v - value * identity).solve(x)
                y -= vectors @ (vectors.T @ y)
                x = y / np.linalg.norm(y)
                value = float(x @ v @ x)
            found = np.array([value])
            basis = x[:, None]
            if high - low > near and not (above(value - near) > k >= above(value + near)):
                above((low + high) / 2)  # another eigenvalue answered: slice further
                continue
        else:
            inner = basis.T @ v @ basis
            turned = np.linalg.eigh((inner + inner.T) / 2)
            found, basis = turned[0][::-1], basis @ turned[1][:, ::-1]
        values.extend(found)
        vectors = np.hstack([vectors, basis])
    return np.array(values[:wanted]), vectors[:, :wanted]


# --- rows -----------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """n distinct vectors, their exact sums, and per component a unit vector, its eigenvalue and its share."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return _mean(self.sums, self.n)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; the machine's integers where a bound shows that they hold it."""
        rough = ((self.n * x.astype(float) - np.array([float(s) for s in self.sums])) ** 2).sum(1)
        with np.errstate(over="ignore"):
            low = np.array([s & (1 << 64) - 1 for s in self.sums], np.uint64).view(np.int64)
            gap = np.int64(self.n) * x - low  # right modulo 2^64, and so is the sum of squares
            whole = (gap * gap).sum(1).tolist()
        for k in np.flatnonzero(rough >= SUM_LIMIT):
            exact = sum((self.n * int(a) - s) ** 2 for a, s in zip(x[k].tolist(), self.sums))
            whole[k] = exact if exact < 1 << 63 else None
        return whole


def _mean(sums: list[int], n: int) -> np.ndarray:
    return np.array([s / n for s in sums])  # a quotient of whole numbers is rounded once


def whole_numbers(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and floor(SCALE * entry) of these as rows of 64-bit integers."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.nan_to_num(np.array(column.value_lengths().to_numpy(zero_copy_only=False), float), nan=-1)
    ok = np.array(column.is_valid()) & (sizes > 0)
    if width is not None:
        ok &= sizes == width
    flat = column.flatten()
    flat = np.floor(SCALE * np.where(np.array(flat.is_valid()), flat.fill_null(0).to_numpy(), np.nan)) if len(flat) else np.zeros(0)
    bad = ~((flat >= -(2.0**63)) & (flat < 2.0**63))
    owner = np.repeat(np.arange(len(column)), np.maximum(sizes, 0).astype(int))
    ok[owner[bad]] = False
    if width is None:
        return ok, sizes
    rows = flat[ok[owner]] if len(flat) else flat
    return ok, rows.astype(np.int64).reshape(-1, width)


def pack(x: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest integers that hold it, so equal vectors are equal bytes."""
    most = np.abs(x.astype(float)).max(1, initial=0)
    out: list[bytes] = [b""] * len(x)
    for kind, limit in ((np.int8, 127), (np.int16, 32767), (np.int32, 2**31 - 1), (np.int64, np.inf)):
        for k in np.flatnonzero(most <= limit):
            if not out[k]:
                out[k] = x[k].astype(kind).tobytes()
    return out


def unpack(column: pa.Array, width: int) -> np.ndarray:
    kinds = {width * np.dtype(k).itemsize: k for k in (np.int8, np.int16, np.int32, np.int64)}
    rows = column.to_pylist()
    return np.array([np.frombuffer(r, kinds[len(r)]) for r in rows], np.int64).reshape(-1, width)


def _partials(fit: DataFrame, name: str, work) -> DataFrame:
    """`work` on all vectors of a task, batch by batch; it ends with a few rows (k, part) of doubles."""

    def run(batches):
        for k, part in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tolist()], pa.list_(pa.float64()))], names=["k", name])

    return fit.mapInArrow(run, f"k int, {name} array<double>")


def _summed(parts: DataFrame, name: str, width: int) -> DataFrame:
    """Entrywise sums of equally long arrays per k, first over a few tasks each, then over these."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for chunk in table[name].chunks:
            total += chunk.flatten().to_numpy().reshape(-1, width).sum(0)
        return pa.table({"k": table["k"][:1], name: pa.array([total.tolist()], pa.list_(pa.float64()))})

    kind = f"k int, {name} array<double>"
    first = parts.withColumn("lane", F.spark_partition_id() % 32).groupBy("lane", "k").applyInArrow(lambda t: add(t), kind)
    return first.groupBy("k").applyInArrow(lambda t: add(t), kind)


def fit(vectors: DataFrame, column: str, components: int) -> tuple[Whitening, int] | None:
    """The whitening of the distinct usable vectors and their length; None without any variance."""
    prepare(vectors.sparkSession)
    narrow = vectors.select(F.col(f"`{column}`").alias("v"))

    def lengths(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            ok, sizes = whole_numbers(batch.column(0))
            for s, c in zip(*np.unique(sizes[ok], return_counts=True)):
                seen[int(s)] = seen.get(int(s), 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["width", "rows"])

    usual = narrow.mapInArrow(lengths, "width int, rows long").groupBy("width").agg(F.sum("rows").alias("rows"))
    usual = usual.orderBy(F.desc("rows"), F.desc("width")).first()
    if usual is None:
        return None
    width = usual["width"]

    def packed(batch: pa.RecordBatch):
        _, x = whole_numbers(batch.column(0), width)
        yield pa.RecordBatch.from_arrays([pa.array(pack(x), pa.binary())], names=["x"])

    distinct = materialize(narrow.mapInArrow(by_batch(packed), "x binary").distinct())

    def sums(batches):
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = unpack(batch.column(0), width)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        parts = [*high, *low]
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * width), pa.int32()), pa.array(parts, pa.int64()), pa.array([n] * len(parts), pa.int64())], names=["k", "s", "n"])

    total = distinct.mapInArrow(sums, "k int, s long, n long").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    total = {r["k"]: r for r in total.collect()}  # two rows per dimension
    n = total[0]["n"]
    exact = [(int(total[k]["s"]) << 32) + int(total[width + k]["s"]) for k in range(width)]
    mean = _mean(exact, n)

    def products(batches):
        m = np.zeros((width, width))
        for batch in batches:
            c = unpack(batch.column(0), width) - mean
            m += c.T @ c
        yield from enumerate(m)

    rows = _summed(_partials(distinct, "m", products), "m", width).collect()  # one row per dimension
    v = np.array([r["m"] for r in sorted(rows, key=lambda r: r["k"])]) / n
    v = (v + v.T) / 2
    values, vecs = leading(v, components)
    real = values > width * EPS * max(values.max(initial=0), 0) * 16
    if not real.any():
        return None
    model = Whitening(n, exact, values[real], vecs[:, real], values[real] / np.trace(v))
    c = int(real.sum())

    def first_moments(batches):
        yield 0, sum((model.whiten(unpack(b.column(0), width)).sum(0) for b in batches), np.zeros(c))

    centre = np.array(_summed(_partials(distinct, "m", first_moments), "m", c).first()["m"]) / n

    def second_moments(batches):
        m = np.zeros((c, c))
        for batch in batches:
            y = model.whiten(unpack(batch.column(0), width)) - centre
            m += y.T @ y
        yield 0, m.ravel()

    second = np.array(_summed(_partials(distinct, "m", second_moments), "m", c * c).first()["m"]).reshape(c, c) / n
    model.identity_error = float(np.abs(second - np.eye(c)).max())
    return model, width


def whiten(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", components: int = 4) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    kind = f"{id} {vectors.schema[id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = prepare(vectors.sparkSession)
    fitted = fit(vectors, column, components)
    if fitted is None:
        return spark.createDataFrame([], kind)
    model, width = fitted
    shared = spark.sparkContext.broadcast(model)  # a few numbers per dimension

    def answer(batch: pa.RecordBatch):
        m = shared.value
        ok, x = whole_numbers(batch.column(1), width)
        if not len(x):
            return
        c = len(m.values)
        take = pa.array(np.repeat(np.flatnonzero(ok), c))
        columns = [
            batch.column(0).take(take), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * c, m.n)),
            pa.array([d for d in m.deviation(x) for _ in range(c)], pa.int64()), pa.array(m.whiten(x).ravel()),
            pa.array(np.tile(m.explained, len(x))), pa.array(np.full(len(x) * c, m.identity_error)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(f"`{id}`", f"`{column}`").mapInArrow(by_batch(answer), kind)
