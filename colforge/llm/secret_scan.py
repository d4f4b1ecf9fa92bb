"""Secrets in whole texts: fixed patterns, and a character convolutional network for what no pattern names.

Patterns give the base spans. Every other run of token characters that could be a key (CANDIDATE: 8 or more of them, with
a digit or a capital after a small letter) is a candidate for the network, which reads the run in pieces of PIECE characters with BEFORE
characters before and AFTER after it: an embedding per character, convolutions of WIDTH characters, their maximum and mean
over the window, one logistic unit. A run's logit is the mean over its pieces, so all of it counts.

Labelled findings are rows (before, value, after, secret); `findings` derives them from texts: what a pattern marks is a
secret, once in its place and once behind other words of the text (so the value tells, not the name before it), candidates
beside the patterns and one stretch of prose per text are none. All distinct findings count. Those of seven folds of ten (by
value) train the network: dealt by hash into blocks of about BLOCK rows, each block learns in a task of its own from the same
weights, and after every pass over the rows the blocks' weights are averaged. A class with fewer than LEAST_CLASS rows per
block is dealt to several blocks, so that every block sees both. The other three folds are not trained on: all of them set
the logistic calibration of the logits, and per shape of value (hexadecimal, capitals and digits, other) the highest
threshold that still finds RECALL of the secrets. A shape seen less than LEAST_SHAPE times has the threshold of all. What the
driver holds is weights and sums; `train(sample=)` bounds the findings and fits in one task instead, if a caller asks for it.

Spans are in code points, end exclusive, sorted by start and kind; added spans have kind `net` and touch no base span. A
null text is empty, an empty text has no spans. Rows are answered one by one, so repeated ids and rows, null ids and extra
columns change nothing (a column named like the result is replaced). Without findings of both classes (an empty table)
nothing is added. Scanning reads each text whole, in place, without a shuffle.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colforge.llm.common import Fitted, by_batch, fit_in_task, materialize, prepare
from colforge.plans.quantile import exact_at_ranks

BLOCK = 16384
LEAST_CLASS = 512
EPOCHS, RATE = 12, 0.004
MEAN_OF = 64
RECALL = 0.99
LEAST_SHAPE = 30
BEFORE, PIECE, AFTER = 24, 48, 8
WINDOW = BEFORE + PIECE + AFTER
WIDTH, CHANNELS, FILTERS = 5, 8, 24
BATCH = 2048

# The patterns of the base spans and the least length of what they must hold.
KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
_MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
_SHAPES = (re.compile(r"[0-9a-f]+"), re.compile(r"[A-Z0-9]+"))


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of every pattern's matches, leftmost first, none overlapping in a kind."""
    spans, low = [], text.lower() if "=" in text or ":" in text else ""
    if any(word in low for word in ("pass", "secret", "token", "api")):
        spans = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Runs that may be secrets and touch no base span."""
    found, k, reach = [], 0, -1
    if not _MIXED.search(text):
        return found
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start() and _MIXED.search(m.group()):
            found.append(m.span())
    return found


def shape(value: str) -> int:
    return next((k for k, s in enumerate(_SHAPES) if s.fullmatch(value)), len(_SHAPES))


def pieces(before: str, value: str, after: str) -> list[tuple[str, str, str]]:
    """The value in pieces of PIECE characters, each with what stands around it."""
    whole, first = before + value + after, len(before)
    cuts = range(first, first + max(len(value), 1), PIECE)
    return [(whole[max(0, a - BEFORE) : a], whole[a : min(a + PIECE, first + len(value))], whole[min(a + PIECE, first + len(value)) :][:AFTER]) for a in cuts]


def encode(windows: list[tuple[str, str, str]]) -> np.ndarray:
    """Codes of fixed length: 0 nothing, 1 any character beyond ASCII, else by character; the value's own codes 100 higher."""
    out = np.zeros((len(windows), WINDOW), np.uint8)
    for row, (before, value, after) in zip(out, windows):
        for part, start, more in ((before[-BEFORE:].rjust(BEFORE, "\0"), 0, 0), (value[:PIECE], BEFORE, 100), (after[:AFTER], BEFORE + min(len(value), PIECE), 0)):
            codes = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
            known = np.where(codes == 0, 0, np.where((codes < 127) & (codes >= 32), codes - 30, np.where(codes < 32, 2, 1)))
            row[start : start + len(known)] = np.where(known > 0, known + more, 0)
    return out


@dataclass
class Network:
    letters: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    at: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = (0.5,) * (len(_SHAPES) + 1)
    heldout: tuple[float, float] = (0.0, 0.0)  # recall of secrets and share of others left alone, on findings not trained on

    def _taps(self) -> list[np.ndarray]:
        return [self.letters @ self.filters[k * CHANNELS : (k + 1) * CHANNELS] for k in range(WIDTH)]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """Per window; a convolution over looked-up letters is a sum of looked-up products."""
        taps, out, steps = self._taps(), [], WINDOW - WIDTH + 1
        for start in range(0, len(codes), BATCH):
            x = codes[start : start + BATCH]
            z = self.bias + sum(tap[x[:, k : k + steps]] for k, tap in enumerate(taps))
            np.maximum(z, 0, out=z)
            out.append(np.concatenate([z.max(1), z.mean(1)], 1) @ self.out + self.at)
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def scores(self, runs: list[tuple[str, str, str]]) -> np.ndarray:
        """Calibrated probability of each (before, value, after)."""
        return self.calibrated(self.means(runs))

    def means(self, runs: list[tuple[str, str, str]]) -> np.ndarray:
        """Mean logit over the pieces of each (before, value, after)."""
        windows = [pieces(*r) for r in runs]
        owner = np.repeat(np.arange(len(runs)), [len(w) for w in windows])
        seen: dict[tuple, int] = {}
        at = [seen.setdefault(w, len(seen)) for ws in windows for w in ws]
        raw = self.logits(encode(list(seen)))[at].astype(float)
        return np.bincount(owner, raw, len(runs)) / np.maximum(np.bincount(owner, minlength=len(runs)), 1)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -60, 60)))


Weights = list[np.ndarray]


@dataclass
class Training:
    """Weights, Adam's two running means of each, and the steps done."""

    p: Weights
    m: Weights
    q: Weights
    t: int = 0

    def network(self) -> Network:
        return Network(*self.p[:4], float(self.p[4][0]))


def _begin() -> tuple[Training, np.random.Generator]:
    random = np.random.default_rng(23)
    f32 = lambda *size, scale: random.normal(0, scale, size).astype(np.float32)
    p = [f32(256, CHANNELS, scale=0.3), f32(WIDTH * CHANNELS, FILTERS, scale=0.2), np.zeros(FILTERS, np.float32), f32(2 * FILTERS, scale=0.2), np.zeros(1, np.float32)]
    p[0][0] = 0
    return Training(p, [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]), random


def _pass(now: Training, codes: np.ndarray, y: np.ndarray, order: np.ndarray, rate: float) -> None:
    """Logistic loss by Adam, once over the rows in `order`; classes weigh the same."""
    p = now.p
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32)
    steps = WINDOW - WIDTH + 1
    for start in range(0, len(order), 64):
        rows = order[start : start + 64]
        x, n = codes[rows], len(rows)
        letters = p[0][x]
        cols = np.stack([letters[:, k : k + steps] for k in range(WIDTH)], 2).reshape(n, steps, -1)
        z = cols @ p[1] + p[2]
        a = np.maximum(z, 0)
        top = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(1)], 1)
        pull = (1 / (1 + np.exp(-np.clip(pooled @ p[3] + p[4], -30, 30))) - y[rows]) * weight[rows] / n
        back = pull[:, None] * p[3]
        da = np.repeat(back[:, None, FILTERS:] / steps, steps, 1)
        np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + back[:, None, :FILTERS], 1)
        dz = da * (z > 0)
        dcols = (dz @ p[1].T).reshape(n, steps, WIDTH, CHANNELS)
        dletters = np.zeros_like(letters)
        for k in range(WIDTH):
            dletters[:, k : k + steps] += dcols[:, :, k]
        flat = x.ravel()
        d0 = np.stack([np.bincount(flat, dletters[..., c].ravel(), 256) for c in range(CHANNELS)], 1)
        d0[0] = 0
        grads = [d0, cols.reshape(-1, WIDTH * CHANNELS).T @ dz.reshape(-1, FILTERS), dz.sum((0, 1)), pooled.T @ pull, pull.sum(keepdims=True)]
        now.t += 1
        for v, g, m, q in zip(p, grads, now.m, now.q):
            g = g.astype(np.float32) + 1e-4 * v
            m += 0.1 * (g - m)
            q += 0.01 * (g * g - q)
            v -= rate * (m / (1 - 0.9**now.t)) / (np.sqrt(q / (1 - 0.99**now.t)) + 1e-7)


def _learn(codes: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> Network:
    now, random = _begin()
    for _ in range(epochs):
        _pass(now, codes, y, random.permutation(len(y)), rate)
    return now.network()


def _learn_blocks(rows: DataFrame, counts: dict[int, int]) -> Network:
    """The network of all `rows` (k, before, value, after, y); `counts` has their number by y."""
    parts = -(-sum(counts.values()) // BLOCK)
    copies = F.when(F.col("y") == 1, min(parts, -(-parts * LEAST_CLASS // counts[1]))).otherwise(min(parts, -(-parts * LEAST_CLASS // counts[0])))
    dealt = rows.withColumn("j", F.explode(F.sequence(F.lit(0), copies - 1))).withColumn("block", F.expr(f"CAST(pmod(pmod(k, {parts}) + j, {parts}) AS INT)"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, codes, y = None, [], []
        for batch in batches:
            if batch.num_rows:
                block = block or batch["block"][:1]
                codes.append(encode(list(zip(*(batch[c].to_pylist() for c in ("before", "value", "after"))))).tobytes())
                y.append(batch["y"].to_numpy().astype(np.uint8).tobytes())
        if block:
            yield pa.RecordBatch.from_arrays([block, pa.array([b"".join(codes)], pa.binary()), pa.array([b"".join(y)], pa.binary())], names=["block", "codes", "y"])

    order = ["before", "value", "after", "y"]
    blocks = materialize(dealt.select("block", *order).repartitionById(parts, F.col("block")).sortWithinPartitions(*order).mapInArrow(pack, "block int, codes binary, y binary"))
    now = _begin()[0]
    for epoch in range(EPOCHS):

        def learn(batch: pa.RecordBatch, before=pickle.dumps(now), epoch=epoch):
            for block, codes, y in zip(*(batch[c].to_pylist() for c in ("block", "codes", "y"))):
                codes, y = np.frombuffer(codes, np.uint8).reshape(-1, WINDOW), np.frombuffer(y, np.uint8).astype(np.float32)
                mine, (_, random) = pickle.loads(before), _begin()
                for _ in range(epoch + 1):  # the same orders as a task that makes all passes
                    turn = random.permutation(len(y))
                _pass(mine, codes, y, turn, RATE)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([len(y)], pa.int64()), pa.array([pickle.dumps(mine)], pa.binary())], names=["block", "n", "learned"])

        learned = blocks.mapInArrow(by_batch(learn), "block int, n long, learned binary")
        few = learned.groupBy(F.expr(f"block div {MEAN_OF}")).applyInArrow(_mean, "block int, n long, learned binary")
        now = pickle.loads(_mean(pa.Table.from_pylist([r.asDict() for r in few.collect()]))["learned"][0].as_py())
    return now.network()


def _mean(learned: pa.Table) -> pa.Table:
    """One row of several (block, n, learned): their mean by rows, added up in the order of blocks."""
    first, *rest = learned.sort_by("block").to_pylist()
    total, mean = first["n"], pickle.loads(first["learned"])
    for row in rest:
        one = pickle.loads(row["learned"])
        total += row["n"]
        for a, b in zip((*mean.p, *mean.m, *mean.q), (*one.p, *one.m, *one.q)):
            a += (b - a) * np.float32(row["n"] / total)
        mean.t = max(mean.t, one.t)
    return pa.table({"block": pa.array([first["block"]], pa.int32()), "n": pa.array([total], pa.int64()), "learned": pa.array([pickle.dumps(mean)], pa.binary())})


def _newton(n1: float, n0: float, sums) -> tuple[float, float]:
    """Slope and shift of a logistic curve through logits, by Newton steps; the targets are drawn in a little.

    `sums` gives, for a slope, a shift and the targets of secrets and others, the sums of v, v x, v x x, d and d x over all logits x,
    where p is the curve, v = p (1 - p) and d = p - target.
    """
    w = np.array([1.0, 0.0])
    for _ in range(50):
        v, vx, vxx, d, dx = sums(w[0], w[1], (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        step = np.linalg.solve(np.array([[vxx, vx], [vx, v]]) + 1e-3 * np.eye(2), np.array([dx, d]) + 1e-3 * (w - [1, 0]))
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    def sums(slope, shift, one, none):
        p = 1 / (1 + np.exp(-np.clip(raw * slope + shift, -30, 30)))
        v, d = p * (1 - p), p - np.where(y == 1, one, none)
        return v.sum(), v @ raw, v @ (raw * raw), d.sum(), d @ raw

    return _newton(y.sum(), len(y) - y.sum(), sums)


def _calibrate_rows(logits: DataFrame, n1: int, n0: int) -> tuple[float, float]:
    """The same over a DataFrame of (raw, y), one aggregate per step."""

    def sums(slope, shift, one, none):
        p = F.expr(f"1 / (1 + exp(-greatest(-30D, least(30D, raw * {float(slope)!r}D + {float(shift)!r}D))))")
        rows = logits.select("raw", p.alias("p"), F.expr(f"IF(y = 1, {one!r}D, {none!r}D)").alias("target"))
        return rows.selectExpr("p * (1 - p) AS v", "p - target AS d", "raw AS x").selectExpr("sum(v)", "sum(v * x)", "sum(v * x * x)", "sum(d)", "sum(d * x)").first()

    return _newton(n1, n0, sums)


def _highest(scores: np.ndarray, recall: float) -> float:
    """The highest threshold that at least `recall` of the scores reach."""
    return float(np.sort(scores)[_rank(len(scores), recall)])


def _rank(n: int, recall: float) -> int:
    return int(np.floor((1 - recall) * n + 1e-9))


def fit(table: pa.Table, recall: float = RECALL) -> Network | None:
    """A calibrated network from rows (before, value, after, secret), or None unless both classes are there."""
    runs = list(zip(*(table[c].to_pylist() for c in ("before", "value", "after"))))
    y = table["secret"].to_numpy().astype(np.float32)
    # By value, so that no secret is on both sides.
    apart = np.array([zlib.crc32(v.encode("utf-8", "replace")) % 10 >= 7 for _, v, _ in runs], bool)
    if not len(y) or not 0 < y[~apart].mean() < 1:
        return None
    codes = encode(runs)
    net = _learn(codes[~apart], y[~apart])
    test = apart if 0 < y[apart].sum() < apart.sum() else np.ones(len(y), bool)
    net.scale, net.shift = _calibrate(net.logits(codes[test]).astype(float), y[test])
    scores, kinds = net.scores(runs), np.array([shape(v) for _, v, _ in runs])
    secret = test & (y == 1)
    every = _highest(scores[secret], recall)
    own = [scores[secret & (kinds == k)] for k in range(len(_SHAPES) + 1)]
    net.thresholds = tuple(_highest(s, recall) if len(s) >= LEAST_SHAPE else every for s in own)
    found = scores >= np.array(net.thresholds)[kinds]
    net.heldout = float(found[secret].mean()), float((~found[test & (y == 0)]).mean())
    return net


def findings(docs: DataFrame) -> DataFrame:
    """Labelled findings of all texts: before, value, after, secret."""

    def extract(batch: pa.RecordBatch):
        rows = []
        for text in batch.column(0).to_pylist():
            text = text or ""
            base = base_spans(text)
            crc = zlib.crc32(text.encode("utf-8", "replace"))
            for n, (_, _, end, value) in enumerate(base):
                parts = pieces(text[max(0, value - BEFORE) : value], text[value:end], text[end : end + AFTER])
                rows += [(*p, 1) for p in parts]
                at = (crc + 7919 * n) % len(text)
                # Behind other words: their end, and a blank or a mark as before a value.
                words = text[max(0, at - BEFORE + 1) : at]
                rows.append((words + " :=\"'"[(crc + n) % 5], *parts[0][1:], 1))
            for start, end in candidates(text, base):
                rows += [(*p, 0) for p in pieces(text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER])]
            if text:
                start = crc % len(text)
                end = min(len(text), start + 12 + crc % 29)
                if not any(a < end and start < b for a, _, b, _ in base):
                    rows.append((text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER], 0))
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.string()] * 3 + [pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["before", "value", "after", "secret"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(by_batch(extract), "before string, value string, after string, secret int")


def train(labelled: DataFrame, sample: int | None = None, recall: float = RECALL) -> Fitted:
    """Learn from all labelled findings; `sample` bounds the distinct ones per class (smallest hashes), for a quick try."""
    prepare(labelled.sparkSession)
    rows = materialize(labelled.where("secret IS NOT NULL AND value IS NOT NULL").distinct().withColumn("k", F.xxhash64("before", "value", "after")))
    if sample is not None:
        classes = [rows.where(c).orderBy("k", "before", "value", "after").limit(sample).drop("k") for c in ("secret = 0", "secret <> 0")]
        return fit_in_task(classes[0].unionByName(classes[1]), lambda table: fit(table, recall))
    return Fitted(pickle.dumps(_fit_rows(rows, recall)))


def _fit_rows(rows: DataFrame, recall: float) -> Network | None:
    """What `fit` does, over a DataFrame of any size."""
    rows = rows.withColumns({"y": F.expr("IF(secret = 0, 0, 1)"), "apart": F.expr("crc32(CAST(value AS BINARY)) % 10 >= 7")})
    found = {(r.y, r.apart): r["count"] for r in rows.groupBy("y", "apart").count().collect()}
    learn, held = ({y: found.get((y, apart), 0) for y in (0, 1)} for apart in (False, True))
    if not all(learn.values()):
        return None
    net = _learn_blocks(rows.where("NOT apart"), learn)
    if all(held.values()):
        test, counts = rows.where("apart"), held
    else:
        test, counts = rows, {y: learn[y] + held[y] for y in (0, 1)}

    def score(batch: pa.RecordBatch):
        runs = list(zip(*(batch[c].to_pylist() for c in ("before", "value", "after"))))
        yield pa.RecordBatch.from_arrays([pa.array(net.means(runs)), batch["y"], pa.array([shape(r[1]) for r in runs], pa.int32())], names=["raw", "y", "shape"])

    logits = materialize(test.select("before", "value", "after", "y").mapInArrow(by_batch(score), "raw double, y int, shape int"))
    net.scale, net.shift = _calibrate_rows(logits, counts[1], counts[0])
    secrets = logits.where("y = 1")
    shapes = {r["shape"]: r["count"] for r in secrets.groupBy("shape").count().collect()}
    own = {f"shape{k}": n for k, n in shapes.items() if n >= LEAST_SHAPE}
    cells = secrets.select("raw", *[F.expr(f"IF(shape = {k}, raw, NULL)").alias(f"shape{k}") for k in shapes])
    least = exact_at_ranks(cells, {c: _rank(n, recall) for c, n in ({"raw": counts[1]} | own).items()})
    lows = [least.get(f"shape{k}", least["raw"]) for k in range(len(_SHAPES) + 1)]
    net.thresholds = tuple(net.calibrated(np.array(lows)).tolist())
    passed = logits.selectExpr("y", f"raw >= element_at(array({', '.join(f'{low!r}D' for low in lows)}), shape + 1) AS passed")
    net.heldout = tuple(passed.selectExpr("avg(IF(y = 1, IF(passed, 1D, 0D), NULL))", "avg(IF(y = 0, IF(passed, 0D, 1D), NULL))").first())
    return net


def scan(docs: DataFrame, model: Fitted, name: str = "findings") -> DataFrame:
    """All columns of `docs` plus `name`: an array of (kind, start, end, score), sorted; base spans have no score."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    @F.arrow_udf("array<struct<kind:string,start:long,end:long,score:double>>")
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shared.value.model
        for part in parts:
            rows, runs, owners = [], [], []
            for k, text in enumerate(part.to_pylist()):
                text = text or ""
                base = base_spans(text)
                rows.append([(start, kind, end, None) for start, kind, end, _ in base])
                if net is not None:
                    for start, end in candidates(text, base):
                        runs.append((text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER]))
                        owners.append((k, start, end))
            if runs:
                for (k, start, end), run, score in zip(owners, runs, net.scores(runs)):
                    if score >= net.thresholds[shape(run[1])]:
                        rows[k].append((start, 3, end, float(score)))
            yield pa.array([[{"kind": KINDS[kind], "start": s, "end": e, "score": p} for s, kind, e, p in sorted(r, key=lambda x: x[:2])] for r in rows], pa.list_(span))

    kept = [F.col(f"`{c}`") for c in docs.columns if c != name]
    return docs.select(*kept, find(F.col("text").cast("string")).alias(name))
