"""Toxicity by a factorization machine over hashed terms.

Terms are the words of the whole lower-cased text and their beginnings of 3 to 6 characters (endings vary), hashed into
a table of SLOTS places. Every term of the sample is trained, however rare and whatever it tells alone: the machine gives
each place a weight and a vector, and adds the vectors' products for each pair of terms in a text, so that two terms
together can mean more than the sum of both.

Steps grow with evidence: a row's error moves its terms by their trust, which is small for terms seen once or twice (they
would learn the row by heart) and for terms of nearly every row (they tell nothing).

Learning takes at most SAMPLE_DOCUMENTS labelled rows per class (smallest hashes of doc_id and text; rows equal in both
teach once) inside one executor task, so the driver sees only the model. All labelled rows of the classes are counted, and
the bias is moved from the odds of the sample to theirs, so that a larger table does not shift the scores.
Scoring reads every text whole, in place, without a shuffle. A null text is empty; it and
texts without any trained term get the score of the bias. Without labelled rows of both classes the score is the known
class (0 without any). Several labels of one document count as toxic if one of them is; rows with null ids or labels
teach nothing. Rows with equal or null doc_id are each scored for themselves, ties at one half count as toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colforge.llm.common import Fitted, by_batch, fit_in_task, materialize, prepare

SAMPLE_DOCUMENTS = 4000
SLOTS = 1 << 18
FACTORS = 8
BEGINNINGS = (3, 4, 5, 6)
CACHED_WORDS = 300_000

_WORD = re.compile(r"[^\W_]+")


def _hashes(word: str) -> list[int]:
    """Signed 64-bit hashes of a word's terms."""
    out = [xxhash.xxh64_intdigest("w:" + word)]
    out += [xxhash.xxh64_intdigest(f"{n}:{word[:n]}") for n in BEGINNINGS if len(word) > n]
    return [h - (1 << 64) if h >> 63 else h for h in out]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class FactorizationMachine:
    """`terms` are hashes, or places of a table of `slots` that hashes are folded to."""

    terms: list[int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    slots: int = 0
    place: dict[int, int] = field(init=False)
    _known: dict[str, tuple[int, ...]] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.place = {t: k for k, t in enumerate(self.terms)}

    def __getstate__(self):
        return self.terms, self.bias, self.weights, self.vectors, self.slots

    def __setstate__(self, state):
        self.terms, self.bias, self.weights, self.vectors, self.slots = state
        self._known = {}
        self.__post_init__()

    def active(self, text: str | None) -> list[int]:
        """Places of the trained terms that the text holds."""
        known, found = self._known, set()
        if len(known) > CACHED_WORDS:
            known.clear()
        for word in words_of(text):
            at = known.get(word)
            if at is None:
                hashes = [h % self.slots for h in _hashes(word)] if self.slots else _hashes(word)
                at = tuple(self.place[h] for h in hashes if h in self.place)
                if len(word) <= 48:
                    known[word] = at
            if at:
                found.update(at)
        return sorted(found)

    def score(self, text: str | None) -> float:
        at = self.active(text)
        v = self.vectors[at]
        total = v.sum(0)
        raw = self.bias + self.weights[at].sum() + 0.5 * float((total * total).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -60, 60))))


def _fit(values: np.ndarray, ends: np.ndarray, y: np.ndarray, size: int, epochs: int = 32, rate: float = 20.0):
    """Logistic loss by falling steps on small batches, which touch only the terms they hold; returns bias, weights, vectors.

    Row k holds the terms values[ends[k] : ends[k + 1]]. A step is divided by the trust it meets (and by the length of the
    text's vector), so that long texts do not leap.
    """
    random = np.random.default_rng(11)
    rows = np.float32(len(y))
    seen = np.bincount(values, minlength=size).astype(np.float32)
    trust = seen * seen / (seen * seen + 100) * (1 - seen / rows) ** 4
    mass = np.array([trust[values[a:b]].sum() for a, b in zip(ends, ends[1:])], np.float32)
    w, v = np.zeros(size, np.float32), random.normal(0, 0.01, (size, FACTORS)).astype(np.float32) * trust[:, None]
    b = np.float32(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))
    for epoch in range(epochs):
        order, now = random.permutation(len(y)), np.float32(rate * 0.005 ** (epoch / epochs))
        for start in range(0, len(order), 16):
            part = order[start : start + 16]
            at, place = np.unique(np.concatenate([values[ends[r] : ends[r + 1]] for r in part]), return_inverse=True)
            x = np.zeros((len(part), len(at)), np.float32)
            x[np.repeat(np.arange(len(part)), ends[part + 1] - ends[part]), place] = 1
            wa, va, t = w[at], v[at], trust[at]
            s = x @ va
            raw = b + x @ wa + 0.5 * ((s * s).sum(1) - x @ (va * va).sum(1))
            pull = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]).astype(np.float32)
            step = now * pull / (1 + mass[part] * (1 + 2 * (s * s).sum(1)))
            held = x.T @ step
            w[at] = wa - t * held
            v[at] = va - 2 * t[:, None] * (x.T @ (step[:, None] * s) - held[:, None] * va)
            b -= step.sum()
    return float(b), w, v


def fit(rows: pa.Table, every: dict[int, int]) -> FactorizationMachine:
    """The machine learned from rows (toxic, terms); `every` counts all labelled rows of the classes."""
    y = rows["toxic"].to_numpy().astype(np.float32)
    n1 = int(y.sum())
    n0 = len(y) - n1
    if not n0 or not n1:
        return FactorizationMachine([], -30.0 if not n1 else 30.0, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    lists = rows["terms"].combine_chunks()
    terms, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    bias, weights, vectors = _fit(at, ends, y, len(terms))
    return FactorizationMachine(terms.tolist(), bias - float(np.log((n1 / n0) / (every[1] / every[0]))), weights, vectors, SLOTS)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Fitted:
    """Learn from `docs` (doc_id, text) and `labels` (doc_id, toxic)."""
    prepare(docs.sparkSession)
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))
    # Which rows there are needs no texts; the classes are sampled each for itself, so the prior is theirs.
    rows = materialize(keyed.select("doc_id", "k").join(marked, "doc_id").distinct())
    every = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [rows.where(F.col("toxic") == c).orderBy("k", "doc_id").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(materialize(chosen[0].unionByName(chosen[1])))  # at most 2 * sample rows

    def extract(batch: pa.RecordBatch):
        terms = [sorted({h % SLOTS for w in words_of(t) for h in _hashes(w)}) for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(terms, pa.list_(pa.int32()))], names=["k", "doc_id", "toxic", "terms"])

    joined = keyed.join(chosen, ["doc_id", "k"]).groupBy("k", "doc_id", "toxic").agg(F.first("text").alias("text"))
    found = joined.mapInArrow(by_batch(extract), "k long, doc_id long, toxic int, terms array<int>")
    return fit_in_task(found, lambda table: fit(table, every))


def score(docs: DataFrame, model: Fitted, name: str = "toxicity") -> DataFrame:
    """All columns of `docs` plus the score from 0 to 1 as column `name` (a clashing column is replaced)."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)  # at most SLOTS terms

    @F.arrow_udf("double")
    def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = shared.value.model
        for part in parts:
            yield pa.array([machine.score(t) for t in part.to_pylist()], pa.float64())

    kept = [F.col(f"`{c}`") for c in docs.columns if c != name]
    return docs.select(*kept, judge(F.col("text").cast("string")).alias(name))
