"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language has a codeword; one logistic classifier per bit separates the languages with a 1 from those with a 0. A
text gets the language whose codeword costs least: the sum of the bits' logistic losses, each weighted by how reliable
its classifier was in training. When the second-best codeword is nearly as cheap, the text is flagged as ambiguous.

Learning takes at most SAMPLE_DOCUMENTS labelled rows, equally many per language, those with the smallest hashes of doc_id
and text; rows equal in both teach once, and should there be more languages than that, some of them go unlearned. It runs
inside one executor task, the driver sees only the model. Scoring reads every text whole, in place, without a shuffle. Texts that are null or hold no letter are `und` with score 0 and
ambiguous. Without any labelled row every text is `und`. Rows with equal or null doc_id are each judged for themselves;
other columns are passed on untouched or not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colforge.llm.common import Fitted, fit_in_task, prepare

SAMPLE_DOCUMENTS = 1600
BUCKETS = 1 << 13
GRAMS = (2, 3, 4)
PART_BYTES = 1 << 20
FRAGMENT = 60
AMBIGUOUS = 0.1

# ASCII bytes that are not letters become spaces; a letter keeps its lower-case form.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)]


def features(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams of the whole text, damped and scaled to length 1."""
    data = _FOLD[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)]
    counts = np.zeros(BUCKETS)
    for start in range(0, len(data), PART_BYTES):
        part = data[start : start + PART_BYTES + max(GRAMS) - 1].astype(np.uint32)
        for n in GRAMS:
            size = min(len(part) - n + 1, PART_BYTES)
            if size <= 0:
                continue
            gram = np.full(size, n, np.uint32)
            for k in range(n):
                gram = gram * np.uint32(0x01000193) + part[k : k + size]
            gram *= np.uint32(0x9E3779B1)
            counts += np.bincount(gram >> np.uint32(32 - 13), minlength=BUCKETS)
    x = np.sqrt(counts)
    return (x / max(np.linalg.norm(x), 1e-9)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """One row of +1 / -1 per language: every split of few languages, else the best of some random codes."""
    if n <= 1:
        return np.zeros((n, 0))
    if n <= 6:
        rest = [set(c) for k in range(1, n) for c in combinations(range(1, n), k)]
        return np.array([[1.0 if k in ones else -1.0 for ones in rest] for k in range(n)])
    random, best, distance = np.random.default_rng(7), None, -1
    bits = math.ceil(10 * math.log2(n))
    for _ in range(200):
        code = random.choice([-1.0, 1.0], (n, bits))
        least = int((bits - (code @ code.T - 2 * bits * np.eye(n)).max()) / 2)
        if least > distance and (np.abs(code.sum(0)) < n).all():
            best, distance = code, least
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score from 0 to 1, and whether the decision is ambiguous."""
        margins = x @ self.weights + self.bias
        losses = np.logaddexp(0, -margins[:, None, :] * self.codes[None]) @ self.trust
        chance = np.exp(losses.min(1, keepdims=True) - losses)
        chance /= chance.sum(1, keepdims=True)
        order = np.sort(chance, 1)
        second = order[:, -2] if chance.shape[1] > 1 else np.zeros(len(x))
        return losses.argmin(1), order[:, -1], order[:, -1] - second < AMBIGUOUS


def _fit(x: np.ndarray, y: np.ndarray, codes: np.ndarray, steps: int = 200, rate: float = 0.5, keep: float = 1e-4):
    """Logistic regression for all bits at once, by full-batch Adam."""
    target = codes[y].astype(np.float32)
    w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = 1 / np.bincount(y)[y]  # every language weighs the same
    share = (share / share.sum()).astype(np.float32)[:, None]
    for t in range(1, steps + 1):
        pull = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * share
        g = x.T @ pull + keep * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * pull.sum(0)
    wrong = ((np.sign(x @ w + b) != target) * share).sum(0)
    return w, b, np.clip(1 - 2 * wrong, 0.05, 1)


def fit(rows: pa.Table) -> LanguageModel | None:
    """The model learned from rows (lang, x): x are the features, BUCKETS numbers of 16 bits."""
    names, y = np.unique(np.array(rows["lang"].to_pylist(), object), return_inverse=True)
    if not len(names):
        return None
    x = np.empty((len(y), BUCKETS), np.float32)
    k = 0
    for chunk in rows["x"].chunks:
        for held in chunk:
            x[k] = np.frombuffer(held.as_buffer(), np.float16)
            k += 1
    codes = codewords(len(names))
    if codes.shape[1] == 0:
        return LanguageModel(list(names), codes, np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.zeros(0))
    return LanguageModel(list(names), codes, *_fit(x, y, codes))


def train(docs: DataFrame, usable: Column, sample: int = SAMPLE_DOCUMENTS) -> Fitted | None:
    """Learn from text and lang of the rows where `usable` holds; None without such rows.

    Reads: how many languages there are, which rows to take (no texts), then the features of these, at most `sample`.
    """
    prepare(docs.sparkSession)
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("k", F.xxhash64("doc_id", "text"))
    languages = rows.agg(F.count_distinct("lang")).first()[0]
    if not languages:
        return None
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("k"))
    chosen = rows.select("lang", "k").withColumn("rank", rank).where(F.col("rank") <= max(1, sample // languages))
    chosen = F.broadcast(chosen.orderBy("rank", "k", "lang").limit(sample).select("lang", "k").distinct())  # at most `sample` rows

    def extract(batches):
        for batch in batches:
            out = []
            for k, lang, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if has_letter(text):
                    out.append((k, lang, features(text).astype(np.float16).tobytes()))
                    # A short stretch of the same text teaches what few words look like.
                    at = k * 7919 % max(1, len(text) - FRAGMENT)
                    if has_letter(text[at : at + FRAGMENT]):
                        out.append((k, lang, features(text[at : at + FRAGMENT]).astype(np.float16).tobytes()))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary()))], names=["k", "lang", "x"])

    found = rows.join(chosen, ["k", "lang"]).groupBy("k", "lang").agg(F.first("text").alias("text"))
    return fit_in_task(found.mapInArrow(extract, "k long, lang string, x binary"), fit)


def identify(docs: DataFrame, model: Fitted | None) -> DataFrame:
    """All columns of `docs` plus lang_pred, lang_score, lang_ambiguous (a clashing column is replaced)."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model or Fitted(pickle.dumps(None)))  # BUCKETS numbers per bit
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_ambiguous")]

    @F.arrow_udf("struct<p:string,s:double,a:boolean>")
    def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            m, texts = shared.value.model, part.to_pylist()
            names, scores, unclear = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            known = [k for k, t in enumerate(texts) if m is not None and has_letter(t)]
            if known:
                at, score, doubt = m.predict(np.stack([features(texts[k]) for k in known]))
                for k, a, s, d in zip(known, at, score, doubt):
                    names[k], scores[k], unclear[k] = m.languages[a], float(s), bool(d)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unclear, pa.bool_())], names=["p", "s", "a"])

    # Nested, so that no column of the input can clash with a helper.
    judged = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), judge(F.col("text").cast("string")).alias("judged"))
    fields = [F.col("row").getField(c).alias(c) for c in kept]
    return judged.select(*fields, F.col("judged.p").alias("lang_pred"), F.col("judged.s").alias("lang_score"), F.col("judged.a").alias("lang_ambiguous"))
