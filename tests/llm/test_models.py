"""Language and toxicity: held-out decisions on made texts, and the odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colforge.llm import language, toxicity
from colforge.llm.common import crc_fold

SYLLABLES = {"xx": "ka lo mi tu re", "yy": "schu bren gol ärt", "zz": "ção nha él oue"}


def words(lang, n, rng):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(spark, n=240):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        rows.append((k, words(lang, rng.choice([3, 40, 200]), rng), lang, "x", k))
    rows += [(n, None, "xx", None, 1), (n + 1, "", None, "a", 2), (n + 2, " 12 !? ", "yy", "a", 3), (None, words("yy", 30, rng), None, "b", None)]
    rows += [(n + 3, words("zz", 30000, rng), None, "b", 4)] * 2
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_score string, judged int").repartition(3)


def test_language(spark):
    rows, df = corpus(spark)
    model = language.train(df, crc_fold("doc_id", 4) != 2)
    got = language.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang", "judged", "lang_pred", "lang_score", "lang_ambiguous"]
    out = got.collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 30 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    for r in out:
        assert 0 <= r.lang_score <= 1 and (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
        if r.doc_id is None:
            assert r.lang_pred == "yy"
        if r.doc_id == 243:
            assert r.lang_pred == "zz"


def test_language_without_labels_or_rows(spark):
    _, df = corpus(spark, 20)
    assert language.train(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None
    assert {r.lang_pred for r in language.identify(df, None).collect()} == {"und"}
    assert language.identify(df.limit(0), language.train(df.limit(0), F.lit(True))).count() == 0
    one = language.train(df.where("lang = 'xx'"), F.lit(True))
    assert {r.lang_pred for r in language.identify(df.where("length(text) > 10 AND doc_id < 20"), one).collect()} == {"xx"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 20):
        codes = language.codewords(n)
        assert codes.shape[0] == n and min(int((codes[a] != codes[b]).sum()) for a in range(n) for b in range(a)) >= max(1, codes.shape[1] // 4)


def test_decoding_mends_a_wrong_bit():
    codes = language.codewords(4)
    model = language.LanguageModel(["a", "b", "c", "d"], codes, np.zeros((1, codes.shape[1]), np.float32), 4 * codes[2], np.ones(codes.shape[1]))
    model.bias[0] *= -1
    at, score, unclear = model.predict(np.zeros((1, 1), np.float32))
    assert at[0] == 2 and score[0] > 0.9 and not unclear[0]
    model.bias[:] = 0
    assert model.predict(np.zeros((1, 1), np.float32))[2][0]


def toxic_rows(n=600):
    """Toxic where an insult meets a group; either alone is harmless."""
    rng = random.Random(9)
    plain = [f"word{k}" for k in range(40)]
    rows, labels = [], []
    for k in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = [rng.choice(plain) for _ in range(30)] + ["dreckig"] * insult + ["nachbarn"] * group
        rng.shuffle(text)
        rows.append((k, " ".join(text).title(), "x"))
        labels.append((k, 1, int(insult and group)))
    return rows, labels


def test_toxicity_learns_a_pair_of_terms(spark):
    rows, labels = toxic_rows()
    truth = {k: t for k, _, t in labels}
    odd = [(None, "Dreckig nachbarn", "x"), (9000, None, "x"), (9001, "", "x"), (9002, "dreckig nachbarn " + "word3 " * 40000, "x"), (9003, rows[0][1], "x"), (9003, rows[0][1], "x")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, score string").repartition(3)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (9001, None, None), (77777, 1, 1), (5, None, None), (7, 1, truth[7])], "doc_id long, quality int, toxic int")
    model = toxicity.train(df.where(crc_fold("doc_id", 5) != 0), marks)
    out = toxicity.score(df, model, "score").collect()
    assert len(out) == len(rows) + len(odd)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80 and sum((r.score >= 0.5) == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r.score for r in out}
    assert by_id[9000] == by_id[9001] and all(0 <= s <= 1 for s in by_id.values())
    assert by_id[9002] >= 0.5


def test_toxicity_learns_pairs_of_many_terms_that_tell_nothing_alone(spark):
    """Each of 40 insults and 40 groups is as frequent in clean as in toxic texts; half of the pairs are toxic."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3))
    insults, groups, plain = ([[word() for _ in range(n)] for _ in range(2)] for n in (20, 20, 30))
    rows, labels = [], []
    for k in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = [rng.choice(insults[a]), rng.choice(groups[b])] + [rng.choice(plain[k % 2]) for _ in range(12)]
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
        labels.append((k, int(a == b)))
    df, truth = spark.createDataFrame(rows, "doc_id long, text string"), dict(labels)
    model = toxicity.train(df.where("doc_id < 1600"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = toxicity.score(df.where("doc_id >= 1600"), model).collect()
    assert len(held) == 400 and sum((r.toxicity >= 0.5) == truth[r.doc_id] for r in held) >= 380


def test_a_larger_label_table_gives_the_same_decisions(spark):
    """Texts that are toxic in three of ten cases pass, however many labelled rows the sample leaves out."""
    rows, labels = [], []
    for k in range(400):
        kind = "vile" if k % 20 == 0 else "heated" if k % 4 == 1 else "calm"
        rows.append((k, f"{kind} words here"))
        labels.append((k, int(kind == "vile" or kind == "heated" and k // 4 % 10 < 3)))
    small, few = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    large = spark.createDataFrame([(k + 1000 * c, t) for k, t in rows for c in range(10)], small.schema)
    many = spark.createDataFrame([(k + 1000 * c, t) for k, t in labels for c in range(10)], few.schema)
    got = []
    for docs, marks in ((small, few), (large, many)):
        scored = toxicity.score(small, toxicity.train(docs, marks, sample=400)).collect()
        got.append({r.doc_id: r.toxicity >= 0.5 for r in scored})
    assert got[0] == got[1] == {k: t.startswith("vile") for k, t in rows}


def test_toxicity_without_labels(spark):
    rows, labels = toxic_rows(30)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.toxicity < 0.5 for r in toxicity.score(df, toxicity.train(df, none)).collect()} == {True}
    ones = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, toxic int")
    assert {r.toxicity > 0.5 for r in toxicity.score(df, toxicity.train(df, ones)).collect()} == {True}
    assert toxicity.score(df.limit(0), toxicity.train(df.limit(0), ones)).count() == 0


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = toxicity.FactorizationMachine([h for w in "aa bb cc".split() for h in toxicity._hashes(w)], 0.3, rng.normal(size=3), rng.normal(size=(3, 2)))
    raw = 0.3 + model.weights.sum() + sum(model.vectors[i] @ model.vectors[j] for i in range(3) for j in range(i))
    assert model.score("BB cc, aa bb") == pytest.approx(1 / (1 + np.exp(-raw)))
