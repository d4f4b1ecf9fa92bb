"""Near-duplicates and decontamination against brute force."""

import random
import re

import numpy as np
import pytest

from colforge.llm import decontaminate, near_dup
from colforge.llm.common import components, mix
from colforge.llm.words import ALPHANUMERIC, BY_SPACE, hash_words

EXTRA = "lang string, n long, band long, label string, item_id long, matched int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, size):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size):
    sets = {i: shingle_set(t, size) for i, t in rows if i is not None}
    least = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {i: (len(sets[i]), least[i]) for i in sets}


def edited(rng, words, share):
    return [rng.choice("abcdefghij") * 3 + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


def copies(n=260, seed=4):
    """A large group of ever more edited copies (a star whose members are often unlike each other), small groups, and others."""
    rng = random.Random(seed)
    fresh = lambda k: [f"w{rng.randint(0, 4000)}" for _ in range(k)]
    base, rows = fresh(90), []
    for k in range(n):
        rows.append(" ".join(edited(rng, base, rng.choice([0.0, 0.02, 0.05, 0.09, 0.14]))))
    for _ in range(40):
        other = fresh(rng.choice([1, 2, 6, 40, 200]))
        rows += [" ".join(edited(rng, other, 0.03)) for _ in range(rng.randint(1, 4))]
    rows += [None, "", " \t\n", "one", "ONE", "one two", "é É", "x " * 30000, "X\tx\n" * 20000, "x y", "x y"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 50)
    rows = copies() + [(None, "nobody knows this row at all"), (None, None)]
    extra = [(i, t, "xx", 1, 2, "b", 3, 4) for i, t in rows]
    extra += [extra[5], extra[7]]
    df = spark.createDataFrame(extra, "doc_id long, text string, " + EXTRA).repartition(5)
    got = near_dup.near_duplicates(df, words=size, percent=80).collect()
    want = brute_components(rows, size)
    assert len(got) == len(extra)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_blocks_alone_find_everything(spark, monkeypatch):
    """When no pivot pair is ever verified the complete comparison finds the same components."""
    monkeypatch.setattr(near_dup, "_verify", lambda pairs, sets, percent: pairs.where("a < 0"))
    monkeypatch.setattr(near_dup, "BLOCK", 30)
    rows = copies(60, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, words=2).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 2).items()}


def test_no_rows(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_chains_meet_at_their_smallest_node(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 105), (105, 103), (7, 7)] + [(200, k) for k in range(201, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in (100, 103, 105)}, **{k: 200 for k in range(200, 400)}}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    items = mix(rng.integers(0, 1 << 62, 4000, np.int64).astype(np.uint64))
    a, b = near_dup.registers(items[:2200]), near_dup.registers(items[1800:])
    assert np.array_equal(np.maximum(a, b), near_dup.registers(items))
    for shared in (0, 300, 700, 1000):
        x, y = items[:1000], items[1000 - shared : 2000 - shared]
        p, q = near_dup.registers(x)[None], near_dup.registers(y)[None]
        guess = near_dup.estimate((p > q).sum(1), (p < q).sum(1), np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(guess - shared / (2000 - shared)) < 0.1


def test_words_are_those_of_the_pattern():
    rng = random.Random(3)
    alphabet = list("abAB \t\n\r\x0b\x0c\x1c.é İ")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(500)] + ["y" * 300, "y" * 301, "y" * 64 + "z"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(d) for d in data])
    for kind, pattern in ((BY_SPACE, "[^\x20\x09-\x0d]+"), (ALPHANUMERIC, "[a-z0-9\x80-\U0010ffff]+")):
        hashes, at = hash_words(np.frombuffer(b"".join(data), np.uint8), offsets, kind)
        known = {}
        for k, text in enumerate(texts):
            words = re.findall(pattern, lower(text))
            assert len(words) == at[k + 1] - at[k]
            for w, h in zip(words, hashes[at[k] : at[k + 1]].tolist()):
                assert known.setdefault(w, h) == h
        assert len(set(known.values())) == len(known)


def brute_runs(docs, items, least):
    words = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", lower(t or ""))
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if len(v) < decontaminate.SHORTEST:
                continue
            for diagonal in range(-len(v) + 1, len(w)):
                lo, hi = max(0, -diagonal), min(len(v), len(w) - diagonal)
                best = score = matched = top = 0
                for k in range(lo, hi):
                    if v[k] == w[k + diagonal]:
                        score, matched = score + 1, matched + 1
                    else:
                        score -= decontaminate.SUBSTITUTION
                    if score <= 0:
                        score, matched = 0, 0
                    if score > top:
                        top, best = score, matched
                if best >= min(least, -(-8 * len(v) // 10)):
                    out[d, i] = max(out.get((d, i), 0), best)
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([3, 6, 9, 14, 30, 60])))) for k in range(25)] + [(90, None), (91, ""), (92, "Tiny one."), (None, " ".join(say(20)))]
    items += [(93, items[4][1]), items[6], items[6]]
    docs = []
    for k in range(60):
        text = say(rng.choice([0, 5, 80]))
        if k % 2:
            passage = rng.choice(items[:25])[1].split()
            step = rng.choice([2, 3, 4, 5, 7, 1000])
            passage = ["other" if (j + 1) % step == 0 else w for j, w in enumerate(passage)]
            text = text + passage + say(rng.choice([0, 10]))
        docs.append((k, ", ".join(text).title()))
    docs += [(70, None), (71, ""), (72, "Long " * 30000 + items[5][1]), (None, items[28][1])]
    df = spark.createDataFrame([(i, t, "x", 1, 2, "b", 3, 4) for i, t in docs + docs[:3]], "doc_id long, text string, " + EXTRA).repartition(4)
    bench = spark.createDataFrame([(i, t, 1, 5) for i, t in items], "item_id long, text string, n int, seed int")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.contaminated(df, bench).collect()}
    want = brute_runs([d for d in docs if d[0] != 72], items, 10)
    # Every second token replaced is beyond what a run tolerates; no mask may miss the others.
    assert {k: v for k, v in got.items() if k[0] != 72} == want
    assert (72, 5) in got


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 0
    assert decontaminate.contaminated(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
