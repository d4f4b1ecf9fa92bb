import hashlib
import random
import re
import zlib

from colforge.llm import prefix_trie


def plain(rows):
    """Brute force: rebuilt conversations as lists, nodes as prefixes."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    said = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        rebuilt[c] = tuple(said.get(base, [])[:h] + own[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {n: 0 for n in members}
    for n in members:
        if n:
            kids[n[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for n, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(m) - 1) * words
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(n)))).encode()).hexdigest())
        for n, m in members.items()
    )


def got(frame):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect())


def some(seed, convs, longest=7):
    rng = random.Random(seed)
    texts = ["", None, "a", "b c", " d  e\tf g ", "a b c d"]
    rows = []
    for c in convs:
        for k in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([k, k, k, None]) if k else 0, rng.choice(["u", "u", "v", None]), rng.choice(texts[:4] if k < 3 else texts)))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    # Columns named like the operator's own must not matter.
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 int, heads string").repartition(3)


def test_trie_equals_brute_force(spark):
    rows = some(1, [*range(120), -3, -25, 10**12, 407, 3055])
    rows = [r for r in rows if r[1] is not None or r[0] % 3]  # nulls and ties of turn, but no ties between unequal rows of one role
    seen, clean = {}, []
    for r in rows:
        if seen.setdefault((r[0], r[1], r[2] or ""), r[3] or "") == (r[3] or ""):
            clean.append(r)
    assert got(prefix_trie.trie(frame(spark, clean + [(None, 1, "u", "a")]))) == plain(clean)


def test_stretches_and_retries_do_not_change_the_trie(spark, monkeypatch):
    rows = [(c, k, "u", "w" * (k % 3) + " x") for c in (0, 1, 5, 20, 21) for k in range(25 + c)]
    want = plain(rows)
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
    draws, real = [], prefix_trie._turns
    monkeypatch.setattr(prefix_trie, "_turns", lambda *a: draws.append(a[-1]) or (None if len(draws) < 3 else real(*a)))
    assert got(prefix_trie.trie(frame(spark, rows))) == want and draws == [0, 1, 2]


def test_colliding_fingerprints_are_noticed(spark, monkeypatch):
    rows = some(6, range(60))
    rows = [(c, k, "u", t) for k, (c, _, _, t) in enumerate(rows)]
    seeds, real = [], prefix_trie.Fingerprints

    class Weak(real):
        def __init__(self, seed):
            super().__init__(seed)
            seeds.append(seed)
            if seed == 0:
                self.bases = [0, 0, 0]  # every prefix has the same fingerprint

        def back(self, lane, steps):
            return super().back(lane, steps) if any(self.bases) else steps * 0

    monkeypatch.setattr(prefix_trie, "Fingerprints", Weak)
    assert got(prefix_trie.trie(frame(spark, rows))) == plain(rows) and seeds == [0, 1]


def test_hot_turns_long_texts_and_empty_tables(spark):
    rows = [(c, 0, "system", "same start") for c in range(2500)] + [(c, 1, "u", f"own {c % 800}") for c in range(2500)]
    rows += [(7, 2, "u", "long " * 50000), (2501, 0, "u", None), (2502, 0, None, None)]
    assert got(prefix_trie.trie(frame(spark, rows))) == plain(rows)
    assert prefix_trie.trie(frame(spark, rows[:1]).limit(0)).count() == 0
    # h is 3 for 1 (crc32 of "1" modulo 4) and its base is absent: a member of the root without turns.
    assert zlib.crc32(b"1") % 4 == 3 and got(prefix_trie.trie(frame(spark, [(1, 0, "u", "a")]))) == plain([(1, 0, "u", "a")])
