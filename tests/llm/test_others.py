"""Nearest vectors, url verdicts, quotations and the pipeline, against brute force and planted cases."""

import random

import numpy as np
import pytest

from colforge.llm import ann, quotes, url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def brute_nearest(rows, every, k):
    held = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            held.setdefault(i, np.array(v, np.float64))
    out = {}
    for q, x in held.items():
        if q % every == 0:
            found = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in held.items() if i != q and len(y) == len(x))
            out[q] = found[:k]
    return out


def test_nearest_has_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=12).astype(np.float32).tolist()) for k in range(900)]
    same = rng.normal(size=12).astype(np.float32).tolist()
    rows += [(k, same) for k in range(1000, 1300)]
    rows += [(1400, None), (1500, []), (1600, [0.0] * 12), (1700, [1.0, None] * 6), (1800, [float("nan")] * 12), (1900, [float("inf")] * 12), (None, same), (2000, [1.0, 2.0]), (2001, [1.0, 2.5])]
    rows += rows[:5]
    df = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<float>, shard int, dim int").repartition(4)
    got = {}
    for r in ann.nearest(df, every=50, k=10, shard_rows=300).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows, 50, 10)
    assert set(got) == set(want)
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        truth = {i: s for s, i in brute_nearest(rows, q or 1, 10_000)[q]} if q else {i: s for s, i in brute_nearest(rows, 50, 10_000)[q]}
        assert all(s == pytest.approx(truth[v], abs=1e-12) for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & {i for _, i in want[q]})
        total += len(want[q])
    assert hits >= 0.95 * total
    # In the group of equal vectors the order of ids decides.
    assert [v for _, v, _ in got[1100]] == list(range(1000, 1010)) and got[2000] == [(1, 2001, 0.5)]


def test_nearest_of_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty).count() == 0
    assert ann.nearest(spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")).count() == 0


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return host, path, max(fit, key=lambda r: len(r[0] + r[1]), default=None)


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(2)
    bits = ["http", "://", "a.", "example.net", "example.com", "EXAMPLE.Net", "xnet", "org", "net", "/", "/en/", "/de/", "/fr/", "?x=/en/", "#f", "\n", "é", "user@", ":80"]
    urls = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 7))) for _ in range(700)] + [None, "", "://", "http://net", "http://net/", "http://a.NET/x", "ftp://org/fr/"]
    df = spark.createDataFrame([(k, u, None, "r", "v") for k, u in enumerate(urls)], "page_id long, url string, html string, rule string, node string")
    out = url_filter.judge(df, RULES).collect()
    assert len(out) == len(urls)
    for r in out:
        host, path, rule = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[0] + rule[1], rule[2] if rule else "allow"), urls[r.page_id]


def test_aliases_of_a_blocked_url_are_blocked(spark):
    link = lambda u: f'<html><LINK href="{u}" rel="canonical"></html>'
    move = lambda u: f"<meta http-equiv='refresh' content='0; URL={u}'>"
    pages = [
        (1, "https://start.example.org/x", link("https://bad.net/page")),  # the target is blocked by its rule, and is no page here
        (2, "https://other.example.org/y#top", move("https://START.example.org/x")),
        (3, "https://shop.example.net/en/z", move("/../x") + link("https://other.example.org/y")),  # an explicit allow stays
        (4, "https://a.example.org/one", link("/two")),
        (5, "https://a.example.org/two", "<link rel='stylesheet' href='https://bad.net/page'>"),
        (6, "https://a.example.org/two", None),
        (7, None, link("https://bad.net/page")),
        (8, "https://q.example.org/fr/p", link("https://bad.net/page")),
        (9, "https://c.example.org/d/e", "<link rel=canonical href=f>"),
        (10, "https://c.example.org/d/f", move("//bad.net/page")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.by_alias) for r in url_filter.judge(df, RULES).collect()}
    assert got == {
        1: ("block", True), 2: ("block", True), 3: ("allow", False), 4: ("allow", False), 5: ("allow", False), 6: ("allow", False),
        7: ("allow", False), 8: ("allow", False), 9: ("block", True), 10: ("block", True),
    }
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_quotations(spark):
    rows = [
        (1, 0, "a", "Hello there.\nHow are you?"), (1, 1, "b", "> Hello there.\n> How are you?\nFine!"),
        (1, 2, "c", ">> Hello there.\n>> how  are YOU?\n> Fine!\nGood to hear"), (1, 3, "d", "New thread"), (1, 4, "e", "> How are you?\nBad"),
        (1, 5, None, None), (1, 6, "f", "  > Good to hear\r\nok"), (1, 7, "g", "> not said before\nok"), (1, 8, "g", "not said before"),
        (2, 0, "a", "> New thread\nother"), (2, 1, "b", ""), (2, 1, "b", ""), (3, 0, "a", "> > > \n>"), (None, 1, "q", "> Fine!\nzz"), (4, None, "q", "> Fine!\nzz"),
        (5, 0, "a", "> " + "long " * 20000), (6, 0, "a", "long " * 20000),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, position int")
    out = quotes.conversations(df).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): r for r in out}
    answer = {k: (r.to_conv, r.to_turn) for k, r in got.items() if r.to_turn is not None}
    assert answer == {(1, 1): (1, 0), (1, 2): (1, 1), (1, 4): (1, 0), (1, 6): (1, 2), (2, 0): (1, 3)}
    assert [t for _, t in sorted((r.position, r.turn) for r in out if r.conv_id == 1)] == [0, 1, 4, 2, 6, 3, 5, 7, 8]
    assert {k: r.depth for k, r in got.items() if r.depth} == {(1, 1): 1, (1, 4): 1, (1, 2): 2, (1, 6): 3, (2, 0): 1}
    assert got[1, 2].text == "Good to hear" and got[1, 2].n_quotes == 2 and got[1, 5].text is None and got[3, 0].text == ""
    assert (got[2, 0].root_conv, got[2, 0].root_turn) == (1, 3) and got[None, 1].to_turn is None
    assert quotes.conversations(df.limit(0)).count() == 0


def test_deep_threads_are_followed_to_their_root(spark):
    rows = [(1, k, "a", (f"> message {k - 1}\n" if k else "") + f"message {k}") for k in range(70)]
    out = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.turn, r.root_turn, r.depth, r.position) for r in out) == [(k, 0, k, k) for k in range(70)]


def pipeline_rows():
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sitamet", "elit"]) + rng.choice("abcdefgh") * 2 + str(rng.randint(0, 30)) for _ in range(n))
    clean = [say(60) for _ in range(60)]
    items = [(k, say(30)) for k in range(5)]
    docs = [(k, t, "en") for k, t in enumerate(clean)]
    docs += [(100, clean[3], "en"), (101, clean[4] + " tail", "en"), (102, clean[5] + " " + items[2][1], "en"), (103, None, None), (104, "123 ...", "en"), (105, "", "en")]
    docs += [(200 + k, say(20) + " dreckiger " + say(5), "en") for k in range(30)]
    french = lambda n: " ".join(rng.choice(["éla", "çoi", "que", "noûr", "eau"]) + rng.choice(["ment", "ère", "eux", "ôt"]) for _ in range(n))
    docs += [(300 + k, french(rng.choice([4, 40])), "fr") for k in range(24)] + [(6, clean[6], "en")]
    labels = [(k, 1, 0) for k in range(60)] + [(200 + k, 1, 1) for k in range(0, 30, 2)]
    return docs, items, labels


def test_pipeline_keeps_the_clean_and_drops_the_planted(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs, items, labels = pipeline_rows()
    spark.createDataFrame([(*d, "s", 1, "x") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = frame.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(f"{tmp_path}/out{k}")
        frame = spark.read.parquet(f"{tmp_path}/out{k}")
        kept[name] = sorted(r.doc_id for r in frame.select("doc_id").collect())
        assert name == "packing" or frame.columns == columns
    every = sorted(d[0] for d in docs)
    clean = [*range(60), *range(300, 324)]
    assert kept["language"] == [x for x in every if x not in (103, 104, 105)]
    assert kept["toxicity"] == [x for x in kept["language"] if not 200 <= x < 230]
    assert kept["near_duplicates"] == sorted([*clean, 102])
    assert kept["decontamination"] == clean and sorted(set(kept["packing"])) == clean
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, frame.select("doc_id", "piece", "ids_crc32").collect()))


def test_texts_under_one_id_are_documents_each_for_itself(spark, tmp_path):
    from colforge.llm import pipeline

    rng = random.Random(4)
    a, b, c, d, e, item = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(6))
    rows = [(0, a), (1, a), (1, b), (1, b), (1, c), (7, c + " tail"), (None, d), (None, d), (8, e), (None, e), (None, ""), (None, ""), (9, None), (9, None), (9, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)
    out = pipeline.near_dup_stage(spark, docs, "")
    assert out.columns == docs.columns
    want = [(0, a), (1, b), (1, c), (None, d), (8, e), (None, ""), (None, ""), (9, None), (9, "")]
    assert sorted(map(repr, out.select("doc_id", "text").toLocalIterator())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in want)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    dirty = spark.createDataFrame([(1, a), (1, b + " " + item), (None, c), (None, item)], "doc_id long, text string")
    assert sorted(r.text for r in pipeline.decontamination_stage(spark, dirty, str(tmp_path)).collect()) == sorted([a, c])
