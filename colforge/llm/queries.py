"""One registered query per operator of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colforge.llm.common import crc_fold, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_frames")
def op1_token_frames(spark, sf_dir):
    from colforge.llm.token_frames import new_folder, read_frames, write_frames

    docs = table(spark, sf_dir, "documents")
    files = write_frames(docs, tokenizer_file("word_bpe_49k.json"), new_folder(spark), end_id=1)
    return read_frames(files).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op6_packing")
def op6_packing(spark, sf_dir):
    from colforge.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), capacity=2048, end_id=0)


@query("op4_language")
def op4_language(spark, sf_dir):
    from colforge.llm.language import identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_fold("doc_id", 4) == 2
    judged = identify(docs.withColumn("held_out", held_out), train(docs, ~held_out))
    return judged.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    from colforge.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_fold("doc_id", 5) == 0
    model = train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scored = score(docs.withColumn("held_out", held_out), model, "score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_near_duplicates")
def op3_near_duplicates(spark, sf_dir):
    from colforge.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query("op10_decontaminate")
def op10_decontaminate(spark, sf_dir):
    from colforge.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    from colforge.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_file("piece_bpe_32k.model")).select("doc_id", "n_tokens")


# Fixed values of the query: host, beginning of the path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op8_url_filter")
def op8_url_filter(spark, sf_dir):
    from colforge.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES).drop("by_alias")


@query("op9_quotations")
def op9_quotations(spark, sf_dir):
    from colforge.llm.quotes import conversations

    return conversations(table(spark, sf_dir, "conversations"), any_conversation=True)


@query("op7_nearest_vectors")
def op7_nearest_vectors(spark, sf_dir):
    from colforge.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    from colforge.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=4)


@query(
    "op12_prefix_trie",
    r"""
    WITH steps AS (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
    crc AS (SELECT list(v ORDER BY i) AS t FROM steps),
    said AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    taken AS (SELECT c, l, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                     lambda s, b: xor(list_extract(t, (xor(s, b) & 255) + 1), s >> 8)), 4294967295) % 4 AS h FROM said, crc),
    rebuilt AS (SELECT o.c, list_concat(coalesce(list_slice(b.l, 1, o.h), []), list_slice(o.l, o.h + 1, len(o.l))) AS l FROM taken o LEFT JOIN said b ON b.c = o.c - o.c % 20),
    places AS (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt),
    nodes AS (SELECT list_slice(l, 1, d) AS k, d, min(c) AS c, count(*) AS n,
              sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(l) = d), '')) AS ends FROM places GROUP BY 1, 2),
    family AS (SELECT n.*, coalesce(m.kids, 0) AS kids, p.c AS up, (n.n - 1) * CASE WHEN n.d = 0 THEN 0 ELSE len(regexp_extract_all(n.k[n.d].t, '[^\x20\x09-\x0D]+')) END AS saved
               FROM nodes n LEFT JOIN (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1) m ON m.k = n.k
               LEFT JOIN nodes p ON n.d > 0 AND p.k = list_slice(n.k, 1, n.d - 1)),
    paths AS (SELECT k, unnest(range(0, d + 1)) AS a, kids, saved FROM family),
    below AS (SELECT list_slice(k, 1, a) AS k, count(*) FILTER (kids = 0) AS leaves, sum(saved) AS saved FROM paths GROUP BY 1)
    SELECT f.c::BIGINT AS conv_id, f.d::BIGINT AS depth, f.up::BIGINT AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children,
           b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
    FROM family f JOIN below b ON b.k = f.k
    """,
)
def op12_prefix_trie(spark, sf_dir):
    from colforge.llm.prefix_trie import trie

    return trie(table(spark, sf_dir, "conversations"))


@query("op11_secrets")
def op11_secrets(spark, sf_dir):
    from colforge.llm.secret_scan import KINDS, findings, scan, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(findings(docs))).select("doc_id", "findings")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("findings", lambda s: s["kind"] != KINDS[-1])
    counts = [F.expr(f"CAST(size(filter(findings, s -> s.kind = '{kind}')) AS LONG)").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts[:-1], F.sha2(named(base), 256).alias("base_sha256"), named(F.col("findings")).alias("spans"), counts[-1])
