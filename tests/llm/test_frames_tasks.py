"""Token files are read back by as many tasks as there are files."""

import pytest

from colforge.llm import token_frames


def test_a_file_is_a_task(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(k, f"some words of document {k} " * 20) for k in range(400)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = token_frames.write_frames(docs, tokenizers.path("word_bpe_49k.json"), str(tmp_path / "frames"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = manifest.count()
    assert files > 1
    found = token_frames.read_frames(manifest)
    assert found.rdd.getNumPartitions() == files
    rows = found.orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(400))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    assert len({r.file_no for r in rows}) == files
