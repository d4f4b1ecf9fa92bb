"""Token frames, token counts and packing against the tokenizers library."""

import io
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer, models, pre_tokenizers  # noqa: E402

from colforge.llm import packing, token_counts, token_frames  # noqa: E402
from colforge.llm.encoder import Encoder  # noqa: E402

BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, part int, n string, length int"
ODD = ["aA", "É", "é", "é", "Σ", "ς", "ß", "ı", "İ", " ", "\u0085", "\x1c", "\x0b", "\x00", "\n", "\t", "\r", "'s", "'LL", "m", "0", "²", "¼", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "&&&", ".", "\xad", "가", "ᄀ", "ᅡ", "🎉"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def odd_texts(n, seed=1):
    random.seed(seed)
    return ["".join(random.choice(ODD) for _ in range(random.randint(0, 14))) for _ in range(n)]


def docs(spark):
    long = " ".join(odd_texts(3000, 5)) + "x" * 5000
    rows = [(3, "Hello world, the end.", 1, "a", 2), (1, None, 1, None, 2), (2, "", None, "b", 1), (5, long, 0, "c", 0), (4, "Same text", 1, "d", 1), (4, "Same text", 1, "d", 1), (None, "no id", 1, "e", 1)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_encoder_equals_library(tokenizer, monkeypatch):
    texts = odd_texts(4000) + ["plain words only the the and", "Ümlaut à la carte, s'il vous plaît."]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert Encoder(BPE).encode(texts) == want
    monkeypatch.setattr("colforge.llm.encoder.CHARS_AT_ONCE", 7)
    monkeypatch.setattr("colforge.llm.encoder.CACHED_WORDS", 20)
    assert Encoder(BPE).encode(texts) == want


def test_frames_round_trip(spark, tmp_path, tokenizer):
    rows, df = docs(spark)
    manifest = token_frames.write_frames(df, BPE, f"file://{tmp_path}/frames", end_id=1, frame_bytes=256)
    got = token_frames.read_frames(manifest).orderBy("start").collect()
    at = 0
    for row, (doc_id, text) in zip(got, sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_reader_takes_only_the_frames_it_needs_and_checks_them():
    out = Bytes()
    writer = token_frames.FrameWriter(out, frame_bytes=64)
    tokens = {k: np.arange(k * 7, dtype="<u4") + k for k in range(20)}
    for k, ids in tokens.items():
        writer.add(k, ids.tobytes())
    writer.close()
    reader = token_frames.FrameReader(out)
    loaded = []
    load = reader._load
    reader._load = lambda k: loaded.append(k) or load(k)
    assert np.array_equal(reader.tokens(11)[0], tokens[11]) and len(set(loaded)) < 8
    assert all(np.array_equal(reader.tokens(k)[0], ids) for k, ids in tokens.items())
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(i.tobytes() for i in tokens.values())
    other = Bytes()
    writer = token_frames.FrameWriter(other, frame_bytes=64)
    for k, ids in tokens.items():
        writer.add(k, (ids + 1).tobytes())
    writer.close()
    forged = token_frames.FrameReader(other)
    forged._rows[:, 2] = reader._rows[:, 2]
    with pytest.raises(ValueError, match="checksum"):
        forged.tokens(11)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    manifest = token_frames.write_frames(empty, BPE, f"file://{tmp_path}/none")
    assert token_frames.read_frames(manifest).count() == 0
    assert packing.pack(empty, BPE).count() == 0
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.count_tokens(empty, vocabulary).count() == 0


def unigram(pieces, unknown, byte_fallback):
    t = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_equal_library_with_ties():
    random.seed(3)
    for _ in range(25):
        words = {"".join(random.choice("ab▁c") for _ in range(random.randint(1, 4))) for _ in range(15)}
        pieces = [("<unk>", 0.0)] + [(w, -float(random.randint(1, 3))) for w in sorted(words)]
        library, own = unigram(pieces, 0, False), token_counts.UnigramCounter(pieces, 0)
        for _ in range(150):
            text = "".join(random.choice("abcd  ") for _ in range(random.randint(0, 12)))
            assert own.count(text) == len(library.encode(text).ids), (pieces, text)


def test_counts_equal_library_on_a_public_vocabulary(spark):
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    library = unigram(*token_counts.sentencepiece_vocabulary(vocabulary), True)
    rows, df = docs(spark)
    got = token_counts.count_tokens(df, vocabulary, name="n")
    assert got.columns == ["doc_id", "text", "part", "length", "n"]
    for row in got.collect():
        assert row.n == len(library.encode(row.text or "").ids)
    counter = token_counts.counter(vocabulary)
    for text in odd_texts(2000, 8):
        assert counter.count(text) == len(library.encode(text).ids), repr(text)


def test_pack(spark, tokenizer):
    rows, df = docs(spark)
    got = packing.pack(df, BPE, capacity=16, end_id=0).collect()
    want = []
    for doc_id, text in ((r[0], r[1]) for r in rows):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(doc_id, k, s, len(ids[s : s + 16]), zlib.crc32(ids[s : s + 16].tobytes())) for k, s in enumerate(range(0, len(ids), 16))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 16


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    low, high, n = [(1, 2048, 3000), (500, 1200, 4000), (650, 720, 2000), (1, 60, 900), (2048, 2049, 5), (1000, 1001, 7)][seed]
    counts = np.unique(rng.integers(low, high, n), return_counts=True)
    histogram = {int(a): int(b) for a, b in zip(*counts)}
    plan = packing.plan(histogram, 2048, phases=8)
    placed = {}
    for copies, lengths in zip(plan.copies, plan.lengths):
        assert copies > 0 and sum(lengths) <= 2048
        for x in lengths:
            placed[x] = placed.get(x, 0) + copies
    assert placed == histogram
    first_fit = sum(k for _, k in packing._best_fit(dict(histogram), 2048))
    assert plan.sequences <= 1.01 * first_fit + 1
    assert packing.plan({}, 2048).sequences == 0
