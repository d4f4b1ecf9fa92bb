"""Token ids of whole texts by a tokenizer file of the tokenizers library, with a bounded cache of words.

The tokenizer must drop white space and never build a token across it (as `word_bpe_49k.json` does). Then the
ids of a text are those of its words one after another, and frequent words need encoding only once per worker.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import regex

CACHED_WORDS = 300_000
CACHED_LENGTH = 48
# Characters that are split into words at the same time.
CHARS_AT_ONCE = 1_000_000


class _Ids(dict):
    """Cached ids by word; what is not kept is looked up among the words of the texts at hand."""

    rare: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.rare[word]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._ids = _Ids({"": b""})
        self._pieces: dict[str, bytes] = {}
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._model = self._tokenizer.model
        self._model._resize_cache(0)  # most words that come this far never come again
        self._missed = 0
        self._split = _plain_split(self._tokenizer)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text the ids as little-endian unsigned 32-bit integers; a null text has none."""
        out: list[bytes] = []
        waiting: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if size + len(text) > CHARS_AT_ONCE and waiting:
                out += self._encode(waiting)
                waiting, size = [], 0
            if len(text) > CHARS_AT_ONCE:
                out.append(b"".join(b"".join(self._encode([part])) for part in _parts(text)))
            else:
                waiting.append(text)
                size += len(text)
        return out + self._encode(waiting)

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        ids, seen, rare = self._ids, set(), {}
        for words in split:
            seen.update(words)
        for word, code in self._unseen([w for w in seen if w not in ids]):
            (ids if len(ids) < CACHED_WORDS and len(word) <= CACHED_LENGTH else rare)[word] = code
        # A full cache keeps the words it met first, the common ones, until the texts have become different ones.
        self._missed += len(rare)
        if self._missed > 20 * CACHED_WORDS:
            self._missed, self._ids, self._pieces = 0, _Ids({"": b""}), {}
        ids.rare = rare
        return [b"".join(map(ids.__getitem__, words)) for words in split]

    def _unseen(self, words: list[str]):
        """(word, ids) of each. Plain words go to the model piece by piece, past the slower general steps."""
        plain = words if self._split else []
        if plain and not _PLAIN.fullmatch(" ".join(plain)):
            plain = [w for w in words if _PLAIN.fullmatch(w)]
        if any(a in " ".join(plain) for a in self._added):
            plain = [w for w in plain if not any(a in w for a in self._added)]
        if len(plain) < len(words):
            done = set(plain)
            for word in words:
                if word not in done:
                    yield word, np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if not plain:
            return
        pieces, at, codes = self._pieces, 0, []
        for piece in self._split(" ".join(plain).lower()):
            if piece == " ":
                yield plain[at], b"".join(codes)
                at, codes = at + 1, []
                continue
            code = pieces.get(piece)
            if code is None:
                tokens = self._model.tokenize(piece if piece.isascii() else piece.translate(_BYTES))
                code = b"".join([t.id.to_bytes(4, "little") for t in tokens])
                if len(pieces) < CACHED_WORDS and len(piece) <= CACHED_LENGTH:
                    pieces[piece] = code
            codes.append(code)
        yield plain[at], b"".join(codes)


# Printable ASCII, the space between words, and the letters of Latin-1: normal forms of themselves, with plain lower-case forms.
_PLAIN = regex.compile("[\x20-\x7eÀ-ÖØ-öø-ÿ]+")
# Byte-level tokenizers spell a character of Latin-1 as its two UTF-8 bytes, each byte as a printable character: those
# from A1 on (but AD) as themselves, the others as U+0100 and on, in order after the 33 bytes up to 20 and 7F.
_UNPRINTABLE = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
_BYTES = {c: "".join(chr(0x100 + _UNPRINTABLE.index(b)) if b in _UNPRINTABLE else chr(b) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def _plain_split(tokenizer):
    """How the tokenizer cuts a lower-case word, if it normalises by NFC and lower case and cuts by one pattern; else None."""
    rules = json.loads(tokenizer.to_str())
    normal, cut = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    kinds = [n["type"] for n in normal.get("normalizers", [])]
    steps = cut.get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return None
    split, level = steps
    if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
        return None
    return regex.compile(split["pattern"]["Regex"] + "| ").findall


def _parts(text: str):
    """The whole text in parts that end after a space, each near CHARS_AT_ONCE long."""
    start = 0
    while start < len(text):
        end = text.find(" ", start + CHARS_AT_ONCE)
        end = len(text) if end < 0 else end + 1
        yield text[start:end]
        start = end


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, kept between tasks."""
    return Encoder(path)
