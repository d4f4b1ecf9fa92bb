"""Token counts of a unigram tokenizer without making the tokens.

The vocabulary (piece, score) comes from a tokenizer file. An Aho-Corasick automaton enumerates the pieces that end at
each character of a word; dynamic programming carries the best score and the number of pieces of the best path. Ties are
broken as the tokenizers library does: at each end the longest piece is tried first and only a strictly better score
replaces it; a character that is no piece itself may be unknown, at the lowest score less 10, and counts as one token per
UTF-8 byte when the vocabulary has byte pieces, else runs of unknown characters count once.

Text is cut like the library's Metaspace: spaces become U+2581, one is put in front, every U+2581 begins a new word.
Scores add as 64-bit floats in the library's order, so counts equal the length of the library's encoding.

Every text is read whole, in place, without a shuffle; frequent words are counted once per worker. Null and empty
texts have 0 tokens. Rows with equal or null doc_id are counted each for itself; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colforge.llm.common import prepare

# Fixed values of the library: the space mark, and what an unknown character costs beyond the lowest score.
MARK = "▁"
UNKNOWN_PENALTY = 10.0

CACHED_WORDS = 400_000
CACHED_LENGTH = 48


def sentencepiece_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with their scores in the order of their ids, and the id of the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())], model.unk_id()


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], unknown: int):
        self._automaton = ahocorasick.Automaton()
        scores = {}
        for piece, score in pieces:
            scores[piece] = score  # of equal pieces the last one counts
        for piece, score in scores.items():
            if piece:
                self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self._bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        self._words: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = len(word)
        best, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at = 0  # characters before this one are done

        def unknown(end: int, found: float | None, pieces: int) -> None:
            """Close an end: the unknown character is tried last and only wins when strictly better."""
            score = best[end - 1] + self._unknown
            if found is None or score > found:
                best[end], loose[end] = score, True
                if self._bytes:
                    count[end] = count[end - 1] + len(word[end - 1].encode("utf-8", "replace"))
                else:
                    count[end] = count[end - 1] + (not loose[end - 1])
            else:
                best[end], count[end] = found, pieces

        found, pieces, single = None, 0, False
        for last, (length, score) in self._automaton.iter(word):
            while at < last:  # ends without a piece, and the end that is complete now
                if single:
                    best[at + 1], count[at + 1] = found, pieces
                else:
                    unknown(at + 1, found, pieces)
                at, found, pieces, single = at + 1, None, 0, False
            start = last + 1 - length
            total = score + best[start]
            if found is None or total > found:
                found, pieces = total, count[start] + 1
            single = single or length == 1
        while at < n:
            if single:
                best[at + 1], count[at + 1] = found, pieces
            else:
                unknown(at + 1, found, pieces)
            at, found, pieces, single = at + 1, None, 0, False
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if not text.startswith(MARK):
            text = MARK + text
        known, total = self._words, 0
        for word in text.split(MARK)[1:]:
            n = known.get(word)
            if n is None:
                n = self.word(MARK + word)
                if len(word) <= CACHED_LENGTH and len(known) < CACHED_WORDS:
                    known[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(*sentencepiece_vocabulary(path))


def count_tokens(docs: DataFrame, vocabulary: str, name: str = "n_tokens") -> DataFrame:
    """All columns of `docs` plus the token count of `text` as column `name` (a clashing column is replaced)."""
    prepare(docs.sparkSession)

    @F.arrow_udf("long")
    def counted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([counter(vocabulary).count(t) for t in part.to_pylist()], pa.int64())

    kept = [F.col(f"`{c}`") for c in docs.columns if c != name]
    return docs.select(*kept, counted(F.col("text").cast("string")).alias(name))
