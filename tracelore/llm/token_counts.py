"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches in each piece of text
that the pre-tokenizer cuts (a space and what follows up to the next), and a Viterbi
pass carries the best score and its number of pieces. Ties keep the first candidate in
order of start, longest first, as the tokenizer does. A character that no piece of
one character matches is unknown: it scores UNKNOWN below the least score and counts
as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracelore.llm.textkit import ids_of, lean

#: Default vocabulary file; its pieces and scores are read as a unigram model.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how far an unknown character scores below the least piece.
UNKNOWN = 10.0
#: Fixed value: the mark that stands for a space and starts a text.
MARK = "▁"
#: Pieces of text whose counts a worker remembers at once.
REMEMBERED = 300_000
_COUNTERS: dict[bytes, PieceCounter] = {}


def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """(piece, score) by id, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class PieceCounter(dict):
    """Counts of pieces of text, computed when first asked for."""

    def __init__(self, vocab: list[tuple[str, float]]) -> None:
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), score))
        if vocab:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN
        self.empty = not vocab

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[piece] = self.count(piece)
        return n

    def count(self, piece: str) -> int:
        """Viterbi over the whole piece; memory follows its length."""
        n = len(piece)
        if self.empty:
            return len(piece.encode())
        score, count, done, unknown = [0.0] * (n + 1), [0] * (n + 1), 0, self.unknown
        best = None
        for last, (size, value) in self.automaton.iter(piece):
            end = last + 1
            if end != done:
                if done and best is not None:
                    score[done], count[done] = best
                # ends that have been passed: close them with an unknown character where nothing of one character matched
                if done and not single:
                    self._unknown(piece, done, score, count, best is not None)
                for k in range(done + 1, end):
                    score[k], count[k] = score[k - 1] + unknown, count[k - 1] + len(piece[k - 1].encode())
                done, best, single = end, None, False
            single = single or size == 1
            value += score[end - size]
            if best is None or value > best[0]:
                best = (value, count[end - size] + 1)
        if done:
            score[done], count[done] = best
            if not single:
                self._unknown(piece, done, score, count, True)
        for k in range(done + 1, n + 1):
            score[k], count[k] = score[k - 1] + unknown, count[k - 1] + len(piece[k - 1].encode())
        return count[n]

    def _unknown(self, piece: str, end: int, score: list, count: list, known: bool) -> None:
        value = score[end - 1] + self.unknown
        if not known or value > score[end]:
            score[end], count[end] = value, count[end - 1] + len(piece[end - 1].encode())


def counter_of(vocab: list[tuple[str, float]]) -> PieceCounter:
    """The worker's counter for a vocabulary, known by a digest of all its pieces and scores."""
    key = hashlib.blake2b(pickle.dumps(vocab), digest_size=16).digest()
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = PieceCounter(vocab)
    return _COUNTERS[key]


def count_tokens(text: str | None, counter: PieceCounter) -> int:
    """Tokens of one text; null and empty texts have none."""
    if not text:
        return 0
    pieces = text.replace(MARK, " ").split(" ")
    # the text starts with a mark; if it starts with a space, that is the mark
    first = 1 if not pieces[0] else 0
    return sum([counter[MARK + p] for p in pieces[first:]])


def token_counts(docs: DataFrame, *, text: str = "text", vocab: list[tuple[str, float]] | None = None, path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, n_chars): one row per row of ``docs``; other columns are not read.

    Texts that are null or empty have 0 tokens. Equal texts have equal counts; there is
    no shuffle, and each task holds one Arrow batch.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path) if vocab is None else vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(pieces.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([ids_of(batch), pa.array([count_tokens(t, counter) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_chars"])

    return docs.select("doc_id", text).mapInArrow(lean(run), "doc_id long, n_tokens long, n_chars long")
