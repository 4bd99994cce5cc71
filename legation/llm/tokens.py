"""Token counts: unigram segmentation that carries only best score and piece count.

The text is cut at spaces into chunks (each with the space mark before it),
as a unigram tokenizer with a space-marking pre-tokenizer does. Inside a
chunk an Aho-Corasick automaton lists the vocabulary pieces that end at each
character, and a Viterbi pass keeps, per character, the best score, the piece
count and whether the last piece is unknown; no path is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legation.llm.common import chunks, text_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of unigram tokenizers: an unknown character scores the lowest piece less this


def load_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


class UnigramCounter:
    """Counts the pieces of the best segmentation.

    Ties go as in the tokenizer's lattice: a path replaces another only with a
    strictly higher score, and pieces are tried from the earliest start, so of
    equal paths the one with the longest last piece stays. A character that no
    single-character piece covers may be an unknown piece; unknown characters
    count one token per UTF-8 byte.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], memory: int = 200_000):
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        self.longest = max((len(piece) for piece, _ in vocabulary), default=0)
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
        if vocabulary:
            self.automaton.make_automaton()
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, int, float]] = {}
        self.memory = memory

    def chunk(self, text: str) -> tuple[int, int, float]:
        """(tokens, tokens from unknown characters, score) of one chunk, remembered for a while."""
        found = self.known.get(text)
        if found is None:
            found = self._segment(text)
            if len(text) <= 64:
                if len(self.known) >= self.memory:
                    self.known.clear()  # costs time, never changes a count
                self.known[text] = found
        return found

    def _segment(self, text: str) -> tuple[int, int, float]:
        # Only the places a piece can reach back to are held, so a text without spaces costs no more memory.
        held = min(len(text), self.longest) + 1
        score, tokens, unknown = [0.0] * held, [0] * held, [0] * held
        # At each end the longest piece, so the earliest start, comes first.
        found = self.automaton.iter(text) if len(self.automaton) else iter(())
        last, piece = next(found, (-1, None))
        now = 0
        for place, char in enumerate(text):
            best, was = None, now
            now = now + 1 if now + 1 < held else 0
            while last == place:
                size, gain = piece
                total = score[now - size] + gain  # a negative index counts from the ring's end
                if best is None or total > best:
                    best, start, extra = total, now - size, 0
                last, piece = next(found, (-1, None))
            if char not in self.single:
                total = score[was] + self.unknown
                if best is None or total > best:
                    best, start, extra = total, was, len(char.encode("utf-8", "surrogatepass"))
            count, bytes_ = tokens[start] + (extra or 1), unknown[start] + extra
            score[now], tokens[now], unknown[now] = best, count, bytes_
        return tokens[now], unknown[now], score[now]

    def count(self, text: str) -> tuple[int, int, float]:
        """(tokens, tokens from unknown characters, score) of a whole text."""
        if not text:
            return 0, 0, 0.0
        parts = text.replace(" ", MARK).split(MARK)
        if parts[0] == "" and len(parts) > 1:
            parts = parts[1:]  # the text begins with a space: no mark is put before it
        known, tokens, unknown, score = self.known, 0, 0, 0.0
        for part in parts:
            part = MARK + part
            n, u, s = known.get(part) or self.chunk(part)
            tokens += n
            unknown += u
            score += s
        return tokens, unknown, score


def token_counts(
    docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text", memory: int = 200_000
) -> DataFrame:
    """One row per document: ``<id>, n_tokens, n_byte_tokens, score``.

    ``n_byte_tokens`` counts the tokens of unknown characters (one per byte),
    ``score`` is the sum of the best segmentation's scores. Null and empty
    texts have 0 tokens; ids may be null or repeated, every input row gives
    one row; other columns are ignored. ``vocabulary`` travels with the task
    (tens of thousands of pieces); ``memory`` bounds the chunks remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(vocabulary, memory)
        for batch in chunks(batches, "text"):
            found = [counter.count(text.as_py()) for text in batch.column(1)]
            tokens, unknown, score = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64()), pa.array(score, pa.float64())],
                names=["id", "n_tokens", "n_byte_tokens", "score"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    out = source.mapInArrow(run, "id long, n_tokens long, n_byte_tokens long, score double")
    return out.withColumnRenamed("id", id_col)
