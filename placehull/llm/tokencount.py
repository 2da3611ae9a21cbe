"""Token counts of a unigram vocabulary by a Viterbi pass that keeps only score and number of pieces.

An Aho-Corasick automaton enumerates the vocabulary's matches in a segment; dynamic programming over end positions carries the
best score and the piece count of it. Ties are settled as the tokenizer does: at an end the first start (the longest piece)
stays unless a later start is strictly better. A character without a match of its own gets the score of an unknown
one (lowest score - 10); unknown characters in a row are one unknown piece, which counts its UTF-8 bytes where the vocabulary has byte pieces.

A text is cut into segments at spaces (each space begins the next segment as ``▁``) and around line feeds; counts of segments are
remembered per task, up to ``MEMORY`` of them.

Nulls and ties: a null or empty text has no tokens; equal rows get equal counts. An empty table returns an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.llm.base import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MEMORY = 1 << 18
PENALTY = 10.0


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, in id order; read on the driver and sent to the tasks."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts pieces of segments."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - PENALTY
        self.bytewise = all(f"<0x{b:02X}>" in dict(pieces) for b in (0, 255))
        # A line feed can be cut off where it is in no piece and counts by itself (as one byte).
        self.breaks = self.bytewise and not any("\n" in p for p, _ in pieces)
        self.known: dict[str, tuple[int, float]] = {}

    def segment(self, text: str) -> tuple[int, float]:
        """(pieces, best score) of a segment."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = [False] * n
        for last, (length, score) in self.automaton.iter(text):
            ends[last + 1].append((last + 1 - length, score))  # the longest match at an end comes first
            if length == 1:
                single[last] = True
        best, count, tail = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # tail: 1 if the last piece is unknown
        for end in range(1, n + 1):
            top = None
            for start, score in ends[end]:
                value = score + best[start]
                if top is None or value > top:
                    top, count[end], tail[end] = value, count[start] + 1, 0
            if not single[end - 1]:
                value = self.unknown + best[end - 1]
                if top is None or value > top:
                    width = len(text[end - 1].encode("utf-8", "surrogatepass"))
                    more = width if self.bytewise else 1 - tail[end - 1]
                    top, count[end], tail[end] = value, count[end - 1] + more, 1
            best[end] = top
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a whole text."""
        if not text:
            return 0, 0.0
        tokens, score, known = 0, 0.0, self.known
        # No piece spans a space's start; a line feed in no piece is an unknown character that splits a segment as well.
        text = text.replace(SPACE, " ")
        begun = "" if text[0] == " " else SPACE
        for part in (begun + text.replace(" ", f" {SPACE}")).split(" "):
            lines = part.split("\n") if self.breaks else [part]
            if len(lines) > 1:
                tokens += len(lines) - 1
                score += self.unknown * (len(lines) - 1)
            for piece in lines:
                pair = known.get(piece)
                if pair is None:
                    if len(known) >= MEMORY:
                        known.clear()
                    pair = known[piece] = self.segment(piece) if piece else (0, 0.0)
                tokens += pair[0]
                score += pair[1]
        return tokens, score


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """``docs`` with n_tokens and best_score; columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    docs = docs.drop("n_tokens", "best_score").withColumns({"n_tokens": F.lit(0).cast("long"), "best_score": F.lit(0.0)})
    names = docs.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            found = np.array([counter.text(t.as_py() or "") for t in batch.column("text")], np.float64).reshape(-1, 2)
            columns = [batch.column(c) for c in names[:-2]]
            columns += [pa.array(found[:, 0].astype(np.int64)), pa.array(found[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(count, docs.schema)


def op7_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, load_pieces(VOCABULARY)).select("doc_id", "n_tokens", "best_score")
