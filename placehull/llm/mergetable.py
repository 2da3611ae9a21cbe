"""Encoding and decoding with a merge-type sentencepiece model, by a table of each prefix's last token.

A merge tokenizer joins the neighbours whose piece scores best (of equal scores the leftmost) until none is left. Two facts make the
result readable without the merges: a prefix that ends at a token border is encoded as the text's own first tokens, so each prefix of a text has
one last token; and a sequence of tokens is the encoding if and only if each two neighbours, merged by themselves, come
out as these two. So, from left to right, an Aho-Corasick automaton gives the pieces that end at a character, and of these the one
which is compatible with the last token of the prefix before it is stored: one whole number per character. The ids are then
recovered backwards from the end of the text.

Compatibility of a pair is tested on the symbols that stand at the border while either token is merged (``edges``): a border is
crossed when a piece made of the left and the right one beats the merges that would consume them. Pieces some merge of which does not score strictly below
its parts are merged out instead. Tests are remembered, as are the ids of short segments; both memories are emptied when full.

A text is cut into segments where no piece has the two characters side by side (before a run of spaces, around line feeds), which
changes no token. A character in no piece becomes its UTF-8 bytes. Memory per text: the text, four bytes per character
of its longest segment and its ids.

Nulls and ties: a null or empty text has no tokens and decodes to the empty text; equal rows get equal results; a null doc_id stays null. An empty
table returns an empty one. Input columns named as a result are replaced, others are kept.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.llm.base import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
SHORT = 64  # longest segment that is remembered
MEMORY = 1 << 19  # segments remembered per worker
PAIRS = 1 << 20  # pair tests remembered per worker
LONE = -1  # the last token of a prefix that ends in a character of no piece
FIELDS = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def merged(text: str, scores: dict[str, float]) -> tuple[list[str], list[tuple[str, str, bool, bool]]]:
    """(symbols left, merges) of a short text, by the tokenizer's rule; a merge is (left, right, at the text's start, at its end)."""
    symbols, merges = list(text), []
    while True:
        options = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
        if not options:
            return symbols, merges
        i = min(options)[1]
        merges.append((symbols[i], symbols[i + 1], i == 0, i == len(symbols) - 2))
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


class Pieces:
    """What a model file says, as far as the encoder needs it; made on the driver, sent to the tasks."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        shape = proto.normalizer_spec
        of_kind = lambda kind: [(i, p) for i, p in enumerate(proto.pieces) if p.type == kind]
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model must be of merge type with byte pieces")
        if shape.precompiled_charsmap or shape.remove_extra_whitespaces or not (shape.add_dummy_prefix and shape.escape_whitespaces):
            raise ValueError("the model must leave texts as they are, but for one space before them")
        if of_kind(kinds.USER_DEFINED) or of_kind(kinds.UNUSED) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("pieces set by users, unused pieces and spaces after words are not supported")
        self.model = model
        self.bytes = {int(p.piece[3:5], 16): i for i, p in of_kind(kinds.BYTE)}
        normal = {p.piece: i for i, p in of_kind(kinds.NORMAL)}
        self.scores = {p: proto.pieces[i].score for p, i in normal.items()}
        #: token -> its text. Characters that occur in longer pieces only are tokens past the model's last id.
        self.texts = {i: p for p, i in normal.items()}
        spare = sorted({c for p in normal if len(p) > 1 for c in p} - set(normal))
        self.texts |= {len(proto.pieces) + k: c for k, c in enumerate(spare)}
        self.size = len(proto.pieces)
        #: token -> ((symbol, score of the merge that consumes it), ...) at its left and right end; None: merge it out
        self.edges: dict[int, tuple | None] = {}
        for token, text in list(self.texts.items()):
            left, merges = merged(text, self.scores)
            if left != [text]:  # never the result of merging
                del self.texts[token]
                continue
            worth = lambda s: self.scores[s] if len(s) > 1 else float("inf")
            plain = all(self.scores[a + b] < min(worth(a), worth(b)) for a, b, _, _ in merges)
            ends = float("-inf")
            starting = [(a, self.scores[a + b]) for a, b, first, _ in merges if first]
            ending = [(b, self.scores[a + b]) for a, b, _, last in merges if last]
            self.edges[token] = ((*starting, (text, ends)), (*ending, (text, ends))) if plain else None
        pairs = {a + b for p in normal for a, b in zip(p, p[1:])}
        # Cuts that no piece spans: between another character and a space, and around line feeds.
        self.cut_spaces = not any(p[1] == SPACE != p[0] for p in pairs)
        self.cut_lines = not any("\n" in p for p in pairs)
        self._encoder: Encoder | None = None

    def encoder(self) -> Encoder:
        """The encoder; a worker makes it once and keeps what it remembers for its next tasks."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder


class Encoder:
    """Texts to ids with the prefix table."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.width = pieces, 2 * pieces.size
        self.lengths = {token: len(text) for token, text in pieces.texts.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, text in pieces.texts.items():
            if len(text) > 1:
                self.automaton.add_word(text, token)
        self.automaton.make_automaton()
        self.single = {text: token for token, text in pieces.texts.items() if len(text) == 1}
        space, line = SPACE if pieces.cut_spaces else "", r"\n" if pieces.cut_lines else ""
        if space:
            cut = rf"{space}+[^{space}{line}]*|[^{space}{line}]+" + (rf"|{line}" if line else "")
        else:
            cut = rf"[^{line}]+|{line}" if line else r"(?s:.+)"
        self.segments = re.compile(cut).findall
        self.by_words = pieces.cut_spaces and pieces.cut_lines
        self.decimal = [str(i) for i in range(pieces.size)]
        self.tested: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, merged side by side, come out as they are."""
        scores, texts = self.pieces.scores, self.pieces.texts
        a_edges, b_edges = self.pieces.edges[left], self.pieces.edges[right]
        if a_edges is None or b_edges is None:
            return merged(texts[left] + texts[right], scores)[0] == [texts[left], texts[right]]
        a_edge, b_edge = a_edges[1], b_edges[0]
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = a_edge[i], b_edge[j]
            across = scores.get(a + b)
            # of equal scores the leftmost merge comes first: the left token's own, then the border's, then the right token's
            if across is not None and across > a_ends and across >= b_ends:
                return False
            if i + 1 == len(a_edge) and j + 1 == len(b_edge):
                return True
            if a_ends >= b_ends:
                i += 1
            else:
                j += 1

    def segment(self, text: str) -> list[int]:
        """Ids of a segment, spaces already written as the model's."""
        # A character's own token ends the prefix unless a longer piece fits.
        own = self.single.get
        last = [LONE, *[own(c, LONE) for c in text]] if len(text) <= SHORT else array("i", chain([LONE], (own(c, LONE) for c in text)))
        tested, width, lengths, done = self.tested, self.width, self.lengths, -1
        for end, token in self.automaton.iter(text):
            if end == done:
                continue
            start = end + 1 - lengths[token]
            if start and last[start] >= 0:
                key = last[start] * width + token
                fits = tested.get(key)
                if fits is None:
                    if len(tested) >= PAIRS:
                        tested.clear()
                    fits = tested[key] = self.compatible(last[start], token)
                if not fits:
                    continue
            last[end + 1] = token
            done = end
        ids, at, size = [], len(text), self.pieces.size
        while at:
            token = last[at]
            if 0 <= token < size:
                ids.append(token)
                at -= lengths[token]
            else:  # a character without a piece of its own: its bytes
                at -= 1
                ids += [self.pieces.bytes[b] for b in reversed(text[at].encode())]
        ids.reverse()
        return ids

    def _look_up(self, part: str) -> tuple[int, ...]:
        """Ids of a part that ``encode`` cuts; they are remembered if it is short."""
        if part[:1] == "\n":
            ids = (self.pieces.bytes[10], *self.segment(part[1:]))
        else:
            ids = tuple(self.segment(SPACE + part))
        if len(part) <= SHORT:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[part] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        known = self.known.get
        if self.by_words and "  " not in text and text[0] != " " and SPACE not in text:
            # Single spaces only: a part is what follows a space, or a line feed and what follows it.
            parts = text.replace("\n", " \n").split(" ")
            return list(chain.from_iterable([known(part) or self._look_up(part) for part in parts]))
        ids = []
        for segment in self.segments(f" {text}".replace(" ", SPACE)):
            if segment[0] == SPACE != segment[1:2]:
                ids += known(segment[1:]) or self._look_up(segment[1:])
            else:
                ids += self.segment(segment)
        return ids


def encode_texts(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with n_tokens and the digests of the ids and of the text decoded from them."""
    sent = docs.sparkSession.sparkContext.broadcast(Pieces(model))
    docs = docs.drop(*FIELDS)
    kinds = {"n_tokens": "long"}
    docs = docs.withColumns({c: F.lit(None).cast(kinds.get(c, "string")) for c in FIELDS})
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sent.value.encoder()
        decode = sentencepiece.SentencePieceProcessor(model_proto=sent.value.model).decode
        decimal = encoder.decimal.__getitem__
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            counts, listed, decoded = [], [], []
            for cell in batch.column("text"):
                ids = encoder.encode(cell.as_py() or "")
                counts.append(len(ids))
                listed.append(digest(",".join(map(decimal, ids))))
                decoded.append(digest(decode(ids) if ids else ""))
            made = [pa.array(v, k) for v, k in zip((counts, listed, decoded), FIELDS.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[: -len(FIELDS)]), *made], names=names)

    return docs.mapInArrow(run, docs.schema)


def model_bytes(name: str = MODEL) -> bytes:
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op11_prefix_table_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, model_bytes()).select("doc_id", *FIELDS)
