"""Language-model scoring with an Elias-Fano n-gram trie, sharded over the cluster.

Tokens are lower-cased words, then one end token per text. Per order the trie holds the contexts seen in training (sorted
64-bit digests), a monotone pointer from each context to its successors, the successors (32-bit digests, sorted inside their
context), and 8-bit codes: for a successor log10 c / (C + m), for a context log10 m / (C + m), where c counts the n-gram, C
its context and m = C ** 0.75. The probability is interpolated: own part + context's part * probability with one word less;
below stands the add-one unigram probability. Contexts, pointers and (context index, successor) pairs rise, so each is
kept as an Elias-Fano sequence; a query finds its context, then its successor relative to it. Levels are memory-mapped while queried.

The trie is cut into shards by context. Texts are packed, once and as numbers of their words, into blocks of bounded size; a block sends each shard its distinct n-grams once, with
training counts, and gets one code per n-gram back. So neither the model nor the counts ever stand in one place, and what is shuffled grows with the
distinct n-grams of the blocks. Words with more than 1/(4 * shards) of all training tokens (at most 4 * shards of them, known from
the unigrams) are spread over all shards by successor as contexts, with their totals sent along.

The query scores every text by orders up to ``ORDER`` from one trie: ``score`` by one word before each token, ``score_3`` by two.
Nulls and ties: a null text counts as empty and has the end token alone; a null doc_id is training data; equal rows get equal scores. An empty
table returns an empty one. Codes are off by 0.016 in log10 at most.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.llm.base import table
from placehull.llm.words import digests, mix
from placehull.session import stage

ORDER = 3
BLOCK_BYTES = 12_000_000
POWER = 0.75
LEVELS, RANGE = 254, 8.0  # codes 0..254 for log10 from 0 to -8; 255: absent
ABSENT = 255
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n</text>"))
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def quantise(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(x) * (LEVELS / RANGE)), 0, LEVELS).astype(np.uint8)


VALUES = np.append(10.0 ** (-np.arange(LEVELS + 1) * (RANGE / LEVELS)), 0.0)  # code -> probability


class EliasFano:
    """A rising sequence of 64-bit numbers: low bytes as they are, high parts as a unary bitmap."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = min(7, -(-max(0, (top // max(n, 1)).bit_length()) // 8))  # bytes
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].T.copy()
        at = (values >> np.uint64(8 * width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) + 1) if n else 0, np.uint8)
        bits[at] = 1
        return cls(n, width, low.reshape(-1), np.packbits(bits))

    def values(self) -> np.ndarray:
        out = np.zeros((self.n, 8), np.uint8)
        out[:, : self.width] = np.asarray(self.low).reshape(self.width, self.n).T
        at = np.flatnonzero(np.unpackbits(np.asarray(self.high)))[: self.n]
        return out.reshape(-1).view("<u8") + ((at - np.arange(self.n)).astype(np.uint64) << np.uint64(8 * self.width))


class Trie:
    """One shard of one order, its levels in an unlinked memory-mapped file."""

    def __init__(self, contexts: np.ndarray, pointers: np.ndarray, successors: np.ndarray, own: np.ndarray, rest: np.ndarray):
        place = np.repeat(np.arange(len(contexts)), np.diff(pointers)).astype(np.uint64)
        parts = [EliasFano.of(contexts), EliasFano.of(pointers.astype(np.uint64)), EliasFano.of((place << np.uint64(32)) | successors)]
        arrays = [a for p in parts for a in (p.low, p.high)] + [own, rest]
        self.shapes = [(p.n, p.width) for p in parts]
        self.sizes = [a.nbytes for a in arrays]
        self.file = tempfile.TemporaryFile()
        for a in arrays:
            a.tofile(self.file)
        self.file.flush()
        data = np.memmap(self.file, np.uint8, "r") if sum(self.sizes) else np.empty(0, np.uint8)
        cut = np.split(data, np.cumsum(self.sizes)[:-1])
        self.parts = [EliasFano(n, w, cut[2 * i], cut[2 * i + 1]) for i, (n, w) in enumerate(self.shapes)]
        self.own, self.rest = cut[6], cut[7]
        self.contexts, self.pairs = self.parts[0].values(), self.parts[2].values()

    def close(self) -> None:
        self.file.close()

    def ask(self, contexts: np.ndarray, lengths: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the successors and of the contexts; ``lengths`` successors belong to each context."""
        if not len(self.contexts):
            return np.full(len(successors), ABSENT, np.uint8), np.full(len(contexts), ABSENT, np.uint8)
        i = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        known = self.contexts[i] == contexts
        rest = np.where(known, self.rest[i], ABSENT).astype(np.uint8)
        wanted = (np.repeat(i, lengths).astype(np.uint64) << np.uint64(32)) | successors
        j = np.minimum(np.searchsorted(self.pairs, wanted), max(0, len(self.pairs) - 1))
        hit = np.repeat(known, lengths) & (self.pairs[j] == wanted)
        return np.where(hit, self.own[j], ABSENT).astype(np.uint8), rest


def pack(*arrays: np.ndarray) -> bytes:
    """Compressed arrays; of each all first bytes stand together, then all second ones, and so on."""
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.compress(b"".join(np.uint64(len(x)).tobytes() + x for x in planes), 1)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, np.uint64, 1, at)[0])
        planes = np.frombuffer(raw, np.uint8, n, at + 8).reshape(np.dtype(kind).itemsize, -1)
        out.append(planes.T.copy().reshape(-1).view(kind))
        at += 8 + n
    return out


def shard_of(digests: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of digests, so those that one shard gets lie close together and their differences are small."""
    return (((digests >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.uint32)


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks (block, ids, held, tokens): documents packed to about BLOCK_BYTES of text, as tokens, written once."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, tokens, size, block = [], [], [], 0, None

        def row() -> pa.RecordBatch:
            words, ranks, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            by = np.argsort(-times, kind="stable")  # frequent words get small numbers, whose high bytes are alike
            number = np.empty(len(by), np.uint32)
            number[by] = np.arange(len(by), dtype=np.uint32)
            data = pack(np.array([len(t) for t in tokens], np.int64), words[by], number[ranks])
            columns = [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "held", "tokens"])

        for batch in batches:
            for key, i, h, t in zip(*(batch.column(k) for k in range(4))):
                if block is None:
                    block = key.as_py()
                ids.append(i.as_py())
                held.append(h.as_py())
                text = t.as_py() or b""
                tokens.append(np.append(digests(text), END))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield row()
                    ids, held, tokens, size, block = [], [], [], 0, None
        if ids:
            yield row()

    rows = docs.select(
        F.monotonically_increasing_id(), F.col("doc_id").cast("long"), F.coalesce(F.col("held_out"), F.lit(False)), F.col("text").cast("binary")
    )
    return stage(rows.mapInArrow(packed, "block long, ids array<long>, held array<boolean>, tokens binary"), "blocks")


class Block:
    """Tokens of a block as numbers of its distinct words, and its distinct n-grams per shard in an order that is the same whenever they are made."""

    def __init__(self, held: list[bool], tokens: bytes):
        self.counts, self.words, self.tokens = unpack(tokens, "i8", "u8", "u4")
        self.starts = np.cumsum(self.counts) - self.counts
        self.train = np.repeat(~np.array(held, bool), self.counts)
        self.place = np.arange(len(self.tokens), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.counts)

    def ngrams(self, orders: int, shards: int, hot: np.ndarray):
        """Per order from 2 on: (positions, place of each in the distinct list, contexts, successors, training counts, shard), sorted by shard and context.

        ``hot`` contexts of order 2 are spread over the shards by successor.
        """
        # the distinct n-gram of one order less that ends at each position, and the digests of these as contexts
        ending, digest = self.tokens, mix(self.words * C2)
        for order in range(2, orders + 1):
            at = np.flatnonzero(self.place >= order - 1).astype(np.int32)
            rank = np.empty(len(digest), np.uint32)
            rank[np.argsort(digest)] = np.arange(len(digest), dtype=np.uint32)
            key = rank[ending[at - 1]].astype(np.uint64)
            key <<= np.uint64(32)
            key |= self.tokens[at]
            by = np.argsort(key).astype(np.int32)
            key = key[by]
            fresh = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            first = at[by[fresh]]  # a position of each distinct n-gram
            counts = np.add.reduceat(self.train[at[by]], fresh, dtype=np.uint32) if len(fresh) else np.empty(0, np.uint32)
            c, s = digest[ending[first - 1]], self.words[self.tokens[first]] & np.uint64(0xFFFFFFFF)
            where = c
            if len(hot) and order == 2:
                where = np.where(np.isin(c, hot), mix(c + s * C2), c)
            shard = shard_of(where, shards)
            back = np.argsort(shard, kind="stable")
            number = np.empty(len(back), np.uint32)
            number[back] = np.arange(len(back), dtype=np.uint32)
            found = np.empty(len(at), np.uint32)
            found[by] = np.repeat(np.arange(len(fresh), dtype=np.uint32), np.diff(np.append(fresh, len(by))))
            del rank, key, by, fresh, where
            yield at, number[found], c[back], s[back], counts[back], shard[back]
            if order < orders:
                digest = mix(digest[ending[first]] * C1 + self.words[self.tokens[first - order + 1]] * C2)
                ending = np.zeros(len(self.tokens), np.uint32)
                ending[at] = found


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, in order, and their lengths."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def _sent(order: int, shards: int, hot: np.ndarray):
    """Rows (shard, block, data): a block's distinct n-grams for one shard."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, tokens in zip(batch.column("block"), batch.column("held"), batch.column("tokens")):
                b = Block(held.as_py(), tokens.as_py())
                if order == 1:
                    by = np.argsort(b.words)
                    words = b.words[by]
                    counts = np.bincount(b.tokens, weights=b.train, minlength=len(words)).astype(np.uint32)[by]
                    parts = [(k, pack(np.diff(words[m], prepend=np.uint64(0)), counts[m])) for k, m in _cuts(shard_of(words, shards))]
                else:
                    for _, _, c, s, counts, shard in b.ngrams(order, shards, hot):
                        pass  # the last order counts
                    parts = []
                    for k, m in _cuts(shard):
                        contexts, lengths = runs(c[m])
                        parts.append((k, pack(np.diff(contexts, prepend=np.uint64(0)), lengths.astype(np.uint32), s[m].astype(np.uint32), counts[m])))
                columns = [pa.array([k for k, _ in parts], pa.int64()), pa.array([block.as_py()] * len(parts), pa.int64()), pa.array([d for _, d in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "data"])

    return send


def _cuts(shard: np.ndarray) -> list[tuple[int, slice]]:
    values, lengths = runs(shard)
    ends = np.cumsum(lengths)
    return [(int(v), slice(int(e - n), int(e))) for v, n, e in zip(values, lengths, ends)]


ANSWER = "shard long, block long, data binary, total long, kinds long, many array<long>, times array<long>"


def _answers(shard: int, rows: list[tuple[int, bytes]], total: int, kinds: int, many: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, (block, data) in enumerate(rows):
        first = i == 0  # what holds for the shard stands in one of its rows
        columns = [
            pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([data], pa.binary()),
            pa.array([total if first else 0], pa.int64()), pa.array([kinds if first else 0], pa.int64()),
            pa.array([many.astype(np.int64) if first else []], pa.list_(pa.int64())), pa.array([times if first else []], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "data", "total", "kinds", "many", "times"])


def _count_words(keep: int):
    """Unigram shard: sums the counts, answers each block, and tells its ``keep`` most frequent words."""

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = [(b.as_py(), unpack(d.as_py(), "u8", "u4")) for batch in batches for b, d in zip(batch.column("block"), batch.column("data"))]
        sent = [(b, (np.cumsum(steps, dtype=np.uint64), c)) for b, (steps, c) in sent]
        words, inverse = np.unique(np.concatenate([w for _, (w, _) in sent]), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate([c for _, (_, c) in sent])).astype(np.int64)
        out = [(b, pack(sums[np.searchsorted(words, w)])) for b, (w, _) in sent]
        top = np.argsort(sums)[::-1][:keep]
        yield from _answers(key[0].as_py(), out, int(sums.sum()), int((sums > 0).sum()), words[top].view(np.int64), sums[top])

    return count


def _build(hot: np.ndarray, totals: np.ndarray):
    """Shard of a higher order: builds the trie of the training n-grams and answers each block from it."""

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = []
        for batch in batches:
            for b, d in zip(batch.column("block"), batch.column("data")):
                sent.append((b.as_py(), d.as_py()))
        cs, ss, ns = [], [], []
        for _, data in sent:
            steps, lengths, s, counts = unpack(data, "u8", "u4", "u4", "u4")
            keep_ = counts > 0
            cs.append(np.repeat(np.cumsum(steps, dtype=np.uint64), lengths)[keep_])
            ss.append(s[keep_])
            ns.append(counts[keep_])
        c, s, n = np.concatenate(cs), np.concatenate(ss), np.concatenate(ns).astype(np.int64)
        rank = np.unique(c, return_inverse=True)[1].astype(np.uint64)
        by = np.argsort((rank << np.uint64(32)) | s)
        c, s, n = c[by], s[by], n[by]
        fresh = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (s[1:] != s[:-1]))) if len(c) else np.empty(0, np.int64)
        n = np.add.reduceat(n, fresh) if len(fresh) else n
        c, s = c[fresh], s[fresh]
        contexts, lengths = runs(c)
        pointers = np.append(0, np.cumsum(lengths))
        whole = np.add.reduceat(n, pointers[:-1]) if len(contexts) else np.empty(0, np.int64)
        if len(hot) and len(contexts):
            i = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
            whole = np.where(hot[i] == contexts, totals[i], whole)
        m = whole.astype(np.float64) ** POWER
        own = quantise(n / np.repeat(whole + m, lengths)) if len(n) else np.empty(0, np.uint8)
        rest = quantise(m / (whole + m)) if len(m) else np.empty(0, np.uint8)
        trie = Trie(contexts, pointers, s.astype(np.uint64), own, rest)
        out = []
        for block, data in sent:
            steps, lengths, succ, _ = unpack(data, "u8", "u4", "u4", "u4")
            out.append((block, pack(*trie.ask(np.cumsum(steps, dtype=np.uint64), lengths, succ.astype(np.uint64)))))
        trie.close()
        yield from _answers(key[0].as_py(), out, int(n.sum()), len(n), np.empty(0, np.int64), np.empty(0, np.int64))

    return build


def score_texts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, scores) per row of ``docs`` (doc_id, text, held_out).

    ``score`` is by ``order``; ``scores`` has one for each order from 2 on.
    """
    spark = docs.sparkSession
    blocks = blocks_of(docs)
    shards = max(4, blocks.count())
    none = np.empty(0, np.uint64)
    keep = 4 * shards
    sent = blocks.mapInArrow(_sent(1, shards, none), "shard long, block long, data binary")
    answers = stage(sent.groupBy("shard").applyInArrow(_count_words(keep), ANSWER), "unigrams")
    row = answers.agg(F.sum("total"), F.sum("kinds")).first()
    tokens, kinds = row[0] or 0, row[1] or 0
    frequent = answers.select(F.explode(F.arrays_zip("many", "times")).alias("x")).select("x.many", "x.times")
    frequent = frequent.filter(F.col("times") * keep > tokens).collect()  # at most 4 * shards words
    hot = np.array([r.many for r in frequent], np.int64).view(np.uint64)
    hot_contexts = mix(hot * C2)
    by = np.argsort(hot_contexts)
    hot_contexts, totals = hot_contexts[by], np.array([r.times for r in frequent], np.int64)[by]
    all_answers = answers.select("block", F.lit(1).alias("level"), "shard", "data")
    for n in range(2, order + 1):
        spread, sums = (hot_contexts, totals) if n == 2 else (none, np.empty(0, np.int64))
        sent = blocks.mapInArrow(_sent(n, shards, spread), "shard long, block long, data binary")
        answers = stage(sent.groupBy("shard").applyInArrow(_build(spread, sums), ANSWER), "ngrams")
        all_answers = all_answers.unionByName(answers.select("block", F.lit(n).alias("level"), "shard", "data"))
    known = spark.sparkContext.broadcast(hot_contexts)

    def finish(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        ids, held = left["ids"][0].as_py(), left["held"][0].as_py()
        block = Block(held, left["tokens"][0].as_py())
        data = sorted(zip(right["level"].to_pylist(), right["shard"].to_pylist(), right["data"].to_pylist()), key=lambda x: x[:2])
        counts = np.empty(len(block.words), np.int64)
        counts[np.argsort(block.words)] = np.concatenate([unpack(d, "i8")[0] for level, _, d in data if level == 1])
        counts = counts[block.tokens]
        p = (counts + 1) / (tokens + kinds + 1)
        base = np.log10(p)
        add = lambda x: np.add.reduceat(x, block.starts)
        scores = []
        for n, (at, place, c, _, _, shard) in enumerate(block.ngrams(order, shards, known.value), 2):
            answered = [unpack(d, "u1", "u1") for level, _, d in data if level == n]
            if answered:
                own, rest = np.concatenate([a for a, _ in answered]), np.concatenate([b for _, b in answered])
                breaks = np.append(True, (c[1:] != c[:-1]) | (shard[1:] != shard[:-1]))
                rest = rest[np.cumsum(breaks) - 1]
                share = np.where(rest == ABSENT, 1.0, VALUES[rest])  # a context never seen leaves all to the order below
                p[at] = VALUES[own][place] + share[place] * p[at]
            scores.append(add(np.log10(p)))
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": block.counts.astype(np.int64),
                "n_known": add((counts > 0).astype(np.int64)), "train_tokens": np.full(len(ids), tokens, np.int64),
                "base_score": add(base), "score": add(np.log10(p)),
                "scores": pa.array(np.reshape(scores, (-1, len(ids))).T.tolist(), pa.list_(pa.float64())),
            }
        )

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, scores array<double>"
    return blocks.groupBy("block").cogroup(all_answers.groupBy("block")).applyInArrow(finish, out)


def op2_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = score_texts(docs.select("doc_id", "text", held.alias("held_out")))
    return scored.withColumns({"score": F.get("scores", F.lit(0)), "score_3": F.get("scores", F.lit(1))}).drop("scores")
