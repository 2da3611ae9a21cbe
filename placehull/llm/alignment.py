"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how common each such pair of ids is.

Each text is encoded once by both tokenizers and its ids are written (two bytes each, zstd). First pass over the ids: byte offsets at which tokens
of both end cut them into groups, and tokens whose byte ranges overlap are linked. A task counts, for each pair of ids, its documents that hold the pair linked, and writes the pairs it met
(one row per task and pair). The distinct pairs are then given places by minimal perfect hashing, in shards of about ``SHARD``: levels of bits in which a
key's bit is set where no other key of the level falls; the rank of its bit is its place. Counts are dense vectors by that place: one per
(shard, branch) of the task rows, summed over a tree of branches. Each shard keeps its keys in place order, so a look-up verifies the key it
finds. The highest count of each id of the first tokenizer has at most one row per id of its vocabulary.

Second pass: the ids are aligned again and the links' counts looked up by place. The shards travel to the tasks in rounds of at most ``ROUND`` pairs
(13 bytes each), whatever the number of pairs; the figures of the rounds are summed per row. One round is the rule: the pairs that occur are far
fewer than the product of the vocabularies.

Both tokenizers cut before a space that follows another character than white space, so a text is aligned in chunks (mostly a word
with its space); a task remembers short chunks' ids and aligns texts of about ``TEXTS`` characters together, as arrays.

Nulls and ties: texts that are null, empty, or not given back by the joined bytes of either tokenizer have no tokens: zeros, and '' for the
digest of groups. A pair is counted once per row of ``docs``, also for rows that share doc_id. Equal counts of an id are all its best. An empty table returns an
empty one. Input columns named as a result are replaced, others are kept but for the text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.llm.base import table
from placehull.session import scratch_path, stage

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARD = 1 << 16  # pairs of a shard, about
ROUND = 1 << 24  # pairs that travel to the tasks at a time
FLUSH = 1 << 20  # distinct pairs a task holds before it writes them
SHORT, MEMORY = 64, 1 << 19  # longest chunk remembered, chunks remembered
TEXTS = 1 << 20  # characters aligned at a time, a long text by itself
BRANCH, FAN = 1 << 20, 8  # task rows of a branch of the tree, branches summed at a time
LEVELS = 64
LOST = (b"", b"")  # ids of a chunk that a tokenizer does not give back
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
LOOKED_UP = ("n_best", "count_sum")
CHUNKS = re.compile(r"(?<=\S) (?=.)", re.S)  # the space that begins the next chunk
AFTER_SPACE = re.compile(r"\s ").search


# --- minimal perfect hashing ---------------------------------------------------------------------


def spread(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of whole numbers."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((2 * seed + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (spread(keys, 99) % np.uint64(shards)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of bits, first word of each level and the end, keys by place) of distinct keys."""
    left, words, starts = keys, [], [0]
    while len(left):
        if len(starts) > LEVELS:
            raise ValueError("keys must be distinct")
        size = -(-len(left) // 32)  # two bits a key, in words
        at = (spread(left, len(starts)) % np.uint64(size * 64)).astype(np.int64)
        alone = np.bincount(at, minlength=size * 64) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        starts.append(starts[-1] + size)
        left = left[~alone[at]]
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    starts = np.array(starts, np.int64)
    placed = np.empty_like(keys)
    placed[Places([(flat, starts)]).find(keys, np.zeros(len(keys), np.int64))] = keys
    return flat, starts, placed


class Places:
    """Places of keys in several shards' hashes, laid end to end."""

    def __init__(self, shards: list[tuple[np.ndarray, np.ndarray]]):
        deepest = max((len(starts) for _, starts in shards), default=1)
        firsts = np.cumsum([0, *(len(words) for words, _ in shards)])
        # a level that a shard lacks has no words
        self.starts = np.array([[*(starts + first), *[starts[-1] + first] * (deepest - len(starts))] for (_, starts), first in zip(shards, firsts)], np.int64)
        self.words = np.concatenate([words for words, _ in shards]) if shards else np.zeros(0, np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def find(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Place of each key, given its shard; any place or -1 for a key that is none of theirs."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level in range(self.starts.shape[1] - 1):
            first, end = self.starts[shard[open_], level], self.starts[shard[open_], level + 1]
            there = end > first
            open_, first, end = open_[there], first[there], end[there]
            if not len(open_):
                break
            at = (spread(keys[open_], level + 1) % ((end - first) * 64).astype(np.uint64)).astype(np.int64)
            word = first + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            mine = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[mine]] = (self.before[word] + np.bitwise_count(below))[mine]
            open_ = open_[~mine]
        return out


# --- texts to groups and links -------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both vocabularies; made on the driver, sent to the tasks. Ids of the first are its merges' order, as in its published form."""

    def __init__(self, first: str, second: bytes, pattern: str):
        letters = byte_letters()
        entries = json.loads(first)["model"]["vocab"]
        self.ranks = {bytes(letters[c] for c in entry): i for entry, i in entries.items()}
        self.second, self.pattern = second, pattern
        self._aligner: Aligner | None = None

    def aligner(self) -> Aligner:
        """A worker loads the tokenizers once and keeps the chunks it remembers for its next tasks."""
        if self._aligner is None:
            self._aligner = Aligner(self)
        return self._aligner


class Aligner:
    """Encodes texts by both tokenizers, chunk by chunk, and lays the ids out for ``Links``."""

    def __init__(self, files: Tokenizers):
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding("first", pat_str=files.pattern, mergeable_ranks=files.ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.second)
        self.a_bytes = [b""] * (max(files.ranks.values()) + 1)
        for part, i in files.ranks.items():
            self.a_bytes[i] = part
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.kinds = tuple("<u2" if len(side) <= 1 << 16 else "<u4" for side in (self.a_bytes, self.b_bytes))
        self.known: dict[str, tuple[bytes, bytes]] = {}
        #: id -> its decimal number with what may follow it
        self.listed = [f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ",|;"]

    @staticmethod
    def cut(text: str) -> list[str]:
        """Chunks of a text, each without the space that begins it."""
        odd = text[0] == " " or text[-1] == " " or AFTER_SPACE(text)
        return CHUNKS.split(text) if odd else text.split(" ")

    def _encode(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """Both tokenizers' ids of chunks, as bytes; ``LOST`` where the second does not give the chunk back."""
        whole = f" {' '.join(chunks)}"
        spelled = whole.encode()
        ends = np.cumsum([len(c) + 1 if c.isascii() else len(c.encode()) + 1 for c in chunks])
        a = self.a.encode_ordinary(whole)  # no token spans two chunks
        b_all = self.b.encode(chunks, num_threads=1)
        b = list(chain.from_iterable(b_all))
        a_ends = np.cumsum(self.a_sizes[a])
        a_cuts = np.searchsorted(a_ends, ends)
        if b"".join(map(self.a_bytes.__getitem__, a)) != spelled or (a_ends[a_cuts] != ends).any():
            raise ValueError("the first tokenizer must be byte level and cut before a word's space")
        b_cuts = np.cumsum(list(map(len, b_all)))
        good = b"".join(map(self.b_bytes.__getitem__, b)) == spelled and (np.cumsum(self.b_sizes[b])[b_cuts - 1] == ends).all()
        (a_flat, a_at), (b_flat, b_at) = (
            (np.array(ids, kind).tobytes(), (cuts * np.dtype(kind).itemsize).tolist())
            for ids, cuts, kind in ((a, a_cuts + 1, self.kinds[0]), (b, b_cuts, self.kinds[1]))
        )
        out = [(a_flat[i:j], b_flat[k:l]) for i, j, k, l in zip([0, *a_at], a_at, [0, *b_at], b_at)]
        if not good:  # somewhere in these chunks
            parts = [b"".join([self.b_bytes[i] for i in ids]) for ids in b_all]
            out = [ids if part == f" {c}".encode() else LOST for ids, part, c in zip(out, parts, chunks)]
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """Per text both tokenizers' ids; None where it has no tokens."""
        known = self.known.get
        cut = [self.cut(t) if t else None for t in texts]
        rows = [list(map(known, parts)) if parts else None for parts in cut]
        lacking = [k for k, row in enumerate(rows) if row and None in row]
        fresh = list({c for k in lacking for c, ids in zip(cut[k], rows[k]) if ids is None})
        made: dict[str, tuple[bytes, bytes]] = {}
        for k in range(0, len(fresh), 8192):
            some = fresh[k : k + 8192]
            made.update(zip(some, self._encode(some)))
        for k in lacking:
            rows[k] = [made[c] if ids is None else ids for c, ids in zip(cut[k], rows[k])]
        if len(self.known) + len(made) > MEMORY:
            self.known.clear()
        self.known.update((c, ids) for c, ids in made.items() if len(c) <= SHORT)
        return [tuple(map(b"".join, zip(*row))) if row and LOST not in row else None for row in rows]


class Links:
    """Tokens of a few texts, end to end, by byte offsets: which overlap, and where groups end."""

    def __init__(self, aligner: Aligner, encoded: list[tuple[bytes, bytes]]):
        a, b = (np.frombuffer(b"".join([e[k] for e in encoded]), aligner.kinds[k]).astype(np.int64) for k in (0, 1))
        #: tokens before each text, the last for all
        widths = [np.dtype(kind).itemsize for kind in aligner.kinds]
        self.a_from, self.b_from = (np.cumsum([0, *(len(e[k]) // widths[k] for e in encoded)]) for k in (0, 1))
        self.a, self.b, self.listed = a, b, aligner.listed
        a_ends, b_ends = np.cumsum(aligner.a_sizes[a]), np.cumsum(aligner.b_sizes[b])
        b_starts = np.concatenate(([0], b_ends[:-1])).astype(np.int64)
        a_starts = np.concatenate(([0], a_ends[:-1])).astype(np.int64)
        first = np.searchsorted(b_ends, a_starts, "right")  # of the second's tokens that overlap
        stop = np.searchsorted(b_starts, a_ends, "left")
        n = stop - first
        #: links before each token of the first tokenizer
        self.before = np.cumsum(np.concatenate(([0], n)))
        at = np.repeat(np.arange(len(a)), n)
        self.pairs = (a[at] << 32) | b[np.arange(self.before[-1]) - self.before[at] + first[at]]
        self.a_closes = b_ends[stop - 1] == a_ends if len(a) else np.zeros(0, bool)  # the token ends a group
        self.b_closes = np.zeros(len(b), bool)
        self.b_closes[stop[self.a_closes] - 1] = True
        self.text_links = self.before[self.a_from]
        self.closed = np.cumsum(np.concatenate(([0], self.a_closes)))

    def texts_of_links(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.a_from) - 1), np.diff(self.text_links))

    def figures(self) -> tuple[np.ndarray, ...]:
        """n_a, n_b, n_groups, n_links of each text."""
        return np.diff(self.a_from), np.diff(self.b_from), np.diff(self.closed[self.a_from]), np.diff(self.text_links)

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        a_group = self.closed[:-1]
        b_group = np.cumsum(np.concatenate(([0], self.b_closes)))[:-1]
        # a group's tokens of the first tokenizer stand before its tokens of the second
        a_at = np.arange(len(self.a)) + np.searchsorted(b_group, a_group, "left")
        b_at = np.arange(len(self.b)) + np.searchsorted(a_group, b_group, "right")
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[a_at] = self.a * 3 + self.a_closes
        code[b_at] = self.b * 3 + 2 * self.b_closes
        spelled = list(map(self.listed.__getitem__, code.tolist()))
        cuts = (self.a_from + self.b_from).tolist()
        return ["".join(spelled[i:j])[:-1] for i, j in zip(cuts, cuts[1:])]


def _few(cells: Iterator, size: Callable) -> Iterator[list]:
    """Neighbouring values of about TEXTS in size together."""
    held, total = [], 0
    for cell in cells:
        held.append(cell)
        total += size(cell)
        if total >= TEXTS:
            yield held
            held, total = [], 0
    if held:
        yield held


def _encoded_cells(batch: pa.RecordBatch) -> Iterator[list[tuple[bytes, bytes] | None]]:
    """Ids of the rows of an encoded table, a few rows at a time."""
    pairs = ((a.as_py(), b.as_py()) if a.is_valid else None for a, b in zip(batch.column("__a"), batch.column("__b")))
    return _few(pairs, lambda e: len(e[0]) if e else 0)


def encode_texts(docs: DataFrame, sent) -> DataFrame:
    """``docs`` without the text, with both tokenizers' ids as __a and __b; null where a text has no tokens."""
    out = docs.withColumns({c: F.lit(None).cast("binary") for c in ("__a", "__b")}).drop("text")
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = sent.value.aligner()
        for batch in batches:
            found = []
            for texts in _few((t.as_py() for t in batch.column("text")), lambda t: len(t or "")):
                found += aligner.encode(texts)
            ids = [pa.array([e[k] if e else None for e in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), *ids], names=names)

    return docs.mapInArrow(run, out.schema)


# --- first pass ----------------------------------------------------------------------------------


def task_pairs(encoded: DataFrame, sent) -> DataFrame:
    """(pair, n): rows of a task that hold the pair linked; a pair has a row per task, or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = sent.value.aligner()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> pa.RecordBatch:
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)
            held[:] = [(pairs, n)]
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for cells in _encoded_cells(batch):
                links = Links(aligner, [e for e in cells if e])
                pairs, at = np.unique(links.pairs, return_inverse=True)
                if len(pairs):
                    once = np.unique(links.texts_of_links() * len(pairs) + at) % len(pairs)
                    held.append((pairs, np.bincount(once, minlength=len(pairs))))
                if sum(len(p) for p, _ in held) > 2 * FLUSH:
                    made = merge()
                    if made.num_rows > FLUSH:
                        yield made
                        held.clear()
        if held:
            yield merge()

    return encoded.select("__a", "__b").mapInArrow(run, "pair long, n long")


# --- counts by place -----------------------------------------------------------------------------


def hashed(pairs: DataFrame, shards: int) -> DataFrame:
    """(shard, words, starts, keys): the hash of each shard of distinct pairs."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        words, starts, placed = build_hash(rows["pair"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [key[0]], "words": [words.tobytes()], "starts": [starts.tobytes()], "keys": [placed.tobytes()]})

    return pairs.groupBy("shard").applyInPandas(run, "shard long, words binary, starts binary, keys binary")


def counted(rows: DataFrame, hashes: DataFrame, branches: int) -> DataFrame:
    """(shard, counts): dense vectors of the pairs' rows by place, summed over a tree of branches."""

    def leaf(key: tuple, rows: pd.DataFrame, hash_: pd.DataFrame) -> pd.DataFrame:
        words, starts, size = (np.frombuffer(hash_[c].iloc[0], t) for c, t in (("words", "<u8"), ("starts", "<i8"), ("keys", "<i8")))
        pairs = rows["pair"].to_numpy(np.int64)
        at = Places([(words, starts)]).find(pairs, np.zeros(len(pairs), np.int64))
        sums = np.bincount(at, rows["n"].to_numpy(np.float64), len(size)).astype(np.int64)
        return pd.DataFrame({"shard": [key[0]], "branch": [key[1]], "counts": [sums.tobytes()]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(c, "<i8") for c in rows["counts"])
        return pd.DataFrame({"shard": [key[0]], "branch": [key[1]], "counts": [sums.tobytes()]})

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(branches - 1).cast("long"))).alias("branch")
    trees = hashes.select("shard", every, "words", "starts", "keys")
    dealt = rows.withColumn("branch", F.pmod(F.xxhash64("pair", F.spark_partition_id()), F.lit(branches)).cast("long"))
    kind = "shard long, branch long, counts binary"
    sums = dealt.groupBy("shard", "branch").cogroup(trees.groupBy("shard", "branch")).applyInPandas(leaf, kind)
    while branches > 1:
        branches = -(-branches // FAN)
        sums = sums.withColumn("branch", F.floor(F.col("branch") / FAN)).groupBy("shard", "branch").applyInPandas(add, kind)
    return sums.select("shard", "counts")


def highest(shards: DataFrame) -> DataFrame:
    """(a, top): the highest count of each id of the first tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                a, n = np.frombuffer(keys.as_py(), "<i8") >> 32, np.frombuffer(counts.as_py(), "<i8")
                ids, at = np.unique(a, return_inverse=True)
                top = np.zeros(len(ids), np.int64)
                np.maximum.at(top, at, n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(top)], names=["a", "top"])

    return shards.select("keys", "counts").mapInArrow(run, "a long, top long").groupBy("a").agg(F.max("top").alias("top"))


class Counts:
    """Counts of the pairs of some shards, looked up by verified place."""

    def __init__(self, shards: int, rows: list, top: np.ndarray):
        self.shards, self.place = shards, np.full(shards, -1, np.int64)
        self.place[[r.shard for r in rows]] = np.arange(len(rows))
        self.hashes = [(np.frombuffer(r.words, "<u8"), np.frombuffer(r.starts, "<i8")) for r in rows]
        self.keys = np.concatenate([np.frombuffer(r.keys, "<i8") for r in rows])
        self.counts = np.concatenate([np.frombuffer(r.counts, "<i8") for r in rows])
        self.best = self.counts == top[self.keys >> 32]
        self._places: Places | None = None

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is its first id's highest) per pair; 0 and False for pairs of other shards."""
        if self._places is None:
            self._places = Places(self.hashes)
        place = self.place[shard_of(pairs, self.shards)]
        mine = np.flatnonzero(place >= 0)
        at = self._places.find(pairs[mine], place[mine])
        good = (at >= 0) & (self.keys[at] == pairs[mine])
        if not good.all():
            raise ValueError("a pair of the texts was not counted: the table changed between the passes")
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        count[mine], best[mine] = self.counts[at], self.best[at]
        return count, best


# --- second pass ---------------------------------------------------------------------------------


def looked_up(encoded: DataFrame, sent, counts) -> DataFrame:
    """``encoded`` with figures, groups_sha256, n_best and count_sum over the pairs ``counts`` holds, in place of the ids."""
    kinds = {c: "long" for c in (*FIGURES, *LOOKED_UP)} | {"groups_sha256": "string"}
    out = encoded.drop("__a", "__b").withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held = sent.value.aligner(), counts.value
        for batch in batches:
            made = []
            for cells in _encoded_cells(batch):
                links = Links(aligner, [e for e in cells if e])
                pairs, at = np.unique(links.pairs, return_inverse=True)
                count, best = held.look_up(pairs) if len(pairs) else (np.zeros(0, np.int64),) * 2
                sums = [np.diff(np.cumsum(np.concatenate(([0], v[at])))[links.text_links]).tolist() for v in (best, count)]
                groups = [hashlib.sha256(g.encode()).hexdigest() for g in links.groups()]
                rows = zip(*(f.tolist() for f in links.figures()), *sums, groups)
                made += [next(rows) if e else (0, 0, 0, 0, 0, 0, "") for e in cells]
            columns = [pa.array([m[k] for m in made], pa.int64()) for k in range(6)] + [pa.array([m[6] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[: -len(kinds)]), *columns], names=names)

    return encoded.mapInArrow(run, out.schema)


def align_texts(docs: DataFrame, files: Tokenizers, round_pairs: int = ROUND, shard_pairs: int = SHARD, branch_rows: int = BRANCH) -> DataFrame:
    """``docs``, without the text, with the figures of their aligned tokens and of their links' corpus-wide counts."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(files)
    docs = docs.drop(*FIGURES, *LOOKED_UP, "groups_sha256")
    encoded, path = encode_texts(docs, sent), scratch_path(spark, "encoded")
    encoded.write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(encoded.schema).parquet(path)
    rows = stage(task_pairs(encoded, sent), "task_pairs")
    pairs = stage(rows.select("pair").distinct(), "pairs")
    n_rows, n_pairs = rows.count(), pairs.count()
    if not n_pairs:
        return looked_up(encoded, sent, spark.sparkContext.broadcast(_NoCounts()))
    shards = max(1, -(-n_pairs // shard_pairs), min(n_pairs // 1024, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    to_shard = F.pandas_udf(lambda pair: pd.Series(shard_of(pair.to_numpy(np.int64), shards)), "long")
    rows, pairs = (df.withColumn("shard", to_shard("pair")) for df in (rows, pairs))
    hashes = stage(hashed(pairs, shards), "hashes")
    sums = counted(rows, hashes, max(1, -(-n_rows // branch_rows)))
    table_ = stage(hashes.join(sums, "shard"), "pair_counts")
    top = {r.a: r.top for r in highest(table_).collect()}  # at most a row per id of the first vocabulary
    tops = np.zeros(max(top) + 1, np.int64)
    tops[list(top)] = list(top.values())
    per_round = max(1, round_pairs * shards // n_pairs)
    bounds = [(k, min(k + per_round, shards)) for k in range(0, shards, per_round)]

    def held(first: int, end: int):
        found = table_.filter(F.col("shard").between(first, end - 1)).collect()
        return spark.sparkContext.broadcast(Counts(shards, found, tops))

    if len(bounds) == 1:
        return looked_up(encoded, sent, held(*bounds[0]))
    numbered = stage(encoded.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    out = None
    for first, end in bounds:
        counts = held(first, end)
        part = stage(looked_up(numbered, sent, counts), "round")
        counts.destroy()
        if out is None:
            out = part
        else:
            more = part.select("__row", *(F.col(c).alias(f"__{c}") for c in LOOKED_UP))
            sums = {c: F.col(c) + F.col(f"__{c}") for c in LOOKED_UP}
            out = stage(out.join(more, "__row").withColumns(sums).drop(*(f"__{c}" for c in LOOKED_UP)), "sums")
    return out.drop("__row")


class _NoCounts:
    """Look-ups where no text has tokens."""

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise ValueError("a pair of the texts was not counted: the table changed between the passes")


def tokenizer_files(first: str = FIRST, second: str = SECOND) -> Tokenizers:
    with open(public_tokenizers.path(first), encoding="utf-8") as a, open(public_tokenizers.path(second), "rb") as b:
        return Tokenizers(a.read(), b.read(), public_tokenizers.PATTERN)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_texts(docs, tokenizer_files()).select("doc_id", *FIGURES, *LOOKED_UP, "groups_sha256")
