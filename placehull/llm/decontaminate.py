"""Benchmark decontamination by latent semantic retrieval.

Texts are seen as passages of 16-word steps with TF-IDF weights over hashed words. A randomised SVD (subspace iteration, each
step a distributed sum over passages) gives a latent space in which every window of every document is compared with every
benchmark passage. A window is a candidate if its cosine with the passage is at least ``NEAR`` of the cosine that the passage alone would have
inside that window (dot product over the passage's squared length), so the words around a leak do not hide it.
Candidates are then checked on the words: the longest common subsequence must cover ``SURE`` of the passage, or
``LIKELY`` of it with the answer word for word. The answer is the column ``answer`` of the benchmark if there is one,
else the last four words of the passage.

Document frequencies cover all documents, and the space is fitted on all passages of all documents and of the whole benchmark; the two sides weigh
the same. Texts are read once for it and written as hashed words (16 bits each). Benchmark passages (128 words at most, longer items are several)
are matched in blocks of ``BLOCK``. Every document is searched whole. What a task holds is of fixed size: 2**15 features times 128
dimensions, and one block. No document text is shuffled. A text is searched in pieces of ``CHUNK`` words that overlap.
An item of fewer than ``LEAST`` words is too short to tell a leak from common speech: it hits a text that consists of its words alone.

Nulls and ties: null or empty texts have no hits; benchmark rows without words are ignored; equal rows get equal hits; an empty
benchmark or table gives no hits. An input column named ``hits`` is replaced. Hits are ordered by item, and per item
the best is told (largest share, then first position).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.llm.base import table
from placehull.llm.words import digests, words_of
from placehull.session import stage

FEATURES, DIMS, SPARE = 1 << 15, 128, 8
STEP, LONGEST = 16, 128  # words of a step; of a benchmark passage
BLOCK = 256
TOGETHER = 8  # passages of one product in the fit
TASK_WORDS = 1 << 24  # words of a task of the fit
NEAR = 0.5
LEAST = 8  # words of an item that is searched for inside texts
SURE, LIKELY = 0.8, 0.6
CHUNK = 1 << 15  # words looked at in one go
PART = 4_096  # features per row of a distributed sum
HIT = "struct<item_id: bigint, share: double, cosine: double, position: bigint>"


def features(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(FEATURES - 1)).astype(np.int64)


def summed(parts: DataFrame, dtype: str) -> np.ndarray:
    """Sum of arrays that tasks emit as rows (part, bytes); one row per part reaches the driver."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column("data"):
                x = np.frombuffer(zstandard.decompress(value.as_py()), dtype)
                total = x.copy() if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zstandard.compress(total.tobytes(), 1)])], names=["part", "data"])

    rows = sorted(parts.groupBy("part").applyInArrow(add, "part int, data binary").collect(), reverse=True)
    total = bytearray()
    while rows:  # a part is dropped as soon as it is read
        total += zstandard.decompress(bytes(rows.pop().data))
    return np.frombuffer(total, dtype)


def emit(array: np.ndarray) -> pa.RecordBatch:
    """Rows (part, compressed bytes) of an array, PART entries of the first axis each."""
    parts = [zstandard.compress(array[i : i + PART].tobytes(), 1) for i in range(0, len(array), PART)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "data"])


def passages(texts: DataFrame) -> DataFrame:
    """All passages of all texts (binary) as hashed words, written once, and the parts of the documents' counts.

    Rows (part, data, lengths): with lengths a run of passages, their features in data (16 bits each); without, a part of the
    sum of documents per hashed word and, at place FEATURES, of documents with words.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FEATURES + PART, np.int64)

        def run(docs: list[np.ndarray]) -> pa.RecordBatch:
            f = np.concatenate(docs)
            pairs = np.sort(np.repeat(np.arange(len(docs)) * FEATURES, [len(d) for d in docs]).astype(np.int32) + f.astype(np.int32))
            seen[:FEATURES] += np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] % FEATURES, minlength=FEATURES)
            seen[FEATURES] += len(docs)
            lengths = np.concatenate([np.diff(cuts_of(len(d))) for d in docs])
            columns = [pa.array([-1], pa.int32()), pa.array([f.astype("<u2").tobytes()], pa.binary()), pa.array([lengths], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "data", "lengths"])

        docs, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                f = features(digests(text.as_py()))
                if len(f):
                    docs.append(f)
                    size += len(f)
                if size >= CHUNK:
                    yield run(docs)
                    docs, size = [], 0
        if docs:
            yield run(docs)
        if seen[FEATURES]:
            counts = emit(seen)
            yield counts.append_column("lengths", pa.nulls(counts.num_rows, pa.list_(pa.int32())))

    return stage(texts.mapInArrow(read, "part int, data binary, lengths array<int>"), "passages")


def document_counts(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per hashed word, and documents, of the texts that ``passages`` read."""
    out = summed(rows.where("lengths is null").select("part", "data"), "int64")
    return (out[:FEATURES], int(out[FEATURES])) if len(out) else (np.zeros(FEATURES, np.int64), 0)


def cuts_of(n: int) -> np.ndarray:
    """Where a text of ``n`` words is cut into passages of at most LONGEST words, of nearly equal length."""
    parts = -(-n // LONGEST)
    return np.arange(parts + 1) * n // max(parts, 1)


def weighted(rows: DataFrame) -> DataFrame:
    """The passages of ``rows`` with the weight that makes them one together.

    A task sends a matrix of fixed size, so it gets up to ``TASK_WORDS`` words.
    """
    rows = rows.where("lengths is not null").select("data", "lengths")
    n, size = rows.agg(F.sum(F.size("lengths")), F.sum(F.length("data"))).first()
    tasks = -(-(size or 0) // (2 * TASK_WORDS))
    return rows.withColumn("weight", F.lit(1.0 / (n or 1))).coalesce(max(1, tasks))


def latent_space(sides: DataFrame, idf: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Features times DIMS: weighted leading right singular vectors of all passages of ``sides`` (data, lengths, weight)."""
    spark = sides.sparkSession
    width = DIMS + SPARE
    basis = np.random.Generator(np.random.PCG64(6)).standard_normal((FEATURES, width), np.float32)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((basis, idf))
        del basis  # the driver holds one matrix at a time

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            basis, idf = sent.value
            total, seen, place = np.zeros((FEATURES, width), np.float32), np.zeros(FEATURES, bool), np.zeros(FEATURES, np.int64)
            for batch in batches:
                for data, lengths, weight in zip(*(batch.column(c) for c in ("data", "lengths", "weight"))):
                    f, lengths, weight = np.frombuffer(data.as_py(), "<u2"), lengths.values.to_numpy(), np.float32(weight.as_py())
                    ends = np.append(0, np.cumsum(lengths))
                    for i in range(0, len(lengths), TOGETHER):
                        n = len(lengths[i : i + TOGETHER])
                        some = f[ends[i] : ends[i + n]]
                        # a dense matrix of a few passages by the features that occur in them
                        seen[some] = True
                        used = np.flatnonzero(seen)
                        seen[used] = False
                        place[used] = np.arange(len(used))
                        at = np.repeat(np.arange(n) * len(used), lengths[i : i + n]) + place[some]
                        x = np.bincount(at, minlength=n * len(used)).reshape(n, -1) * idf.take(used)
                        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
                        x = x.astype(np.float32)
                        part = x.T @ (x @ basis.take(used, 0) * weight)
                        part += total.take(used, 0)
                        total[used] = part
            yield emit(total)

        image = summed(sides.mapInArrow(apply, "part int, data binary"), "float32")
        sent.destroy()
        image = image.reshape(-1, width) if len(image) else np.zeros((FEATURES, width), np.float32)
        # Orthonormal columns, leading first, by the small Gram matrix: no second matrix of full height in double precision.
        power, turn = np.linalg.eigh((image.T @ image).astype(np.float64))
        scale = turn[:, ::-1] / np.sqrt(np.maximum(power[::-1], 1e-12 * max(power[-1], 1e-12)))
        basis = image @ scale.astype(np.float32)
        del image
    basis = basis[:, :DIMS].copy()
    basis *= idf[:, None]
    return basis


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; bits of one integer stand for the places of ``a``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for x in b:
        at = places.get(x)
        if at:
            u = row & at
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def contains(whole: list[int], part: list[int]) -> bool:
    n = len(part)
    return any(whole[i : i + n] == part for i in range(len(whole) - n + 1))


def checked(words: list[int], answer: list[int], region: list[int]) -> float:
    """Share of the passage in its longest common subsequence with the region; 0 if that is no leak."""
    kinds = set(words)
    if len(kinds.intersection(region)) < LIKELY * len(words) - (len(words) - len(kinds)):
        return 0.0  # too few of its words for any subsequence
    share = common(words, region) / len(words)
    return share if share >= SURE or (share >= LIKELY and contains(region, answer)) else 0.0


class Search:
    """Finds the passages of one block in texts given as word hashes."""

    def __init__(self, space: np.ndarray, items: list[tuple[int, list[int], list[int]]]):
        # one more row, of zeros, fills up the last step of a text
        self.space, self.groups = np.concatenate((space, np.zeros((1, space.shape[1]), space.dtype))), []
        self.short: dict[tuple[int, ...], list[int]] = {}
        for item, words, _ in items:
            if len(words) < LEAST:
                self.short.setdefault(tuple(words), []).append(item)
        items = [x for x in items if len(x[1]) >= LEAST]
        steps = [-(-len(words) // STEP) + 1 for _, words, _ in items]
        for width in sorted(set(steps)):
            mine = [x for x, s in zip(items, steps) if s == width]
            vectors = np.stack([space[features(np.array(words, np.uint64))].sum(0) for _, words, _ in mine])
            squares = np.maximum((vectors * vectors).sum(1), 1e-6)
            self.groups.append((width, mine, (vectors / squares[:, None]).T.copy(), np.sqrt(squares)))

    def sums(self, texts: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        """Latent vector of each step of the texts."""
        rows = np.full(int(counts.sum()) * STEP, FEATURES, np.int64)
        at = 0
        for h, n in zip(texts, counts.tolist()):
            rows[at : at + len(h)] = features(h)
            at += n * STEP
        rows = rows.reshape(-1, STEP).T.copy()
        out = self.space.take(rows[0], 0)
        more = np.empty_like(out)
        for k in range(1, STEP):
            out += self.space.take(rows[k], 0, more, "clip")  # no index is out of bounds; "clip" fills more without a copy
        return out

    def look(self, texts: list[np.ndarray]) -> list[list[dict]]:
        """Hits of each text; a text longer than CHUNK words is seen in overlapping pieces."""
        found: list[dict[int, tuple]] = [{} for _ in texts]
        if self.short:
            for mine, h in zip(found, texts):
                if 0 < len(h) < LEAST:
                    mine.update((item, (1.0, 0, 1.0)) for item in self.short.get(tuple(h.tolist()), ()))
        # pieces of long texts share the words of the widest window and its neighbours
        lap = (LONGEST // STEP + 4) * STEP
        pieces = [(i, a) for i, h in enumerate(texts) for a in range(0, max(len(h) - lap, 1), CHUNK) if len(h)]
        batch, size = [], 0
        for i, a in pieces if self.groups else ():
            batch.append((i, a, texts[i][a : a + CHUNK + lap]))
            size += len(batch[-1][2])
            if size >= CHUNK:
                self._search(batch, texts, found)
                batch, size = [], 0
        if batch:
            self._search(batch, texts, found)
        return [[{"item_id": k, "share": v[0], "cosine": v[2], "position": -v[1]} for k, v in sorted(f.items())] for f in found]

    def _search(self, pieces: list[tuple[int, int, np.ndarray]], texts: list[np.ndarray], found: list[dict[int, tuple]]) -> None:
        counts = np.array([-(-len(h) // STEP) for _, _, h in pieces])
        sums = self.sums([h for _, _, h in pieces], counts)
        ends = np.repeat(np.cumsum(counts), counts)
        piece = np.repeat(np.arange(len(pieces)), counts)
        begins = ends - np.repeat(counts, counts)
        at, windows, reach = np.arange(len(sums)), sums.copy(), 1
        for width, mine, vectors, lengths in self.groups:
            for k in range(reach, min(width, len(sums))):
                last = np.flatnonzero(at[:-k] + k >= ends[:-k])  # windows that end with their text
                whole = windows[last]
                windows[:-k] += sums[k:]
                windows[last] = whole
            reach = max(reach, width)
            near = windows @ vectors
            for w, i in zip(*(x.tolist() for x in divmod(np.flatnonzero(near >= NEAR), len(mine)))):
                text, start, _ = pieces[piece[w]]
                first = start + int(w - begins[w]) * STEP
                begin = max(0, first - STEP)
                region = texts[text][begin : first + (width + 1) * STEP].tolist()
                item, words, answer = mine[i]
                share = checked(words, answer, region)
                if share:
                    cosine = float(near[w, i] * lengths[i] / max(np.linalg.norm(windows[w]), 1e-9))
                    hit = (share, -begin, cosine)
                    found[text][item] = max(found[text].get(item, hit), hit)


def with_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``hits``: array of (item_id, share, cosine, position) of benchmark passages found in the text."""
    read = passages(docs.select(F.col("text").cast("binary").alias("text")))
    counts, n = document_counts(read)
    idf = np.log((n + 1) / (counts + 1)).astype(np.float32)
    answered = "answer" in benchmark.columns
    rows = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.col("text").cast("binary").alias("text"),
        (F.col("answer").cast("binary") if answered else F.lit(None).cast("binary")).alias("answer"),
    )
    out = docs.drop("hits").withColumn("hits", F.array().cast(f"array<{HIT}>"))
    space = None
    for block in _blocks(rows):
        if space is None:
            space = latent_space(weighted(read).unionByName(weighted(passages(rows.select("text")))), idf)
        items = [(item, _ints(text), answer or _ints(text)[-4:]) for item, text, answer in block]
        out = _annotate(out, space, items)
    return out


def _ints(text: bytes | None) -> list[int]:
    return digests(text).tolist()


def _blocks(rows: DataFrame) -> Iterator[list[tuple[int, bytes, list[int]]]]:
    """Benchmark passages, BLOCK at a time: (item_id, words, answer's hashes)."""
    block = []
    for r in rows.toLocalIterator():
        words, answer = words_of(r.text), _ints(r.answer)
        cuts = cuts_of(len(words)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            block.append((r.item_id, b" ".join(words[a:b]), answer))
            if len(block) == BLOCK:
                yield block
                block = []
    if block:
        yield block


def _annotate(docs: DataFrame, space: np.ndarray, items: list) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((space, items))
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*sent.value)
        for batch in batches:
            hits, waiting, size = [], [], 0
            for text in batch.column(batch.num_columns - 1):
                waiting.append(digests(text.as_py()))
                size += len(waiting[-1])
                if size >= CHUNK:
                    hits += search.look(waiting)
                    waiting, size = [], 0
            hits += search.look(waiting)
            before = batch.column("hits").to_pylist()
            hits = [sorted([*a, *b], key=lambda x: x["item_id"]) for a, b in zip(before, hits)]
            kind = batch.schema.field("hits").type
            columns = [pa.array(hits, kind) if c == "hits" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.withColumn("__bytes", F.col("text").cast("binary")).mapInArrow(scan, docs.schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without a hit."""
    return with_hits(docs, benchmark).filter(F.size("hits") == 0).select(*docs.columns)


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
