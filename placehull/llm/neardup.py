"""Near-duplicate documents by MinHash bands, odd sketches and an exact check.

A document's set holds its distinct shingles of five words. Texts with one word sequence form a class, and one text stands
for it. MinHash values in bands give buckets; the members of a bucket are compared with its least member, then members of different
components with each other. A pair is first judged by odd sketches (parity bitmaps of the MinHash values, and of the set
itself: the bits set in the XOR of two bitmaps estimate the similarity and the number of items apart); what passes is
checked on the full sets. Components of the confirmed links are the groups.

Bands of 4 rows, 36 of them: a pair at similarity 0.75 shares no bucket with probability 1e-6. The sketch test
asks for an estimate of about 0.56, almost four standard deviations below the threshold. The set bitmap loses nothing by
its first bound, since the XOR never has more bits than the sets have items apart.

Work in large buckets: two rounds of one comparison per member (a star) join a group of copies without all its pairs, first around the
bucket's least member, then around the member with the most links so far. Then only members outside the bucket's main component meet the others, and
only where a bucket spans components.

Nulls and ties: a null or empty text has no shingles and links with nothing. Rows that share doc_id count as rows of their own; equal texts are one
class, so equal rows share a group. A null doc_id takes part and gets the group's least id; a group without ids has a null
component and its rows are kept. An empty table returns an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.llm.base import table
from placehull.llm.graph import components
from placehull.llm.words import Hashes, hashes_of, mix, words_of
from placehull.session import stage

SHINGLE = 5
ROWS, BANDS = 4, 36
BITS = 512
SET_BITS = 512  # of the bitmap of the set
FAR = 100  # bits in the XOR of two sketches beyond which a pair is not similar
SIMILAR = 75  # percent
SKETCHED = "norm binary, f1 long, f2 long, n_shingles long, bands array<long>, sketch array<long>"

_rng = np.random.Generator(np.random.PCG64(8))
FACTORS = _rng.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POSITIONS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = _rng.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def shingles(words: list[bytes], known: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; the whole sequence if it is shorter than one."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = hashes_of(words, known)
    n = len(h) - SHINGLE + 1
    total = h[:n] * POSITIONS[0]
    for i in range(1, SHINGLE):
        total = total + h[i : i + n] * POSITIONS[i]
    return np.unique(mix(total))


def minhash(items: np.ndarray) -> np.ndarray:
    """Least value of each hash function over the items, in blocks."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 1024):
        block = items[i : i + 1024, None] * FACTORS[None, :]
        least = np.minimum(least, block.min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = (mix(least ^ SALTS)).reshape(BANDS, ROWS)
    keys = rows[:, 0]
    for i in range(1, ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return keys.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Bitmap in which each (function, value) flips one bit."""
    bits = (mix(least * SALTS + SALTS) % np.uint64(BITS)).astype(np.int64)
    parity = np.bincount(bits, minlength=BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def set_parity(items: np.ndarray) -> np.ndarray:
    """Bitmap in which each item of the set flips one bit."""
    bits = (mix(items ^ SALTS[0]) % np.uint64(SET_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=SET_BITS) & 1).astype(np.uint8)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Hashes()
    for batch in batches:
        rest = [batch.column(i) for i in range(batch.num_columns - 1)]
        out = [[] for _ in range(6)]
        for text in batch.column(batch.num_columns - 1):
            words = words_of(text.as_py())
            norm = b" ".join(words)
            items = shingles(words, known)
            digest = xxhash.xxh3_128_digest(norm)
            f1, f2 = np.frombuffer(digest, np.int64)
            least = minhash(items) if len(items) else None
            out[0].append(norm)
            out[1].append(int(f1))
            out[2].append(int(f2))
            out[3].append(len(items))
            out[4].append(None if least is None else band_keys(least))
            out[5].append(None if least is None else np.concatenate([[len(items)], odd_sketch(least), set_parity(items)]))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = [*batch.schema.names[:-1], "norm", "f1", "f2", "n_shingles", "bands", "sketch"]
        yield pa.RecordBatch.from_arrays([*rest, *(pa.array(o, k) for o, k in zip(out, kinds))], names=names)


def sketched(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of each document with a row number, lower-cased words, digest, set size, band keys and sketch; written once."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *columns, F.col("text").cast("binary").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return stage(rows.mapInArrow(_sketch, f"{kinds}, {SKETCHED}"), "sketched")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Hashes()
    for batch in batches:
        keep, last, mine = [], None, None
        for a, b in zip(batch.column("norm_a"), batch.column("norm_b")):
            a, b = a.as_py(), b.as_py()
            if a != last:
                last, mine = a, shingles(a.split(b" "), known)
            other = shingles(b.split(b" "), known)
            both = len(np.intersect1d(mine, other, assume_unique=True))
            keep.append(100 * both >= SIMILAR * (len(mine) + len(other) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def flips(x: str, y: str, start: int, bits: int) -> Column:
    """Bits in the XOR of two bitmaps that begin at ``start`` of the sketches."""
    out = F.lit(0)
    for i in range(start, start + bits // 64):
        out = out + F.bit_count(F.get(F.col(x), F.lit(i)).bitwiseXOR(F.get(F.col(y), F.lit(i))))
    return out


def alike(x: str, y: str) -> Column:
    """Whether two sketches allow the similarity asked for.

    Sets of sizes n and m that are similar at 0.75 differ in (n + m) / 7 items at most, and the set bitmap's XOR has no more bits than that. Where
    items crowd the bitmap, the XOR has the mean and variance of as many items thrown into ``SET_BITS`` bins, and five standard deviations are granted.
    """
    sizes = F.get(F.col(x), F.lit(0)) + F.get(F.col(y), F.lit(0))
    apart = sizes.cast("double") * ((100 - SIMILAR) / (100 + SIMILAR))
    p = (1 - F.exp(-2 * apart / SET_BITS)) / 2
    variance = SET_BITS * p * (1 - p) - apart * F.exp(-4 * apart / SET_BITS)
    most = F.least(F.floor(apart + 1e-6), SET_BITS * p + 5 * F.sqrt(F.greatest(variance, F.lit(0.0))) + 2)
    return (flips(x, y, 1, BITS) <= FAR) & (flips(x, y, 1 + BITS // 64, SET_BITS) <= most)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose full sets are similar. ``texts``: (node, norm)."""
    pairs = stage(pairs.distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = stage(texts.join(wanted, "node", "left_semi"), "texts")
    left = texts.select(F.col("node").alias("a"), F.col("norm").alias("norm_a"))
    right = texts.select(F.col("node").alias("b"), F.col("norm").alias("norm_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "norm_a", "norm_b")
    return stage(joined.mapInArrow(_similar, "a long, b long"), "links")


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that connect what all links of similar nodes connect.

    ``nodes``: (node, bands, sketch), a row per word sequence; ``texts``: (node, norm) of these and others.
    """
    keys = nodes.select("node", F.explode("bands").alias("key"))
    spans = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    members = stage(keys.join(spans.select("key", "low"), "key"), "buckets")
    sketches = stage(nodes.select("node", "sketch").join(members.select("node").distinct(), "node", "left_semi"), "sketches")

    def close(pairs: DataFrame) -> DataFrame:
        a = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
        b = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
        return pairs.join(a, "a").join(b, "b").filter(alike("sketch_a", "sketch_b")).select("a", "b")

    def star(centre: str) -> DataFrame:
        pairs = members if centre == "low" else around
        pairs = pairs.filter(F.col(centre) != F.col("node"))
        return pairs.select(F.least(centre, "node").alias("a"), F.greatest(centre, "node").alias("b")).distinct()

    first = confirmed(close(star("low")), texts)
    ends = first.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    # One number holds degree and node, so that the maximum stays in a hash aggregate.
    packed = (F.coalesce("degree", F.lit(0)).cast("decimal(18,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + F.col("node")).alias("packed")
    hubs = members.join(ends, "node", "left").select("key", packed).groupBy("key").agg(F.max("packed").alias("packed"))
    hubs = hubs.select("key", (F.col("packed") % F.lit(str(10**19)).cast("decimal(20,0)")).cast("long").alias("hub"))
    around = members.join(hubs, "key").select("node", "hub")
    first = first.unionByName(confirmed(close(star("hub")), texts)).distinct()
    groups = stage(components(first), "groups")
    placed = members.join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    placed = stage(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("main"), F.max("component").alias("top")).filter("main < top")
    open_buckets = placed.join(mixed.select("key", "main"), "key")
    outside = open_buckets.filter("component <> main").select("key", F.col("node").alias("a"), F.col("component").alias("ca"))
    inside = open_buckets.select("key", F.col("node").alias("b"), F.col("component").alias("cb"), "main")
    with_sketch = lambda df, x: df.join(sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")), x)
    # Of two members outside the main component each pair comes once; the main component's members are on one side only.
    meet = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
    crossed = with_sketch(outside, "a").join(with_sketch(inside, "b"), "key")
    crossed = crossed.filter(meet & (alike("sketch_a", "sketch_b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return first.unionByName(confirmed(crossed, texts))


def grouped(rows: DataFrame, id_column: str) -> DataFrame:
    """``rows`` (as ``sketched`` gives them) with ``component_id``: the least id of the group, or the own id where there is none to link."""
    ids = F.col(id_column)
    classes = rows.filter("n_shingles > 0").groupBy("f1", "f2").agg(F.min("row").alias("node"), F.min(ids).alias("least"))
    classes = stage(classes, "classes")
    chosen = classes.select(F.col("node").alias("row"))
    nodes = rows.select("row", "bands", "sketch").join(chosen, "row").select(F.col("row").alias("node"), "bands", "sketch")
    texts = rows.select(F.col("row").alias("node"), "norm")
    groups = components(links(stage(nodes, "nodes"), texts))
    placed = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stage(placed, "placed")
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(named, "component").select("f1", "f2", "component_id")
    out = rows.drop("norm", "bands", "sketch").join(named, ["f1", "f2"], "left").drop("f1", "f2")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(ids))


def group_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``; ``kept`` marks rows with their group's least id."""
    out = grouped(sketched(docs, ["doc_id"]), "doc_id")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, with the columns of ``docs``: the first of those with the least doc_id, null last."""
    wrapped = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    rows = sketched(wrapped, ["__row"])
    # A group is named by its least row number, so that rows that share an id still count as several.
    slim = rows.select("row", F.col("__row.doc_id").alias("doc_id"), "n_shingles", "f1", "f2", "norm", "bands", "sketch")
    groups = stage(grouped(slim, "row").select("row", "doc_id", F.col("component_id").alias("group")), "groups")
    least = groups.groupBy("group").agg(F.min("doc_id").alias("least"))
    best = groups.join(least, "group").filter(F.col("doc_id").eqNullSafe(F.col("least")))
    chosen = best.groupBy("group").agg(F.min("row").alias("row")).select("row")
    return rows.select("row", "__row").join(chosen, "row").select("__row.*")


def op8_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), sets as materialized (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w]
    else list_distinct([w[i:i + 4] for i in range(1, len(w) - 3)]) end) as s from words
), sizes as (
  select doc_id, count(*) as n from sets group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by all
), links as materialized (
  select s.a, s.b from shared s join sizes x on x.doc_id = s.a join sizes y on y.doc_id = s.b
  where 100 * s.n >= 75 * (x.n + y.n - s.n)
), reach as (
  select doc_id as node, doc_id as seen from documents
  union
  select r.node, l.b from reach r join links l on l.a = r.seen
), least as (
  select node, min(seen) as component_id from reach group by node
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join least on least.node = d.doc_id left join sizes on sizes.doc_id = d.doc_id
"""
