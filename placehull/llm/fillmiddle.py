"""Fill-in-middle transformation: cut offsets come from a Roaring-style set of unit boundaries.

The units of a text are its lines (each with its line feed). The code-point offsets at which units end form a set of whole
numbers, kept as containers of 65,536 values each: a sorted array of low halves, a bitmap, or runs, whichever is smallest. Cumulative
cardinalities of the containers answer *select*: the k-th boundary lies in the container found by binary search, and a select
inside it (array place, bit rank, or place in the runs) gives the low half. Two selects give the two cut offsets of a document.

A document's cuts come from a digest of its id, so reruns agree: ``choice(doc_id, units)`` by default. Texts that hold a sentinel, or no
character, stay as they are (``plain``). Otherwise the three parts are written prefix, suffix, middle (``psm``) or suffix first (``spm``) and
can be cut out of the output again, as no part holds a sentinel.

Nulls and ties: a null text is empty; a null doc_id is digested as the empty text; rows that share doc_id and text get the same
result. An empty table returns an empty one. Input columns named as a result are replaced, others are kept. Memory per text: a few
copies of it (four bytes per character) and its boundary set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.llm.base import table

SEED = 7
FIM_PERCENT, SPM_PERCENT = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CONTAINER = 1 << 16
FIELDS = {
    "n": ("long", pa.int64()), "form": ("string", pa.string()), "prefix_chars": ("long", pa.int64()), "middle_chars": ("long", pa.int64()),
    "output": ("string", pa.string()),
}


@dataclass
class Container:
    """The values of one block of 65,536, by their low halves."""

    kind: str  # array, bitmap, runs
    data: np.ndarray
    before: np.ndarray | None = None  # bitmap: ones before each word; runs: values before each run

    @classmethod
    def of(cls, low: np.ndarray) -> Container:
        """The smallest form of sorted distinct values."""
        breaks = np.flatnonzero(np.diff(low.astype(np.int64)) != 1) + 1
        starts = np.concatenate(([0], breaks))
        sizes = {"array": 2 * len(low), "bitmap": CONTAINER // 8, "runs": 4 * len(starts)}
        kind = min(sizes, key=sizes.get)
        if kind == "array":
            return cls(kind, low.astype(np.uint16))
        if kind == "runs":
            return cls(kind, low[starts].astype(np.uint16), starts.astype(np.int64))
        bits = np.zeros(CONTAINER, np.uint8)
        bits[low] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.bitwise_count(words).astype(np.int64)
        return cls(kind, words, np.cumsum(ones) - ones)

    def select(self, k: int) -> int:
        """The k-th value (from 0)."""
        if self.kind == "array":
            return int(self.data[k])
        at = int(np.searchsorted(self.before, k, "right")) - 1
        left = k - int(self.before[at])
        if self.kind == "runs":
            return int(self.data[at]) + left
        word = int(self.data[at])
        for _ in range(left):
            word &= word - 1  # drop the lowest one
        return at * 64 + (word & -word).bit_length() - 1


class BoundarySet:
    """Sorted distinct whole numbers with select."""

    def __init__(self, values: np.ndarray):
        high = values >> 16
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(high)) + 1, [len(values)])) if len(values) else np.zeros(1, np.int64)
        self.highs = high[cuts[:-1]]
        self.ends = cuts[1:]  # cumulative cardinalities
        self.containers = [Container.of(values[a:b] & (CONTAINER - 1)) for a, b in zip(cuts, cuts[1:])]

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.ends, k, "right"))
        before = int(self.ends[at - 1]) if at else 0
        return (int(self.highs[at]) << 16) + self.containers[at].select(k - before)


def line_ends(text: str) -> BoundarySet:
    """Code-point offsets behind each line of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(points == 10) + 1
    if len(points) and points[-1] != 10:
        ends = np.append(ends, len(points))
    return BoundarySet(ends)


@dataclass(frozen=True)
class Choice:
    """Units before the middle and up to its end, and the form's two percentages."""

    first: int
    second: int
    fim: int
    spm: int


def choice(doc_id: int | None, units: int, seed: int = SEED) -> Choice:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = h[0] % (units + 1), h[1] % (units + 1)
    return Choice(min(a, b), max(a, b), h[2] % 100, h[3] % 100)


def transform(text: str, doc_id: int | None, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple:
    """(units, form, prefix and middle code points or None, output)."""
    ends = line_ends(text)
    chosen = choice(doc_id, len(ends))
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or chosen.fim >= fim_percent:
        return len(ends), "plain", None, None, text
    first, second = (ends.select(k - 1) if k else 0 for k in (chosen.first, chosen.second))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if chosen.spm < spm_percent:
        return len(ends), "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(ends), "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text an output was made from."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = head[len(PREFIX) :].split(SUFFIX)
    else:
        suffix, prefix = head[len(SUFFIX) :].split(PREFIX)
    return prefix + middle + suffix


def _renewed(docs: DataFrame, fields: dict[str, tuple]) -> DataFrame:
    return docs.drop(*fields).withColumns({c: F.lit(None).cast(kind) for c, (kind, _) in fields.items()})


def fill_in_middle(docs: DataFrame, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars (null if plain) and output, the text to train on."""
    docs = _renewed(docs, FIELDS)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [transform(t.as_py() or "", i, fim_percent, spm_percent) for i, t in zip(ids, batch.column("text"))]
            made = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(FIELDS.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[: -len(FIELDS)]), *made], names=names)

    return docs.mapInArrow(run, docs.schema)


def digests(made: DataFrame) -> DataFrame:
    """``made`` with digests of the output and of the text restored from output and form alone."""
    names = [c for c in made.columns if c not in ("output", "text")]
    columns = [*names, "output_sha256", "restored_sha256"]
    out = made.select(*names, *(F.lit("").alias(c) for c in columns[-2:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            outputs = [(o.as_py(), f.as_py()) for o, f in zip(batch.column("output"), batch.column("form"))]
            made = [pa.array([digest(o) for o, _ in outputs], pa.string()), pa.array([digest(restore(*x)) for x in outputs], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=columns)

    return made.mapInArrow(run, out.schema)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(fill_in_middle(docs))


ORACLE = rf"""
with digested as (
  select doc_id, coalesce(text, '') as text, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as h from documents
), lines as (
  select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units,
    ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
  from digested
), cuts as (
  select *, len(units)::bigint as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b
  from lines
), parts as (
  select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix,
    case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= {FIM_PERCENT} then 'plain'
      when h4 % 100 < {SPM_PERCENT} then 'spm' else 'psm' end as form
  from cuts
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
  case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    else '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""
