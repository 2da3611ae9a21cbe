"""Line de-duplication by a suffix array over line-ID sequences.

The corpus is read as sequences of line IDs. Prefix doubling sorts runs of 1, 2, 4, ... lines: the rank of a run of 2h lines
is the sorted place of the pair (rank of its first h lines, rank of its last h lines). Positions of one rank after
k rounds are an interval of the suffix array whose longest common prefix is at least 2 ** k lines. A run of any length
between has its interval as the pair of ranks of the two overlapping runs of 2 ** k lines that cover it. Of each
interval the first position (by doc_id, then line) stays and every later one is deleted.

Only runs of at least ``min_words`` words count. Every line of a maximal repeated run of that size lies in a shortest run of that
size that starts or ends at some line of the run and is repeated as well, so these shortest runs decide, and doubling ends once
the longest of them is covered (at most log2(min_words) rounds, since a line with a word counts one at least).
A line that occurs once ends every repeat, so only positions of repeated lines take part.

Lines are equal if their texts are (128-bit digests stand for them). Lines without a word are no part of the
sequences and stay. Nulls and ties: a null text stays null; a null doc_id comes after all others; rows
that share doc_id and text are one document and get the same cut; lines at one place of rows that share doc_id but not text do not
delete each other. An empty table returns an empty one. Input columns named ``n_lines`` or ``n_cut`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.llm.base import number_rows, table, word_count
from placehull.session import stage

MIN_WORDS = 8
HAS_WORD = r"[^\x20\x09-\x0D]"


def doc_key() -> Column:
    """Whole number that orders documents; never null."""
    return F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))


def position() -> Column:
    """One number per (document, line), in reading order: fit for a hash aggregate."""
    return F.col("doc") * F.lit(10**10).cast("decimal(11,0)") + F.col("pos")


def shortest(sizes: Column, start: Column, min_words: int) -> Column:
    """Lines from ``start`` on that hold ``min_words`` words; 0 if the document ends before."""
    begun = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("lines"))

    def add(a: Column, x: Column) -> Column:
        more = F.struct((a.words + x).alias("words"), (a.lines + 1).alias("lines"))
        return F.when(a.words >= min_words, a).otherwise(more)

    return F.aggregate(F.slice(sizes, start, min_words), begun, add, lambda a: F.when(a.words >= min_words, a.lines).otherwise(0))


def sequences(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, digest, pos, h1, h2, ahead, behind): a row per line with a word.

    ``ahead`` and ``behind`` are the lengths of the shortest runs of min_words words that start and end at the line.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(HAS_WORD))
    rows = docs.filter(F.col("text").isNotNull()).select(
        doc_key().alias("doc"), F.xxhash64("text").alias("digest"), lines.alias("lines")
    )
    rows = rows.withColumn("sizes", F.transform("lines", word_count))
    rows = rows.withColumn("back", F.reverse("sizes"))
    n = F.size("lines")
    facts = F.transform(
        "lines",
        lambda x, i: F.struct(
            F.xxhash64(x).alias("h1"),
            F.xxhash64(F.lit(7), x).alias("h2"),
            shortest(F.col("sizes"), i + 1, min_words).alias("ahead"),
            shortest(F.col("back"), n - i, min_words).alias("behind"),
        ),
    )
    return rows.select("doc", "digest", F.posexplode(facts).alias("pos", "fact")).select("doc", "digest", "pos", "fact.*")


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys come at two positions or more, with the sorted place of the keys as ``rank``."""
    at = position()
    groups = rows.groupBy(*keys).agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first < last")
    ranks = number_rows(groups.select(*keys), [F.col(k) for k in keys], "rank")
    return rows.join(ranks, keys)


def shifted(ranks: DataFrame, by: Column) -> DataFrame:
    """Ranks as seen from the line ``by`` lines before."""
    return ranks.select("doc", "digest", (F.col("pos") - by).alias("pos"), F.col("rank").alias("rank2"))


def repeated_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, digest, pos, len): shortest runs of min_words words that occur before."""
    seen = ranked(lines, ["h1", "h2"]).select("doc", "digest", "pos", "rank").distinct()
    seen = stage(seen, "ranks")  # distinct: rows with equal id and text are one document
    runs = lines.select(
        "doc",
        "digest",
        F.explode(
            F.array(
                F.struct("pos", F.col("ahead").alias("len")),
                F.struct((F.col("pos") - F.col("behind") + 1).alias("pos"), F.col("behind").alias("len")),
            )
        ).alias("run"),
    )
    runs = runs.select("doc", "digest", "run.*").filter("len > 0").distinct()
    later, h = [], 1
    while h <= min_words:
        mine = runs.filter((F.col("len") >= h) & (F.col("len") < 2 * h))
        pairs = mine.join(seen, ["doc", "digest", "pos"]).withColumn("other", F.col("pos") + F.col("len") - h)
        ends = seen.select("doc", "digest", F.col("pos").alias("other"), F.col("rank").alias("rank2"))
        pairs = pairs.join(ends, ["doc", "digest", "other"]).drop("other")
        keys = ["len", "rank", "rank2"]
        at = position()
        groups = pairs.groupBy(*keys).agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first < last")
        found = pairs.join(groups, keys).filter(at > F.col("first")).select("doc", "digest", "pos", "len")
        later.append(stage(found, "found"))
        if 2 * h <= min_words:
            pairs = seen.join(shifted(seen, F.lit(h)), ["doc", "digest", "pos"])
            pairs = pairs.select("doc", "digest", "pos", F.col("rank").alias("rank1"), "rank2")
            seen = stage(ranked(pairs, ["rank1", "rank2"]).select("doc", "digest", "pos", "rank"), "ranks")
        h *= 2
    out = later[0]
    for more in later[1:]:
        out = out.unionByName(more)
    return out


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs cut from text, n_lines (lines with a word) and n_cut (those deleted)."""
    lines = stage(sequences(docs, min_words), "lines")
    runs = repeated_runs(lines, min_words)
    cut = runs.select("doc", "digest", F.explode(F.sequence("pos", F.col("pos") + F.col("len") - 1)).alias("pos"))
    cut = cut.groupBy("doc", "digest").agg(F.collect_set("pos").alias("__cut"))
    cut = cut.select(F.col("doc").alias("__doc"), F.col("digest").alias("__digest"), "__cut")
    keyed = docs.drop("n_lines", "n_cut").withColumns({"__doc": doc_key(), "__digest": F.xxhash64("text")})
    joined = keyed.join(cut, ["__doc", "__digest"], "left").withColumn("__lines", F.split("text", "\n"))
    numbered = F.filter(F.transform("__lines", lambda x, i: F.when(x.rlike(HAS_WORD), i)), lambda i: i.isNotNull())
    joined = joined.withColumn("__numbers", numbered)
    gone = F.transform("__cut", lambda p: F.get("__numbers", p))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone)
    text = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    joined = joined.withColumns(
        {
            "text": F.when(F.col("__cut").isNull(), F.col("text")).otherwise(text),
            "n_lines": F.coalesce(F.size("__numbers"), F.lit(0)).cast("long"),
            "n_cut": F.when(F.col("__cut").isNull(), 0).otherwise(F.size("__cut")).cast("long"),
        }
    )
    return joined.select(*docs.columns, *(c for c in ("n_lines", "n_cut") if c not in docs.columns))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs)


ORACLE = rf"""
with lines as (
  select doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{HAS_WORD}'))) as line,
    unnest(range(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{HAS_WORD}'))))) as pos
  from documents
), sized as (
  select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from lines
), starts as (
  select s.doc_id, s.pos, min(e.pos) as stop
  from sized s join (
    select doc_id, pos, sum(words) over (partition by doc_id order by pos) as upto from sized
  ) e on s.doc_id = e.doc_id and e.pos >= s.pos and e.pos < s.pos + {MIN_WORDS}
  join (select doc_id, pos, sum(words) over (partition by doc_id order by pos) - words as before from sized) b
    on b.doc_id = s.doc_id and b.pos = s.pos
  where e.upto - b.before >= {MIN_WORDS} group by all
), stops as (
  select e.doc_id, max(b.pos) as pos, e.pos as stop
  from (select doc_id, pos, sum(words) over (partition by doc_id order by pos) as upto from sized) e
  join (select doc_id, pos, sum(words) over (partition by doc_id order by pos) - words as before from sized) b
    on b.doc_id = e.doc_id and b.pos <= e.pos and b.pos > e.pos - {MIN_WORDS}
  where e.upto - b.before >= {MIN_WORDS} group by e.doc_id, e.pos
), runs as (
  select distinct * from (select * from starts union all select * from stops)
), spelled as (
  select r.doc_id, r.pos, r.stop, string_agg(l.line, chr(10) order by l.pos) as run
  from runs r join lines l on l.doc_id = r.doc_id and l.pos between r.pos and r.stop group by all
), later as (
  select doc_id, pos, stop from (
    select *, row_number() over (partition by run order by doc_id, pos) as k from spelled
  ) where k > 1
), cut as (
  select distinct doc_id, p from (select doc_id, unnest(range(pos, stop + 1)) as p from later)
), cuts as (
  select doc_id, list(p) as cut from cut group by doc_id
), raw as (
  select d.doc_id, d.text, c.cut, string_split(d.text, chr(10)) as parts,
    list_filter(range(len(string_split(d.text, chr(10)))), lambda i: regexp_matches(string_split(d.text, chr(10))[i + 1], '{HAS_WORD}')) as numbers
  from documents d left join cuts c using (doc_id)
)
select doc_id, coalesce(len(numbers), 0)::bigint as n_lines, coalesce(len(cut), 0)::bigint as n_cut,
  case when cut is null then text else array_to_string(list_transform(
    list_filter(range(len(parts)), lambda i: not list_contains(list_transform(cut, lambda p: numbers[p + 1]), i)),
    lambda i: parts[i + 1]), chr(10)) end as text
from raw
"""
