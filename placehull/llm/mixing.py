"""Mixing sources to target weights.

Words are counted per source, a target is set per source, and each document is emitted
floor(rate) times plus one more copy with the probability of rate's fraction, where rate is
target / words of the source. The extra copy is drawn from a hash of seed and document, so reruns
and retried tasks agree.

Nulls and ties: a null source is a source of its own, ordered last. A null text has no words. A
document without id draws by its text's digest; rows that share id draw alike. A source
without words has target 0 and rate 0. An empty table gives an empty mix. A column of the input named like a
result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.llm.base import number_rows, table, word_count
from placehull.session import stage

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # of all words, as a fraction
CAP = 2  # times the words of the source
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size).

    Weights repeat over the sources in code-point order, null last. The budget is shared by
    weight; a source never gets more than ``cap`` times its words, and the excess is shared again until
    none is above. Each round is one sum over the sources, and only its totals reach the driver.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(sums, [F.col("source").asc_nulls_last()], "__rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("__rank") % len(weights)).cast("int")).cast("long"))
    ranked = stage(ranked.drop("__rank"), "sources")
    num, den = share
    size, weight = F.col("source_size"), F.col("weight")
    level = (0, 1)  # budget per unit of weight, as a fraction
    capped = -1
    while True:
        full = (F.lit(cap) * size * F.lit(level[1])).cast("double") <= (weight * F.lit(level[0])).cast("double")
        row = ranked.agg(
            F.sum(size).alias("total"),
            F.sum(F.when(full, size)).alias("full"),
            F.sum(F.when(~full, weight)).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row.n == capped or not row.open:
            break
        capped = row.n
        level = (num * row.total - den * cap * (row.full or 0), den * row.open)
    top = (F.lit(cap) * size).cast("double")
    given = (weight * F.lit(level[0])).cast("double") / F.lit(level[1]).cast("double")
    target = F.when(full, top).otherwise(F.least(top, given))
    return ranked.withColumn("target", target)


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Number in [0, 1) that depends on seed and document alone: 52 bits of a digest."""
    key = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the row)."""
    sized = docs.withColumn("size", word_count(F.col("text")))
    targets = source_targets(sized.select("source", "size"), weights, share, cap)
    targets = targets.select(F.col("source").alias("__source"), "source_size", "target")
    docs = sized.drop("source_size", "target")
    rows = docs.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    extra = (draw(F.col("doc_id"), F.col("text"), seed) < rate - whole).cast("long")
    return rows.withColumn("copies", whole + extra)


def emit(planned: DataFrame) -> DataFrame:
    """One row per copy taken; ``copy`` counts from 1."""
    taken = planned.filter(F.col("copies") > 0)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return plan_mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


ORACLE = r"""
with sized as (
  select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), sums as (
  select source, sum(size)::hugeint as source_size from sized group by source
), weighted as (
  select *, [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3]::hugeint as weight from sums
), ordered as (
  select *, row_number() over (order by source_size::double / weight, source nulls last) as k from weighted
), cuts as (
  select k,
    3 * (sum(source_size) over ()) - 4 * coalesce(sum(source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as num,
    2 * sum(weight) over (order by k rows between current row and unbounded following) as den,
    source_size, weight
  from ordered
), cut as (
  select num, den, k from cuts where num * weight < 2 * source_size * den order by k limit 1
), targets as (
  select o.source, o.source_size, case when c.k is null or o.k < c.k then (2 * o.source_size)::double
    else least((2 * o.source_size)::double, (o.weight * c.num)::double / c.den::double) end as target
  from ordered o left join cut c on true
), rated as (
  select d.doc_id, d.size, t.source_size::bigint as source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size::double else 0 end as rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::varchar, md5(coalesce(d.text, '')))), 1, 13))::bigint::double / 4503599627370496.0 as u
  from sized d join targets t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (size * (floor(rate) + (u < rate - floor(rate))::int))::bigint as taken,
  (floor(rate) + (u < rate - floor(rate))::int)::bigint as copies
from rated
"""
