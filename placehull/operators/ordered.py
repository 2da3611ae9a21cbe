"""Row numbers and running sums inside groups of any size.

A window partitioned by a group key puts each group in one task. That is right for the usual
small group and fails for a key that holds a large share of all rows. The functions here find
groups above a fixed row count, range-partition their rows by key and order into as many parts
as the rows need, write them once and add what lies below a part or a group. Nothing depends
on how even the parts are.

The number of parts, and so the table of part offsets, is rows / ``hot_rows``; a limit far below
``HOT_ROWS`` makes no more parts than the session's shuffles have. Offsets and hot groups are
written tables that are joined, so Spark broadcasts them only while their size is below its own
threshold. Null keys form a group like any other.

Inputs are read more than once, so pass tables (scans or staged tables), not long lineages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placehull.session import stage

HOT_ROWS = 4_000_000  # narrow rows that one task may sort
LOCAL_BITS = (1 << 33) - 1  # row position inside a partition in monotonically_increasing_id


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys of the groups above the limit, ``group_rows`` and ``group_start``; None when there are none.

    ``group_start`` counts the rows of the hot groups before this one in key order.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("group_rows"))
    hot = stage(sizes.where(F.col("group_rows") > hot_rows), "hot_sizes")
    if hot.isEmpty():
        return None
    # one row per hot group: a hot_rows-th of the input at most, which is many for a small limit
    ends = running_totals(hot, keys, {"group_end": F.col("group_rows")}).drop("__bucket")
    start = F.col("group_end") - F.col("group_rows")
    return stage(ends.withColumn("group_start", start).drop("group_end"), "hot_groups")


def with_group_facts(df: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of per-group columns in which null keys meet as well."""
    renamed = facts.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return df.join(renamed, same, "left").drop(*[f"__key_{k}" for k in keys])


def _part_count(rows: int, part_rows: int) -> int:
    return max(1, -(-rows // part_rows))


def _with_offsets(dealt: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """Add ``__below_<name>``: the sums over all parts before the row's ``__bucket``."""
    totals = dealt.groupBy("__bucket").agg(*[v.alias(f"__total_{n}") for n, v in sums.items()])
    # one row per part
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = [F.coalesce(F.sum(f"__total_{n}").over(before), F.lit(0)).alias(f"__below_{n}") for n in sums]
    return dealt.join(stage(totals.select("__bucket", *below), "part_offsets"), "__bucket")


def _number_hot(big: DataFrame, keys: Sequence[str], name: str, order: Sequence[Column], parts: int) -> DataFrame:
    """Row numbers of hot rows: place in the order over all of them minus the group's start."""
    place = [*(F.col(k) for k in keys), *order]
    dealt = (
        big.repartitionByRange(parts, *place)
        .sortWithinPartitions(*place)
        .withColumn("__bucket", F.spark_partition_id())
        .withColumn("__local", F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL_BITS)))
    )
    rows = _with_offsets(stage(dealt, "dealt"), {"rows": F.count("*")})
    number = F.col("__below_rows") + F.col("__local") - F.col("group_start") + 1
    return rows.withColumn(name, number).drop("__bucket", "__local", "__below_rows")


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    orders: Mapping[str, Sequence[Column]],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add 1-based row numbers per group, one column for each named order.

    All orders share one shuffle on the keys; only hot groups take the range-partitioned way.
    """
    window = Window.partitionBy(*keys)

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumns({
            name: F.row_number().over(window.orderBy(*order)).cast("long")
            for name, order in orders.items()
        })

    hot = hot_groups(df, keys, hot_rows)
    if hot is None:
        return plain(df)
    rows = hot.agg(F.sum("group_rows")).first()[0]
    # parts need not be as small as a small limit for groups: never more tasks than a shuffle has, but for their size
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(_part_count(rows, hot_rows), max(_part_count(rows, HOT_ROWS), tasks))
    marked = with_group_facts(df, hot, keys)
    big = marked.where("group_rows is not null")
    for name, order in orders.items():
        big = _number_hot(big, keys, name, order, parts)
    small = marked.where("group_rows is null").select(*df.columns)
    return plain(small).unionByName(big.select(*df.columns, *orders))


def running_totals(
    df: DataFrame, order: Sequence[str], sums: Mapping[str, Column], part_rows: int = HOT_ROWS
) -> DataFrame:
    """Running sums over all rows in one global order, without one task seeing all rows.

    The parts hold about ``part_rows`` rows each; ``__bucket`` tells a row's part.
    """
    parts = _part_count(df.count(), part_rows)
    valued = df.withColumns({f"__value_{n}": v for n, v in sums.items()})
    dealt = valued.repartitionByRange(parts, *order).withColumn("__bucket", F.spark_partition_id())
    dealt = stage(dealt, "dealt")
    rows = _with_offsets(dealt, {n: F.sum(f"__value_{n}") for n in sums})
    inside = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # the window takes over this partitioning, so its tasks grow in number with the rows
    rows = rows.repartition(parts, "__bucket")
    rows = rows.withColumns({n: F.sum(f"__value_{n}").over(inside) + F.col(f"__below_{n}") for n in sums})
    return rows.select(*df.columns, "__bucket", *sums)
