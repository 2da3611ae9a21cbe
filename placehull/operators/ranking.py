"""Per-POI ranks, their mean, and the best area."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placehull.operators.ordered import HOT_ROWS, row_numbers
from placehull.options import MatchOptions

TIE_BREAK = ("search_rank", "uid")


def rank_keys(options: MatchOptions) -> dict[str, Column]:
    """Sort key of each enabled rank, smaller is better.

    Measured keys are rounded far below any real difference (0.001 m2, 0.001 mm), so equal
    outlines stay ties whatever the order their sums were added up in.
    """
    keys = {
        "search_rank": F.col("search_rank"),
        "area": F.round("area_km2", 9) * F.lit(float(options.sort_by_area or 1)),
        "distance": F.round("distance_m", 6),
        "similarity": -F.col("similarity") if "similarity" in options.enabled_sorts else None,
    }
    return {f"rank_{n}": keys[n] for n in options.enabled_sorts}


def ordinal_ranks(
    aois: DataFrame, keys: Mapping[str, Column], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """0-based ranks per POI; equal keys are told apart by search rank, then uid."""
    orders = {n: [k, *(F.col(c) for c in TIE_BREAK)] for n, k in keys.items()}
    ranked = row_numbers(aois, ["poi_id"], orders, hot_rows)
    return ranked.withColumns({n: F.col(n) - 1 for n in keys})


def mean_rank(ranks: list[str]) -> Column:
    """Every enabled rank weighs the same; a sign lives in the sort key only."""
    total = F.col(ranks[0])
    for name in ranks[1:]:
        total = total + F.col(name)
    return total / F.lit(float(len(ranks)))


def score_aois(valid: DataFrame, options: MatchOptions, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Valid areas with their enabled ranks and ``score`` (the mean)."""
    keys = rank_keys(options)
    return ordinal_ranks(valid, keys, hot_rows).withColumn("score", mean_rank(list(keys)))


def best_per_poi(scored: DataFrame, *fields: str) -> DataFrame:
    """The area with the lowest score of each POI; merges map-side, so no group is collected."""
    head = ("score", *TIE_BREAK)
    extra = [f for f in fields if f not in head]
    best = F.min(F.struct(*head, *extra)).alias("best")
    return scored.groupBy("poi_id").agg(best).select(
        "poi_id", *[F.col(f"best.{f}").alias(f) for f in (*head, *extra)]
    )


def candidate_lists(
    valid: DataFrame, fields: list[str], page_size: int = 1000, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """List view in search order: arrays of at most ``page_size`` areas, ``page`` counts from 0."""
    rows = row_numbers(valid, ["poi_id"], {"position": [F.col(c) for c in TIE_BREAK]}, hot_rows)
    rows = rows.withColumn("page", F.floor((F.col("position") - 1) / page_size))
    items = F.array_sort(F.collect_list(F.struct("position", *fields)))
    return rows.groupBy("poi_id", "page").agg(items.alias("aois"))
