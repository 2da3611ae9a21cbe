"""Name similarity and the report texts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _matcher_ratio(first: pd.Series, second: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; equal pairs inside an Arrow batch are computed once."""
    seen: dict[tuple[str, str], float] = {}

    def ratio(pair):
        if pair not in seen:
            seen[pair] = SequenceMatcher(None, *pair).ratio()
        return seen[pair]

    return pd.Series([None if None in p else ratio(p) for p in zip(first, second)], dtype="float64")


def name_similarity(aoi_name: Column, poi_name: Column) -> Column:
    """Similarity 0..1 in argument order (area name, point name).

    Equal names are 1 whatever the ratio's inner workings, so those pairs are handed to
    Python as nulls and answered in the JVM.
    """
    differ = aoi_name != poi_name
    ratio = _matcher_ratio(F.when(differ, aoi_name), F.when(differ, poi_name))
    return F.when(aoi_name == poi_name, F.lit(1.0)).otherwise(ratio)


def duration_text(seconds: Column) -> Column:
    """``>24h``, ``HhMmin``, ``MminSs`` or ``Ss``; the bounds are strict."""
    s = seconds.cast("double")

    def whole(column: Column) -> Column:
        return F.format_string("%.0f", column)

    hours, minutes = F.floor(s / 3600), F.floor(s / 60)
    return (
        F.when(s > 86400, F.lit(">24h"))
        .when(s > 3600, F.concat(
            hours.cast("string"), F.lit("h"),
            F.floor((s - hours * 3600) / 60).cast("string"), F.lit("min")))
        .when(s > 60, F.concat(
            minutes.cast("string"), F.lit("min"), whole(F.bround(s - minutes * 60)), F.lit("s")))
        .when(s.isNotNull(), F.concat(whole(F.bround(s)), F.lit("s")))
    )


def speed_text(done: Column, seconds: Column) -> Column:
    """``x.xx/s (n/h)``; no elapsed time gives the nan text."""
    rate = F.try_divide(done.cast("double"), seconds.cast("double"))
    return F.when(rate.isNull(), F.lit("nan/s (nan/h)")).otherwise(
        F.format_string("%.2f/s (%.0f/h)", F.bround(rate, 2), F.bround(rate * 3600))
    )


def remaining_text(done: Column, to_do: Column, seconds: Column) -> Column:
    """Expected time for the rest at the average rate; ``nan`` / ``Inf`` when there is none."""
    rate = F.try_divide(done.cast("double"), seconds.cast("double"))
    return (
        F.when(rate.isNull(), F.lit("nan"))
        .when(rate == 0, F.lit("Inf"))
        .otherwise(duration_text(F.try_divide(to_do - done, rate)))
    )


def percent_text(part: Column, whole: Column) -> Column:
    share = F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return F.format_string("%.2f%%", F.bround(share * 100, 2))
