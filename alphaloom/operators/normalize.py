"""Global min/max and the three min-max normalisations.

Global statistics are attached as *scalar subqueries* (``DataFrame.scalar``):
Catalyst merges every min/max over the same input into one aggregate
(``MergeScalarSubqueries``), runs it once with map-side partial aggregation
and inlines the values.  No driver round trip per column, no single-partition
window and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def global_minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """One aggregate row with ``<c>_min`` / ``<c>_max`` for every column."""
    aggs = []
    for c in columns:
        aggs += [F.min(_c(c)).alias(f"{c}_min"), F.max(_c(c)).alias(f"{c}_max")]
    return df.agg(*aggs)


def bounds_struct(stats_source: DataFrame, columns: list[str]) -> Column:
    """ONE scalar subquery returning a struct of ``<c>_min`` / ``<c>_max``
    for every column of ``stats_source``."""
    fields = []
    for c in columns:
        fields += [F.min(_c(c)).alias(f"{c}_min"), F.max(_c(c)).alias(f"{c}_max")]
    return stats_source.agg(F.struct(*fields).alias("b")).scalar()


def attach_bounds(df: DataFrame, name: str, stats_source: DataFrame, columns: list[str]) -> DataFrame:
    """Add the bounds struct as column ``name``.  Kept as its own projected
    column (a subquery is not cheap, so Catalyst does not inline it into each
    use); normalisations then read plain struct fields."""
    return df.withColumn(name, bounds_struct(stats_source, columns))


def minmax_plain(x: Column, mn: Column, mx: Column) -> Column:
    """(x - min) / (max - min); a constant column gives NULL (the
    reference divides unguarded)."""
    return F.try_divide(x - mn, mx - mn)


def minmax_half(x: Column, mn: Column, mx: Column) -> Column:
    """As N1, but a constant or all-NULL column is 0.5 on every row."""
    return F.when(mx.isNull() | mn.isNull() | (mx == mn), F.lit(0.5)).otherwise((x - mn) / (mx - mn))


def minmax_zero(x: Column, mn: Column, mx: Column) -> Column:
    """Scaler semantics: a constant column maps to 0.0, NULL stays NULL."""
    return F.when(x.isNull(), F.lit(None).cast("double")).when(mx == mn, F.lit(0.0)).otherwise(
        (x - mn) / (mx - mn))
