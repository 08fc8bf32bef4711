"""Credit-macro views and the prompt rules re-aimed as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Beta bands (below low -> "low", up to high inclusive ->
# "market-like", above -> "high").
BETA_LOW = 0.8
BETA_HIGH = 1.2


def create_latest_view(spark: SparkSession, source_view: str, view: str,
                       date_col: str = "date") -> DataFrame:
    """S7 in SQL form: a temp view holding the rows at the newest date."""
    new, old, day = (f"`{x.replace('`', '``')}`" for x in (view, source_view, date_col))
    spark.sql(f"CREATE OR REPLACE TEMP VIEW {new} AS SELECT * FROM {old} WHERE {day} = (SELECT max({day}) FROM {old})")
    return spark.table(view)


def history_top(macro: DataFrame, n: int = 5, date_col: str = "date") -> DataFrame:
    """The newest ``n`` rows (top-k), ties broken by the other columns."""
    others = [F.col(c) for c in macro.columns if c != date_col]
    return macro.orderBy(F.col(date_col).desc(), *others).limit(n)


def latest_one(macro: DataFrame, date_col: str = "date") -> DataFrame:
    """One macro row: the newest, ties broken by the remaining columns."""
    others = [F.col(c) for c in macro.columns if c != date_col]
    return macro.orderBy(F.col(date_col).desc(), *others).limit(1)


def beta_band(beta: Column) -> Column:
    """C18."""
    return (F.when(beta < BETA_LOW, F.lit("low"))
             .when(beta <= BETA_HIGH, F.lit("market-like"))
             .when(beta > BETA_HIGH, F.lit("high")))


def macro_trend(change: Column) -> Column:
    """A narrowing spread is improving credit, a widening one worsening."""
    return (F.when(change < 0, F.lit("improving"))
             .when(change > 0, F.lit("worsening"))
             .when(change == 0, F.lit("unchanged")))
