"""Named pipeline stages built from a data folder.

Each stage is a lazy DataFrame; later stages extend earlier ones, so a query
that needs the flagged company table compiles the whole chain into one plan
(Catalyst prunes the columns each query does not read).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import fundamentals as fu
from ..operators import flags as fl
from ..sources import fixtures as fx


def companies(spark: SparkSession, base: str) -> DataFrame:
    return fx.companies(spark, base)


def cleaned(spark: SparkSession, base: str) -> DataFrame:
    return fu.clean_fundamentals(companies(spark, base))


def scored(spark: SparkSession, base: str, fixed: bool = False) -> DataFrame:
    return fu.factor_scores(cleaned(spark, base), fixed=fixed)


def standardized(spark: SparkSession, base: str) -> DataFrame:
    return fu.standardize(scored(spark, base))


def anomalies(spark: SparkSession, base: str) -> DataFrame:
    """The flagged company table: scores, names, volatility proxies and red flags."""
    return fl.with_anomalies(standardized(spark, base))


def flagged(spark: SparkSession, base: str) -> DataFrame:
    """Red flags from the cleaned table alone: flags need no percentile."""
    return fl.with_anomalies(fu.standardize(cleaned(spark, base)))
