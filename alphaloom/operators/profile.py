"""Column profiling and data-quality reports.

The reference runs one job per column; here every report is a single
aggregate pass over the table (``count(c)`` per column in one ``agg``),
unpivoted into rows afterwards.  The pass reads only the profiled columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The profiled columns in their named groups.
CRITICAL_COLUMNS = {
    "Basic Info": ["ticker", "company_name", "sector", "industry"],
    "Market Data": ["market_cap", "current_price", "enterprise_value"],
    "Valuation": ["pe_ratio", "pb_ratio", "ps_ratio", "ev_to_ebitda"],
    "Profitability": ["roe", "roa", "profit_margin", "operating_margin", "gross_margin"],
    "Growth": ["quarterly_revenue_growth", "earnings_growth", "quarterly_earnings_growth"],
    "Financial Health": ["total_debt", "debt_to_equity", "current_ratio", "total_cash"],
    "Cash Flow": ["operating_cashflow", "free_cashflow", "fcf_per_share"],
    "Risk": ["beta", "52week_high", "52week_low"],
}

# Columns the standardized table must carry, by group.
REQUIRED_COLUMNS = {
    "Identifiers": ["ticker", "company_name", "sector", "industry"],
    "Valuation": ["pe_ratio", "pb_ratio", "ps_ratio", "ev_ebitda"],
    "Growth": ["revenue_growth_yoy", "eps_growth_yoy"],
    "Quality": ["roe", "gross_margin", "operating_margin", "free_cash_flow_margin"],
    "Risk": ["debt_to_equity", "volatility_30d", "volatility_90d", "beta"],
    "Scores": ["value_score", "growth_score", "quality_score", "risk_score",
               "overall_alpha_score", "conviction"],
}

# Completeness bands (percent complete, highest first).
COMPLETENESS_BANDS = [(80.0, "ok"), (50.0, "warn")]
COMPLETENESS_FLOOR = "fail"


def _q(c: str) -> str:
    return f"`{c}`"


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``_n`` = row count and ``c<i>`` = non-NULL count of column i."""
    return df.agg(F.count("*").alias("_n"),
                  *[F.count(F.col(_q(c))).alias(f"c{i}") for i, c in enumerate(columns)])


def completeness(df: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Per column position, group, name, type, non-NULL and NULL count,
    percent complete and band.  ``groups=None`` profiles every column.
    Columns that are absent from ``df`` are skipped."""
    types = dict(df.dtypes)
    if groups is None:
        groups = {"all": list(df.columns)}
    entries = [(g, c) for g, cols in groups.items() for c in cols if c in types]
    counts = column_counts(df, [c for _, c in entries])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(g).alias("column_group"),
                              F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"),
                              F.col(f"c{i}").alias("non_null"))
                     for i, (g, c) in enumerate(entries)])
    pct = F.try_divide(F.col("non_null") * 100.0, F.col("_n").cast("double"))
    band = F.lit(COMPLETENESS_FLOOR)
    for threshold, label in reversed(COMPLETENESS_BANDS):
        band = F.when(pct >= threshold, F.lit(label)).otherwise(band)
    return (counts.select("_n", F.inline(rows))
            .select("position", "column_group", "column_name", "data_type", "non_null",
                    (F.col("_n") - F.col("non_null")).alias("null_count"),
                    pct.alias("pct_complete"), band.alias("band")))


def empty_columns(df: DataFrame) -> DataFrame:
    """Columns whose every value is NULL (one pass over all columns)."""
    prof = completeness(df, None)
    return prof.where(F.col("non_null") == 0).select("column_name")


def category_distribution(df: DataFrame, column: str, by_name: bool = False) -> DataFrame:
    """P5: rows per category; sorted by count (desc) or by name."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(column) if by_name else out.orderBy(F.col("count").desc(), column)


def required_columns(df: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """Each required column is present (in the schema) and usable
    (present and not all NULL).  The present ones are profiled in one pass;
    the required list is a small literal frame joined to that profile."""
    spark = df.sparkSession
    present = [c for cols in required.values() for c in cols if c in df.columns]
    prof = completeness(df, {"p": present}).select("column_name", "non_null")
    req = spark.createDataFrame([(g, c) for g, cols in required.items() for c in cols],
                                "column_group string, column_name string")
    return (req.join(F.broadcast(prof), "column_name", "left")
            .select("column_group", "column_name",
                    F.col("non_null").isNotNull().alias("present"),
                    F.coalesce(F.col("non_null") > 0, F.lit(False)).alias("usable")))
