"""Red flags: threshold predicates, roll-up, partitions, frequency and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# The ten red flags in array order
# (flag column, label, input column, comparison, threshold).
RED_FLAG_RULES = [
    ("flag_extreme_debt", "extreme_debt", "debt_to_equity", ">", 2.0),
    ("flag_negative_margin", "negative_profit_margin", "profit_margin", "<", 0.0),
    ("flag_negative_operating", "negative_operating_margin", "operating_margin", "<", 0.0),
    ("flag_liquidity_risk", "liquidity_risk", "current_ratio", "<", 1.0),
    ("flag_negative_fcf", "negative_free_cashflow", "free_cashflow", "<", 0.0),
    ("flag_high_pe", "extreme_high_pe", "pe_ratio", ">", 50.0),
    ("flag_high_volatility", "high_volatility", "beta", ">", 1.5),
    ("flag_negative_roe", "negative_roe", "roe", "<", 0.0),
    ("flag_revenue_decline", "revenue_decline", "revenue_growth_yoy", "<", -0.05),
    ("flag_low_cash_coverage", "low_cash_coverage", "cash_to_debt", "<", 0.2),
]

# Severity by flag count, highest first; below the last is "Low".
SEVERITY_LEVELS = [(5, "Critical"), (3, "High"), (1, "Medium")]
SEVERITY_FLOOR = "Low"

FLAG_COLUMNS = [r[0] for r in RED_FLAG_RULES]


def red_flags(df: DataFrame) -> DataFrame:
    """One label-or-NULL column per rule; a NULL input raises no flag."""
    cols = {}
    for name, label, column, op, threshold in RED_FLAG_RULES:
        cond = _c(column) > threshold if op == ">" else _c(column) < threshold
        cols[name] = F.when(cond, F.lit(label))
    return df.withColumns(cols)


def severity_expr(count: Column) -> Column:
    out = F.lit(SEVERITY_FLOOR)
    for threshold, label in reversed(SEVERITY_LEVELS):
        out = F.when(count >= threshold, F.lit(label)).otherwise(out)
    return out


def red_flag_rollup(df: DataFrame) -> DataFrame:
    """Array of the ten columns, NULLs removed, count, score, severity."""
    return (df.withColumn("red_flags_array", F.array(*[_c(c) for c in FLAG_COLUMNS]))
              .withColumn("red_flags", F.filter("red_flags_array", lambda x: x.isNotNull()))
              .withColumn("red_flag_count", F.size("red_flags"))
              .withColumn("red_flag_score", F.col("red_flag_count"))
              .withColumn("red_flag_severity", severity_expr(F.col("red_flag_count"))))


def with_anomalies(standardized: DataFrame) -> DataFrame:
    """C8 -> C9: the company table the app and memo jobs read."""
    return red_flag_rollup(red_flags(standardized))


# ---------------------------------------------------------------------------
# C10 partitions, A10 frequency
# ---------------------------------------------------------------------------

# Partition predicates on (red_flag_count, overall_alpha_score).
FLAG_PARTITIONS = {
    "any_flag": lambda n, a: n > 0,
    "critical": lambda n, a: n >= 5,
    "high_risk": lambda n, a: (n >= 3) & (n < 5),
    "contradiction": lambda n, a: (a >= 7.0) & (n >= 2),
    "clean": lambda n, a: n == 0,
}


def flag_partition(df: DataFrame, name: str) -> DataFrame:
    """Rows of one partition (sorted by the caller)."""
    pred = FLAG_PARTITIONS[name](F.col("red_flag_count"), F.col("overall_alpha_score"))
    return df.where(pred)


def flag_partition_counts(df: DataFrame) -> DataFrame:
    """C10 counts fused into one aggregate (one job instead of five)."""
    n, a = F.col("red_flag_count"), F.col("overall_alpha_score")
    return df.agg(*[F.count_if(pred(n, a)).alias(f"n_{name}")
                    for name, pred in FLAG_PARTITIONS.items()])


def flag_frequency(df: DataFrame) -> DataFrame:
    """A10: how often each flag fires.  ``explode`` then a grouped count with
    map-side partial aggregation: at most ten groups leave each task."""
    return (df.select(F.explode("red_flags").alias("flag"))
              .groupBy("flag").agg(F.count(F.lit(1)).alias("count")))


# ---------------------------------------------------------------------------
# C14-C16 text forms
# ---------------------------------------------------------------------------

def prettify_flags(arr: Column) -> Column:
    """C14: underscores to spaces, trimmed; NULL or empty entries removed."""
    kept = F.filter(arr, lambda f: f.isNotNull() & (f != ""))
    return F.transform(kept, lambda f: F.trim(F.regexp_replace(f, "_", " ")))


def parse_flags_text(txt: Column) -> Column:
    """A flag list that arrives as the text of a list, e.g.
    ``['extreme_debt', 'liquidity_risk']`` -> array of the quoted items."""
    return F.regexp_extract_all(txt, F.lit(r"'([^']*)'"), 1)


def flags_or_fallback(primary: Column, fallback: Column) -> Column:
    """Prefer the first list, fall back to the second when it is
    NULL or has no non-empty item."""
    p = prettify_flags(primary)
    return F.when(F.coalesce(F.size(p), F.lit(0)) > 0, p).otherwise(
        F.coalesce(prettify_flags(fallback), F.array().cast("array<string>")))


def flags_text(arr: Column, empty: str = "None detected", sep: str = ", ") -> Column:
    """Joined flags, or a fixed word when there are none."""
    return F.when(F.coalesce(F.size(arr), F.lit(0)) <= 0, F.lit(empty)).otherwise(F.concat_ws(sep, arr))
