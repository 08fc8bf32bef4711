"""Company fundamentals: cleaning, sector-relative factor scores, conviction.

Every function takes a DataFrame and returns a lazy DataFrame; the chain
``clean -> factor_scores -> standardize -> red flags`` compiles to one plan.
Formulas follow the reference semantics ("reference mode"), including its
odd ones, which are documented where they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import RankSpec, grouped_percent_rank


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# ---------------------------------------------------------------------------
# C1-C4 cleaning
# ---------------------------------------------------------------------------

# Columns dropped before scoring; the core columns a company
# must have.
DROPPED_COLUMNS = ("peg_ratio", "roic", "next_earnings_date")
CORE_COLUMNS = ("ticker", "market_cap", "sector", "current_price")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares greater than every number in Spark; cleaning turns it into
    NULL so that thresholds and rankings treat it as missing."""
    doubles = [f.name for f in df.schema.fields
               if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not doubles:
        return df
    return df.withColumns({c: F.expr(f"nanvl(`{c}`, CAST(NULL AS double))") for c in doubles})


def drop_columns(df: DataFrame, columns=DROPPED_COLUMNS) -> DataFrame:
    """Drop columns; names that are absent are ignored."""
    return df.drop(*columns)


def core_not_null(df: DataFrame, columns=CORE_COLUMNS) -> DataFrame:
    """Keep companies whose core columns are all present.  Plain
    ``isNotNull`` predicates reach the parquet scan as pushed filters."""
    cond = None
    for c in columns:
        cond = _c(c).isNotNull() if cond is None else cond & _c(c).isNotNull()
    return df.where(cond)


def guarded_ratio(num: Column, den: Column, scale: float | None = None,
                  extra: Column | None = None) -> Column:
    """``num / den * scale`` when ``num`` is present and ``den > 0``, else NULL."""
    cond = num.isNotNull() & (den > 0)
    if extra is not None:
        cond = extra & cond
    value = num / den
    if scale is not None:
        value = value * scale
    return F.when(cond, value)


def guarded_ratios(df: DataFrame) -> DataFrame:
    """The five derived ratios."""
    return df.withColumns({
        "fcf_yield": guarded_ratio(_c("free_cashflow"), _c("market_cap"), 100),
        "fcf_to_revenue": guarded_ratio(_c("free_cashflow"), _c("total_revenue"), 100),
        "price_volatility": F.when(
            _c("52week_high").isNotNull() & _c("52week_low").isNotNull() & (_c("current_price") > 0),
            (_c("52week_high") - _c("52week_low")) / _c("current_price") * 100),
        "cash_to_debt": guarded_ratio(_c("total_cash"), _c("total_debt")),
        "ev_to_revenue_calc": guarded_ratio(_c("enterprise_value"), _c("total_revenue")),
    })


def coalesce_fill(df: DataFrame) -> DataFrame:
    """C4: fill a missing EV/revenue from the computed one."""
    return df.withColumn("ev_to_revenue", F.coalesce(_c("ev_to_revenue"), _c("ev_to_revenue_calc")))


def clean_fundamentals(df: DataFrame) -> DataFrame:
    """NaN to NULL, then C1 -> C2 -> C3 -> C4."""
    return coalesce_fill(guarded_ratios(core_not_null(drop_columns(nan_to_null(df)))))


# ---------------------------------------------------------------------------
# W4 + F1-F5 + C7 factor scores
# ---------------------------------------------------------------------------

# The 18 sector percentiles (output name, input column,
# ascending?).  Ascending ranks the smallest value 0, descending the largest;
# NULLs rank last either way.
VALUE_RANKS = [
    RankSpec("pe_percentile", "pe_ratio", True),
    RankSpec("pb_percentile", "pb_ratio", True),
    RankSpec("ps_percentile", "ps_ratio", True),
    RankSpec("ev_ebitda_percentile", "ev_to_ebitda", True),
    RankSpec("fcf_yield_percentile", "fcf_yield", False),
]
GROWTH_RANKS = [
    RankSpec("rev_growth_percentile", "quarterly_revenue_growth", False),
    RankSpec("earnings_growth_percentile", "earnings_growth", False),
    RankSpec("qtr_earnings_percentile", "quarterly_earnings_growth", False),
]
QUALITY_RANKS = [
    RankSpec("roe_percentile", "roe", False),
    RankSpec("roa_percentile", "roa", False),
    RankSpec("profit_margin_percentile", "profit_margin", False),
    RankSpec("operating_margin_percentile", "operating_margin", False),
    RankSpec("fcf_quality_percentile", "fcf_to_revenue", False),
]
RISK_RANKS = [
    RankSpec("debt_eq_percentile", "debt_to_equity", True),
    RankSpec("current_ratio_percentile", "current_ratio", False),
    RankSpec("beta_percentile", "beta", True),
    RankSpec("volatility_percentile", "price_volatility", True),
    RankSpec("cash_debt_percentile", "cash_to_debt", False),
]
ALL_RANKS = VALUE_RANKS + GROWTH_RANKS + QUALITY_RANKS + RISK_RANKS

# Factor weights of the overall alpha score.
ALPHA_WEIGHTS = {"value": 0.25, "growth": 0.30, "quality": 0.30, "risk": 0.15}

# Conviction thresholds on the overall alpha score, highest first;
# anything lower (or NULL) is the last label.
CONVICTION_LEVELS = [(8.0, "Strong Buy"), (7.0, "Buy"), (5.0, "Hold"), (3.0, "Sell")]
CONVICTION_FLOOR = "Strong Sell"


def sector_percentiles(df: DataFrame, group: str = "sector") -> DataFrame:
    """The 18 sector-relative percentiles, exact, for every row."""
    return grouped_percent_rank(df, group, ALL_RANKS)


def _inv(name: str) -> Column:
    return F.lit(1) - _c(name)


def value_score(df: DataFrame) -> DataFrame:
    """2 x [(1-pe) + (1-pb) + (1-ps) + (1-ev/ebitda) + fcf yield]."""
    return df.withColumn("value_score",
                         _inv("pe_percentile") * 2.0 + _inv("pb_percentile") * 2.0
                         + _inv("ps_percentile") * 2.0 + _inv("ev_ebitda_percentile") * 2.0
                         + _c("fcf_yield_percentile") * 2.0)


def growth_score(df: DataFrame) -> DataFrame:
    """F2: weights 3.33/3.33/3.34 then x10, so the range is 0-100 (kept
    as in the reference; it dominates the overall alpha)."""
    return df.withColumn("growth_score",
                         (_c("rev_growth_percentile") * 3.33 + _c("earnings_growth_percentile") * 3.33
                          + _c("qtr_earnings_percentile") * 3.34) * 10)


def quality_score(df: DataFrame) -> DataFrame:
    """F3.  Descending ranks give the best company 0 (reference semantics)."""
    return df.withColumn("quality_score",
                         _c("roe_percentile") * 2.0 + _c("roa_percentile") * 2.0
                         + _c("profit_margin_percentile") * 2.0
                         + _c("operating_margin_percentile") * 2.0
                         + _c("fcf_quality_percentile") * 2.0)


def risk_score(df: DataFrame) -> DataFrame:
    """F4."""
    return df.withColumn("risk_score",
                         _inv("debt_eq_percentile") * 2.0 + _c("current_ratio_percentile") * 2.0
                         + _inv("beta_percentile") * 2.0 + _inv("volatility_percentile") * 2.0
                         + _c("cash_debt_percentile") * 2.0)


def overall_alpha(df: DataFrame, weights: dict = ALPHA_WEIGHTS) -> DataFrame:
    """F5."""
    return df.withColumn("overall_alpha_score",
                         _c("value_score") * F.lit(weights["value"])
                         + _c("growth_score") * F.lit(weights["growth"])
                         + _c("quality_score") * F.lit(weights["quality"])
                         + _c("risk_score") * F.lit(weights["risk"]))


def conviction_expr(score: Column) -> Column:
    out = F.lit(CONVICTION_FLOOR)
    for threshold, label in reversed(CONVICTION_LEVELS):
        out = F.when(score >= threshold, F.lit(label)).otherwise(out)
    return out


def conviction_bucket(df: DataFrame) -> DataFrame:
    """C7."""
    return df.withColumn("conviction", conviction_expr(_c("overall_alpha_score")))


def factor_scores(cleaned: DataFrame, fixed: bool = False) -> DataFrame:
    """W4 -> F1..F5 -> C7 on a cleaned fundamentals frame.

    ``fixed=True`` is the corrected variant of the reference formulas: every
    term is ``1 - p`` (the better value scores higher whichever direction
    ranks it), a missing metric scores a neutral 0.5 instead of the last
    rank, and the growth score keeps the 0-10 scale (no x10)."""
    df = sector_percentiles(cleaned)
    steps = (fixed_scores,) if fixed else (value_score, growth_score, quality_score, risk_score)
    for step in (*steps, overall_alpha, conviction_bucket):
        df = step(df)
    return df


def _fixed_term(spec: RankSpec) -> Column:
    return F.when(_c(spec.column).isNull(), F.lit(0.5)).otherwise(F.lit(1.0) - _c(spec.name))


def fixed_scores(df: DataFrame) -> DataFrame:
    """F1-F4, fixed variant (see ``factor_scores``)."""
    def two_each(specs):
        total = None
        for sp in specs:
            term = _fixed_term(sp) * 2.0
            total = term if total is None else total + term
        return total

    g = GROWTH_RANKS
    growth = _fixed_term(g[0]) * 3.33 + _fixed_term(g[1]) * 3.33 + _fixed_term(g[2]) * 3.34
    return df.withColumns({"value_score": two_each(VALUE_RANKS), "growth_score": growth,
                           "quality_score": two_each(QUALITY_RANKS), "risk_score": two_each(RISK_RANKS)})


# ---------------------------------------------------------------------------
# C5, C6 naming and volatility proxies
# ---------------------------------------------------------------------------

# Standard column names.
STANDARD_NAMES = {
    "ev_to_ebitda": "ev_ebitda",
    "quarterly_revenue_growth": "revenue_growth_yoy",
    "earnings_growth": "eps_growth_yoy",
    "fcf_to_revenue": "free_cash_flow_margin",
    "price_volatility": "volatility_52w",
}
# Beta multipliers of the volatility proxies.
VOLATILITY_PROXIES = {"volatility_30d": 15.0, "volatility_90d": 25.0}


def standardize_names(df: DataFrame, names: dict = STANDARD_NAMES) -> DataFrame:
    """C5."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def volatility_proxy(df: DataFrame) -> DataFrame:
    """Beta multiples (the 52-week figure is a price range, see docs)."""
    return df.withColumns({k: _c("beta") * F.lit(m) for k, m in VOLATILITY_PROXIES.items()})


def standardize(scored: DataFrame) -> DataFrame:
    return volatility_proxy(standardize_names(scored))


# ---------------------------------------------------------------------------
# W5, K1-K4 orderings
# ---------------------------------------------------------------------------

def top_per_sector(df: DataFrame, score: str = "overall_alpha_score", key: str = "ticker",
                   group: str = "sector") -> DataFrame:
    """Best company per sector, ticker as tie-break.

    ``row_number() = 1`` plans as a WindowGroupLimit: each task keeps one row
    per sector before the exchange, so a hot sector ships one row per task,
    not all of its rows.
    """
    w = Window.partitionBy(group).orderBy(_c(score).desc(), _c(key).asc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def top_k(df: DataFrame, order: list[Column], k: int, columns: list[str] | None = None) -> DataFrame:
    """K1-K5: sorted top-k; planned as TakeOrderedAndProject (per-task top-k,
    then one merge of k rows per task)."""
    out = df.orderBy(*order).limit(k)
    return out.select(*columns) if columns else out
