"""Registered queries: company fundamentals, profiling, flags, orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flags as fl
from ..operators import fundamentals as fu
from ..operators import profile as pf
from ..operators.ranking import RankSpec, grouped_percent_rank
from ..sources import fixtures as fx
from ..sources.tables import scan_table
from . import oracle
from . import stages as st
from .registry import register

FLAG_TEXT_SQL = "array_to_string(red_flags, '|')"


def _flag_text(df):
    return df.withColumn("red_flags_text", F.concat_ws("|", "red_flags"))


# --- C1-C4 -----------------------------------------------------------------

_DOUBLE_COMPANY_COLS = [c for c in fx.COMPANY_COLUMNS
                        if c not in ("ticker", "company_name", "sector", "industry", "country",
                                     "exchange", "currency", "next_earnings_date")]
_KEPT = [c for c in fx.COMPANY_COLUMNS if c not in fu.DROPPED_COLUMNS]
_KEPT_SPEC = ", ".join(f"{c}:d" if c in _DOUBLE_COMPANY_COLS else c for c in _KEPT)


@register("scan_table", ", ".join(f"{c}:d" if c in _DOUBLE_COMPANY_COLS else c
                                  for c in fx.COMPANY_COLUMNS),
          "FROM companies", ctes=("companies",))
def q_scan_table(spark, base):
    """The fundamentals table registered in the session catalog and read
    back by name."""
    st.companies(spark, base).createOrReplaceTempView("company_fundamentals")
    return scan_table(spark, None, "company_fundamentals")


@register("drop_columns", _KEPT_SPEC,
          "FROM (SELECT * EXCLUDE (peg_ratio, roic, next_earnings_date) FROM companies)",
          ctes=("companies",))
def q_drop_columns(spark, base):
    return fu.drop_columns(st.companies(spark, base))


@register("core_not_null", "ticker, company_name, sector, market_cap:d, current_price:d",
          """FROM companies WHERE ticker IS NOT NULL AND market_cap IS NOT NULL
             AND sector IS NOT NULL AND current_price IS NOT NULL""", ctes=("companies",))
def q_core_not_null(spark, base):
    return fu.core_not_null(fu.drop_columns(st.companies(spark, base)))


@register("guarded_ratios",
          "ticker, fcf_yield:d, fcf_to_revenue:d, price_volatility:d, cash_to_debt:d, ev_to_revenue_calc:d",
          "FROM cleaned", ctes=("cleaned",))
def q_guarded_ratios(spark, base):
    return st.cleaned(spark, base)


@register("coalesce_fill", "ticker, ev_to_revenue:d, ev_to_revenue_calc:d",
          "FROM cleaned", ctes=("cleaned",))
def q_coalesce_fill(spark, base):
    return st.cleaned(spark, base)


# --- W4, F1-F5, C7 ---------------------------------------------------------

_PCT = [s.name for s in fu.ALL_RANKS]


@register("sector_percentiles", "ticker, sector, " + ", ".join(f"{p}:d" for p in _PCT),
          "FROM percentiles", ctes=("percentiles",))
def q_sector_percentiles(spark, base):
    return fu.sector_percentiles(st.cleaned(spark, base))


_DUP_RANKS = [RankSpec("price_rank", "l_extendedprice", True), RankSpec("discount_rank", "l_discount", False),
              RankSpec("tax_rank", "tax", False)]


@register("sector_percentiles_dupkeys", "ticker, sector, l_quantity:d, price_rank:d, discount_rank:d, tax_rank:d",
          """FROM (SELECT ticker, sector, l_quantity,
                    PERCENT_RANK() OVER (PARTITION BY sector ORDER BY l_extendedprice NULLS LAST) AS price_rank,
                    PERCENT_RANK() OVER (PARTITION BY sector ORDER BY l_discount DESC NULLS LAST) AS discount_rank,
                    PERCENT_RANK() OVER (PARTITION BY sector ORDER BY tax DESC NULLS LAST) AS tax_rank
             FROM (SELECT CASE WHEN l_orderkey % 7 <> 0 THEN 'T' || CAST(l_partkey AS VARCHAR) END AS ticker,
                          CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS sector, l_quantity,
                          l_extendedprice, l_discount, CASE WHEN l_partkey % 3 <> 0 THEN l_tax END AS tax FROM lineitem))""")
def q_percentiles_dupkeys(spark, base):
    """W4 over line items: repeated and NULL keys, a NULL group, ties and NULL values."""
    li = scan_table(spark, base, "lineitem")
    rows = li.select(
        F.when(F.col("l_orderkey") % 7 != 0, F.concat(F.lit("T"), F.col("l_partkey").cast("string"))).alias("ticker"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_returnflag")).alias("sector"), "l_quantity", "l_extendedprice",
        "l_discount", F.when(F.col("l_partkey") % 3 != 0, F.col("l_tax")).alias("tax"))
    return grouped_percent_rank(rows, "sector", _DUP_RANKS)


for _name, _col in [("value_score", "value_score"), ("growth_score", "growth_score"),
                    ("quality_score", "quality_score"), ("risk_score", "risk_score"),
                    ("overall_alpha", "overall_alpha_score")]:
    register(_name, f"ticker, sector, {_col}:d", "FROM scored", ctes=("scored",))(
        lambda spark, base: st.scored(spark, base))


@register("conviction_bucket", "ticker, overall_alpha_score:d, conviction",
          "FROM scored", ctes=("scored",))
def q_conviction(spark, base):
    return st.scored(spark, base)


@register("standardize_names",
          "ticker, ev_ebitda:d, revenue_growth_yoy:d, eps_growth_yoy:d, "
          "free_cash_flow_margin:d, volatility_52w:d",
          "FROM standardized", ctes=("standardized",))
def q_standardize(spark, base):
    return st.standardized(spark, base)


@register("volatility_proxy", "ticker, beta:d, volatility_30d:d, volatility_90d:d",
          "FROM standardized", ctes=("standardized",))
def q_volatility(spark, base):
    return st.standardized(spark, base)


# --- C8-C10, A10 -----------------------------------------------------------

@register("red_flags", "ticker, " + ", ".join(fl.FLAG_COLUMNS),
          "FROM anomalies", ctes=("anomalies",))
def q_red_flags(spark, base):
    return st.flagged(spark, base)


@register("red_flag_rollup",
          "ticker, red_flags_text, red_flag_count, red_flag_score, red_flag_severity",
          f"FROM (SELECT *, {FLAG_TEXT_SQL} AS red_flags_text FROM anomalies)",
          ctes=("anomalies",))
def q_rollup(spark, base):
    return _flag_text(st.flagged(spark, base))


@register("flag_partitions", "n_any_flag, n_critical, n_high_risk, n_contradiction, n_clean",
          """FROM (SELECT CAST(count_if(red_flag_count > 0) AS BIGINT) AS n_any_flag,
                          CAST(count_if(red_flag_count >= 5) AS BIGINT) AS n_critical,
                          CAST(count_if(red_flag_count >= 3 AND red_flag_count < 5) AS BIGINT) AS n_high_risk,
                          CAST(count_if(overall_alpha_score >= 7.0 AND red_flag_count >= 2) AS BIGINT) AS n_contradiction,
                          CAST(count_if(red_flag_count = 0) AS BIGINT) AS n_clean FROM anomalies)""",
          ctes=("anomalies",))
def q_flag_partitions(spark, base):
    return fl.flag_partition_counts(st.anomalies(spark, base))


@register("critical_flags",
          "ticker, company_name, sector, red_flag_count, red_flags_text, overall_alpha_score:d, conviction",
          f"FROM (SELECT *, {FLAG_TEXT_SQL} AS red_flags_text FROM anomalies) WHERE red_flag_count >= 5",
          ctes=("anomalies",))
def q_critical(spark, base):
    """C10 listing: the critical partition (sorted by count in the report)."""
    return _flag_text(fl.flag_partition(st.anomalies(spark, base), "critical")
                      .orderBy(F.col("red_flag_count").desc(), "ticker"))


@register("high_risk_flags",
          "ticker, company_name, sector, red_flag_count, red_flags_text, overall_alpha_score:d, conviction",
          f"""FROM (SELECT *, {FLAG_TEXT_SQL} AS red_flags_text FROM anomalies)
              WHERE red_flag_count >= 3 AND red_flag_count < 5""", ctes=("anomalies",))
def q_high_risk(spark, base):
    """C10 listing: the high-risk partition, most flags first."""
    return _flag_text(fl.flag_partition(st.anomalies(spark, base), "high_risk")
                      .orderBy(F.col("red_flag_count").desc(), "ticker"))


@register("flag_frequency", "flag, count",
          "FROM (SELECT flag, COUNT(*) AS count FROM (SELECT unnest(red_flags) AS flag FROM anomalies) GROUP BY flag)",
          ctes=("anomalies",))
def q_flag_frequency(spark, base):
    return fl.flag_frequency(st.flagged(spark, base)).orderBy(F.col("count").desc(), "flag")


# --- W5, K1-K4 -------------------------------------------------------------

@register("top_per_sector", "sector, ticker, company_name, overall_alpha_score:d, conviction",
          """FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sector
                        ORDER BY overall_alpha_score DESC, ticker ASC) AS rn FROM scored)
             WHERE rn = 1""", ctes=("scored",))
def q_top_per_sector(spark, base):
    return fu.top_per_sector(st.scored(spark, base)).orderBy("sector")


_SAMPLE = ["ticker", "company_name", "sector", "market_cap", "current_price", "pe_ratio",
           "pb_ratio", "roe", "profit_margin", "quarterly_revenue_growth", "debt_to_equity", "beta"]
_SAMPLE_SPEC = ", ".join(f"{c}:d" if c in _DOUBLE_COMPANY_COLS else c for c in _SAMPLE)


@register("topk_market_cap", _SAMPLE_SPEC,
          "FROM companies ORDER BY market_cap DESC NULLS LAST, ticker LIMIT 5",
          ctes=("companies",))
def q_topk_market_cap(spark, base):
    return fu.top_k(st.companies(spark, base),
                    [F.col("market_cap").desc_nulls_last(), F.col("ticker")], 5, _SAMPLE)


@register("topk_nulls_last", "ranking, " + _SAMPLE_SPEC,
          """FROM ((SELECT 'roe' AS ranking, * FROM companies ORDER BY roe DESC NULLS LAST, ticker LIMIT 5)
                   UNION ALL
                   (SELECT 'debt_to_equity' AS ranking, * FROM companies
                    ORDER BY debt_to_equity DESC NULLS LAST, ticker LIMIT 5))""",
          ctes=("companies",))
def q_topk_nulls_last(spark, base):
    c = st.companies(spark, base)
    roe = fu.top_k(c, [F.col("roe").desc_nulls_last(), F.col("ticker")], 5, _SAMPLE)
    de = fu.top_k(c, [F.col("debt_to_equity").desc_nulls_last(), F.col("ticker")], 5, _SAMPLE)
    return (roe.select(F.lit("roe").alias("ranking"), "*")
            .unionByName(de.select(F.lit("debt_to_equity").alias("ranking"), "*")))


_ALPHA_COLS = ("ticker, company_name, sector, value_score:d, growth_score:d, quality_score:d, "
               "risk_score:d, overall_alpha_score:d, conviction")


@register("topk_alpha", _ALPHA_COLS,
          "FROM scored ORDER BY overall_alpha_score DESC, ticker LIMIT 15", ctes=("scored",))
def q_topk_alpha(spark, base):
    """Flagship: top companies by overall alpha over the whole factor chain."""
    return fu.top_k(st.scored(spark, base),
                    [F.col("overall_alpha_score").desc(), F.col("ticker")], 15)


@register("sample_projection",
          "ticker, company_name, sector, fcf_yield:d, fcf_to_revenue:d, price_volatility:d, cash_to_debt:d",
          "FROM cleaned ORDER BY ticker LIMIT 10", ctes=("cleaned",))
def q_sample_projection(spark, base):
    return fu.top_k(st.cleaned(spark, base), [F.col("ticker")], 10)


@register("sample_standardized",
          "ticker, company_name, sector, ev_ebitda:d, revenue_growth_yoy:d, eps_growth_yoy:d, free_cash_flow_margin:d, "
          "volatility_52w:d, overall_alpha_score:d, conviction",
          "FROM standardized ORDER BY overall_alpha_score DESC, ticker LIMIT 10", ctes=("standardized",))
def q_sample_standardized(spark, base):
    """K4, second sample: the standardized columns of the best companies by alpha."""
    return fu.top_k(st.standardized(spark, base), [F.col("overall_alpha_score").desc(), F.col("ticker")], 10)


# --- P1-P6 -----------------------------------------------------------------

def _spark_type(c):
    if c in _DOUBLE_COMPANY_COLS:
        return "double"
    return "date" if c == "next_earnings_date" else "string"


_ALL_IDX = {c: i for i, c in enumerate(fx.COMPANY_COLUMNS)}
oracle.cte("company_profile", ("companies",),
           "SELECT COUNT(*) AS n, " + ", ".join(f'COUNT("{c}") AS c{i}'
                                                 for c, i in _ALL_IDX.items()) + " FROM companies")


def _completeness_sql():
    parts, pos = [], 0
    for g, cols in pf.CRITICAL_COLUMNS.items():
        for c in cols:
            pos += 1
            i = _ALL_IDX[c]
            pct = f"CAST(c{i} AS DOUBLE) * 100.0 / CAST(NULLIF(n, 0) AS DOUBLE)"
            parts.append(
                f"SELECT CAST({pos} AS BIGINT) AS position, '{g}' AS column_group, '{c}' AS column_name, "
                f"'{_spark_type(c)}' AS data_type, c{i} AS non_null, n - c{i} AS null_count, "
                f"{pct} AS pct_complete, CASE WHEN {pct} >= 80.0 THEN 'ok' WHEN {pct} >= 50.0 "
                f"THEN 'warn' ELSE 'fail' END AS band FROM company_profile")
    return "FROM (" + " UNION ALL ".join(parts) + ")"


@register("completeness",
          "position, column_group, column_name, data_type, non_null, null_count, pct_complete:d, band",
          _completeness_sql(), ctes=("company_profile",))
def q_completeness(spark, base):
    return pf.completeness(st.companies(spark, base), pf.CRITICAL_COLUMNS)


@register("empty_columns", "column_name",
          "FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name FROM company_profile WHERE c{i} = 0"
                                        for c, i in _ALL_IDX.items()) + ")",
          ctes=("company_profile",))
def q_empty_columns(spark, base):
    return pf.empty_columns(st.companies(spark, base))


@register("category_distribution", "sector, count",
          "FROM (SELECT sector, COUNT(*) AS count FROM companies GROUP BY sector)",
          ctes=("companies",))
def q_category_distribution(spark, base):
    return pf.category_distribution(st.companies(spark, base), "sector")


@register("conviction_distribution", "conviction, count",
          "FROM (SELECT conviction, COUNT(*) AS count FROM scored GROUP BY conviction)",
          ctes=("scored",))
def q_conviction_distribution(spark, base):
    return pf.category_distribution(st.scored(spark, base), "conviction", by_name=True)


@register("required_columns", "column_group, column_name, present, usable",
          "FROM (" + " UNION ALL ".join(
              f"SELECT '{g}' AS column_group, '{c}' AS column_name, TRUE AS present, "
              f'COUNT("{c}") > 0 AS usable FROM standardized'
              for g, cols in pf.REQUIRED_COLUMNS.items() for c in cols)
          + " UNION ALL SELECT 'absent' AS column_group, 'no_such_column' AS column_name, FALSE AS present, FALSE AS usable)",
          ctes=("standardized",))
def q_required_columns(spark, base):
    return pf.required_columns(st.standardized(spark, base), pf.REQUIRED_COLUMNS | {"absent": ["no_such_column"]})


@register("completeness_band", "column_name, pct_complete:d, band",
          _completeness_sql(), ctes=("company_profile",))
def q_completeness_band(spark, base):
    """The band of every profiled column."""
    return pf.completeness(st.companies(spark, base), pf.CRITICAL_COLUMNS)


@register("contradictions",
          "ticker, company_name, overall_alpha_score:d, conviction, red_flag_count, red_flags_text",
          f"""FROM (SELECT *, {FLAG_TEXT_SQL} AS red_flags_text FROM anomalies)
              WHERE overall_alpha_score >= 7.0 AND red_flag_count >= 2""", ctes=("anomalies",))
def q_contradictions(spark, base):
    """C10 listing: high alpha but two or more red flags, best alpha first."""
    return _flag_text(fl.flag_partition(st.anomalies(spark, base), "contradiction")
                      .orderBy(F.col("overall_alpha_score").desc(), "ticker"))


@register("factor_scores_fixed",
          "ticker, sector, value_score:d, growth_score:d, quality_score:d, risk_score:d, "
          "overall_alpha_score:d, conviction", "FROM scored_fixed", ctes=("scored_fixed",))
def q_factor_scores_fixed(spark, base):
    """Corrected variant of F1-F5 and C7 (see ``factor_scores(fixed=True)``)."""
    return st.scored(spark, base, fixed=True)


@register("severity_distribution", "red_flag_severity, count",
          "FROM (SELECT red_flag_severity, COUNT(*) AS count FROM anomalies GROUP BY red_flag_severity)",
          ctes=("anomalies",))
def q_severity_distribution(spark, base):
    """P5 for the red-flag severity, ordered by name."""
    return pf.category_distribution(st.flagged(spark, base), "red_flag_severity", by_name=True)
