"""Registered queries: macro views, company context, screens, memo jobs,
portfolio and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as cx
from ..operators import macro as mc
from ..operators import memo_jobs as mj
from ..operators import portfolio as pt
from ..operators import screen as sc
from ..operators.flags import parse_flags_text, prettify_flags
from ..sources import fixtures as fx
from ..sources.sinks import save_lookup_table
from ..session import fresh_path
from . import oracle
from . import stages as st
from .registry import register


def _macro(spark, base):
    return fx.macro(spark, base)


def _context(spark, base):
    return cx.company_context(st.anomalies(spark, base), _macro(spark, base))


# --- S7, S10, C18, C19 -----------------------------------------------------

_MACRO_COLS = "date, spread_bps:d, spread_3m_change:d, credit_risk_bucket"


@register("latest_view", _MACRO_COLS,
          "FROM macro WHERE date = (SELECT MAX(date) FROM macro)", ctes=("macro",))
def q_latest_view(spark, base):
    """The SQL view over the newest date."""
    _macro(spark, base).createOrReplaceTempView("credit_macro")
    return mc.create_latest_view(spark, "credit_macro", "credit_macro_latest")


@register("macro_history_top", _MACRO_COLS, "FROM macro ORDER BY date DESC LIMIT 5", ctes=("macro",))
def q_macro_history_top(spark, base):
    return mc.history_top(_macro(spark, base))


@register("macro_trend", "date, spread_3m_change:d, macro_trend",
          """FROM (SELECT *, CASE WHEN spread_3m_change < 0 THEN 'improving'
                                  WHEN spread_3m_change > 0 THEN 'worsening'
                                  WHEN spread_3m_change = 0 THEN 'unchanged' END AS macro_trend FROM macro)""",
          ctes=("macro",))
def q_macro_trend(spark, base):
    m = _macro(spark, base)
    return m.withColumn("macro_trend", mc.macro_trend(F.col("spread_3m_change")))


@register("beta_band", "ticker, beta:d, beta_band",
          """FROM (SELECT *, CASE WHEN beta < 0.8 THEN 'low' WHEN beta <= 1.2 THEN 'market-like'
                                  WHEN beta > 1.2 THEN 'high' END AS beta_band FROM context)""",
          ctes=("context",))
def q_beta_band(spark, base):
    ctx = _context(spark, base)
    return ctx.withColumn("beta_band", mc.beta_band(F.col("beta")))


# --- C11-C17, J5 -----------------------------------------------------------

@register("company_lookup", "request, ticker, company_name, sector, found",
          """FROM (SELECT r.request, a.ticker, a.company_name, a.sector, a.ticker IS NOT NULL AS found
                   FROM (VALUES ('t1'), ('T2'), ('t999999')) r(request)
                   LEFT JOIN anomalies a ON a.ticker = upper(r.request))""", ctes=("anomalies",))
def q_company_lookup(spark, base):
    return cx.company_lookup(st.flagged(spark, base), fx.requested_tickers(spark), few_requests=True)   # a literal list


@register("company_lookup_indexed", "request, ticker, company_name, sector, found",
          """FROM (SELECT r.request, a.ticker, a.company_name, a.sector, a.ticker IS NOT NULL AS found
                   FROM (VALUES ('t1'), ('T2'), ('t999999')) r(request)
                   LEFT JOIN anomalies a ON a.ticker = upper(r.request))""", ctes=("anomalies",))
def q_company_lookup_indexed(spark, base):
    """C11 on the stored company table, sorted by ticker and with bloom filters."""
    path = fresh_path(spark, "companies_by_ticker")
    save_lookup_table(st.flagged(spark, base), path, "ticker")
    return cx.indexed_lookup(spark.read.parquet(path), fx.requested_tickers(spark))


_CTX_COLS = ("ticker, company_name, sector, industry, country, exchange, currency, market_cap:d, "
             "value_score:d, growth_score:d, quality_score:d, risk_score:d, overall_alpha_score:d, "
             "conviction_rating, beta:d, volatility_30d:d, volatility_90d:d, volatility_52w:d, "
             "current_price:d, free_cash_flow:d, free_cash_flow_margin:d, fcf_yield:d, debt_to_equity:d, "
             "current_ratio:d, cash_to_debt:d, macro_date, spread_bps:d, spread_3m_change:d, "
             "credit_risk_bucket, red_flag_score:d, red_flag_severity, red_flag_count, red_flags_text, n_peers")


def _flat_context(spark, base):
    ctx = _context(spark, base)
    return ctx.select("*", F.col("macro.date").alias("macro_date"),
                      F.col("macro.spread_bps").alias("spread_bps"),
                      F.col("macro.spread_3m_change").alias("spread_3m_change"),
                      F.col("macro.credit_risk_bucket").alias("credit_risk_bucket"),
                      F.col("red_flags.red_flag_score").alias("red_flag_score"),
                      F.col("red_flags.red_flag_severity").alias("red_flag_severity"),
                      F.col("red_flags.red_flag_count").alias("red_flag_count"),
                      F.concat_ws("|", F.col("red_flags.red_flags")).alias("red_flags_text"),
                      F.size("peers").alias("n_peers"))


@register("company_context", _CTX_COLS, "FROM context", ctes=("context",))
def q_company_context(spark, base):
    """C12/J5 flattened (the library returns nested structs)."""
    return _flat_context(spark, base)


@register("round_or_none", "ticker, market_cap:d, fcf_yield:d, cash_to_debt:d",
          "FROM context", ctes=("context",))
def q_round_or_none(spark, base):
    return _flat_context(spark, base)


@register("prettify_flags", "ticker, red_flags_text", "FROM context", ctes=("context",))
def q_prettify(spark, base):
    a = st.anomalies(spark, base)
    return a.select("ticker", F.concat_ws("|", prettify_flags(F.col("red_flags"))).alias("red_flags_text"))


@register("parse_flags_text", "ticker, red_flags_text",
          "FROM context", ctes=("context",))
def q_parse_flags_text(spark, base):
    """The flag list arrives as text of a list (as a remote fetch
    delivers it) and is parsed back, then prettified."""
    a = st.anomalies(spark, base)
    as_text = F.concat(F.lit("["), F.concat_ws(", ", F.transform("red_flags", lambda f: F.concat(
        F.lit("'"), f, F.lit("'")))), F.lit("]"))
    parsed = parse_flags_text(as_text)
    return a.select("ticker", F.concat_ws("|", prettify_flags(parsed)).alias("red_flags_text"))


@register("flags_text", "ticker, flags_text",
          """FROM (SELECT ticker, CASE WHEN len(red_flags) = 0 THEN 'None detected'
                                       ELSE array_to_string(red_flags, ', ') END AS flags_text
                   FROM anomalies)""", ctes=("anomalies",))
def q_flags_text(spark, base):
    from ..operators.flags import flags_text
    a = st.anomalies(spark, base)
    return a.select("ticker", flags_text(F.col("red_flags")).alias("flags_text"))


@register("safe_value_text", "ticker, market_cap_bn, roe_pct, pe_text",
          f"""FROM (SELECT ticker, {oracle.fmt('market_cap', 2, '(1.0 / 1e9)')} AS market_cap_bn,
                          {oracle.fmt('roe', 1, '100.0')} AS roe_pct, {oracle.fmt('pe_ratio')} AS pe_text
                   FROM anomalies)""", ctes=("anomalies",))
def q_safe_value_text(spark, base):
    a = st.anomalies(spark, base)
    return a.select("ticker", cx.safe_value_text(F.col("market_cap"), 2, 1 / 1e9).alias("market_cap_bn"),
                    cx.safe_value_text(F.col("roe"), 1, 100.0).alias("roe_pct"),
                    cx.safe_value_text(F.col("pe_ratio")).alias("pe_text"))


# --- F6, F7, R4 -------------------------------------------------------------

_F6_SQL = ("6.0 + (0.25 * (coalesce(value_score, 0.0) - 5.0) + 0.35 * (coalesce(growth_score, 0.0) - 5.0)"
           " + 0.25 * (coalesce(quality_score, 0.0) - 5.0) - 0.30 * (coalesce(risk_score, 0.0) - 5.0))")


@register("factor_expected_return", "ticker, exp_return_pct:d",
          f"FROM (SELECT ticker, {_F6_SQL} AS exp_return_pct FROM context)", ctes=("context",))
def q_expected_return(spark, base):
    ctx = _context(spark, base)
    return ctx.select("ticker", cx.factor_expected_return(ctx).alias("exp_return_pct"))


@register("factor_radar", "ticker, r_value:d, r_growth:d, r_quality:d, r_risk_inv:d, r_close:d",
          """FROM (SELECT ticker, coalesce(value_score, 0.0) AS r_value, coalesce(growth_score, 0.0) AS r_growth,
                          coalesce(quality_score, 0.0) AS r_quality, 10.0 - coalesce(risk_score, 0.0) AS r_risk_inv,
                          coalesce(value_score, 0.0) AS r_close FROM context)""", ctes=("context",))
def q_factor_radar(spark, base):
    ctx = _context(spark, base)
    radar = cx.factor_radar(ctx)
    return ctx.select("ticker", *[radar[i].alias(n) for i, n in
                                  enumerate(["r_value", "r_growth", "r_quality", "r_risk_inv", "r_close"])])


_R4_SQL = (f"SELECT ticker, coalesce(nullif(current_price, 0.0), 100.0) AS spot, "
           f"coalesce(nullif(volatility_52w, 0.0), 30.0) AS vol_pct, {_F6_SQL} AS exp_return_pct FROM context")
oracle.cte("scenario_inputs", ("context",), _R4_SQL)


@register("scenario_inputs", "ticker, spot:d, vol_pct:d, exp_return_pct:d",
          "FROM scenario_inputs", ctes=("scenario_inputs",))
def q_scenario_inputs(spark, base):
    return cx.scenario_inputs(_context(spark, base))


# --- M1, M2, A14 -------------------------------------------------------------

def stub_model(prompt: str) -> str:
    """Deterministic stand-in for a model client (used by the registered
    query and the tests): fails on odd-length prompts."""
    if len(prompt) % 2 == 1:
        raise RuntimeError("model unavailable")
    return f"memo[{len(prompt)}] {prompt.splitlines()[0]}"


_SCEN_FIELDS = [("value score", "value_score"), ("growth score", "growth_score"),
                ("quality score", "quality_score"), ("risk score", "risk_score"),
                ("overall alpha", "overall_alpha_score"), ("beta", "beta"),
                ("52-week volatility", "volatility_52w"), ("debt to equity", "debt_to_equity"),
                ("FCF yield", "fcf_yield")]
_SCEN_SQL = f"""FROM (SELECT ticker, concat_ws(chr(10),
  concat('Describe bull, base and bear cases for ', coalesce(ticker, 'N/A'), ' (', coalesce(company_name, 'N/A'),
         ', ', coalesce(sector, 'N/A'), ') over the next 12-18 months, without numeric forecasts.'),
  concat('Facts: ', concat_ws('; ', {", ".join(f"concat('{lab} ', {oracle.fmt(col)})" for lab, col in _SCEN_FIELDS)}), '.'),
  concat('Credit: spread ', {oracle.fmt('spread_bps')}, ' bps, bucket ', coalesce(credit_risk_bucket, 'N/A'), '.'),
  concat('Red flags: ', CASE WHEN len(flags) = 0 THEN 'None' ELSE array_to_string(flags, ', ') END, '.'),
  'For each case give drivers, how the risk profile changes and who it suits.') AS prompt
  FROM (SELECT c.*, list_transform(list_filter(a.red_flags, lambda f: f IS NOT NULL AND f <> ''),
                                   lambda f: trim(replace(f, '_', ' '))) AS flags
        FROM context c JOIN anomalies a ON a.ticker = c.ticker))"""


@register("scenario_prompt", "ticker, prompt", _SCEN_SQL, ctes=("context", "anomalies"))
def q_scenario_prompt(spark, base):
    """M1 scenario form over every company's context."""
    ctx = _context(spark, base)
    return ctx.select("ticker", cx.scenario_prompt(ctx).alias("prompt"))


_APP_SQL = f"""FROM (SELECT ticker, concat_ws(chr(10),
  concat('Assess ', coalesce(ticker, 'N/A'), ' (', coalesce(company_name, 'N/A'), ', ', coalesce(sector, 'N/A'), ', ',
         coalesce(country, 'N/A'), ') for this question: Is this stock attractive for a long-term investor?'),
  concat('Scores: value ', {oracle.fmt('value_score')}, ', growth ', {oracle.fmt('growth_score')}, ', quality ',
         {oracle.fmt('quality_score')}, ', risk ', {oracle.fmt('risk_score')}, ', alpha ', {oracle.fmt('overall_alpha_score')},
         '; rated ', coalesce(conviction_rating, 'N/A'), '.'),
  concat('Risk: beta ', {oracle.fmt('beta')}, ' (',
         CASE WHEN beta < 0.8 THEN 'low' WHEN beta <= 1.2 THEN 'market-like' WHEN beta > 1.2 THEN 'high' ELSE 'unknown' END,
         ' sensitivity), volatility 30d ', {oracle.fmt('volatility_30d')}, ', 90d ', {oracle.fmt('volatility_90d')}, ', 52w ',
         {oracle.fmt('volatility_52w')}, '; D/E ', {oracle.fmt('debt_to_equity')}, ', current ratio ', {oracle.fmt('current_ratio')},
         ', cash to debt ', {oracle.fmt('cash_to_debt')}, ', FCF yield ', {oracle.fmt('fcf_yield')}, ', FCF margin ',
         {oracle.fmt('free_cash_flow_margin')}, '.'),
  concat('Credit: spread ', {oracle.fmt('spread_bps')}, ' bps, three-month change ', {oracle.fmt('spread_3m_change')}, ' (',
         CASE WHEN spread_3m_change < 0 THEN 'improving' WHEN spread_3m_change > 0 THEN 'worsening'
              WHEN spread_3m_change = 0 THEN 'unchanged' ELSE 'unknown' END, '), bucket ', coalesce(credit_risk_bucket, 'N/A'), '.'),
  concat('Red flags: score ', {oracle.fmt('red_flag_score')}, ', severity ', coalesce(red_flag_severity, 'N/A'), ', ',
         coalesce(CAST(red_flag_count AS VARCHAR), '0'), ' found: ',
         CASE WHEN red_flags_text = '' THEN 'None detected' ELSE replace(red_flags_text, '|', ', ') END, '.'),
  'Use only these facts, name what is missing and give no numeric forecast.',
  'Answer with a summary, strengths, risks, the effect of wider credit spreads, and a verdict that fits the rating.') AS prompt
  FROM context)"""


@register("app_memo_prompt", "ticker, prompt", _APP_SQL, ctes=("context",))
def q_app_memo_prompt(spark, base):
    """M1, app form: macro trend, beta band and volatility in the prompt."""
    ctx = _context(spark, base)
    return ctx.select("ticker", cx.app_memo_prompt(ctx, "Is this stock attractive for a long-term investor?").alias("prompt"))


@register("memo_prompt", "ticker, prompt", "FROM memo_prompts", ctes=("memo_prompts",))
def q_memo_prompt(spark, base):
    a = st.anomalies(spark, base)
    return a.select("ticker", cx.memo_prompt(a).alias("prompt"))


_MEMO_COLS = ("ticker, company_name, sector, overall_alpha_score:d, conviction, value_score:d, "
              "growth_score:d, quality_score:d, risk_score:d, red_flag_count, investment_memo")


@register("memo_batch", _MEMO_COLS, "FROM memo_batch", ctes=("memo_batch",))
def q_memo_batch(spark, base):
    return cx.memo_batch(st.anomalies(spark, base), stub_model, top_n=10)


@register("memo_batch_resumed", _MEMO_COLS, "FROM memo_batch", ctes=("memo_batch",))
def q_memo_batch_resumed(spark, base):
    """M2 as a resumed job: a first run asks for four memos, a second one for the missing six."""
    companies, path = st.anomalies(spark, base), fresh_path(spark, "memo-results")
    mj.resumable_memo_batch(companies, stub_model, path, top_n=4, attempts=1)
    return mj.resumable_memo_batch(companies, stub_model, path, top_n=10, attempts=1, retry_failed=False)


@register("batch_outcome", "successful, failed, total",
          """FROM (SELECT CAST(count_if(NOT starts_with(investment_memo, 'Error')) AS BIGINT) AS successful,
                          CAST(count_if(starts_with(investment_memo, 'Error')) AS BIGINT) AS failed,
                          COUNT(*) AS total FROM memo_batch)""", ctes=("memo_batch",))
def q_batch_outcome(spark, base):
    return cx.batch_outcome(cx.memo_batch(st.anomalies(spark, base), stub_model, top_n=10))


# --- Q1-Q3, K5 ---------------------------------------------------------------

SCREEN_REQUEST = "undervalued high quality US stocks"
LOW_RISK_REQUEST = "low risk high growth names"


@register("screen_rules", "ticker, company_name, sector, country, value_score:d, quality_score:d",
          """FROM anomalies WHERE country = 'United States'
             ORDER BY value_score DESC NULLS LAST, quality_score DESC NULLS LAST, ticker LIMIT 10""",
          ctes=("anomalies",))
def q_screen_rules(spark, base):
    return sc.screen_rules(st.anomalies(spark, base), SCREEN_REQUEST, max_rows=10)


@register("screen_rules_low_risk",
          "ticker, growth_score:d, risk_score:d, volatility_52w:d, beta:d, debt_to_equity:d",
          """FROM anomalies ORDER BY growth_score DESC NULLS LAST, risk_score ASC NULLS LAST,
             volatility_52w ASC NULLS LAST, beta ASC NULLS LAST, debt_to_equity ASC NULLS LAST, ticker
             LIMIT 10""", ctes=("anomalies",))
def q_screen_low_risk(spark, base):
    return sc.screen_rules(st.anomalies(spark, base), LOW_RISK_REQUEST, max_rows=10)


SCREEN_SQL = ("SELECT ticker, sector, value_score, risk_score, debt_to_equity FROM company_view "
              "WHERE debt_to_equity < :max_de AND sector = :sector ORDER BY value_score DESC, ticker")


@register("screen_sql", "ticker, sector, value_score:d, risk_score:d, debt_to_equity:d",
          """FROM (SELECT ticker, sector, value_score, risk_score, debt_to_equity FROM anomalies
                   WHERE debt_to_equity < 1.0 AND sector = 'PROMO'
                   ORDER BY value_score DESC, ticker LIMIT 25)""", ctes=("anomalies",))
def q_screen_sql(spark, base):
    return sc.screen_sql(spark, st.anomalies(spark, base), SCREEN_SQL,
                         args={"max_de": 1.0, "sector": "PROMO"}, max_rows=25)


@register("screen_limit", "ticker, sector, value_score:d, risk_score:d, debt_to_equity:d",
          """FROM (SELECT ticker, sector, value_score, risk_score, debt_to_equity FROM anomalies
                   WHERE debt_to_equity < 1.0 AND sector = 'PROMO'
                   ORDER BY value_score DESC, ticker LIMIT 5)""", ctes=("anomalies",))
def q_screen_limit(spark, base):
    """K5: the same screen capped at 5 rows."""
    return sc.screen_sql(spark, st.anomalies(spark, base), SCREEN_SQL,
                         args={"max_de": 1.0, "sector": "PROMO"}, max_rows=5)


@register("value_risk_points", "ticker, Value:d, Risk:d",
          """FROM (SELECT ticker, value_score AS Value, risk_score AS Risk FROM anomalies
                   WHERE country = 'United States'
                   ORDER BY value_score DESC NULLS LAST, quality_score DESC NULLS LAST, ticker LIMIT 10)""",
          ctes=("anomalies",))
def q_value_risk(spark, base):
    return sc.value_risk_points(sc.screen_rules(st.anomalies(spark, base), SCREEN_REQUEST, max_rows=10))


# --- S3, W7, A12, R1, R2, A13, W8 ----------------------------------------

def _prices(spark, base):
    return fx.prices_grid(spark, base)


@register("prices_csv_long", "date, ticker, price:d", "FROM prices_grid", ctes=("prices_grid",))
def q_prices_csv_long(spark, base):
    """S3: the wide price matrix written as CSV to the shared scratch folder
    and read back into the long form."""
    path = fresh_path(spark, "prices_wide_csv")
    fx.prices_wide(spark, base).orderBy("date").write.option("header", True).csv(path)
    return pt.prices_csv_long(spark, path)


@register("daily_returns", "date, ticker, ret:d", "FROM returns", ctes=("returns",))
def q_daily_returns(spark, base):
    return pt.daily_returns(_prices(spark, base))


@register("return_variance", "ticker, variance:d", "FROM weights", ctes=("weights",))
def q_return_variance(spark, base):
    return pt.return_variance(pt.daily_returns(_prices(spark, base)))


@register("return_covariance", "ticker_a, ticker_b, n, covariance:d",
          """FROM (SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, COUNT(*) AS n, COVAR_SAMP(a.ret, b.ret) AS covariance
                   FROM returns a JOIN returns b ON a.date = b.date GROUP BY a.ticker, b.ticker)""", ctes=("returns",))
def q_return_covariance(spark, base):
    """The covariance matrix of all tickers."""
    return pt.return_covariance(pt.daily_returns(_prices(spark, base)), block_tickers=8)


@register("inverse_variance_weights", "ticker, variance:d, weight:d", "FROM weights", ctes=("weights",))
def q_weights(spark, base):
    return pt.inverse_variance_weights(pt.daily_returns(_prices(spark, base)))


def _daily(spark, base):
    r = pt.daily_returns(_prices(spark, base))
    return pt.portfolio_daily(r, pt.inverse_variance_weights(r))


@register("portfolio_daily", "date, port_ret:d", "FROM port_daily", ctes=("port_daily",))
def q_portfolio_daily(spark, base):
    return _daily(spark, base)


@register("portfolio_stats", "mean_daily:d, vol_daily:d, ann_return:d, ann_vol:d",
          """FROM (SELECT AVG(port_ret) AS mean_daily, STDDEV_SAMP(port_ret) AS vol_daily,
                          AVG(port_ret) * 252.0 AS ann_return, STDDEV_SAMP(port_ret) * sqrt(252.0) AS ann_vol
                   FROM port_daily)""", ctes=("port_daily",))
def q_portfolio_stats(spark, base):
    return pt.portfolio_stats(_daily(spark, base))


@register("cumulative_return", "date, port_ret:d, cum_return:d",
          """FROM (SELECT date, port_ret, SUM(port_ret) OVER (ORDER BY date
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_return FROM port_daily)""",
          ctes=("port_daily",))
def q_cumulative(spark, base):
    return pt.cumulative_return(_daily(spark, base))
