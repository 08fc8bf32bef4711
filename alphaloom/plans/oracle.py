"""DuckDB oracle CTEs.

Written independently of the Spark code, straight from the formulas in the
docs, so that the checker compares two implementations.  The tables named
in the FROM clauses are the views the checker registers.
"""

from __future__ import annotations

from ..sources.fixtures import COMPANY_METRIC_RULES

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


def with_ctes(names: tuple[str, ...], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order)
    return f"WITH {parts}\n{body}"


# ---------------------------------------------------------------------------
# Company fundamentals
# ---------------------------------------------------------------------------

def _metric_sql(name, a, b, c, d, m) -> str:
    return (f'CASE WHEN p_partkey % {m} = 0 THEN NULL '
            f'ELSE CAST((p_partkey * {a}) % {b} - ({c}) AS DOUBLE) / {d} END AS "{name}"')


cte("companies", (), f"""
SELECT 'T' || CAST(p_partkey AS VARCHAR) AS ticker,
       p_name AS company_name,
       CASE WHEN p_partkey % 41 = 40 THEN NULL ELSE p_type END AS sector,
       p_brand AS industry,
       CASE WHEN p_partkey % 3 = 0 THEN 'United States' ELSE 'Other' END AS country,
       'XNYS' AS exchange, 'USD' AS currency,
       p_retailprice AS current_price, p_retailprice AS "open",
       CASE WHEN p_partkey % 101 = 0 THEN NULL
            ELSE CAST((p_partkey * 131) % 500 + 100 + p_size AS DOUBLE) END AS "52week_high",
       CAST(NULL AS DOUBLE) AS peg_ratio, CAST(NULL AS DOUBLE) AS roic,
       CAST(NULL AS DOUBLE) AS operating_cashflow, CAST(NULL AS DOUBLE) AS fcf_per_share,
       CAST(NULL AS DOUBLE) AS dividend_yield, CAST(NULL AS DATE) AS next_earnings_date,
       {", ".join(_metric_sql(*r) for r in COMPANY_METRIC_RULES)}
FROM part""")

cte("cleaned", ("companies",), """
SELECT * REPLACE (COALESCE(ev_to_revenue, ev_to_revenue_calc) AS ev_to_revenue)
FROM (
  SELECT *,
    CASE WHEN free_cashflow IS NOT NULL AND market_cap > 0 THEN free_cashflow / market_cap * 100 END AS fcf_yield,
    CASE WHEN free_cashflow IS NOT NULL AND total_revenue > 0 THEN free_cashflow / total_revenue * 100 END AS fcf_to_revenue,
    CASE WHEN "52week_high" IS NOT NULL AND "52week_low" IS NOT NULL AND current_price > 0
         THEN ("52week_high" - "52week_low") / current_price * 100 END AS price_volatility,
    CASE WHEN total_cash IS NOT NULL AND total_debt > 0 THEN total_cash / total_debt END AS cash_to_debt,
    CASE WHEN enterprise_value IS NOT NULL AND total_revenue > 0 THEN enterprise_value / total_revenue END AS ev_to_revenue_calc
  FROM (SELECT * EXCLUDE (peg_ratio, roic, next_earnings_date) FROM companies
        WHERE ticker IS NOT NULL AND market_cap IS NOT NULL AND sector IS NOT NULL
          AND current_price IS NOT NULL)
)""")


def _pr(col: str, asc: bool) -> str:
    d = "ASC" if asc else "DESC"
    return f"PERCENT_RANK() OVER (PARTITION BY sector ORDER BY {col} {d} NULLS LAST)"


cte("percentiles", ("cleaned",), f"""
SELECT *,
  {_pr('pe_ratio', True)} AS pe_percentile,
  {_pr('pb_ratio', True)} AS pb_percentile,
  {_pr('ps_ratio', True)} AS ps_percentile,
  {_pr('ev_to_ebitda', True)} AS ev_ebitda_percentile,
  {_pr('fcf_yield', False)} AS fcf_yield_percentile,
  {_pr('quarterly_revenue_growth', False)} AS rev_growth_percentile,
  {_pr('earnings_growth', False)} AS earnings_growth_percentile,
  {_pr('quarterly_earnings_growth', False)} AS qtr_earnings_percentile,
  {_pr('roe', False)} AS roe_percentile,
  {_pr('roa', False)} AS roa_percentile,
  {_pr('profit_margin', False)} AS profit_margin_percentile,
  {_pr('operating_margin', False)} AS operating_margin_percentile,
  {_pr('fcf_to_revenue', False)} AS fcf_quality_percentile,
  {_pr('debt_to_equity', True)} AS debt_eq_percentile,
  {_pr('current_ratio', False)} AS current_ratio_percentile,
  {_pr('beta', True)} AS beta_percentile,
  {_pr('price_volatility', True)} AS volatility_percentile,
  {_pr('cash_to_debt', False)} AS cash_debt_percentile
FROM cleaned""")

cte("factor_scores", ("percentiles",), """
SELECT *,
  (1 - pe_percentile) * 2.0 + (1 - pb_percentile) * 2.0 + (1 - ps_percentile) * 2.0
    + (1 - ev_ebitda_percentile) * 2.0 + fcf_yield_percentile * 2.0 AS value_score,
  (rev_growth_percentile * 3.33 + earnings_growth_percentile * 3.33
    + qtr_earnings_percentile * 3.34) * 10 AS growth_score,
  roe_percentile * 2.0 + roa_percentile * 2.0 + profit_margin_percentile * 2.0
    + operating_margin_percentile * 2.0 + fcf_quality_percentile * 2.0 AS quality_score,
  (1 - debt_eq_percentile) * 2.0 + current_ratio_percentile * 2.0 + (1 - beta_percentile) * 2.0
    + (1 - volatility_percentile) * 2.0 + cash_debt_percentile * 2.0 AS risk_score
FROM percentiles""")

cte("scored", ("factor_scores",), """
SELECT *,
  CASE WHEN overall_alpha_score >= 8.0 THEN 'Strong Buy'
       WHEN overall_alpha_score >= 7.0 THEN 'Buy'
       WHEN overall_alpha_score >= 5.0 THEN 'Hold'
       WHEN overall_alpha_score >= 3.0 THEN 'Sell'
       ELSE 'Strong Sell' END AS conviction
FROM (SELECT *, value_score * 0.25 + growth_score * 0.30 + quality_score * 0.30
                + risk_score * 0.15 AS overall_alpha_score FROM factor_scores)""")

cte("standardized", ("scored",), """
SELECT * EXCLUDE (ev_to_ebitda, quarterly_revenue_growth, earnings_growth, fcf_to_revenue, price_volatility),
  ev_to_ebitda AS ev_ebitda, quarterly_revenue_growth AS revenue_growth_yoy,
  earnings_growth AS eps_growth_yoy, fcf_to_revenue AS free_cash_flow_margin,
  price_volatility AS volatility_52w,
  beta * 15.0 AS volatility_30d, beta * 25.0 AS volatility_90d
FROM scored""")

cte("flag_cols", ("standardized",), """
SELECT *,
  CASE WHEN debt_to_equity > 2.0 THEN 'extreme_debt' END AS flag_extreme_debt,
  CASE WHEN profit_margin < 0 THEN 'negative_profit_margin' END AS flag_negative_margin,
  CASE WHEN operating_margin < 0 THEN 'negative_operating_margin' END AS flag_negative_operating,
  CASE WHEN current_ratio < 1.0 THEN 'liquidity_risk' END AS flag_liquidity_risk,
  CASE WHEN free_cashflow < 0 THEN 'negative_free_cashflow' END AS flag_negative_fcf,
  CASE WHEN pe_ratio > 50 THEN 'extreme_high_pe' END AS flag_high_pe,
  CASE WHEN beta > 1.5 THEN 'high_volatility' END AS flag_high_volatility,
  CASE WHEN roe < 0 THEN 'negative_roe' END AS flag_negative_roe,
  CASE WHEN revenue_growth_yoy < -0.05 THEN 'revenue_decline' END AS flag_revenue_decline,
  CASE WHEN cash_to_debt < 0.2 THEN 'low_cash_coverage' END AS flag_low_cash_coverage
FROM standardized""")

cte("anomalies", ("flag_cols",), """
SELECT *,
  CASE WHEN red_flag_count >= 5 THEN 'Critical' WHEN red_flag_count >= 3 THEN 'High'
       WHEN red_flag_count >= 1 THEN 'Medium' ELSE 'Low' END AS red_flag_severity
FROM (
  SELECT *, len(red_flags) AS red_flag_count, len(red_flags) AS red_flag_score
  FROM (
    SELECT *, list_filter(red_flags_array, lambda x: x IS NOT NULL) AS red_flags
    FROM (SELECT *, [flag_extreme_debt, flag_negative_margin, flag_negative_operating,
                     flag_liquidity_risk, flag_negative_fcf, flag_high_pe, flag_high_volatility,
                     flag_negative_roe, flag_revenue_decline, flag_low_cash_coverage] AS red_flags_array
          FROM flag_cols)))""")


# ---------------------------------------------------------------------------
# Retail signals
# ---------------------------------------------------------------------------

cte("retail_transactions", (), """
SELECT o.o_orderkey AS Transaction_ID, o.o_orderdate AS "Date",
       list_sort(array_agg(DISTINCT p.p_brand)) AS Product,
       CAST(SUM(l.l_quantity) AS INT) AS Total_Items, o.o_totalprice AS Total_Cost,
       n.n_name AS City, MAX(l.l_discount) > 0.07 AS Discount_Applied,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'BOGO (Buy One Get One)'
            WHEN '2-HIGH' THEN 'Discount on Selected Items' ELSE 'None' END AS Promotion,
       CASE WHEN month(o.o_orderdate) IN (12, 1, 2) THEN 'Winter'
            WHEN month(o.o_orderdate) IN (3, 4, 5) THEN 'Spring'
            WHEN month(o.o_orderdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS Season
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
     JOIN part p ON p.p_partkey = l.l_partkey
     JOIN customer c ON c.c_custkey = o.o_custkey
     JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY o.o_orderkey, o.o_orderdate, o.o_totalprice, n.n_name, o.o_orderpriority""")

cte("rx", ("retail_transactions",), """
SELECT unnest(Product) AS Product, CAST("Date" AS DATE) AS DateOnly, Total_Items, Total_Cost,
       City, Season, Promotion, Discount_Applied
FROM retail_transactions""")

cte("daily_prod", ("rx",), """
SELECT *, CAST(Items_7d - Items_30d AS DOUBLE) / NULLIF(CAST(Items_30d AS DOUBLE), 0) AS Demand_Momentum
FROM (
  SELECT DateOnly, Product, Daily_Items,
         CAST(SUM(Daily_Items) OVER (PARTITION BY Product ORDER BY DateOnly
              ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS BIGINT) AS Items_7d,
         CAST(SUM(Daily_Items) OVER (PARTITION BY Product ORDER BY DateOnly
              ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS BIGINT) AS Items_30d
  FROM (SELECT DateOnly, Product, CAST(SUM(Total_Items) AS BIGINT) AS Daily_Items
        FROM rx GROUP BY DateOnly, Product))""")

cte("daily_spend", ("rx",), """
SELECT City, DateOnly, Daily_Spend, Spend_7d, Spend_30d,
       (Spend_7d - Spend_30d) / NULLIF(Spend_30d, 0) AS Spend_Momentum
FROM (
  SELECT City, DateOnly, CAST(spend AS DOUBLE) AS Daily_Spend,
         CAST(SUM(spend) OVER w7 AS DOUBLE) / COUNT(spend) OVER w7 AS Spend_7d,
         CAST(SUM(spend) OVER w30 AS DOUBLE) / COUNT(spend) OVER w30 AS Spend_30d
  FROM (SELECT City, DateOnly, fsum(Total_Cost) AS spend
        FROM rx GROUP BY City, DateOnly)
  WINDOW w7 AS (PARTITION BY City ORDER BY DateOnly ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY City ORDER BY DateOnly ROWS BETWEEN 30 PRECEDING AND CURRENT ROW))""")

cte("discount", ("rx",), """
SELECT *, (Avg_Items_Discount - Avg_Items_NoDiscount) / NULLIF(Avg_Items_NoDiscount, 0) AS Discount_Elasticity
FROM (
  SELECT Product,
    CAST(SUM(CASE WHEN Discount_Applied THEN Total_Items END) AS DOUBLE)
      / CAST(NULLIF(COUNT(CASE WHEN Discount_Applied THEN Total_Items END), 0) AS DOUBLE) AS Avg_Items_Discount,
    CAST(SUM(CASE WHEN NOT Discount_Applied THEN Total_Items END) AS DOUBLE)
      / CAST(NULLIF(COUNT(CASE WHEN NOT Discount_Applied THEN Total_Items END), 0) AS DOUBLE) AS Avg_Items_NoDiscount
  FROM rx GROUP BY Product)""")

cte("promo", ("rx",), """
SELECT Product, Promotion,
       CAST(SUM(Total_Items) AS DOUBLE) / CAST(NULLIF(COUNT(Total_Items), 0) AS DOUBLE) AS Avg_Items
FROM rx GROUP BY Product, Promotion""")

cte("promo_lift", ("promo",), """
SELECT p.Product, p.Promotion, p.Avg_Items, b.Avg_Items AS Baseline_Avg_Items,
       p.Avg_Items / NULLIF(b.Avg_Items, 0) - 1.0 AS Promo_Lift
FROM promo p LEFT JOIN (SELECT * FROM promo WHERE Promotion = 'None') b ON p.Product = b.Product""")

cte("promo_lift_prod", ("promo_lift",), """
SELECT Product, MAX(Promo_Lift) AS Max_Promo_Lift FROM promo_lift GROUP BY Product""")

cte("season", ("rx",), """
SELECT Product, Season, Season_Items,
       CAST(Season_Items AS DOUBLE) / NULLIF(CAST(SUM(Season_Items) OVER (PARTITION BY Product) AS DOUBLE), 0)
         AS Seasonality_Factor
FROM (SELECT Product, Season, CAST(SUM(Total_Items) AS BIGINT) AS Season_Items
      FROM rx GROUP BY Product, Season)""")

cte("city", ("rx",), """
SELECT City, CAST(SUM(Total_Items) AS BIGINT) AS City_Items,
       fsum(Total_Cost) / COUNT(Total_Cost) AS Avg_Spend,
       CAST(SUM(CAST(Discount_Applied AS INT)) AS DOUBLE) / COUNT(Discount_Applied) AS Discount_Rate,
       COUNT(*) AS Transaction_Count
FROM rx GROUP BY City""")

cte("city_stats", ("city",), """
SELECT MIN(City_Items) AS City_Items_min, MAX(City_Items) AS City_Items_max,
       MIN(Avg_Spend) AS Avg_Spend_min, MAX(Avg_Spend) AS Avg_Spend_max,
       MIN(Discount_Rate) AS Discount_Rate_min, MAX(Discount_Rate) AS Discount_Rate_max,
       MIN(Transaction_Count) AS Transaction_Count_min, MAX(Transaction_Count) AS Transaction_Count_max
FROM city""")


def _n1(c: str) -> str:
    return (f"CAST(c.{c} - s.{c}_min AS DOUBLE) / NULLIF(CAST(s.{c}_max - s.{c}_min AS DOUBLE), 0) "
            f"AS {c}_norm")


cte("city_norm", ("city_stats",), f"""
SELECT *, 0.25 * City_Items_norm + 0.25 * Avg_Spend_norm + 0.25 * Discount_Rate_norm
          + 0.25 * Transaction_Count_norm AS Regional_Activity_Score
FROM (SELECT c.*, {_n1('City_Items')}, {_n1('Avg_Spend')}, {_n1('Discount_Rate')},
             {_n1('Transaction_Count')}
      FROM city c, city_stats s)""")

cte("base", ("rx",), "SELECT DISTINCT DateOnly, Product, City, Season FROM rx")


def _gold(spend_keys: str) -> str:
    return f"""
SELECT b.DateOnly, b.Product, b.City, b.Season, dp.Daily_Items, dp.Items_7d, dp.Items_30d,
       dp.Demand_Momentum, ds.Spend_Momentum, d.Discount_Elasticity, pl.Max_Promo_Lift,
       s.Seasonality_Factor, cn.Regional_Activity_Score
FROM base b
LEFT JOIN daily_prod dp ON dp.DateOnly = b.DateOnly AND dp.Product = b.Product
LEFT JOIN daily_spend ds ON {spend_keys}
LEFT JOIN discount d ON d.Product = b.Product
LEFT JOIN promo_lift_prod pl ON pl.Product = b.Product
LEFT JOIN season s ON s.Product = b.Product AND s.Season = b.Season
LEFT JOIN city_norm cn ON cn.City = b.City"""


_GOLD_DEPS = ("base", "daily_prod", "daily_spend", "discount", "promo_lift_prod", "season", "city_norm")
cte("gold", _GOLD_DEPS, _gold("ds.DateOnly = b.DateOnly"))
cte("gold_fixed", _GOLD_DEPS, _gold("ds.DateOnly = b.DateOnly AND ds.City = b.City"))

SIGNALS = [("Demand_Momentum", "0.25"), ("Spend_Momentum", "0.25"), ("Discount_Elasticity", "0.15"),
           ("Max_Promo_Lift", "0.15"), ("Seasonality_Factor", "0.10"),
           ("Regional_Activity_Score", "0.10")]


def _scored(src: str) -> str:
    stats = ", ".join(f"MIN({c}) AS {c}_min, MAX({c}) AS {c}_max" for c, _ in SIGNALS)
    norms = ", ".join(
        f"CASE WHEN s.{c}_max IS NULL OR s.{c}_min IS NULL OR s.{c}_max = s.{c}_min THEN 0.5 "
        f"ELSE (g.{c} - s.{c}_min) / (s.{c}_max - s.{c}_min) END AS {c}_norm" for c, _ in SIGNALS)
    score = " + ".join(f"{w} * {c}_norm" for c, w in SIGNALS)
    return f"""
SELECT *, {score} AS Retail_Activity_Score
FROM (SELECT g.*, {norms} FROM {src} g, (SELECT {stats} FROM {src}) s)"""


cte("gold_scored", ("gold",), _scored("gold"))
cte("gold_fixed_scored", ("gold_fixed",), _scored("gold_fixed"))


# ---------------------------------------------------------------------------
# Posts
# ---------------------------------------------------------------------------

_WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\p{Z}"
_W = r"[\p{L}\p{N}_]"
# Word lists and lexicon of the reference semantics, as SQL.
_FEAR = ("['crash','fear','panic','worried','scared','scary','dump','tank','plunge','collapse',"
         "'bleeding','nervous']")
_KEYWORDS = ("['delivery','deliveries','estimate','estimates','earnings','guidance','margin','margins',"
             "'revenue','profit','profits','loss','losses','layoff','layoffs','acquisition','equity',"
             "'rsu','rsus','valuation','price','target','dividend','cashflow','debt']")
LEXICON_VALUES = ("('love', 3.0), ('great', 3.0), ('beat', 1.5), ('up', 0.5), ('profit', 1.9), "
                  "('cut', -1.1), ('scared', -1.9), ('crash', -2.0), ('panic', -2.5), "
                  "('debt', -1.5), ('selling', -0.5)")

cte("tweets", (), """
SELECT doc_id,
       CASE WHEN doc_id % 97 = 0 THEN NULL
            ELSE concat(text, CASE doc_id % 5
              WHEN 0 THEN ' $TSLA Crash and PANIC selling'
              WHEN 1 THEN ' @desk Earnings beat, margins up &amp; revenue up! http://t.example/x'
              WHEN 2 THEN ' great profit   www.x.example love it'
              WHEN 3 THEN ' scared of debt, price target cut'
              ELSE ' the caf&eacute; isn&#8217;t cheap: &#x20AC;5 &amp;lt;b&amp;gt; &eacutet&eacute; &unknown; &#0000000065;&#x0000000041;&#999999999; &notit;' END) END AS Tweet,
       source AS "Stock Name", concat('Company ', source) AS "Company Name"
FROM documents""")


def _clean_sql(col: str) -> str:
    t = col
    for a, b in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"),
                 ("&#x27;", "''"), ("&nbsp;", " "), ("&eacute;", "é"), ("&eacute", "é"),
                 ("&#8217;", "\u2019"), ("&#x20AC;", "€"), ("&#0000000065;", "A"),
                 ("&#x0000000041;", "A"), ("&#999999999;", "\ufffd"), ("&notit;", "¬it;"), ("&amp;", "&")]:
        t = f"replace({t}, '{a}', '{b}')"
    for a, b in [("â€œ", '"'), ("â€\u009d", '"'), ("â€™", "''")]:
        t = f"replace({t}, '{a}', '{b}')"
    t = f"regexp_replace({t}, 'http[^{_WS}]+|www\\.[^{_WS}]+', '', 'g')"
    t = f"regexp_replace({t}, '\\${_W}+', '', 'g')"
    t = f"regexp_replace({t}, '@{_W}+', '', 'g')"
    t = f"regexp_replace({t}, '[{_WS}]+', ' ', 'g')"
    return f"coalesce(lower(trim({t})), '')"


cte("tweet_words", ("tweets",), f"""
SELECT *,
  CASE WHEN len(tokens) > 0
       THEN CAST(len(list_filter(tokens, lambda t: list_contains({_FEAR}, t))) AS DOUBLE) / len(tokens)
       ELSE 0.0 END AS fear_score,
  len(list_filter(tokens, lambda t: list_contains({_KEYWORDS}, t))) AS finance_keyword_score
FROM (SELECT *, regexp_extract_all(lower(clean), '{_W}+') AS tokens
      FROM (SELECT *, {_clean_sql('Tweet')} AS clean FROM tweets))""")

cte("tweet_sent", ("tweet_words",), f"""
SELECT w.*, GREATEST(-1.0, LEAST(1.0, s.s / sqrt(s.s * s.s + 15.0))) AS sentiment
FROM tweet_words w JOIN (
  SELECT u.doc_id, coalesce(SUM(l.valence), 0.0) AS s
  FROM (SELECT doc_id, unnest(CASE WHEN len(tokens) = 0 THEN [NULL] ELSE tokens END) AS tok
        FROM tweet_words) u
  LEFT JOIN (VALUES {LEXICON_VALUES}) l(token, valence) ON l.token = u.tok
  GROUP BY u.doc_id) s ON s.doc_id = w.doc_id""")

cte("stock_vol", ("tweets",), """
SELECT "Stock Name" AS stock, COUNT(*) AS n_rows, COUNT(Tweet) AS volume
FROM tweets WHERE "Stock Name" IS NOT NULL GROUP BY 1""")

cte("vol_moments", ("tweets", "stock_vol"), """
SELECT AVG(v.volume) AS volume_mean, STDDEV_SAMP(v.volume) AS volume_std
FROM tweets t JOIN stock_vol v ON v.stock = t."Stock Name\"""")

cte("tweet_feat", ("tweet_sent", "stock_vol", "vol_moments"), """
SELECT t.*, v.volume, (v.volume - m.volume_mean) / NULLIF(m.volume_std, 0) AS volume_zscore
FROM tweet_sent t LEFT JOIN stock_vol v ON v.stock = t."Stock Name", vol_moments m""")


def _n3(src: str, dst: str) -> str:
    return (f"CASE WHEN {src} IS NULL THEN NULL WHEN s.{src}_mx = s.{src}_mn THEN 0.0 "
            f"ELSE (CAST({src} AS DOUBLE) - s.{src}_mn) / (s.{src}_mx - s.{src}_mn) END AS {dst}")


_N3 = [("sentiment", "sent_norm"), ("fear_score", "fear_norm"),
       ("finance_keyword_score", "keyword_norm"), ("volume_zscore", "volume_norm")]

cte("tweet_scored", ("tweet_feat",), f"""
SELECT *, 0.4 * sent_norm + 0.3 * fear_norm + 0.2 * keyword_norm + 0.1 * volume_norm AS tweet_alpha
FROM (SELECT f.*, {", ".join(_n3(a, b) for a, b in _N3)}
      FROM tweet_feat f, (SELECT {", ".join(f"CAST(MIN({a}) AS DOUBLE) AS {a}_mn, CAST(MAX({a}) AS DOUBLE) AS {a}_mx" for a, _ in _N3)}
                          FROM tweet_feat) s)""")


# ---------------------------------------------------------------------------
# Macro, context, screens
# ---------------------------------------------------------------------------

cte("macro_daily", (), """
SELECT CAST(ts AS DATE) AS date, CAST(COUNT(*) AS DOUBLE) AS spread_bps FROM events GROUP BY 1""")

cte("macro", ("macro_daily",), """
SELECT date, spread_bps, spread_3m_change,
       CASE WHEN pr < 0.33 THEN 'LOW' WHEN pr < 0.67 THEN 'MEDIUM' ELSE 'HIGH' END AS credit_risk_bucket
FROM (SELECT date, spread_bps, spread_bps - LAG(spread_bps, 3) OVER (ORDER BY date) AS spread_3m_change,
             PERCENT_RANK() OVER (ORDER BY spread_bps) AS pr FROM macro_daily)""")


def r2(expr: str, digits: int = 2) -> str:
    """Spark's ``round`` on a double: half-up on the shortest decimal form."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


cte("macro_one", ("macro",), """
SELECT * FROM macro ORDER BY date DESC, spread_bps, spread_3m_change, credit_risk_bucket LIMIT 1""")

cte("context", ("anomalies", "macro_one"), f"""
SELECT a.ticker, a.company_name, a.sector, a.industry, a.country, a.exchange, a.currency,
       {r2('a.market_cap', 0)} AS market_cap,
       {r2('a.value_score')} AS value_score, {r2('a.growth_score')} AS growth_score,
       {r2('a.quality_score')} AS quality_score, {r2('a.risk_score')} AS risk_score,
       {r2('a.overall_alpha_score')} AS overall_alpha_score, a.conviction AS conviction_rating,
       {r2('a.beta')} AS beta, {r2('a.volatility_30d')} AS volatility_30d,
       {r2('a.volatility_90d')} AS volatility_90d, {r2('a.volatility_52w')} AS volatility_52w,
       {r2('a.current_price')} AS current_price, {r2('a.free_cashflow')} AS free_cash_flow,
       {r2('a.free_cash_flow_margin')} AS free_cash_flow_margin, {r2('a.fcf_yield')} AS fcf_yield,
       {r2('a.debt_to_equity')} AS debt_to_equity, {r2('a.current_ratio')} AS current_ratio,
       {r2('a.cash_to_debt')} AS cash_to_debt,
       CAST(m.date AS VARCHAR) AS macro_date, {r2('m.spread_bps')} AS spread_bps,
       {r2('m.spread_3m_change')} AS spread_3m_change, m.credit_risk_bucket,
       {r2('a.red_flag_score')} AS red_flag_score, a.red_flag_severity, a.red_flag_count,
       array_to_string(list_transform(list_filter(a.red_flags, lambda f: f IS NOT NULL AND f <> ''),
                                      lambda f: trim(replace(f, '_', ' '))), '|') AS red_flags_text,
       CAST(0 AS BIGINT) AS n_peers
FROM anomalies a LEFT JOIN macro_one m ON TRUE""")


def fmt(expr: str, decimals: int = 2, mult: str | None = None) -> str:
    v = f"({expr}) * {mult}" if mult else expr
    return f"coalesce(printf('%.{decimals}f', {r2(v, decimals)}), 'N/A')"


cte("memo_prompts", ("anomalies",), f"""
SELECT *, concat_ws(chr(10),
  concat('Write a short investment memo on ', coalesce(ticker, 'N/A'), ' (', coalesce(company_name, 'N/A'), ').'),
  concat('Sector: ', coalesce(sector, 'N/A'), '; industry: ', coalesce(industry, 'N/A'),
         '; market cap (USD bn): ', {fmt('market_cap', 2, '(1.0 / 1e9)')}, '.'),
  concat('Alpha score ', {fmt('overall_alpha_score')}, ', rated ', coalesce(conviction, 'N/A'), '.'),
  concat('Value ', {fmt('value_score')}, ' (P/E ', {fmt('pe_ratio')}, ', P/B ', {fmt('pb_ratio')},
         '); growth ', {fmt('growth_score')}, ' (revenue ', {fmt('revenue_growth_yoy', 1, '100.0')},
         '%); quality ', {fmt('quality_score')}, ' (ROE ', {fmt('roe', 1, '100.0')}, '%); risk ',
         {fmt('risk_score')}, ' (D/E ', {fmt('debt_to_equity')}, ').'),
  concat('Red flags (', coalesce(CAST(red_flag_count AS VARCHAR), '0'), '): ',
         CASE WHEN red_flags IS NULL OR len(red_flags) = 0 THEN 'None'
              ELSE array_to_string(red_flags, ', ') END, '.'),
  'Cover the thesis, two strengths, two risks and a recommendation.') AS prompt
FROM anomalies""")

cte("memo_batch", ("memo_prompts",), """
SELECT ticker, company_name, sector, overall_alpha_score, conviction, value_score, growth_score,
       quality_score, risk_score, red_flag_count,
       CASE WHEN length(prompt) % 2 = 1 THEN 'Error generating memo: model unavailable'
            ELSE concat('memo[', CAST(length(prompt) AS VARCHAR), '] ', split_part(prompt, chr(10), 1)) END
         AS investment_memo
FROM memo_prompts ORDER BY overall_alpha_score DESC, ticker LIMIT 10""")


# ---------------------------------------------------------------------------
# Prices and portfolio
# ---------------------------------------------------------------------------

cte("prices_obs", (), """
SELECT CAST(date_trunc('month', l.l_shipdate) AS DATE) AS date, p.p_brand AS ticker,
       MAX(l.l_extendedprice / l.l_quantity) AS price
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1, 2""")

cte("prices_grid", ("prices_obs",), """
SELECT d.date, t.ticker, o.price
FROM (SELECT DISTINCT date FROM prices_obs) d CROSS JOIN (SELECT DISTINCT ticker FROM prices_obs) t
LEFT JOIN prices_obs o ON o.date = d.date AND o.ticker = t.ticker""")

cte("returns_all", ("prices_grid",), """
SELECT date, ticker, px / LAG(px) OVER (PARTITION BY ticker ORDER BY date) - 1.0 AS ret
FROM (SELECT *, LAST_VALUE(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM prices_grid)""")

cte("returns", ("returns_all",), """
SELECT * FROM returns_all WHERE date IN (
  SELECT date FROM returns_all GROUP BY date
  HAVING COUNT(ret) = (SELECT COUNT(DISTINCT ticker) FROM returns_all))""")

cte("weights", ("returns",), """
SELECT ticker, variance, inv_var / SUM(inv_var) OVER () AS weight
FROM (SELECT ticker, VAR_SAMP(ret) AS variance, 1.0 / NULLIF(VAR_SAMP(ret), 0) AS inv_var
      FROM returns GROUP BY ticker)""")

cte("port_daily", ("returns", "weights"), """
SELECT r.date, SUM(r.ret * w.weight) AS port_ret FROM returns r JOIN weights w ON w.ticker = r.ticker
GROUP BY r.date""")


# ---------------------------------------------------------------------------
# Corrected ("fixed") variants
# ---------------------------------------------------------------------------

def _ft(metric: str, pct: str) -> str:
    return f"(CASE WHEN {metric} IS NULL THEN 0.5 ELSE 1.0 - {pct} END)"


cte("scored_fixed", ("percentiles",), f"""
SELECT *, CASE WHEN overall_alpha_score >= 8.0 THEN 'Strong Buy' WHEN overall_alpha_score >= 7.0 THEN 'Buy'
               WHEN overall_alpha_score >= 5.0 THEN 'Hold' WHEN overall_alpha_score >= 3.0 THEN 'Sell'
               ELSE 'Strong Sell' END AS conviction
FROM (SELECT *, value_score * 0.25 + growth_score * 0.30 + quality_score * 0.30 + risk_score * 0.15
                AS overall_alpha_score
      FROM (SELECT *,
        {_ft('pe_ratio', 'pe_percentile')} * 2.0 + {_ft('pb_ratio', 'pb_percentile')} * 2.0
          + {_ft('ps_ratio', 'ps_percentile')} * 2.0 + {_ft('ev_to_ebitda', 'ev_ebitda_percentile')} * 2.0
          + {_ft('fcf_yield', 'fcf_yield_percentile')} * 2.0 AS value_score,
        {_ft('quarterly_revenue_growth', 'rev_growth_percentile')} * 3.33
          + {_ft('earnings_growth', 'earnings_growth_percentile')} * 3.33
          + {_ft('quarterly_earnings_growth', 'qtr_earnings_percentile')} * 3.34 AS growth_score,
        {_ft('roe', 'roe_percentile')} * 2.0 + {_ft('roa', 'roa_percentile')} * 2.0
          + {_ft('profit_margin', 'profit_margin_percentile')} * 2.0
          + {_ft('operating_margin', 'operating_margin_percentile')} * 2.0
          + {_ft('fcf_to_revenue', 'fcf_quality_percentile')} * 2.0 AS quality_score,
        {_ft('debt_to_equity', 'debt_eq_percentile')} * 2.0 + {_ft('current_ratio', 'current_ratio_percentile')} * 2.0
          + {_ft('beta', 'beta_percentile')} * 2.0 + {_ft('price_volatility', 'volatility_percentile')} * 2.0
          + {_ft('cash_to_debt', 'cash_debt_percentile')} * 2.0 AS risk_score
      FROM percentiles))""")

cte("daily_prod_calendar", ("rx",), """
SELECT *, CAST(Items_7d - Items_30d AS DOUBLE) / NULLIF(CAST(Items_30d AS DOUBLE), 0) AS Demand_Momentum
FROM (
  SELECT DateOnly, Product, Daily_Items,
         CAST(SUM(Daily_Items) OVER (PARTITION BY Product ORDER BY date_diff('day', DATE '1970-01-01', DateOnly)
              RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS Items_7d,
         CAST(SUM(Daily_Items) OVER (PARTITION BY Product ORDER BY date_diff('day', DATE '1970-01-01', DateOnly)
              RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS Items_30d
  FROM (SELECT DateOnly, Product, CAST(SUM(Total_Items) AS BIGINT) AS Daily_Items
        FROM rx GROUP BY DateOnly, Product))""")
