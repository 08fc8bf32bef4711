"""Domain tables derived from the given test tables.

The analytics in this library read company fundamentals, retail
transactions, short social posts, a price history and a credit-macro series.
The test folders hold TPC-H-like tables instead, so each loader below derives
one domain table from them with plain DataFrame operations (rules in
FIXTURES.md).  Every loader is lazy and scales with its inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import scan_table


def _read(spark: SparkSession, base: str, name: str, *cols: str) -> DataFrame:
    df = scan_table(spark, base, name)
    return df.select(*cols) if cols else df


# ---------------------------------------------------------------------------
# Company fundamentals
# ---------------------------------------------------------------------------

# Derivation rule per metric, (column, A, B, C, D, M) meaning
# NULL when p_partkey % M = 0, else CAST((p_partkey * A) % B - C AS DOUBLE) / D.
COMPANY_METRIC_RULES = [
    ("pe_ratio", 37, 900, 0, 10, 7),
    ("pb_ratio", 41, 120, 0, 10, 11),
    ("ps_ratio", 43, 150, 0, 10, 13),
    ("ev_to_ebitda", 47, 400, 0, 10, 17),
    ("roe", 53, 80, 20, 100, 19),
    ("roa", 59, 40, 10, 100, 23),
    ("profit_margin", 61, 70, 20, 100, 29),
    ("operating_margin", 67, 60, 15, 100, 31),
    ("gross_margin", 71, 90, 0, 100, 37),
    ("quarterly_revenue_growth", 73, 80, 30, 100, 41),
    ("earnings_growth", 79, 200, 80, 100, 43),
    ("quarterly_earnings_growth", 83, 220, 90, 100, 47),
    ("debt_to_equity", 89, 400, 0, 100, 53),
    ("current_ratio", 97, 350, 0, 100, 59),
    ("beta", 101, 250, 0, 100, 61),
    ("free_cashflow", 10007, 900000, 200000, 1, 67),
    ("total_debt", 10009, 500000, 0, 1, 71),
    ("total_cash", 10037, 400000, 0, 1, 73),
    ("market_cap", 7919, 9000000, -1000000, 1, 97),
    ("enterprise_value", 7907, 9500000, -500000, 1, 83),
    ("total_revenue", 7901, 3000000, 0, 1, 89),
    ("ev_to_revenue", 127, 90, 0, 10, 5),
    ("52week_low", 131, 500, -100, 1, 101),
]

# Columns of the fundamentals table, in order.
COMPANY_COLUMNS = [
    "ticker", "company_name", "sector", "industry", "country", "exchange", "currency",
    "market_cap", "current_price", "enterprise_value", "open",
    "pe_ratio", "pb_ratio", "ps_ratio", "ev_to_ebitda", "ev_to_revenue", "peg_ratio",
    "roe", "roa", "profit_margin", "operating_margin", "gross_margin", "roic",
    "quarterly_revenue_growth", "earnings_growth", "quarterly_earnings_growth",
    "total_debt", "total_cash", "total_revenue", "debt_to_equity", "current_ratio",
    "operating_cashflow", "free_cashflow", "fcf_per_share", "dividend_yield",
    "beta", "52week_high", "52week_low", "next_earnings_date",
]


def _metric(key: str, a: int, b: int, c: int, d: int, m: int) -> Column:
    return F.expr(f"CASE WHEN {key} % {m} <> 0 THEN CAST(({key} * {a}) % {b} - {c} AS DOUBLE) / {d} END")


def companies(spark: SparkSession, base: str) -> DataFrame:
    """One row per company with its fundamentals, derived from ``part``."""
    p = _read(spark, base, "part", "p_partkey", "p_name", "p_brand", "p_type",
              "p_size", "p_retailprice")
    k = F.col("p_partkey")
    cols = {
        "ticker": F.concat(F.lit("T"), k.cast("string")),
        "company_name": F.col("p_name"),
        "sector": F.when(k % 41 == 40, F.lit(None).cast("string")).otherwise(F.col("p_type")),
        "industry": F.col("p_brand"),
        "country": F.when(k % 3 == 0, F.lit("United States")).otherwise(F.lit("Other")),
        "exchange": F.lit("XNYS"),
        "currency": F.lit("USD"),
        "current_price": F.col("p_retailprice"),
        "open": F.col("p_retailprice"),
        "52week_high": F.when(k % 101 == 0, F.lit(None).cast("double")).otherwise(
            ((k * 131) % 500 + 100 + F.col("p_size")).cast("double")),
        "peg_ratio": F.lit(None).cast("double"),
        "roic": F.lit(None).cast("double"),
        "operating_cashflow": F.lit(None).cast("double"),
        "fcf_per_share": F.lit(None).cast("double"),
        "dividend_yield": F.lit(None).cast("double"),
        "next_earnings_date": F.lit(None).cast("date"),
    }
    for name, a, b, c, d, m in COMPANY_METRIC_RULES:
        cols[name] = _metric("p_partkey", a, b, c, d, m)
    return p.select(*[cols[c].alias(c) for c in COMPANY_COLUMNS])


# ---------------------------------------------------------------------------
# Retail transactions: one row per basket
# ---------------------------------------------------------------------------

# Promotion per order priority, season per month.
PROMOTION_BY_PRIORITY = {"1-URGENT": "BOGO (Buy One Get One)",
                         "2-HIGH": "Discount on Selected Items"}
NO_PROMOTION = "None"
SEASON_MONTHS = [("Winter", (12, 1, 2)), ("Spring", (3, 4, 5)), ("Summer", (6, 7, 8))]
OTHER_SEASON = "Fall"
DISCOUNT_THRESHOLD = 0.07


def retail_transactions(spark: SparkSession, base: str) -> DataFrame:
    """One row per order: basket of product brands, items, cost, city, flags.

    Plan shape: line items are joined to parts and pre-aggregated per order
    (map-side partial aggregation, basket size is bounded by the line count of
    one order) before meeting ``orders``; the aggregate is already hash
    partitioned on the order key, so only ``orders`` is shuffled for that
    join.  ``nation`` (25 rows by definition of the schema) is broadcast.
    """
    li = _read(spark, base, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_discount")
    pt = _read(spark, base, "part", "p_partkey", "p_brand")
    per_order = (li.join(pt, li.l_partkey == pt.p_partkey)
                 .groupBy("l_orderkey")
                 .agg(F.array_sort(F.collect_set("p_brand")).alias("Product"),
                      F.sum("l_quantity").cast("int").alias("Total_Items"),
                      (F.max("l_discount") > DISCOUNT_THRESHOLD).alias("Discount_Applied")))
    o = _read(spark, base, "orders", "o_orderkey", "o_custkey", "o_orderdate",
              "o_totalprice", "o_orderpriority")
    c = _read(spark, base, "customer", "c_custkey", "c_nationkey")
    n = _read(spark, base, "nation", "n_nationkey", "n_name")
    month = F.month("o_orderdate")
    season = F.lit(OTHER_SEASON)
    for name, months in reversed(SEASON_MONTHS):
        season = F.when(month.isin(*months), F.lit(name)).otherwise(season)
    promo = F.lit(NO_PROMOTION)
    for prio, label in reversed(list(PROMOTION_BY_PRIORITY.items())):
        promo = F.when(F.col("o_orderpriority") == prio, F.lit(label)).otherwise(promo)
    return (per_order.join(o, per_order.l_orderkey == o.o_orderkey)
            .join(c, o.o_custkey == c.c_custkey)
            .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
            .select(F.col("o_orderkey").alias("Transaction_ID"),
                    F.col("o_orderdate").alias("Date"),
                    "Product", "Total_Items",
                    F.col("o_totalprice").alias("Total_Cost"),
                    F.col("n_name").alias("City"),
                    "Discount_Applied",
                    promo.alias("Promotion"),
                    season.alias("Season")))


# ---------------------------------------------------------------------------
# Short posts about stocks
# ---------------------------------------------------------------------------

# Text appended to each post by doc_id % 5.
TWEET_SUFFIXES = [
    " $TSLA Crash and PANIC selling",
    " @desk Earnings beat, margins up &amp; revenue up! http://t.example/x",
    " great profit   www.x.example love it",
    " scared of debt, price target cut",
    " the caf&eacute; isn&#8217;t cheap: &#x20AC;5 &amp;lt;b&amp;gt; &eacutet&eacute; &unknown; &#0000000065;&#x0000000041;&#999999999; &notit;",
]


def tweets(spark: SparkSession, base: str) -> DataFrame:
    """One post per document: the whole document text plus a tagged suffix
    (every 97th post is NULL), the source as stock, a company name."""
    d = _read(spark, base, "documents", "doc_id", "text", "source")
    k = F.col("doc_id")
    suffix = F.lit("")
    for i, s in reversed(list(enumerate(TWEET_SUFFIXES))):
        suffix = F.when(k % 5 == i, F.lit(s)).otherwise(suffix)
    tweet = F.when(k % 97 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.col("text"), suffix))
    return d.select(k, tweet.alias("Tweet"), F.col("source").alias("Stock Name"),
                    F.concat(F.lit("Company "), F.col("source")).alias("Company Name"))


# ---------------------------------------------------------------------------
# Prices: one observation per (month, brand) and the wide matrix
# ---------------------------------------------------------------------------

def prices_observed(spark: SparkSession, base: str) -> DataFrame:
    """Long prices ``(date, ticker, price)``; only observed pairs."""
    li = _read(spark, base, "lineitem", "l_partkey", "l_shipdate", "l_extendedprice",
               "l_quantity")
    pt = _read(spark, base, "part", "p_partkey", "p_brand")
    return (li.join(pt, li.l_partkey == pt.p_partkey)
            .groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"),
                     F.col("p_brand").alias("ticker"))
            .agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("price")))


# The tickers of the wide price file (brands 1 to 25 by the
# schema of ``part``).
WIDE_TICKERS = [f"Brand#{i}" for i in range(1, 26)]


def prices_wide(spark: SparkSession, base: str) -> DataFrame:
    """Wide price matrix, one column per listed ticker (the CSV shape the
    portfolio tools read); a missing observation becomes a NULL cell."""
    return prices_observed(spark, base).groupBy("date").pivot("ticker", WIDE_TICKERS).agg(F.first("price"))


def prices_grid(spark: SparkSession, base: str) -> DataFrame:
    """Long prices on the full (date, ticker) grid.  The calendar is one array
    value (one entry per observed date), exploded for each ticker; there is no
    limit on tickers and no job while this is built."""
    seen = prices_observed(spark, base)
    calendar = seen.agg(F.sort_array(F.collect_set("date")).alias("d")).scalar()
    grid = seen.select("ticker").distinct().withColumn("date", F.explode(calendar))
    return grid.join(seen, ["date", "ticker"], "left").select("date", "ticker", "price")


# ---------------------------------------------------------------------------
# Credit macro series
# ---------------------------------------------------------------------------

# Fixture-only bucket thresholds on the percent rank of the spread.
MACRO_BUCKETS = [("LOW", 0.33), ("MEDIUM", 0.67)]
MACRO_TOP_BUCKET = "HIGH"
MACRO_CHANGE_LAG = 3


def macro(spark: SparkSession, base: str) -> DataFrame:
    """Daily series ``(date, spread_bps, spread_3m_change, credit_risk_bucket)``.

    The windows are unpartitioned on purpose: the input is first reduced to
    one row per calendar day, so the single window task holds at most one row
    per day of history whatever the size of ``events``.
    """
    ev = _read(spark, base, "events", "ts")
    daily = ev.groupBy(F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("spread_bps"))
    by_date = Window.orderBy("date")
    by_spread = Window.orderBy("spread_bps")
    pr = F.percent_rank().over(by_spread)
    bucket = F.lit(MACRO_TOP_BUCKET)
    for name, upper in reversed(MACRO_BUCKETS):
        bucket = F.when(F.col("_pr") < upper, F.lit(name)).otherwise(bucket)
    return (daily
            .withColumn("spread_3m_change",
                        F.col("spread_bps") - F.lag("spread_bps", MACRO_CHANGE_LAG).over(by_date))
            .withColumn("_pr", pr)
            .select("date", "spread_bps", "spread_3m_change", bucket.alias("credit_risk_bucket")))


# ---------------------------------------------------------------------------
# Small lookup tables (own values, see FIXTURES.md part C)
# ---------------------------------------------------------------------------

# Sentiment lexicon (token, valence).
LEXICON = [("love", 3.0), ("great", 3.0), ("beat", 1.5), ("up", 0.5), ("profit", 1.9),
           ("cut", -1.1), ("scared", -1.9), ("crash", -2.0), ("panic", -2.5),
           ("debt", -1.5), ("selling", -0.5)]

# Requested tickers for the batch lookup (lower-case hit, hit, miss).
REQUESTED_TICKERS = ["t1", "T2", "t999999"]


def requested_tickers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in REQUESTED_TICKERS], "request string")
