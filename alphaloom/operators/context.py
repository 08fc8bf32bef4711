"""Company context, lookups, memo prompts and memo batches
(C11-C13, C17, J5, F6, F7, R4, M1, M2, A14).

The reference builds one Python dict per request from two point queries.
Here the context is a column set computed for *all* companies in one pass:
scalar fields rounded, a nested ``macro`` struct (the newest macro row,
attached as a scalar subquery -- one value for the whole table) and a nested
``red_flags`` struct.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import point_lookup
from .flags import flags_or_fallback, flags_text
from .macro import beta_band, latest_one, macro_trend


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def round_or_none(x: Column, digits: int = 2) -> Column:
    """Round half-up; NULL (or a failed cast) stays NULL."""
    return F.round(x.try_cast("double"), digits)


# Context field -> (source column, digits); None digits = no rounding.
CONTEXT_FIELDS = [
    ("ticker", "ticker", None), ("company_name", "company_name", None), ("sector", "sector", None),
    ("industry", "industry", None), ("country", "country", None), ("exchange", "exchange", None),
    ("currency", "currency", None), ("market_cap", "market_cap", 0),
    ("value_score", "value_score", 2), ("growth_score", "growth_score", 2),
    ("quality_score", "quality_score", 2), ("risk_score", "risk_score", 2),
    ("overall_alpha_score", "overall_alpha_score", 2), ("conviction_rating", "conviction", None),
    ("beta", "beta", 2), ("volatility_30d", "volatility_30d", 2), ("volatility_90d", "volatility_90d", 2),
    ("volatility_52w", "volatility_52w", 2), ("current_price", "current_price", 2),
    ("free_cash_flow", "free_cashflow", 2), ("free_cash_flow_margin", "free_cash_flow_margin", 2),
    ("fcf_yield", "fcf_yield", 2), ("debt_to_equity", "debt_to_equity", 2),
    ("current_ratio", "current_ratio", 2), ("cash_to_debt", "cash_to_debt", 2),
]
# Numeric defaults when a score column is absent.
ABSENT_DEFAULT = 0.0


def company_context(companies: DataFrame, macro: DataFrame | None) -> DataFrame:
    """One row per company with the context fields, a ``macro``
    struct and a ``red_flags`` struct.  Absent source columns take their
    default (0.0 for numbers, NULL for text); ``current_price`` falls back to
    ``open`` only when the column is absent."""
    cols = set(companies.columns)
    out = []
    for name, src, digits in CONTEXT_FIELDS:
        if src == "current_price" and src not in cols and "open" in cols:
            src = "open"
        if src in cols:
            v = _c(src)
            out.append((round_or_none(v, digits) if digits is not None else v).alias(name))
        else:
            out.append((F.lit(ABSENT_DEFAULT) if digits is not None else F.lit(None).cast("string"))
                       .alias(name))
    if macro is not None:
        m = latest_one(macro).select(F.struct(
            F.col("date").cast("string").alias("date"),
            round_or_none(F.col("spread_bps")).alias("spread_bps"),
            round_or_none(F.col("spread_3m_change")).alias("spread_3m_change"),
            F.col("credit_risk_bucket").alias("credit_risk_bucket")).alias("m"))
        out.append(m.scalar().alias("macro"))
    else:
        out.append(F.lit(None).cast("struct<date:string,spread_bps:double,spread_3m_change:double,"
                                    "credit_risk_bucket:string>").alias("macro"))
    primary = _c("red_flags") if "red_flags" in cols else F.lit(None).cast("array<string>")
    fallback = _c("red_flags_array") if "red_flags_array" in cols else F.lit(None).cast("array<string>")
    out.append(F.struct(
        round_or_none(_c("red_flag_score") if "red_flag_score" in cols else F.lit(0.0)).alias("red_flag_score"),
        (_c("red_flag_severity") if "red_flag_severity" in cols else F.lit(None).cast("string"))
        .alias("red_flag_severity"),
        (_c("red_flag_count").cast("int") if "red_flag_count" in cols else F.lit(0)).alias("red_flag_count"),
        flags_or_fallback(primary, fallback).alias("red_flags")).alias("red_flags"))
    out.append(F.array().cast("array<string>").alias("peers"))
    return companies.select(*out)


# ---------------------------------------------------------------------------
# C11 lookups
# ---------------------------------------------------------------------------

def indexed_lookup(table: DataFrame, requests: DataFrame, request_col: str = "request", most: int = 1000) -> DataFrame:
    """C11 on a stored table sorted by ticker (``sinks.save_lookup_table``): as ``company_lookup``, but a
    short list of requests becomes a filter of the scan, which skips the files and row groups without them."""
    wanted = requests.select(F.upper(F.col(request_col)).alias(request_col))
    return company_lookup(point_lookup(table, wanted, "ticker", request_col, most), requests, request_col, few_requests=False)


def company_lookup(companies: DataFrame, requests: DataFrame, request_col: str = "request",
                   few_requests: bool = False) -> DataFrame:
    """C11 in batch form: one row per request row (repeats included) with the
    matching company (``upper(request) = ticker``; the stored side is not
    upper-cased) and a ``found`` flag.  The distinct requests select the few
    matching companies, which then meet the request rows, so the company table is
    scanned and never shuffled when ``few_requests`` says that the list is
    short.  Of companies that share a ticker the first by name is taken."""
    r = requests.select(F.col(request_col).alias("request")).withColumn("_want", F.upper("request"))
    wanted = r.select("_want").distinct()
    if few_requests:
        wanted = F.broadcast(wanted)
    first = Window.partitionBy("_want").orderBy(*[_c(c).asc_nulls_last() for c in ("company_name",) if c in companies.columns]
                                                or [F.lit(0)])
    hits = companies.join(wanted, _c("ticker") == F.col("_want"))
    hits = hits.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return r.join(hits, "_want", "left").drop("_want").withColumn("found", _c("ticker").isNotNull())


def lookup_one(spark: SparkSession, view: str, ticker: str) -> DataFrame:
    """C11 for one ticker, with parameter binding (never string splicing).
    Raises ``LookupError`` when nothing matches."""
    name = view.replace("`", "``")
    rows = spark.sql(f"SELECT * FROM `{name}` WHERE ticker = upper(:t) ORDER BY ticker LIMIT 1", args={"t": ticker})
    found = rows.collect()                      # at most one row
    if not found:
        raise LookupError(f"No data found for ticker {ticker}")
    return spark.createDataFrame(found, rows.schema)


# ---------------------------------------------------------------------------
# C17, F6, F7, R4
# ---------------------------------------------------------------------------

def safe_value_text(x: Column, decimals: int = 2, multiply: float = 1.0) -> Column:
    """C17: number -> fixed decimals after scaling; NULL/NaN -> "N/A".
    The value is rounded half-up first, so the text never depends on the
    formatter's own tie rule."""
    v = x.try_cast("double")
    v = F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)
    scaled = v * F.lit(multiply) if multiply != 1.0 else v
    # format_string renders a NULL argument as (truncated) text, so test first.
    return F.when(scaled.isNull(), F.lit("N/A")).otherwise(
        F.format_string(f"%.{decimals}f", F.round(scaled, decimals)))


# Expected-return model (percent): base + sum w * (score - 5).
BASE_RETURN = 6.0
RETURN_WEIGHTS = [("value_score", 0.25), ("growth_score", 0.35), ("quality_score", 0.25),
                  ("risk_score", -0.30)]
SCORE_CENTER = 5.0


def factor_expected_return(ctx: DataFrame) -> Column:
    """F6 on context values (already rounded); NULL or 0 -> 0.0.
    Note the risk score is subtracted although the producer treats a higher
    risk score as safer (kept as in the reference)."""
    units = None
    for c, w in RETURN_WEIGHTS:
        x = F.coalesce(_c(c), F.lit(0.0)) - F.lit(SCORE_CENTER)
        term = F.lit(abs(w)) * x
        units = term if units is None else (units + term if w > 0 else units - term)
    return F.lit(BASE_RETURN) + units


def factor_radar(ctx: DataFrame) -> Column:
    """[value, growth, quality, 10 - risk, value] (closed loop), NULL -> 0."""
    v, g, q, r = [F.coalesce(_c(c), F.lit(0.0)) for c in
                  ("value_score", "growth_score", "quality_score", "risk_score")]
    return F.array(v, g, q, F.lit(10.0) - r, v)


# Scenario defaults (spot price, annual volatility in percent).
DEFAULT_SPOT = 100.0
DEFAULT_VOL = 30.0


def scenario_inputs(ctx: DataFrame) -> DataFrame:
    """Spot, volatility and expected return per company; a missing or
    zero spot/volatility takes the default."""
    return ctx.select(
        "ticker",
        F.coalesce(F.nullif(_c("current_price"), F.lit(0.0)), F.lit(DEFAULT_SPOT)).alias("spot"),
        F.coalesce(F.nullif(_c("volatility_52w"), F.lit(0.0)), F.lit(DEFAULT_VOL)).alias("vol_pct"),
        factor_expected_return(ctx).alias("exp_return_pct"))


# ---------------------------------------------------------------------------
# M1 prompts, M2 batches, A14 outcome
# ---------------------------------------------------------------------------

def memo_prompt(df: DataFrame) -> Column:
    """M1: one prompt text per company from its columns; missing -> "N/A"."""
    def txt(c):
        return F.coalesce(_c(c).cast("string"), F.lit("N/A"))

    def num(c, d=2, k=1.0):
        return safe_value_text(_c(c), d, k)

    flags = flags_text(_c("red_flags"), empty="None")
    lines = [
        F.concat(F.lit("Write a short investment memo on "), txt("ticker"), F.lit(" ("),
                 txt("company_name"), F.lit(").")),
        F.concat(F.lit("Sector: "), txt("sector"), F.lit("; industry: "), txt("industry"),
                 F.lit("; market cap (USD bn): "), num("market_cap", 2, 1 / 1e9), F.lit(".")),
        F.concat(F.lit("Alpha score "), num("overall_alpha_score"), F.lit(", rated "),
                 txt("conviction"), F.lit(".")),
        F.concat(F.lit("Value "), num("value_score"), F.lit(" (P/E "), num("pe_ratio"),
                 F.lit(", P/B "), num("pb_ratio"), F.lit("); growth "), num("growth_score"),
                 F.lit(" (revenue "), num("revenue_growth_yoy", 1, 100.0), F.lit("%); quality "),
                 num("quality_score"), F.lit(" (ROE "), num("roe", 1, 100.0), F.lit("%); risk "),
                 num("risk_score"), F.lit(" (D/E "), num("debt_to_equity"), F.lit(").")),
        F.concat(F.lit("Red flags ("), F.coalesce(_c("red_flag_count").cast("string"), F.lit("0")),
                 F.lit("): "), flags, F.lit(".")),
        F.lit("Cover the thesis, two strengths, two risks and a recommendation."),
    ]
    return F.concat_ws("\n", *lines)


# Context fields quoted in a scenario prompt, as (label, column).
SCENARIO_FIELDS = [("value score", "value_score"), ("growth score", "growth_score"),
                   ("quality score", "quality_score"), ("risk score", "risk_score"),
                   ("overall alpha", "overall_alpha_score"), ("beta", "beta"),
                   ("52-week volatility", "volatility_52w"), ("debt to equity", "debt_to_equity"),
                   ("FCF yield", "fcf_yield")]


def scenario_prompt(ctx: DataFrame, horizon: str = "the next 12-18 months") -> Column:
    """M1 (scenario form): one qualitative bull/base/bear request per company
    from its context row (flat fields plus the nested macro and flag structs)."""
    def txt(c):
        return F.coalesce(c.cast("string"), F.lit("N/A"))

    facts = F.concat_ws("; ", *[F.concat(F.lit(f"{label} "), safe_value_text(_c(c)))
                                for label, c in SCENARIO_FIELDS])
    flags = flags_text(F.col("red_flags.red_flags"), empty="None")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Describe bull, base and bear cases for "), txt(_c("ticker")), F.lit(" ("),
                 txt(_c("company_name")), F.lit(", "), txt(_c("sector")), F.lit(") over "),
                 F.lit(horizon), F.lit(", without numeric forecasts.")),
        F.concat(F.lit("Facts: "), facts, F.lit(".")),
        F.concat(F.lit("Credit: spread "), safe_value_text(F.col("macro.spread_bps")),
                 F.lit(" bps, bucket "), txt(F.col("macro.credit_risk_bucket")), F.lit(".")),
        F.concat(F.lit("Red flags: "), flags, F.lit(".")),
        F.lit("For each case give drivers, how the risk profile changes and who it suits."))


def app_memo_prompt(ctx: DataFrame, question: str) -> Column:
    """M1 (app form): a question about one company with its scores, risk
    figures with the beta band, credit regime with its trend, and flags."""
    def txt(c, missing="N/A"):
        return F.coalesce(c.cast("string"), F.lit(missing))

    def num(c):
        return safe_value_text(c if isinstance(c, Column) else _c(c))

    def line(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    m, red = F.col("macro"), F.col("red_flags")
    return F.concat_ws(
        "\n",
        line("Assess ", txt(_c("ticker")), " (", txt(_c("company_name")), ", ", txt(_c("sector")), ", ", txt(_c("country")),
             ") for this question: ", question),
        line("Scores: value ", num("value_score"), ", growth ", num("growth_score"), ", quality ", num("quality_score"),
             ", risk ", num("risk_score"), ", alpha ", num("overall_alpha_score"), "; rated ", txt(_c("conviction_rating")), "."),
        line("Risk: beta ", num("beta"), " (", txt(beta_band(_c("beta")), "unknown"), " sensitivity), volatility 30d ",
             num("volatility_30d"), ", 90d ", num("volatility_90d"), ", 52w ", num("volatility_52w"), "; D/E ",
             num("debt_to_equity"), ", current ratio ", num("current_ratio"), ", cash to debt ", num("cash_to_debt"),
             ", FCF yield ", num("fcf_yield"), ", FCF margin ", num("free_cash_flow_margin"), "."),
        line("Credit: spread ", num(m["spread_bps"]), " bps, three-month change ", num(m["spread_3m_change"]), " (",
             txt(macro_trend(m["spread_3m_change"]), "unknown"), "), bucket ", txt(m["credit_risk_bucket"]), "."),
        line("Red flags: score ", num(red["red_flag_score"]), ", severity ", txt(red["red_flag_severity"]), ", ",
             txt(red["red_flag_count"], "0"), " found: ", flags_text(red["red_flags"]), "."),
        F.lit("Use only these facts, name what is missing and give no numeric forecast."),
        F.lit("Answer with a summary, strengths, risks, the effect of wider credit spreads, and a verdict that fits the rating."))


MEMO_COLUMNS = ["ticker", "company_name", "sector", "overall_alpha_score", "conviction",
                "value_score", "growth_score", "quality_score", "risk_score", "red_flag_count"]
MEMO_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("company_name", T.StringType()),
    T.StructField("sector", T.StringType()), T.StructField("overall_alpha_score", T.DoubleType()),
    T.StructField("conviction", T.StringType()), T.StructField("value_score", T.DoubleType()),
    T.StructField("growth_score", T.DoubleType()), T.StructField("quality_score", T.DoubleType()),
    T.StructField("risk_score", T.DoubleType()), T.StructField("red_flag_count", T.IntegerType()),
    T.StructField("investment_memo", T.StringType()),
    T.StructField("generation_timestamp", T.TimestampType()),
])
ERROR_PREFIX = "Error generating memo: "


def memo_batch(companies: DataFrame, infer: Callable[[str], str], top_n: int = 10,
               parallelism: int | None = None) -> DataFrame:
    """M2: top-N companies by alpha -> prompt -> ``infer(prompt)`` per row.

    ``infer`` is any picklable callable (a model client); a failure is kept
    as the row's memo text with the error prefix instead of failing the job.
    The N rows are spread over ``parallelism`` tasks (default N) so the
    model calls run concurrently instead of in a driver loop."""
    top = (companies.orderBy(F.col("overall_alpha_score").desc(), F.col("ticker"))
           .limit(top_n)
           .select(*[_c(c) for c in MEMO_COLUMNS], memo_prompt(companies).alias("_prompt")))
    top = top.repartition(parallelism or top_n)

    def run(batches):
        for pdf in batches:
            memos = []
            for p in pdf["_prompt"]:
                try:
                    memos.append(str(infer(p)))
                except Exception as e:  # noqa: BLE001 - the error is the row's result
                    memos.append(f"{ERROR_PREFIX}{e}")
            out = pdf[MEMO_COLUMNS].copy()
            out["red_flag_count"] = out["red_flag_count"].astype("Int32")
            out["investment_memo"] = memos
            out["generation_timestamp"] = pd.Timestamp(_dt.datetime.now(_dt.timezone.utc)).tz_localize(None)
            yield out

    return top.mapInPandas(run, MEMO_SCHEMA)


def batch_outcome(memos: DataFrame) -> DataFrame:
    """Successes and failures of a memo batch."""
    failed = F.col("investment_memo").startswith("Error")
    return memos.agg(F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed"),
                     F.count(F.lit(1)).alias("total"))
