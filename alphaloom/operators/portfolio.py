"""Portfolio tools: returns, inverse-variance weights and portfolio statistics
(S3, W7, W8, A12, A13, R1, R2).

Prices are a long table ``(date, ticker, price)``; a missing observation is
a NULL price on a (date, ticker) row of the full grid, which is what a wide
price file (one column per ticker) unpivots into.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


# ---------------------------------------------------------------------------
# S3 wide price file -> long
# ---------------------------------------------------------------------------

def csv_cells(line: Column) -> Column:
    """The cells of one CSV line as an array; a line with quotes is read cell by cell, any other split at commas."""
    cell = r'(?:^|,)((?:"(?:[^"]|"")*"|[^,"])*)'
    quoted = F.transform(F.regexp_extract_all(line, F.lit(cell), 1), lambda c: F.when(
        F.startswith(c, F.lit('"')), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.instr(line, '"') > 0, quoted).otherwise(F.split(line, ","))


def prices_csv_long(spark: SparkSession, path: str, date_format: str | None = None) -> DataFrame:
    """S3: read a wide CSV (first column = date, one column per ticker)
    into ``(date, ticker, price)``; empty and missing cells become NULL prices.

    The file is read as lines, each is split once and exploded against the header, which is one
    array value of the plan: the plan is the same for 20 tickers and 20,000.  Every file
    of a folder starts with the same header line.  The header (one line) is read when this is called.
    A value that is no number raises, as a typed read would not let it pass either; cells hold no line breaks."""
    lines = spark.read.text(path)
    head = lines.head()
    if head is None:
        raise ValueError(f"{path} has no header line")
    header = spark.createDataFrame([(head[0].removeprefix("\ufeff"),)], "line string").select(
        F.transform(F.slice(csv_cells(F.col("line")), 2, 1 << 30), lambda c: F.trim(c)))
    cells = csv_cells(F.col("value"))
    rows = lines.where((F.col("value") != F.lit(head[0])) & (F.trim("value") != "")).select(cells.alias("cells"))
    day = F.trim(F.get("cells", F.lit(0)))
    long = rows.select(F.to_date(day, date_format).alias("date") if date_format else F.to_date(day).alias("date"), "cells",
                       F.posexplode(header.scalar()).alias("at", "ticker"))
    price = F.nullif(F.trim(F.get("cells", F.col("at") + 1)), F.lit("")).cast("double")
    return long.select("date", "ticker", price.alias("price"))


def wide_to_long(wide: DataFrame, date_col: str, date_format: str | None = None) -> DataFrame:
    tickers = [c for c in wide.columns if c != date_col]
    d = F.to_date(F.col(f"`{date_col}`"), date_format) if date_format else F.to_date(F.col(f"`{date_col}`"))
    return (wide.withColumn("_date", d)
            .unpivot(["_date"], [F.col(f"`{t}`") for t in tickers], "ticker", "price")
            .withColumnRenamed("_date", "date"))


# ---------------------------------------------------------------------------
# W7 returns
# ---------------------------------------------------------------------------

def daily_returns(prices: DataFrame, fill: str | None = "ffill") -> DataFrame:
    """Per-ticker percentage change, then only dates on which every
    ticker has a return.  ``fill="ffill"`` carries the last price over gaps
    (so a gap yields a 0 return, as the reference's pandas does); ``None``
    leaves gaps as missing returns.  A ticker's window partition holds one
    row per date, bounded by the calendar."""
    w = Window.partitionBy("ticker").orderBy("date")
    px = (F.last("price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
          if fill == "ffill" else F.col("price"))
    r = (prices.withColumn("_px", px)
         .withColumn("ret", F.try_divide(F.col("_px"), F.lag("_px").over(w)) - F.lit(1.0)))
    n_tickers = prices.agg(F.count_distinct("ticker").alias("n")).scalar()
    complete = (r.groupBy("date").agg(F.count("ret").alias("_k"))
                .where(F.col("_k") == n_tickers).select("date"))
    return r.join(complete, "date", "left_semi").select("date", "ticker", "ret")


# ---------------------------------------------------------------------------
# A12, R1, R2, A13, W8
# ---------------------------------------------------------------------------

def return_variance(returns: DataFrame) -> DataFrame:
    """Sample variance of each ticker's returns (the diagonal of
    ``return_covariance``, all that the weights need)."""
    return returns.groupBy("ticker").agg(F.var_samp("ret").alias("variance"))


def _block(column: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(column), blocks).cast("int")


PAIR_SUMS = "ticker_a string, ticker_b string, n bigint, sx double, sy double, sxy double"


def _pair_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over the common dates of every pair of a ticker of ``left`` and one of
    ``right``, as four matrix products of (dates x tickers) blocks with 0 where a return is missing."""
    days = np.unique(np.concatenate([left.column("day").to_numpy(), right.column("day").to_numpy()]))

    def matrix(part: pa.Table):
        tickers, at = np.unique(part.column("ticker").to_numpy().astype(str), return_inverse=True)
        x, seen = np.zeros((len(days), len(tickers))), np.zeros((len(days), len(tickers)))
        row = np.searchsorted(days, part.column("day").to_numpy())
        x[row, at], seen[row, at] = part.column("x").to_numpy(), 1.0
        return tickers, x, seen
    a, x, in_a = matrix(left)
    b, y, in_b = matrix(right)
    sums = {"n": in_a.T @ in_b, "sx": x.T @ in_b, "sy": in_a.T @ y, "sxy": x.T @ y}
    i, j = np.indices((len(a), len(b))).reshape(2, -1)
    keep = a[i] <= b[j] if left is right else np.ones(len(i), bool)
    first, second = a[i[keep]], b[j[keep]]
    return pa.table({"ticker_a": pa.array(first, pa.string()), "ticker_b": pa.array(second, pa.string()),
                     "n": pa.array(sums["n"].ravel()[keep].astype(np.int64)),
                     **{c: pa.array(sums[c].ravel()[keep]) for c in ("sx", "sy", "sxy")}})


def return_covariance(returns: DataFrame, block_tickers: int = 256, block_days: int = 1024) -> DataFrame:
    """A12, the whole matrix: (ticker_a, ticker_b, n, covariance), the sample covariance of every ordered
    pair of tickers over the dates on which both have a return (n of them; NULL below two).

    Gram sums by blocks: returns are dealt to blocks of about ``block_tickers`` tickers and of
    ``block_days`` days, each pair of ticker blocks meets once for each block of days, and a task turns the two blocks into
    matrix products.  A block is sent to as many pairs as there are ticker blocks, and no row
    pairs are made on the way: what is shuffled after that is one row of sums for each pair of tickers and
    block of days.  Returns are taken relative to their ticker's mean first, so that the sums don't cancel.  Rows
    that repeat a date and ticker, and rows without one, are an error of the input: of repeats one counts."""
    seen = returns.where("ticker IS NOT NULL AND date IS NOT NULL AND ret IS NOT NULL").select(
        F.col("ticker").cast("string").alias("ticker"), F.unix_date("date").alias("day"), F.col("ret").cast("double").alias("ret"))
    seen = seen.groupBy("ticker", "day").agg(F.max("ret").alias("ret"))
    means = seen.groupBy("ticker").agg(F.avg("ret").alias("mean"))
    tickers = means.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block_tickers)), F.lit(1)).cast("int").alias("b")).scalar()
    rows = seen.join(means, "ticker").select("ticker", "day", (F.col("ret") - F.col("mean")).alias("x"), tickers.alias("blocks"))
    rows = rows.select("ticker", "day", "x", "blocks", _block("ticker", F.col("blocks")).alias("own"),
                       F.floor(F.col("day") / F.lit(block_days)).cast("int").alias("days"))
    other = rows.select("ticker", "day", "x", "own", "days",
                        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = other.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})

    def products(group: pa.Table) -> pa.Table:
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        own = group.column("own").to_numpy()
        left = group if lo == hi else group.filter(pa.array(own == lo))
        right = left if lo == hi else group.filter(pa.array(own == hi))
        if not left.num_rows or not right.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in sums_schema}, schema=sums_schema)
        return _pair_sums(left, right)
    sums_schema = pa.schema([("ticker_a", pa.string()), ("ticker_b", pa.string()), ("n", pa.int64()),
                             ("sx", pa.float64()), ("sy", pa.float64()), ("sxy", pa.float64())])
    parts = met.groupBy("lo", "hi", "days").applyInArrow(products, PAIR_SUMS)
    swap = F.col("ticker_a") > F.col("ticker_b")
    total = parts.groupBy(F.least("ticker_a", "ticker_b").alias("a"), F.greatest("ticker_a", "ticker_b").alias("b")).agg(
        F.sum("n").alias("n"), F.sum(F.when(swap, F.col("sy")).otherwise(F.col("sx"))).alias("sx"),
        F.sum(F.when(swap, F.col("sx")).otherwise(F.col("sy"))).alias("sy"), F.sum("sxy").alias("sxy"))
    cov = F.try_divide(F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n")), F.nullif(F.col("n") - 1, F.lit(0)))
    both = F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    return total.where("n > 0").select(both.alias("pair"), "n", F.when(F.col("n") > 1, cov).alias("covariance")).select(
        F.col("pair.a").alias("ticker_a"), F.col("pair.b").alias("ticker_b"), "n", "covariance")


def inverse_variance_weights(returns: DataFrame) -> DataFrame:
    """w = (1/var) / sum(1/var); a zero or undefined variance gives NULL."""
    inv = return_variance(returns).withColumn(
        "inv_var", F.try_divide(F.lit(1.0), F.nullif(F.col("variance"), F.lit(0.0))))
    total = inv.agg(F.sum("inv_var").alias("t")).scalar()
    return inv.withColumn("weight", F.try_divide(F.col("inv_var"), total)).select("ticker", "variance", "weight")


def portfolio_daily(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """R2: sum of weight x return per date.  Weights hold one row per ticker;
    the planner broadcasts them from their runtime size."""
    return (returns.join(weights.select("ticker", "weight"), "ticker")
            .groupBy("date").agg(F.sum(F.col("ret") * F.col("weight")).alias("port_ret")))


def portfolio_stats(daily: DataFrame, days: int = TRADING_DAYS) -> DataFrame:
    """Mean and sample std of the daily portfolio return, annualised."""
    return daily.agg(F.avg("port_ret").alias("mean_daily"), F.stddev_samp("port_ret").alias("vol_daily")) \
        .withColumns({"ann_return": F.col("mean_daily") * F.lit(float(days)),
                      "ann_vol": F.col("vol_daily") * F.lit(math.sqrt(days))})


def cumulative_return(daily: DataFrame) -> DataFrame:
    """Running arithmetic sum of the daily portfolio return.  The input
    has one row per trading date, so the single ordered window holds the
    length of the history, not the volume of any table."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cum_return", F.sum("port_ret").over(w))
