"""Blocked and spread work: covariance blocks, very wide price files, the salted join."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import altdata as ad
from alphaloom.operators import portfolio as pt
from alphaloom.operators.joins import salted_left_join
from alphaloom.sources import fixtures as fx

from .conftest import SF_SMALL

DAY = dt.date(2020, 1, 1)


def returns(spark, n_days, n_tickers, missing=0.0, seed=1, offset=0.0):
    rng = random.Random(seed)
    rows = [(DAY + dt.timedelta(d), f"T{t}", None if rng.random() < missing else offset + rng.gauss(0, 1 + t))
            for d in range(n_days) for t in range(n_tickers)]
    return rows, spark.createDataFrame(rows, "date date, ticker string, ret double").repartition(4)


def plain_covariance(rows):
    by = {}
    for d, t, r in rows:
        if r is not None:
            by.setdefault(t, {})[d] = r
    out = {}
    for a in by:
        for b in by:
            common = sorted(by[a].keys() & by[b].keys())
            if common:
                x, y = np.array([by[a][d] for d in common]), np.array([by[b][d] for d in common])
                cov = float(((x - x.mean()) * (y - y.mean())).sum() / (len(common) - 1)) if len(common) > 1 else None
                out[a, b] = (len(common), cov)
    return out


@pytest.mark.parametrize("missing, offset, tickers, days", [(0.0, 0.0, 256, 1024), (0.4, 0.0, 3, 10), (0.95, 0.0, 4, 7), (0.1, 1e6, 2, 16)])
def test_covariance_blocks_equal_the_plain_matrix(spark, missing, offset, tickers, days):
    rows, df = returns(spark, 40, 11, missing, offset=offset)
    want = plain_covariance(rows)
    got = {(r.ticker_a, r.ticker_b): (r.n, r.covariance) for r in pt.return_covariance(df, tickers, days).collect()}
    assert got.keys() == want.keys()
    for pair, (n, cov) in want.items():
        assert got[pair][0] == n
        assert got[pair][1] == pytest.approx(cov, rel=1e-9, abs=1e-9) if cov is not None else got[pair][1] is None
    assert all(got[a, b] == got[b, a] for a, b in got)


def test_covariance_edges(spark):
    empty = spark.createDataFrame([], "date date, ticker string, ret double")
    assert pt.return_covariance(empty).collect() == []
    odd = spark.createDataFrame([(DAY, "A", 1.0), (DAY, None, 2.0), (None, "B", 3.0), (DAY, "C", None), (DAY, "A", 1.0)],
                                "date date, ticker string, ret double")
    assert [tuple(r) for r in pt.return_covariance(odd).collect()] == [("A", "A", 1, None)]


def test_variance_is_the_diagonal(spark):
    _, df = returns(spark, 25, 6)
    diagonal = {r.ticker_a: r.covariance for r in pt.return_covariance(df, 2).where("ticker_a = ticker_b").collect()}
    assert diagonal == pytest.approx({r.ticker: r.variance for r in pt.return_variance(df).collect()})


def test_twenty_thousand_tickers_parse_with_the_same_plan(spark, tmp_path):
    names = [f"N{i}" for i in range(20_000)]
    lines = ["Date," + ",".join(names)]
    for d in range(3):
        lines.append(f"2024-01-0{d + 1}," + ",".join("" if (i + d) % 7 == 0 else str(i + d / 4) for i in range(20_000)))
    (tmp_path / "wide.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "narrow.csv").write_text("Date,A,B\n2024-01-01,1,2\n")
    wide = pt.prices_csv_long(spark, str(tmp_path / "wide.csv"))
    got = wide.agg(F.count("*"), F.count("price"), F.sum("price"), F.count_distinct("ticker")).first()
    filled = [i + d / 4 for d in range(3) for i in range(20_000) if (i + d) % 7]
    assert tuple(got) == (60_000, len(filled), pytest.approx(sum(filled)), 20_000)
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(wide) == size(pt.prices_csv_long(spark, str(tmp_path / "narrow.csv")))


def test_price_file_cells(spark, tmp_path):
    folder = tmp_path / "prices"
    folder.mkdir()
    head = '"Date",A,"B,x","say ""hi"""\n'
    (folder / "a.csv").write_text(head + '2024-01-02,1.5,,3\n"2024-01-03",2,"4.25"\n\n')
    (folder / "b.csv").write_text(head + "2024-01-04, 7 ,8,9,10\n")
    got = sorted((str(r.date), r.ticker, r.price) for r in pt.prices_csv_long(spark, str(folder)).collect())
    names = ["A", "B,x", 'say "hi"']
    want = {"2024-01-02": [1.5, None, 3.0], "2024-01-03": [2.0, 4.25, None], "2024-01-04": [7.0, 8.0, 9.0]}
    assert got == sorted((d, n, p) for d, prices in want.items() for n, p in zip(names, prices))
    us = tmp_path / "us.csv"
    us.write_text("Date,A\n01/31/2024,5\n")
    assert pt.prices_csv_long(spark, str(us), "MM/dd/yyyy").first().date == dt.date(2024, 1, 31)
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        pt.prices_csv_long(spark, str(tmp_path / "empty.csv"))


def unaided(spark):
    """Neither broadcasts nor adaptive splitting: what the plan itself spreads."""
    for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}.items():
        spark.conf.set(k, v)


@pytest.fixture
def no_help(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    unaided(spark)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_salted_join_spreads_a_hot_key(spark, no_help):
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
    right = spark.range(40).select(F.when(F.col("id") < 20, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("r"))
    out = salted_left_join(left, right, ["k"], ["k", "row"], salts=64)
    assert out.exceptAll(left.join(right, "k", "left")).isEmpty() and out.count() == left.join(right, "k", "left").count()
    load = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    plain = sorted(r["count"] for r in left.join(right, "k", "left").groupBy(F.spark_partition_id()).count().collect())
    assert load[-1] < 0.3 * sum(load) < 0.8 * sum(plain) < plain[-1]


def test_gold_spreads_a_hot_date(spark, no_help):
    """One date with a third of the rows: the fan-out's tasks stay even."""
    silver = fx.retail_transactions(spark, SF_SMALL)
    hot = silver.withColumn("Date", F.when(F.col("Transaction_ID") % 3 == 0, F.lit("1995-01-01").cast("date")).otherwise(F.col("Date")))
    signals = ad.Signals(hot)
    gold = signals.gold(fixed=False)
    load = sorted(r["count"] for r in gold.groupBy(F.spark_partition_id()).count().collect())
    on_hot = gold.where("DateOnly = DATE'1995-01-01'")
    share = on_hot.count() / sum(load)
    parts = on_hot.groupBy(F.spark_partition_id()).count().collect()
    assert share > 0.3 and len(parts) == 8 and max(r["count"] for r in parts) < 0.25 * on_hot.count()
    spend = signals.tables["Spend_Momentum"].groupBy("DateOnly").count()
    assert sum(load) == signals.base.join(spend, "DateOnly").agg(F.sum("count")).first()[0]
