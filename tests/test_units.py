"""Hand-made frames for the edge cases of every operator family."""

import math

import pytest
from pyspark.sql import functions as F

from alphaloom.functions import text as tx
from alphaloom.operators import altdata as ad
from alphaloom.operators import context as cx
from alphaloom.operators import flags as fl
from alphaloom.operators import fundamentals as fu
from alphaloom.operators import portfolio as pt
from alphaloom.operators import screen as sc
from alphaloom.operators import text as te
from alphaloom.operators.normalize import bounds_struct, minmax_half, minmax_plain, minmax_zero
from alphaloom.plans.q_app import stub_model
from alphaloom.plans import stages as st

from .conftest import SF_SMALL


# --- normalisation -----------------------------------------------------------

def _norm(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")
    b = F.col("b")
    df = df.withColumn("b", bounds_struct(df, ["x"]))
    return [r.n for r in df.select("id", fn(F.col("x"), b["x_min"], b["x_max"]).alias("n")).orderBy("id").collect()]


def test_minmax_three_degeneracies(spark):
    assert _norm(spark, [3.0, 3.0], minmax_plain) == [None, None]
    assert _norm(spark, [3.0, 3.0, None], minmax_half) == [0.5, 0.5, 0.5]
    assert _norm(spark, [None, None], minmax_half) == [0.5, 0.5]
    assert _norm(spark, [3.0, 3.0, None], minmax_zero) == [0.0, 0.0, None]
    assert _norm(spark, [1.0, 2.0, 3.0], minmax_plain) == [0.0, 0.5, 1.0]


# --- fundamentals --------------------------------------------------------------

def test_nan_becomes_null_and_does_not_flag(spark):
    raw = st.companies(spark, SF_SMALL).withColumn("pe_ratio", F.lit(float("nan")))
    out = fl.with_anomalies(fu.standardize(fu.clean_fundamentals(raw)))
    assert out.count() > 0
    assert out.where("array_contains(red_flags, 'extreme_high_pe') OR pe_ratio IS NOT NULL").count() == 0


def test_conviction_and_severity_thresholds(spark):
    df = spark.createDataFrame([(8.0,), (7.999,), (7.0,), (5.0,), (3.0,), (2.9,), (None,)],
                               "overall_alpha_score double")
    got = [r.c for r in df.select(fu.conviction_expr(F.col("overall_alpha_score")).alias("c")).collect()]
    assert got == ["Strong Buy", "Buy", "Buy", "Hold", "Sell", "Strong Sell", "Strong Sell"]
    cnt = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (5,), (9,)], "n int")
    sev = [r.s for r in cnt.select(fl.severity_expr(F.col("n")).alias("s")).collect()]
    assert sev == ["Low", "Medium", "Medium", "High", "High", "Critical", "Critical"]


def test_guarded_ratio_needs_positive_denominator(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, -5.0), (None, 5.0), (10.0, 5.0)], "n double, d double")
    got = [r.r for r in df.select(fu.guarded_ratio(F.col("n"), F.col("d"), 100).alias("r")).collect()]
    assert got == [None, None, None, 200.0]


def test_red_flags_null_inputs_raise_nothing(spark):
    cols = {c: "double" for _, _, c, _, _ in fl.RED_FLAG_RULES}
    schema = ", ".join(f"{c} {t}" for c, t in cols.items())
    df = spark.createDataFrame([tuple([None] * len(cols)), (3.0, -1.0, -1.0, 0.5, -1.0, 60.0, 2.0, -1.0, -0.1, 0.1)],
                               schema)
    rows = fl.with_anomalies(df).select("red_flag_count", "red_flags", "red_flag_severity").collect()
    assert rows[0].red_flag_count == 0 and rows[0].red_flags == [] and rows[0].red_flag_severity == "Low"
    assert rows[1].red_flag_count == 10 and rows[1].red_flags[0] == "extreme_debt"


def test_flag_text_forms(spark):
    df = spark.createDataFrame([(["extreme_debt", None, "", " low_cash_coverage"],), ([],), (None,)],
                               "f array<string>")
    pretty = [r.p for r in df.select(fl.prettify_flags(F.col("f")).alias("p")).collect()]
    assert pretty[0] == ["extreme debt", "low cash coverage"] and pretty[1] == []
    text = [r.t for r in df.select(fl.flags_text(F.col("f")).alias("t")).collect()]
    assert text[1] == "None detected" and text[2] == "None detected"
    parsed = spark.createDataFrame([("['extreme_debt', 'liquidity_risk']",), ("[]",)], "s string") \
        .select(fl.parse_flags_text(F.col("s")).alias("a")).collect()
    assert parsed[0].a == ["extreme_debt", "liquidity_risk"] and parsed[1].a == []
    fb = spark.createDataFrame([([], ["negative_roe"]), (["a_b"], ["x"])], "p array<string>, q array<string>") \
        .select(fl.flags_or_fallback(F.col("p"), F.col("q")).alias("r")).collect()
    assert fb[0].r == ["negative roe"] and fb[1].r == ["a b"]


def test_round_half_up_and_safe_text(spark):
    df = spark.createDataFrame([(2.675, None), (0.125, float("nan")), (-0.001, 1.23456)], "x double, y double")
    r = df.select(cx.round_or_none(F.col("x")).alias("r"),
                  cx.safe_value_text(F.col("y"), 1, 100.0).alias("t")).collect()
    assert [x.r for x in r] == [2.68, 0.13, 0.0]
    assert [x.t for x in r] == ["N/A", "N/A", "123.5"]


# --- retail ----------------------------------------------------------------------

def _silver(spark, rows):
    return spark.createDataFrame(rows, "Transaction_ID long, Date timestamp, Product array<string>, "
                                       "Total_Items int, Total_Cost double, City string, "
                                       "Discount_Applied boolean, Promotion string, Season string")


def test_retail_edge_cases(spark):
    import datetime as dt
    d = dt.datetime(2024, 1, 1)
    rows = [(1, d, ["A", "B"], 2, 10.0, "X", True, "BOGO", "Winter"),
            (2, d, ["A"], 4, 20.0, "Y", False, "None", "Winter"),
            (3, d, [], 9, 99.0, "X", False, "None", "Winter"),        # empty basket: dropped
            (4, d, None, 9, 99.0, "X", False, "None", "Winter"),      # NULL basket: dropped
            (5, d + dt.timedelta(days=1), ["B"], 6, 30.0, "X", False, "BOGO", "Winter")]
    s = ad.Signals(_silver(spark, rows), materialize=False)
    lift = {r.Product: r.Max_Promo_Lift for r in s.tables["Max_Promo_Lift"].collect()}
    assert lift["B"] is None                         # no "None" baseline for B
    assert lift["A"] == pytest.approx(0.0)           # baseline's own lift, BOGO 2 vs 4 -> -0.5
    city = {r.City: r for r in s.cities.collect()}
    assert city["X"].Transaction_Count == 3          # exploded rows: basket 1 counts twice
    assert s.gold(fixed=False).count() > s.gold().count() == s.base.count()


# --- posts -------------------------------------------------------------------------

def test_post_cleaning_edge_cases(spark):
    rows = [(1, ""), (2, None), (3, "&amp;"), (4, "http://x.y/z"), (5, "Hi @bob $TSLA  crash!! â€œq"),
            (6, "Ünïcode wörds_1 fear")]
    df = spark.createDataFrame(rows, "doc_id long, Tweet string")
    out = {r.doc_id: r for r in te.word_features(df).collect()}
    assert out[1].clean == "" and out[2].clean == "" and out[1].fear_score == 0.0
    assert out[2].finance_keyword_score == 0
    assert out[3].clean == "&" and out[4].clean == ""
    assert out[5].clean == 'hi crash!! "q' and out[5].fear_score == pytest.approx(1 / 3)
    assert out[6].tokens == ["ünïcode", "wörds_1", "fear"]


def test_character_references(spark):
    """One decoding pass over numeric, named and bare references."""
    pairs = [("caf&eacute; &#x41;", "café A"), ("isn&#8217;t", "isn\u2019t"), ("&amp;lt;", "&lt;"), ("&ltb&gt", "<b>"),
             ("&#8364 5", "\u20ac 5"), ("&#150;", "\u2013"), ("&#0;", "\ufffd"), ("&#xD800;", "\ufffd"), ("&#x110000;", "\ufffd"),
             ("a&#1;b", "ab"), ("&#128512;", "\U0001F600"), ("&unknown; & &; &#;", "&unknown; & &; &#;"),
             ("&CounterClockwiseContourIntegral;", "\u2233"), ("&nbsp;", "\xa0"), ("&amp;&amp;", "&&"), ("plain", "plain"), (None, None)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, t string")
    got = [r.c for r in df.select("i", tx.decode_entities(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [b for _, b in pairs]


def test_lexicon_sentiment_and_zscore(spark):
    rows = [(1, "great profit", "S1"), (2, "", "S1"), (3, None, "S1"), (4, "crash", None)]
    df = spark.createDataFrame(rows, "doc_id long, Tweet string, `Stock Name` string")
    lex = {"Great": 1.0, "great": 2.0, "profit": 1.9, "crash": -2.0}         # a word listed twice adds up
    feat = te.lexicon_sentiment(te.word_features(df), lex)
    s = {r.doc_id: r.sentiment for r in feat.collect()}
    assert s[1] == pytest.approx(4.9 / math.sqrt(4.9 ** 2 + 15))
    assert s[2] == 0.0 and s[3] == 0.0 and s[4] < 0
    twice = te.word_features(df.unionByName(df.withColumn("Tweet", F.lit("crash"))))
    both = sorted(r.sentiment for r in te.lexicon_sentiment(twice, lex).where("doc_id = 1").collect())
    assert both == pytest.approx([s[4], s[1]])                              # posts that share an id score apart
    nulls = spark.createDataFrame([(["great", None],), (None,)], "tokens array<string>")
    assert [r.sentiment > 0 for r in te.lexicon_sentiment(nulls, lex).collect()] == [True, False]
    assert te.lexicon_sentiment(nulls, {}).first().sentiment == 0.0
    z = {r.doc_id: r.volume_zscore for r in te.volume_zscore(df).collect()}
    assert z[1] is None and z[4] is None          # single stock: std 0; NULL stock: NULL


def test_memo_cleaning(spark):
    df = spark.createDataFrame([("**Bold** and *it* # head 😀 ok",)], "t string")
    assert df.select(tx.clean_memo(F.col("t")).alias("c")).first().c == "Bold and it  head  ok"


# --- portfolio -------------------------------------------------------------------

def test_returns_gaps_and_weights(spark):
    import datetime as dt
    d = [dt.date(2024, 1, i) for i in range(1, 6)]
    rows = [(d[0], "A", 10.0), (d[1], "A", 11.0), (d[2], "A", None), (d[3], "A", 12.1), (d[4], "A", 12.1),
            (d[0], "B", None), (d[1], "B", 5.0), (d[2], "B", 5.5), (d[3], "B", 5.0), (d[4], "B", 5.5),
            (d[0], "C", 1.0), (d[1], "C", 1.0), (d[2], "C", 1.0), (d[3], "C", 1.0), (d[4], "C", 1.0)]
    prices = spark.createDataFrame(rows, "date date, ticker string, price double")
    r = pt.daily_returns(prices)
    dates = sorted({x.date for x in r.collect()})
    assert dates == d[2:]                            # d0: first row, d1: B's leading gap
    a = {x.date: x.ret for x in r.where("ticker = 'A'").collect()}
    assert a[d[2]] == 0.0                            # forward-filled gap
    assert sorted({x.date for x in pt.daily_returns(prices, fill=None).collect()}) == d[4:]
    w = {x.ticker: x.weight for x in pt.inverse_variance_weights(r).collect()}
    assert w["C"] is None                            # zero variance
    assert w["A"] + w["B"] == pytest.approx(1.0)


# --- screens, lookups, memos ----------------------------------------------------

def test_screen_rule_matching(spark):
    assert [r.columns[0] for r in sc.rules_for("Undervalued US names")] == ["value_score", "country"]
    assert [r.columns[0] for r in sc.rules_for("tell us which are undervalued")] == ["value_score"]
    assert sc.rules_for("business services") == []
    for good in ["WITH a AS (SELECT 1 AS x) SELECT * FROM a;", "SELECT ';' AS s", "SELECT a, sum(b) FROM t GROUP BY a HAVING sum(b) > 1",
                 "SELECT * FROM t WHERE x IN (SELECT y FROM u) ORDER BY x LIMIT 3", "SELECT rank() OVER (ORDER BY x) FROM t",
                 "SELECT a FROM t UNION ALL SELECT b FROM u", "SELECT * FROM t JOIN u USING (k) WHERE t.a < :p"]:
        assert sc.validate_select(good, spark, ("t", "u"))
    for bad in ["DROP TABLE t", "SELECT 1; DROP TABLE t", "delete from t", "SELECT",
                "WITH a AS (SELECT 1 AS x) INSERT INTO t SELECT * FROM a", "FROM a INSERT INTO t SELECT *",
                "WITH a AS (SELECT 1 AS x) FROM a INSERT INTO t SELECT * INSERT INTO u SELECT *",
                "WITH a AS (SELECT 1 AS x) MERGE INTO t USING a ON t.x = a.x WHEN MATCHED THEN DELETE",
                "CREATE TABLE t AS SELECT 1", "WITH a AS (SELECT 1) DELETE FROM t", "EXPLAIN SELECT 1"]:
        with pytest.raises(ValueError):
            sc.validate_select(bad, spark, ("t", "u", "a"))


def test_lookup_binding(spark):
    spark.createDataFrame([("T1", "a"), ("T2", "b")], "ticker string, company_name string") \
        .createOrReplaceTempView("lookup_view")
    assert cx.lookup_one(spark, "lookup_view", "t1").first().company_name == "a"
    with pytest.raises(LookupError):
        cx.lookup_one(spark, "lookup_view", "x' OR '1'='1")


def test_memo_batch_captures_errors(spark):
    rows = [(f"T{i}", f"n{i}", "S", float(i), "Buy", 1.0, 2.0, 3.0, 4.0, 1, 1.0, 1.0, 0.1, 0.2, 1.0, ["x_y"])
            for i in range(6)]
    df = spark.createDataFrame(rows, "ticker string, company_name string, sector string, "
                                     "overall_alpha_score double, conviction string, value_score double, "
                                     "growth_score double, quality_score double, risk_score double, "
                                     "red_flag_count int, pe_ratio double, pb_ratio double, "
                                     "revenue_growth_yoy double, roe double, debt_to_equity double, "
                                     "red_flags array<string>")
    df = df.withColumn("industry", F.lit(None).cast("string")).withColumn("market_cap", F.lit(2e9))
    out = cx.memo_batch(df, stub_model, top_n=4).collect()
    assert len(out) == 4 and {r.ticker for r in out} == {"T5", "T4", "T3", "T2"}
    for r in out:
        assert r.investment_memo.startswith("memo[") or r.investment_memo.startswith(cx.ERROR_PREFIX)
    res = cx.batch_outcome(cx.memo_batch(df, stub_model, top_n=4)).first()
    assert res.successful + res.failed == res.total == 4


def test_scale_conf_sizes_partitions():
    from alphaloom.session import scale_conf
    small = scale_conf(1 << 30, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"          # two waves floor
    big = scale_conf(100 * 10 ** 12, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == -(-100 * 10 ** 12 // (256 << 20))
    assert big["spark.sql.adaptive.enabled"] == "true"


def test_lexicon_negation(spark):
    rows = [(1, "not great at all", "S"), (2, "great", "S"), (3, "no way this is great", "S"),
            (4, "never ever ever great", "S"), (5, "", "S")]
    df = te.word_features(spark.createDataFrame(rows, "doc_id long, Tweet string, `Stock Name` string"))
    got = {r.doc_id: r.sentiment for r in te.lexicon_sentiment(df, {"great": 3.0}, negation=True).collect()}
    plain = {r.doc_id: r.sentiment for r in te.lexicon_sentiment(df, {"great": 3.0}).collect()}
    neg = -0.74 * 3.0 / math.sqrt((0.74 * 3.0) ** 2 + 15)
    assert got[1] == pytest.approx(neg)
    assert plain[2] > 0 and got[2] == pytest.approx(plain[2])
    assert got[3] == pytest.approx(plain[3])          # "no" four tokens back: outside the window
    assert got[4] == pytest.approx(neg)               # "never" three tokens back: inside
    assert got[5] == 0.0


def test_costs_are_not_rounded_before_summing(spark):
    import datetime as dt
    d = dt.datetime(2024, 1, 1)
    rows = [(i, d, ["A"], 1, 0.005, "X", False, "None", "Winter") for i in range(3)]
    s = ad.spend_momentum(ad.daily_city_spend(ad.grain(_silver(spark, rows))))
    assert s.first().Daily_Spend == pytest.approx(0.015, abs=1e-12)


def test_company_lookup_keeps_repeated_requests_and_scans_once(spark):
    companies = spark.createDataFrame([("T1", "b"), ("T1", "a"), ("T2", "c")], "ticker string, company_name string")
    requests = spark.createDataFrame([("t1",), ("t1",), ("T2",), ("x",), (None,)], "request string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cx.company_lookup(companies, requests, few_requests=True)
        got = sorted(((r.request, r.company_name, r.found) for r in out.collect()), key=str)
        assert got == sorted([("t1", "a", True)] * 2 + [("T2", "c", True), ("x", None, False), (None, None, False)], key=str)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_screen_request_without_a_rule_raises(spark):
    df = spark.createDataFrame([("T1", "United States", 1.0)], "ticker string, country string, value_score double")
    with pytest.raises(ValueError):
        sc.screen_rules(df, "something nice")


def test_checkpoint_folder_must_be_shared_off_local_mode(spark, monkeypatch):
    from alphaloom import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}
    fake = type("S", (), {"sparkContext": Context()})()
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(fake)
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")
