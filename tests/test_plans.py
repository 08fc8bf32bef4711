"""Physical-plan checks: pushdown, top-k, group limit, no Python in the hot
path, no single-partition windows over unaggregated data, one scan."""

from alphaloom.plans import stages as st
from alphaloom.operators import fundamentals as fu
from alphaloom.operators import text as te
from alphaloom.plans.catalog import all_queries
from alphaloom.sources import fixtures as fx
from alphaloom.sources.tables import scan_format, table_path

import __spark_entry__ as E

from .conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushdown_and_pruning(spark):
    o = scan_format(spark, table_path(SF_SMALL, "orders"), "parquet")
    p = plan(o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice"))
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in p
    schema = p.split("ReadSchema: struct<", 1)[1].split(">", 1)[0]
    assert {f.split(":")[0] for f in schema.split(",")} == {"o_orderkey", "o_totalprice", "o_orderpriority"}


def test_core_filter_reaches_scan(spark):
    p = plan(fu.core_not_null(st.companies(spark, SF_SMALL)).select("ticker"))
    assert "Scan parquet" in p and "PushedFilters" in p


def test_topk_is_take_ordered(spark):
    p = plan(E.queries()["topk_alpha"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p


def test_top_per_sector_uses_group_limit(spark):
    df = fu.top_per_sector(st.scored(spark, SF_SMALL))
    df.collect()
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()


def test_text_features_stay_in_jvm_and_are_not_written(spark):
    feat = te.tweet_features(fx.tweets(spark, SF_SMALL), dict(fx.LEXICON))
    p = plan(te.tweet_alpha(feat, write=False))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "documents.parquet" in p                     # lazily from the posts, no written copy


def test_post_alpha_cleans_each_post_once(spark):
    """The one job that reads the posts cleans them; what follows reads the written features."""
    cleaned = spark.sparkContext.accumulator(0)
    feat = te.tweet_features(fx.tweets(spark, SF_SMALL), dict(fx.LEXICON))

    def counted(batches):
        for b in batches:
            cleaned.add(b.num_rows)
            yield b
    counted_posts = feat.mapInArrow(counted, feat.schema)       # stands where the features are computed
    out = te.tweet_alpha(counted_posts)
    rows = out.collect()
    assert cleaned.value == len(rows) == feat.count()
    assert "regexp_replace" not in plan(out)
    assert out.inputFiles() and all("/post-features-" in f for f in out.inputFiles())
    lazy = {r.doc_id: r for r in te.tweet_alpha(feat, write=False).collect()}
    for r in rows:
        assert r.clean == lazy[r.doc_id].clean
        assert (r.tweet_alpha is None) == (lazy[r.doc_id].tweet_alpha is None)
        assert r.tweet_alpha is None or abs(r.tweet_alpha - lazy[r.doc_id].tweet_alpha) < 1e-12


def test_post_alpha_of_an_empty_table(spark):
    feat = te.tweet_features(fx.tweets(spark, SF_SMALL).limit(0), dict(fx.LEXICON))
    assert te.tweet_alpha(feat).collect() == [] and te.tweet_alpha(feat, write=False).collect() == []


def test_price_chain_builds_without_a_job(spark):
    sc = spark.sparkContext
    sc.setJobGroup("prices-build", "")
    try:
        for name in ("daily_returns", "return_variance", "inverse_variance_weights", "portfolio_stats", "cumulative_return"):
            all_queries()[name].build(spark, SF_SMALL)
        schema_jobs = len(sc.statusTracker().getJobIdsForGroup("prices-build"))
    finally:
        sc.setJobGroup("", "")
    sc.setJobGroup("prices-schemas", "")
    try:
        for _ in range(5):
            for t in ("lineitem", "part"):
                spark.read.parquet(table_path(SF_SMALL, t))
        assert schema_jobs <= len(sc.statusTracker().getJobIdsForGroup("prices-schemas"))     # only schemas are read
    finally:
        sc.setJobGroup("", "")


def test_gold_reads_the_checkpoint_not_the_transactions(spark):
    p = plan(E.queries()["retail_activity_score"](spark, SF_SMALL))
    assert "lineitem" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_context_has_no_cross_join(spark):
    p = plan(E.queries()["company_context"](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_no_query_uses_cross_joins_or_python_rows(spark):
    """Across every registered query: no Cartesian product or nested-loop
    join, and Python only where the operator is a Python step by design."""
    python_ok = {"memo_batch", "memo_batch_resumed", "batch_outcome", "return_covariance"}
    for name, q in all_queries().items():
        p = plan(q.spark(spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
        if name not in python_ok:
            assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "MapInPandas" not in p, name


def test_completeness_is_one_pass(spark):
    """29 profiled columns in one aggregate: a constant number of jobs (AQE
    runs the shuffle stage as its own job), not one job per column."""
    from alphaloom.operators import profile as pf
    sc = spark.sparkContext
    df = pf.completeness(st.companies(spark, SF_SMALL), pf.CRITICAL_COLUMNS)
    sc.setJobGroup("completeness-one-pass", "count jobs")
    try:
        rows = df.collect()
    finally:
        sc.setJobGroup("", "")
    jobs = sc.statusTracker().getJobIdsForGroup("completeness-one-pass")
    assert len(rows) == 29
    assert 1 <= len(jobs) <= 3, jobs
