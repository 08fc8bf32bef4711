"""The one-plan percent rank equals Spark's native percent_rank exactly."""

import math
import random
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from alphaloom.operators import fundamentals as fu
from alphaloom.operators import ranking as rk
from alphaloom.operators.ranking import RankSpec, grouped_percent_rank
from alphaloom.plans import stages as st

from .conftest import SF_CHECK


def native(df, group, specs):
    """Ranks by Spark's own window function."""
    cols = {}
    for s in specs:
        c = F.col(f"`{s.column}`")
        order = c.asc_nulls_last() if s.ascending else c.desc_nulls_last()
        cols[s.name] = F.percent_rank().over(Window.partitionBy(group).orderBy(order))
    return df.withColumns(cols)


def compare(df, group, specs):
    got, want = grouped_percent_rank(df, group, specs), native(df, group, specs)
    assert got.columns == want.columns
    assert Counter(map(str, got.collect())) == Counter(map(str, want.collect()))


def test_hand_made_edge_cases(spark):
    rows = [
        ("a", "g1", 1.0, None), ("b", "g1", 1.0, 5.0), ("c", "g1", 2.0, None),   # ties, NULLs
        ("d", "g1", None, 3.0), ("e", "g1", 4.0, 3.0), ("f", "g1", 0.0, 3.0),
        ("g", "g2", 7.0, None),                                                 # one-row group
        ("h", "g3", None, None), ("i", "g3", None, None),                       # all NULL
        ("j", None, 4.0, 1.0), ("k", None, 3.0, 1.0),                           # NULL group
        (None, "g1", 1.0, 2.0), (None, "g1", 1.0, 2.0),                         # NULL keys, repeated rows
        ("a", "g2", 1.0, 9.0), ("z", "g1", float("inf"), float("-inf")),        # a key in two groups
    ]
    df = spark.createDataFrame(rows, "id string, grp string, x double, y double")
    compare(df, "grp", [RankSpec("px", "x", True), RankSpec("py", "y", False)])


def test_negative_zero_ties_with_zero(spark):
    df = spark.createDataFrame([("g", -0.0), ("g", 0.0), ("g", 1.0), ("g", -1e-300)], "grp string, x double")
    got = sorted(r.p for r in grouped_percent_rank(df, "grp", [RankSpec("p", "x", True)]).collect())
    assert got == [0.0, 1 / 3, 1 / 3, 1.0]


def test_random_frame_many_ties(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(3000):
        grp = rnd.choice(["hot"] * 8 + ["a", "b", "c"])                      # one dominant group
        x = None if rnd.random() < 0.1 else float(rnd.randint(-20, 20))
        y = None if rnd.random() < 0.3 else rnd.random()
        rows.append((f"k{i % 700}", grp, x, y))
    df = spark.createDataFrame(rows, "id string, grp string, x double, y double")
    specs = [RankSpec("px", "x", True), RankSpec("py", "y", False), RankSpec("qx", "x", False)]
    compare(df, "grp", specs)


def test_every_kind_of_double_ranks_like_the_window(spark):
    rnd = random.Random(5)
    edge = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1e-300, -1e-300, 1.0, 1.0 + 2 ** -52, 1.0 - 2 ** -53, 2.0,
            2.0 - 2 ** -52, 1e308, -1.7976931348623157e308, 1.7976931348623157e308, float("inf"), float("-inf"), None,
            8.0, 8.0 - 2 ** -50, 0.1, 0.1 + 2 ** -56, 1e15 + 0.125, 1e15 + 0.25, -1e15 - 0.125]
    rows = [("edge", x) for x in edge] + [("bits", math.copysign(math.ldexp(rnd.random(), rnd.randint(-1074, 1023)), rnd.random() - 0.5))
                                          for _ in range(3000)]
    rows += [("powers", math.ldexp(1.0, e) * (1 + d * 2 ** -52)) for e in range(-60, 60) for d in (-1, 0, 1)]
    rows += [("near", 1.0 + i * 2 ** -52) for i in range(2000)] + [("near", -1.0 - i * 2 ** -50) for i in range(2000)]
    df = spark.createDataFrame(rows, "grp string, x double")
    compare(df, "grp", [RankSpec("px", "x", True), RankSpec("qx", "x", False)])


def test_a_narrow_range_spreads_over_the_windows(spark):
    """100,000 values between 1,000,000 and 1,000,900, and a few far away: no
    window of any level holds a large part of them, and the tasks of the last level are even."""
    values = spark.range(100_000).select(F.lit("one").alias("g"), F.lit(0).alias("metric"),
                                         (F.lit(1e6) + F.col("id") * F.lit(0.009)).alias("v"))
    far = spark.createDataFrame([("one", 0, x) for x in (-1e9, 0.0, 5.0, 1e30)], "g string, metric int, v double")
    digits = rk._digits(values.union(far).withColumn("c", F.lit(1))).cache()
    for level in (["d1"], ["d1", "d2"]):
        sizes = digits.select(*level).distinct().groupBy(*level[:-1]).count().agg(F.max("count")).first()[0]
        assert sizes <= 60_000, level
    last = digits.groupBy("d1", "d2").count().agg(F.max("count"), F.count("*")).first()
    assert last[0] <= 10 and last[1] >= 50_000
    tasks = digits.repartition(8, "g", "metric", "d1", "d2").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) <= 1.2 * 100_004 / 8


def test_fixture_all_eighteen_percentiles(spark):
    cleaned = st.cleaned(spark, SF_CHECK)
    keep = ["ticker", "sector", *dict.fromkeys(s.column for s in fu.ALL_RANKS)]
    compare(cleaned.select(*keep), "sector", fu.ALL_RANKS)


def test_percentiles_in_unit_interval(spark):
    df = fu.sector_percentiles(st.cleaned(spark, SF_CHECK))
    for r in df.select(*[s.name for s in fu.ALL_RANKS]).collect():
        for v in r:
            assert v is not None and 0.0 <= v <= 1.0 and not math.isnan(v)


def test_building_starts_no_job_and_needs_no_group_in_one_task(spark):
    cleaned = st.cleaned(spark, SF_CHECK)
    sc = spark.sparkContext
    sc.setJobGroup("rank-build", "")
    try:
        df = fu.sector_percentiles(cleaned)
    finally:
        sc.setJobGroup("", "")
    assert not sc.statusTracker().getJobIdsForGroup("rank-build")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "percent_rank" not in plan and "SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_exploded_rows_are_never_broadcast(spark):
    """How small the files are says nothing about the rows they are exploded to."""
    df = fu.factor_scores(st.cleaned(spark, SF_CHECK)).groupBy("conviction").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_the_histogram_is_shuffled_once(spark):
    """A NULL group and a NULL value among the keys: what reads the histogram twice reads one shuffle."""
    rows = [(i, [None, "a", "b"][i % 3], [None, -0.0, 0.0, i / 7][i % 4]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, grp string, x double").repartition(4)
    specs = [RankSpec("px", "x", True), RankSpec("qx", "x", False)]
    compare(df, "grp", specs)
    done = grouped_percent_rank(df, "grp", specs)
    done.collect()
    final = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("functions=[partial_count(1)]") == 1 and "ReusedExchange" in final
