"""Stored tables: overwrites that fail, point lookups, counts from footers, files that split."""

import os

import pytest
from pyspark.sql import functions as F

from alphaloom.operators import context as cx
from alphaloom.operators import profile as pf
from alphaloom.session import fresh_path
from alphaloom.sources import sinks
from alphaloom.sources.tables import point_lookup, scan_footers, table_path

from .conftest import SF_SMALL


def local(path):
    return path.removeprefix("file:")


def failing(df):
    """The same columns, but a task fails after some rows are written."""
    return df.withColumn("id", F.when(F.col("id") == 999, F.raise_error(F.lit("broken row")).cast("bigint")).otherwise(F.col("id")))


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("table", [None, "safe_overwrite_test"])
def test_a_failing_overwrite_leaves_the_old_rows(spark, table):
    path = fresh_path(spark, "safe_overwrite")
    read = (lambda: spark.table(table)) if table else (lambda: spark.read.parquet(path))
    sinks.save_table(spark.range(5), path, table=table)
    before = read()
    with pytest.raises(Exception, match="broken row"):
        sinks.save_table(failing(spark.range(1000)), path, table=table)
    assert ids(read()) == [0, 1, 2, 3, 4] == ids(before)
    folder = local(path) if table else os.path.dirname(local(path))
    left = [n for n in os.listdir(folder) if n.startswith(("v-", os.path.basename(path)))]
    assert len(left) == 1                                                   # nothing of the failed write stays
    sinks.save_table(read().where("id > 2"), path, table=table)             # an overwrite may read what it replaces
    assert ids(read()) == [3, 4]


def test_catalog_overwrites_switch_versions(spark):
    path, name = fresh_path(spark, "versions"), "versions_test"
    sinks.save_table(spark.range(3), path, table=name)
    first = spark.table(name)
    sinks.save_table(spark.range(4), path, table=name)
    assert ids(first) in ([0, 1, 2], [0, 1, 2, 3]) and ids(spark.table(name)) == [0, 1, 2, 3]
    sinks.save_table(spark.range(2).withColumn("x", F.lit("a")), path, table=name)      # another schema
    assert spark.table(name).columns == ["id", "x"] and ids(spark.table(name)) == [0, 1]
    sinks.save_table(spark.range(6).withColumn("p", F.col("id") % 2), path, table=name, partition_by=["p"])
    assert ids(spark.table(name).where("p = 1")) == [1, 3, 5]
    sinks.save_table(spark.range(2), path, fmt="json", table=name)
    assert ids(spark.table(name)) == [0, 1]
    assert len([n for n in os.listdir(local(path)) if n.startswith("v-")]) <= 2
    sinks.save_table(spark.range(10, 12), path, fmt="json", mode="append", table=name)
    assert ids(spark.table(name)) == [0, 1, 10, 11]


def test_path_overwrite_and_append(spark):
    path = fresh_path(spark, "paths") + "/"
    sinks.save_table(spark.range(3), path)
    sinks.save_table(spark.range(1), path)
    sinks.save_table(spark.range(7, 8), path, mode="append")
    assert ids(spark.read.parquet(path)) == [0, 7]


def scan_rows(df):
    """Rows that the scans of an executed plan gave out, and the files they opened."""
    df.collect()
    rows = files = 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if name == "FileSourceScanExec":
            rows += p.metrics().apply("numOutputRows").value()
            files += p.metrics().apply("numFiles").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return rows, files


@pytest.fixture(scope="module")
def lookup_path(spark):
    path = fresh_path(spark, "lookup")
    df = spark.range(200_000).select(F.concat(F.lit("T"), F.col("id") * 2).alias("ticker"), F.concat(F.lit("name "), "id").alias("company_name"),
                                     F.sha2(F.col("id").cast("string"), 512).alias("more"))
    sinks.save_lookup_table(df, path, "ticker", files=4, distinct_keys=50_000, row_group_bytes=1 << 20)
    return path


def test_point_lookup_skips_row_groups(spark, lookup_path):
    table = spark.read.parquet(lookup_path)
    want = spark.createDataFrame([("T10",), ("T399998",), ("T10",), (None,)], "request string")
    found = point_lookup(table, want, "ticker")
    assert sorted(r.ticker for r in found.collect()) == ["T10", "T399998"]
    rows, _ = scan_rows(found)
    assert rows < 0.2 * 200_000                         # two row groups of many
    absent = spark.createDataFrame([(f"T{i}",) for i in range(100_001, 100_041, 2)], "request string")
    rows, _ = scan_rows(point_lookup(table, absent, "ticker"))
    assert rows < 0.05 * 200_000                        # inside the range of a file, ruled out by bloom filters
    assert scan_rows(table)[0] == 200_000


def test_lookup_gives_the_same_by_filter_and_by_join(spark, lookup_path):
    table = spark.read.parquet(lookup_path)
    requests = spark.createDataFrame([("t10",), ("T12",), ("T12",), ("t7",), (None,), ("",)], "request string")
    by_filter = cx.indexed_lookup(table, requests)
    by_join = cx.indexed_lookup(table, requests, most=1)
    plain = cx.company_lookup(table, requests)
    key = lambda df: sorted(map(str, df.select("request", "ticker", "company_name", "found").collect()))
    assert key(by_filter) == key(by_join) == key(plain) and len(key(plain)) == 6
    assert point_lookup(table, requests.limit(0), "ticker").collect() == []


def test_profiles_from_footers_read_no_column(spark, tmp_path):
    df = spark.read.parquet(table_path(SF_SMALL, "orders")).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")))
    df = df.withColumn("none", F.lit(None).cast("double"))
    df.repartition(3).write.parquet(str(tmp_path / "o"))
    found = scan_footers(spark, str(tmp_path / "o"))
    prof = pf.completeness(found)
    plan = prof._jdf.queryExecution().executedPlan().toString()
    assert "struct<count(*):bigint,count(o_orderkey):bigint" in plan        # the scan gives out counts, not columns
    rows, _ = scan_rows(found.agg(F.count("*")))
    assert rows == 0                                                        # and no file scan of the row reader is in it
    key = lambda d: sorted(map(str, d.collect()))
    plain = spark.read.parquet(str(tmp_path / "o"))
    assert key(prof) == key(pf.completeness(plain))
    assert [r.column_name for r in pf.empty_columns(found).collect()] == ["none"]
    assert found.count() == plain.count()
    assert "struct<count(*)" not in pf.completeness(plain)._jdf.queryExecution().executedPlan().toString()


def test_split_csv_keeps_texts_and_splits(spark, tmp_path):
    odd = ["a\nb", "\\n", "\\", "\\\\n\n", "x\\s", "\r\n\\r", '"q", \n"', "", None, "  edge ", "\\sn", "\x00", "\\\\s\\n"]
    small = spark.createDataFrame(list(enumerate(odd)), "id int, t string")
    sinks.export_csv(small, str(tmp_path / "odd"), splittable=True)
    back = sinks.read_csv(spark, str(tmp_path / "odd"), small.schema, splittable=True)
    assert sorted(((r.id, r.t) for r in back.collect())) == list(enumerate(odd))
    big = spark.range(40_000).select("id", F.concat(F.lit("line\n\""), F.sha2(F.col("id").cast("string"), 512)).alias("t"))
    path = str(tmp_path / "big")
    sinks.export_csv(big, path, single_file=True, splittable=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        read = sinks.read_csv(spark, path, big.schema, splittable=True)
        tasks = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) >= 4 and sum(tasks) == 40_000
        assert read.exceptAll(big).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
