"""Sinks: catalog-registered tables and single-file CSV export."""

import glob
import os

from alphaloom.session import fresh_path, scratch_path
from alphaloom.sources import sinks


def test_save_table_registers_in_catalog(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, flags array<string>")
    path = fresh_path(spark, "sink_table_test")
    sinks.save_table(df, path, table="sink_table_test")
    back = spark.table("sink_table_test")
    assert sorted(r.id for r in back.collect()) == [1, 2]
    sinks.save_table(df.where("id = 1"), path, table="sink_table_test")      # overwrite
    assert spark.table("sink_table_test").count() == 1


def test_export_csv_single_file_and_arrays(spark):
    df = spark.createDataFrame([(1, ["extreme_debt", "negative_roe"]), (2, [])], "id int, flags array<string>")
    path = fresh_path(spark, "sink_csv_test")
    sinks.export_csv(df, path, single_file=True)
    local = path.replace("file:", "")
    parts = glob.glob(os.path.join(local, "part-*.csv"))
    assert len(parts) == 1
    back = sinks.read_csv(spark, path, "id int, flags string").orderBy("id").collect()
    assert back[0].flags == "extreme_debt, negative_roe" and back[1].flags in (None, "")


def test_csv_keeps_quotes_line_breaks_and_edges(spark):
    rows = [(1, 'line1\nline2 "q", x'), (2, ""), (3, None), (4, "  edges\t"), (5, 'back\\slash "'), (6, "\r\nwin")]
    df = spark.createDataFrame(rows, "id int, t string")
    path = fresh_path(spark, "sink_csv_text")
    sinks.export_csv(df, path)
    assert sorted(tuple(r) for r in sinks.read_csv(spark, path, "id int, t string").collect()) == rows
