"""Registered queries: scans, sinks and table metadata."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators import profile as pf
from ..session import fresh_path, scratch_path
from ..sources import sinks
from ..sources.tables import TABLES, scan_footers, scan_format, scan_table, table_path, table_preview, table_stats
from . import stages as st
from .registry import register

# Column counts of the given tables (their published schemas).
_N_COLS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6,
           "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3,
           "benchmark": 2, "labels": 3, "conversations": 4}


@register("table_stats", "table_name, n_rows, n_cols",
          "FROM (" + " UNION ALL ".join(
              f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows, CAST({_N_COLS[t]} AS BIGINT) AS n_cols FROM {t}"
              for t in TABLES) + ")")
def q_table_stats(spark, base):
    """S8 over every given table."""
    return table_stats({t: scan_table(spark, base, t) for t in TABLES})


@register("table_stats_footers", "table_name, n_rows, n_cols",
          "FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows, CAST({_N_COLS[t]} AS BIGINT) AS n_cols FROM {t}"
                                        for t in ("lineitem", "orders", "events")) + ")")
def q_table_stats_footers(spark, base):
    """S8 from the files' footers: no column data is read.  Each frame has a session of its
    own, so the union is one of literal rows."""
    found = [(t, df.count(), len(df.columns)) for t in ("lineitem", "orders", "events")
             for df in [scan_footers(spark, table_path(base, t))]]
    return spark.createDataFrame(found, "table_name string, n_rows bigint, n_cols bigint")


_FOOTER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@register("completeness_footers", "column_name, non_null, null_count, pct_complete:d, band",
          "FROM (" + " UNION ALL ".join(
              f"""SELECT '{c}' AS column_name, COUNT({c}) AS non_null, COUNT(*) - COUNT({c}) AS null_count,
                         COUNT({c}) * 100.0 / COUNT(*) AS pct_complete,
                         CASE WHEN COUNT({c}) * 100.0 / COUNT(*) >= 80 THEN 'ok'
                              WHEN COUNT({c}) * 100.0 / COUNT(*) >= 50 THEN 'warn' ELSE 'fail' END AS band FROM orders"""
              for c in _FOOTER_COLUMNS) + ")")
def q_completeness_footers(spark, base):
    """P1-P4 from the files' footers alone."""
    return pf.completeness(scan_footers(spark, table_path(base, "orders")))


_ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice:d, o_orderdate, o_orderpriority"


@register("scan_format", _ORDER_COLS, "FROM orders")
def q_scan_format(spark, base):
    """Format-qualified read of a catalog table (registered over the given
    files, nothing is copied)."""
    path = table_path(base, "orders")
    name = f"orders_{hashlib.sha1(path.encode()).hexdigest()[:12]}"
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=path, source="parquet")
    return scan_format(spark, fmt="parquet", table=name)


@register("scan_format_path", _ORDER_COLS, "FROM orders")
def q_scan_format_path(spark, base):
    """Format-qualified read of a path."""
    return scan_format(spark, table_path(base, "orders"), "parquet")


@register("table_preview", "o_orderkey, o_custkey, o_orderstatus, o_totalprice:d",
          "FROM orders ORDER BY o_orderkey LIMIT 10")
def q_table_preview(spark, base):
    """First rows under a key order (top-k, not a full sort)."""
    return table_preview(scan_table(spark, base, "orders"), ["o_orderkey"], 10)


@register("save_table", "ticker, red_flag_count, red_flag_severity, overall_alpha_score:d",
          "FROM anomalies", ctes=("anomalies",))
def q_save_table(spark, base):
    """Write the flagged company table into the catalog (over the one of an earlier
    call, whose rows stay readable until then) and read it back by name."""
    sinks.save_table(st.anomalies(spark, base), scratch_path(spark, "companies_flagged"), table="companies_flagged")
    return spark.table("companies_flagged")


def _round_trip(spark, df, name):
    path = fresh_path(spark, name)
    sinks.export_csv(df, path)
    return sinks.read_csv(spark, path, sinks.arrays_to_text(df).schema)


_EXPORT_COLS = ("ticker, company_name, sector, industry, country, market_cap:d, current_price:d, pe_ratio:d, value_score:d, "
                "growth_score:d, quality_score:d, risk_score:d, overall_alpha_score:d, conviction, beta:d, red_flags, "
                "red_flag_count, red_flag_severity")


@register("export_csv", _EXPORT_COLS,
          """FROM (SELECT * REPLACE (CASE WHEN len(red_flags) = 0 THEN '' ELSE array_to_string(red_flags, ', ') END AS red_flags)
                   FROM anomalies)""", ctes=("anomalies",))
def q_export_csv(spark, base):
    """Export the whole flagged table with arrays as text and read the CSV back."""
    return _round_trip(spark, st.anomalies(spark, base), "anomalies_csv")


@register("export_csv_texts", "doc_id, text, lang, source, n_chars",
          "FROM (SELECT * REPLACE (text || chr(10) || '\"q\", ' || source AS text) FROM documents)")
def q_export_csv_texts(spark, base):
    """S5 over whole texts with line breaks, quotes and commas."""
    d = scan_table(spark, base, "documents")
    return _round_trip(spark, d.withColumn("text", F.concat("text", F.lit('\n"q", '), "source")), "documents_csv")


@register("export_csv_split", "doc_id, text, lang, source, n_chars",
          "FROM (SELECT * REPLACE (text || chr(13) || chr(10) || '\\n\"q\", ' || source AS text) FROM documents)")
def q_export_csv_split(spark, base):
    """S5 over whole texts, with line breaks escaped so that a file is read by many tasks."""
    d = scan_table(spark, base, "documents").withColumn("text", F.concat("text", F.lit('\r\n\\n"q", '), "source"))
    path = fresh_path(spark, "documents_lines")
    sinks.export_csv(d, path, splittable=True)
    return sinks.read_csv(spark, path, d.schema, splittable=True)
