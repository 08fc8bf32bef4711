"""Scans of the given tables (S1, S2) and cheap table metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables every data folder holds, one parquet file (or folder) each.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def scan_table(spark: SparkSession, base: str | None, name: str) -> DataFrame:
    """Read a table by name.

    With a data folder the name resolves to ``<base>/<name>.parquet``;
    without one (``base=None``) it is a catalog table or view.  The scan
    stays lazy so that Catalyst prunes columns and pushes filters into the
    parquet reader.
    """
    if base is None:
        return spark.table(name)
    return spark.read.parquet(table_path(base, name))


def scan_format(spark: SparkSession, path: str | None = None, fmt: str = "parquet", table: str | None = None,
                **options) -> DataFrame:
    """Format-qualified read (``parquet``, ``orc``, ``json``, ``csv`` or an
    installed table format such as ``delta``) of a path, or of a catalog table
    by name."""
    reader = spark.read.format(fmt).options(**options)
    return reader.table(table) if table else reader.load(path)


def scan_footers(spark: SparkSession, path: str) -> DataFrame:
    """A scan of a Parquet path for whole-table counts, minima and maxima: its
    aggregates are answered from the files' footers and read no column data.

    The push-down belongs to the newer reader, which a session chooses for all its reads, so the frame
    lives in a session of its own on the same context (same catalog of global views, same
    executors); don't join it with frames of another session.  Profiles (``profile.completeness``, ``empty_columns``)
    and ``table_stats`` take it like any frame.  Rows added up are those of the
    files: filters and derived columns are not answered from footers."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path)


def point_lookup(table: DataFrame, requests: DataFrame, key: str, request_col: str = "request", most: int = 1000) -> DataFrame:
    """The rows of ``table`` whose ``key`` is among the distinct requests.

    Up to ``most`` distinct requests (they come to the driver) become a filter that reaches the
    Parquet reader, so that of a table written by ``sinks.save_lookup_table`` only the files and row
    groups that may hold them are read; more are joined.  Null requests match nothing."""
    wanted = requests.select(F.col(f"`{request_col}`").alias("_want")).where("_want IS NOT NULL").distinct()
    few = wanted.limit(most + 1).collect()
    if len(few) <= most:
        return table.where(F.col(f"`{key}`").isin([r[0] for r in few]) if few else F.lit(False))
    return table.join(wanted, F.col(f"`{key}`") == F.col("_want"), "left_semi")


def table_stats(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row and column count.

    Each count is a plain aggregate (parquet answers it from footers); the
    union runs the scans as independent tasks in one job.
    """
    parts = [df.agg(F.count("*").alias("n_rows"))
               .select(F.lit(name).alias("table_name"), "n_rows",
                       F.lit(len(df.columns)).alias("n_cols"))
             for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def table_preview(df: DataFrame, order_by: list[str], n: int = 10,
                  columns: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows under a deterministic key order.

    ``orderBy(...).limit(n)`` plans as a top-k (TakeOrderedAndProject), so
    each task keeps only ``n`` rows before the single merge.
    """
    out = df.select(*columns) if columns else df
    return out.orderBy(*order_by).limit(n)
