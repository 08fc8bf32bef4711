"""Table sinks.

Writes go to the path or catalog the caller names; on a cluster that is the
shared storage the job is configured with.  Nothing is collected to the
driver: files are written by the tasks that hold the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Quotes are doubled inside quoted values, so quotes, commas and line breaks
# survive; white space at the edges is kept and an empty text is not a NULL.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "nullValue": "",
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}

EMPTY_MARK = "\x00empty"     # what the reader puts for a quoted empty text, which it would else take for a NULL


def _folder(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: list[str] | None = None, table: str | None = None) -> None:
    """Overwrite a table.  With ``table`` it is a table of the session catalog, otherwise the
    files at ``path``.  An overwrite that fails or is killed leaves the old rows readable, and may
    read the table that it overwrites:

    * a catalog table is written beside its old rows, in a folder of its own below ``path``, and then its location
      is switched (a change of the schema replaces the catalog entry); the version before stays for
      readers that have begun, older ones go;
    * a path is written beside and moved into place when the write is done."""
    spark = df.sparkSession
    if mode != "overwrite":
        w = df.write.mode(mode).format(fmt).partitionBy(*partition_by or [])
        if table and spark.catalog.tableExists(table):
            w.saveAsTable(table)            # its present version is where it is
        elif table:
            w.option("path", f"{path}/v-{uuid.uuid4().hex}").saveAsTable(table)
        else:
            w.save(path)
        return
    beside = f"{path}/v-{uuid.uuid4().hex}" if table else f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    try:
        df.write.format(fmt).partitionBy(*partition_by or []).save(beside)
    except Exception:
        at, fs = _folder(spark, beside)
        fs.delete(at, True)
        raise
    if table:
        _switch(df, path, beside, fmt, partition_by, table)
    else:
        _move_into_place(spark, path, beside)


def _switch(df: DataFrame, path: str, beside: str, fmt: str, partition_by: list[str] | None, table: str) -> None:
    spark = df.sparkSession
    name = ".".join(f"`{p}`" for p in table.split("."))
    plain = lambda schema: sorted((f.name, f.dataType.simpleString()) for f in schema.fields)
    before = None
    if spark.catalog.tableExists(table):
        rows = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
        before = rows.get("Location", "")
        same = plain(spark.table(table).schema) == plain(df.schema) and rows.get("Provider", "").lower() == fmt.lower()
        if same and not partition_by and "# Partition Information" not in rows:
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{beside}'")
        else:
            spark.sql(f"DROP TABLE {name}")
            before_files, before = before, None
            _create(spark, name, df, beside, fmt, partition_by)
            before = before_files
    else:
        _create(spark, name, df, beside, fmt, partition_by)
    spark.catalog.refreshTable(table)
    at, fs = _folder(spark, path)
    keep = {beside.rstrip("/").rpartition("/")[2], (before or "").rstrip("/").rpartition("/")[2]}
    for entry in fs.listStatus(at):
        folder = entry.getPath()
        if folder.getName().startswith("v-") and folder.getName() not in keep:
            fs.delete(folder, True)


def _create(spark: SparkSession, name: str, df: DataFrame, beside: str, fmt: str, partition_by: list[str] | None) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    parts = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING {fmt}{parts} LOCATION '{beside}'")
    if partition_by:                    # the catalog learns of the folders that are there already
        spark.sql(f"MSCK REPAIR TABLE {name}")


def _move_into_place(spark: SparkSession, path: str, beside: str) -> None:
    """Old files aside, new files to ``path``, old files gone: two renames, the second undoes the first if it fails."""
    at, fs = _folder(spark, path.rstrip("/"))
    aside, _ = _folder(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    new, _ = _folder(spark, beside)
    had = fs.exists(at)
    if had and not fs.rename(at, aside):
        raise OSError(f"{path} can't be moved aside; the new rows are at {beside}")
    if not fs.rename(new, at):
        if had:
            fs.rename(aside, at)
        raise OSError(f"{beside} can't be moved to {path}; the old rows are still there")
    if had:
        fs.delete(aside, True)


def save_lookup_table(df: DataFrame, path: str, key: str, files: int = 8, distinct_keys: int = 1_000_000,
                      row_group_bytes: int = 8 << 20) -> None:
    """A Parquet table made for point lookups by ``key``: files hold ranges of the key and are sorted, row groups
    are small and carry a bloom filter for it.  A filter on the key then skips files' row
    groups by their ranges, and by the bloom filters where ranges overlap or a key is absent.
    ``distinct_keys`` is what to expect in a file."""
    rows = df.repartitionByRange(files, F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`"))
    rows.write.option(f"parquet.bloom.filter.enabled#{key}", "true") \
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct_keys)) \
        .option("parquet.block.size", str(row_group_bytes)).mode("overwrite").parquet(path)


def arrays_to_text(df: DataFrame, sep: str = ", ") -> DataFrame:
    """CSV has no array type: array columns become joined text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.concat_ws(sep, F.col(f"`{f.name}`").cast("array<string>")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


# Written for a backslash, a line feed and a carriage return.  Every backslash of an escaped text
# starts one of these, so taking them back in reverse order is exact.
ESCAPES = [("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r")]


def escape_breaks(text: Column) -> Column:
    """A text on one line."""
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape_breaks(text: Column) -> Column:
    for raw, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def export_csv(df: DataFrame, path: str, sep: str = ", ", single_file: bool = False, splittable: bool = False) -> None:
    """CSV with a header and no index.  ``single_file`` funnels the rows
    through one task and is meant only for bounded results (a top-N memo
    table); otherwise every task writes its own part file.  ``splittable`` escapes line breaks in texts, so
    that a line is a row and ``read_csv`` can read a file in many tasks."""
    out = arrays_to_text(df, sep)
    if splittable:
        out = out.withColumns({c: escape_breaks(F.col(f"`{c}`")) for c in _texts(out)})
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").options(**CSV_OPTIONS, emptyValue='""').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, splittable: bool = False) -> DataFrame:
    """Read what ``export_csv`` wrote.  Files written ``splittable`` are split among tasks; others are
    read with ``multiLine``, which keeps a file in one task, so they should be of moderate size."""
    df = spark.read.options(**CSV_OPTIONS, emptyValue=EMPTY_MARK, multiLine=not splittable).schema(schema).csv(path)
    back = unescape_breaks if splittable else (lambda c: c)
    return df.withColumns({c: F.when(F.col(f"`{c}`") == EMPTY_MARK, F.lit("")).otherwise(back(F.col(f"`{c}`"))) for c in _texts(df)})
