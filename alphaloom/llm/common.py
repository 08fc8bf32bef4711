"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark (any store it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; a null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_key(column: str = "doc_id") -> Column:
    """A non-null join key for an id that may be null."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker process.

    Functions are shipped by value, so module globals do not outlive a task;
    a loaded tokenizer is worth keeping between tasks."""
    holder = sys.modules.get("_alphaloom_worker")
    if holder is None:
        holder = sys.modules["_alphaloom_worker"] = types.ModuleType("_alphaloom_worker")
        holder.store = {}
    return holder.store


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``modulus``, equals ``remainder``.
    A null id is held out, so it is never learnt from."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce((crc % F.lit(modulus)) == F.lit(remainder), F.lit(True))


__all__ = ["table", "text_of", "id_key", "shuffle_partitions", "worker_cache", "held_out", "materialize"]
