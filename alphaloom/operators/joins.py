"""Joins that Spark has no hint for: many-to-many with a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], salts: int = SALTS) -> DataFrame:
    """``left`` left-joined to ``right`` on ``keys``, where one key may hold a large part
    of ``left`` and match many rows of ``right``.

    A row of ``left`` takes one of ``salts`` numbers by a hash of its columns ``spread`` (which should tell
    the rows of one key apart; a hash, so that a task that is run again gives the same rows), every
    row of ``right`` is repeated for each, and the number joins the keys.  A hot key's rows, and what they multiply
    to, so fall to ``salts`` tasks, without a broadcast and whatever the planner knows of
    sizes.  Made for a ``right`` that is small against the result.  Rows with a null key match nothing
    and are spread like the others."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread]), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")
