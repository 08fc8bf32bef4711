"""Query registry: one Spark builder and one DuckDB oracle per query key.

A query is declared once with its output columns.  ``cols`` is a comma list;
``name:d`` marks a double that both sides round to 6 digits so the checker
compares stable values.  The Spark builder returns the unprojected frame;
the registry applies the projection.  The oracle is a SQL body over CTEs from
``plans.oracle`` (the CTEs it needs are pulled in with their dependencies).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle

DIGITS = 6
SCALE = 10 ** DIGITS
# Rounding both engines evaluate bit-identically: floor(x * 1e6 + 0.5) / 1e6
# (IEEE multiply/add/floor), left alone beyond +-1e12 where it could overflow.
LIMIT = 1e12


def stable_round(col):
    scaled = F.floor(col * F.lit(float(SCALE)) + F.lit(0.5)).cast("double") / F.lit(float(SCALE))
    return F.when(F.abs(col) < LIMIT, scaled).otherwise(col)


def stable_round_sql(expr: str) -> str:
    return (f"CASE WHEN abs({expr}) < {LIMIT:.0f} THEN CAST(floor({expr} * CAST({SCALE} AS DOUBLE) + 0.5) AS DOUBLE)"
            f" / CAST({SCALE} AS DOUBLE) ELSE {expr} END")


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    cols: list[tuple[str, str]] | None
    sql_from: str | None          # FROM ... (+ WHERE/GROUP BY) part of the oracle, or full SQL
    ctes: tuple[str, ...] = ()
    full_sql: bool = False

    def spark(self, spark: SparkSession, base: str) -> DataFrame:
        df = self.build(spark, base)
        if self.cols is None:
            return df
        types = dict(df.dtypes)
        out = []
        for c, kind in self.cols:
            col = F.col(f"`{c}`")
            if kind == "d":
                col = stable_round(col.cast("double"))
            elif types.get(c) in ("int", "smallint", "tinyint"):
                col = col.cast("bigint")          # one integer width on both sides
            out.append(col.alias(c))
        return df.select(*out)

    def sql(self) -> str | None:
        if self.sql_from is None:
            return None
        if self.full_sql:
            body = self.sql_from
        else:
            sel = []
            for c, kind in self.cols:
                q = f'"{c}"'
                sel.append(f"{stable_round_sql(f'CAST({q} AS DOUBLE)')} AS {q}" if kind == "d" else q)
            body = f"SELECT {', '.join(sel)} {self.sql_from}"
        return oracle.with_ctes(self.ctes, body)


REGISTRY: dict[str, Query] = {}


def parse_cols(spec: str | None) -> list[tuple[str, str]] | None:
    if spec is None:
        return None
    out = []
    for part in spec.split(","):
        part = part.strip()
        if not part:
            continue
        name, _, kind = part.partition(":")
        out.append((name.strip(), kind.strip()))
    return out


def register(name: str, cols: str | None, sql_from: str | None, ctes=(), full_sql=False):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, parse_cols(cols), sql_from, tuple(ctes), full_sql)
        return fn
    return deco
