"""Exact ``percent_rank`` within groups, for many columns at once, in one plan.

A native ``percent_rank`` window sends a whole group to one task.  Groups here
are sectors: few values, and one may hold a third of all rows.  This plan
never does, at any size, and needs no key and no job while it is built:

1. every row becomes one narrow row per ranked column ``(g, metric, v)``; a
   descending order ranks ``-x`` ascending, NULLs last.  The first of them
   carries the row itself.  ``g`` is the group in a struct: a NULL group joins like any other,
   and no join needs another shuffle for it;
2. a histogram ``(g, metric, v) -> c`` (map-side combined, so a hot value
   collapses before the shuffle);
3. a value is cut into digits that keep its order: its power of two with ten
   bits of the mantissa, then 20 bits more (exact arithmetic on the double, so the order is the value's), and
   22 bits are left.  Each level adds up the counts of its digits and takes one running
   sum among the digits of one parent; the last level runs over the values themselves.  The rank is the sum of a
   value's running sums down its digits.  No window, whatever the values, holds more rows than a
   digit has values (2^23), and far fewer in practice, so a narrow range spreads like a wide one;
4. ``p = rank / (n - 1)`` (0 when ``n = 1``);
5. the ranks are joined back on ``(g, metric, v)`` (adaptive execution splits a
   hot value) and the narrow rows are folded by the id they were given together.

The joins always shuffle: how many narrow rows they get can't be told from the size of the
files, and broadcast because the files are small they would fill the driver.

Rows that repeat, NULL groups and NULL keys rank like any other.  NaN ranks above
every number in ascending and below in descending order; loaders turn it to NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, HIGH = -1000, 1023     # powers of two told apart; smaller values share the lowest
TOP_BITS = 10               # bits of the mantissa in the first digit
DIGIT_BITS = 20             # and in the second
INFINITE = HIGH + 1


@dataclass(frozen=True)
class RankSpec:
    name: str        # output column
    column: str      # ranked input column
    ascending: bool  # True: smallest value ranks 0; NULLs always last


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _digits(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``v``) with the digits d1, d2 of the value, in its order: where
    two values differ, the first digit that differs, or else the value itself, says how.
    Scaling by a power of two and taking a floor off are exact for doubles.  NULL ranks
    last and NaN before it, each as a first digit of its own."""
    plain = "v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')"
    above = (INFINITE - LOW) * (2 << TOP_BITS)
    rows = rows.selectExpr(
        "*", "CASE WHEN v < 0 THEN -1 ELSE 1 END AS _sign",
        f"CASE WHEN {plain} THEN CASE WHEN v = 0 THEN {LOW} ELSE greatest({LOW}, least({HIGH}, floor(log2(abs(v))))) END END AS _power")
    rows = rows.selectExpr("*", f"abs(v) * pow(2D, -_power) * {1 << TOP_BITS}D AS _x")
    return rows.selectExpr(
        "g", "metric", "v", "c",
        f"""coalesce(CAST(CASE WHEN v IS NULL THEN {above + 2} WHEN isnan(v) THEN {above + 1} WHEN _power IS NULL THEN {above} * _sign
                 ELSE ((_power - {LOW}) * {2 << TOP_BITS} + floor(_x)) * _sign END AS int), 0) AS d1""",
        f"coalesce(CAST(floor((_x - floor(_x)) * {1 << DIGIT_BITS}D) AS int) * _sign, 0) AS d2")


def _ranked_level(rows: DataFrame, parents: list[str], order: Column) -> DataFrame:
    """``rows`` with ``before``, the count ``c`` of smaller ones under all of ``parents``
    (g and metric first): under the nearest parent by a running sum, and what comes before
    that parent in the same way, from the parents' sums."""
    near = Window.partitionBy(*parents).orderBy(order)
    own = F.coalesce(F.sum("c").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("before", own)
    if len(parents) == 2:
        return ranked.withColumn("n", F.sum("c").over(Window.partitionBy(*parents)))
    sums = ranked.groupBy(*parents).agg(F.max(F.col("before") + F.col("c")).alias("c"))     # no further shuffle
    up = _ranked_level(sums, parents[:-1], F.col(parents[-1]).asc()).drop("c")
    up = up.withColumnsRenamed({p: f"_{p}" for p in parents} | {"before": "_before"})
    return ranked.join(up.hint("merge"), [F.col(p) == F.col(f"_{p}") for p in parents]).select(*rows.columns, (F.col("before") + F.col("_before")).alias("before"), "n")


def value_ranks(narrow: DataFrame) -> DataFrame:
    """``(g, metric, v, p)`` of the distinct values of ``narrow`` (g, metric, v); g is never NULL."""
    hist = _digits(narrow.groupBy("g", "metric", "v").agg(F.count(F.lit(1)).alias("c")))
    ranked = _ranked_level(hist, ["g", "metric", "d1", "d2"], F.col("v").asc_nulls_last())
    return ranked.select(
        F.col("g").alias("rg"), F.col("metric").alias("rm"), F.col("v").alias("rv"),
        F.when(F.col("n") > 1, F.col("before").cast("double") / (F.col("n") - 1).cast("double")).otherwise(F.lit(0.0)).alias("p"))


def grouped_percent_rank(df: DataFrame, group: str, specs: list[RankSpec]) -> DataFrame:
    """``df`` with one ``percent_rank`` column per spec, within ``group``."""
    row = F.struct(*df.columns) if all("." not in c and "`" not in c for c in df.columns) else F.struct(*map(_col, df.columns))
    cells = F.expr("array(" + ", ".join(
        f"named_struct('metric', {i}, 'v', CAST({'' if s.ascending else '-'}`{s.column}` AS double))" for i, s in enumerate(specs)) + ")")
    key = F.struct(_col(group).alias("k")).alias("g")
    narrow = df.select(key, F.inline(cells))
    carried = (df.select(key, row.alias("row"), F.monotonically_increasing_id().alias("rid"),
                         cells.alias("cells"))
               .select("g", "rid", "row", F.inline("cells"))
               .withColumn("row", F.when(F.col("metric") == 0, F.col("row"))))
    ranks = value_ranks(narrow)
    same = (F.col("g") == F.col("rg")) & (F.col("metric") == F.col("rm")) & F.col("v").eqNullSafe(F.col("rv"))
    # dealt by id before the aggregation: a sum before that shuffle would sort all rows and join none
    folded = carried.hint("merge").join(ranks, same).select("rid", "row", "metric", "p").repartition("rid").groupBy("rid").agg(
        F.any_value("row", True).alias("row"),
        *[F.max(F.when(F.col("metric") == i, F.col("p"))).alias(s.name) for i, s in enumerate(specs)])
    return folded.select("row.*", *[s.name for s in specs])
