"""Stock screening (Q1-Q3, K5).

The reference asks a language model to write SQL from a request and runs
whatever comes back.  Here (Q1) a fixed rule table maps request phrases to
filters and orderings that are composed into one DataFrame plan, and (Q2)
caller-written SQL runs against a registered view with bound parameters,
accepted only if every node, expression, function and relation of the parsed
plan is on a list of harmless ones.  Both end in a top-k.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScreenRule:
    phrases: tuple[str, ...]
    kind: str                      # "order" or "filter"
    columns: tuple[str, ...]
    direction: str = "desc"        # order rules: "asc" / "desc"
    value: str | None = None       # filter rules: required value
    exact: tuple[str, ...] = ()    # phrases matched with their case ("US" is no pronoun)


# The screening rules, in priority order.
SCREEN_RULES = [
    ScreenRule(("undervalued",), "order", ("value_score",), "desc"),
    ScreenRule(("high growth",), "order", ("growth_score",), "desc"),
    ScreenRule(("high quality",), "order", ("quality_score",), "desc"),
    ScreenRule(("low risk",), "order", ("risk_score", "volatility_52w", "beta", "debt_to_equity"), "asc"),
    ScreenRule(("united states",), "filter", ("country",), value="United States", exact=("US", "USA", "U.S.")),
]


def _matches(request: str, phrase: str) -> bool:
    return re.search(rf"(?<![A-Za-z]){re.escape(phrase)}(?![A-Za-z])", request) is not None


def rules_for(request: str, rules=SCREEN_RULES) -> list[ScreenRule]:
    return [r for r in rules if any(_matches(request.lower(), p) for p in r.phrases)
            or any(_matches(request, p) for p in r.exact)]


def screen_rules(companies: DataFrame, request: str, max_rows: int = 10,
                 key: str = "ticker", rules=SCREEN_RULES) -> DataFrame:
    """Q1 + K5: filters and orderings from the matched rules, key as final
    tie-break, capped at ``max_rows`` (a top-k: each task keeps ``max_rows``).
    A request that no rule matches raises ``ValueError``."""
    matched = rules_for(request, rules)
    if not matched:
        raise ValueError(f"no screening rule matches {request!r}")
    df = companies
    order: list[Column] = []
    for r in matched:
        if r.kind == "filter":
            for c in r.columns:
                df = df.where(F.col(c) == F.lit(r.value))
        else:
            for c in r.columns:
                order.append(F.col(c).desc_nulls_last() if r.direction == "desc"
                             else F.col(c).asc_nulls_last())
    order.append(F.col(key).asc())
    return df.orderBy(*order).limit(max_rows)


_STARTS = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)
# What a parsed screen may hold.  Anything else (commands, writes, DDL, table functions, time
# travel, identifiers made from strings) is refused, so a new kind of node is refused until it is listed.
QUERY_NODES = frozenset("""
    Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset
    OneRowRelation Pivot Project Sort SubqueryAlias Union Unpivot UnresolvedHaving UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedWith Window WithWindowDefinition""".split())
EXPRESSIONS = frozenset("""
    Add Alias And AttributeReference Between BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Coalesce Concat Contains
    CreateNamedStruct CurrentDate CurrentTimestamp Divide EndsWith EqualNullSafe EqualTo Exists GreaterThan GreaterThanOrEqual
    ILike If In InSubquery IntegralDivide IsNaN IsNotNull IsNull LambdaFunction LateralSubquery LessThan LessThanOrEqual
    Like LikeAll LikeAny ListQuery Literal MultiAlias Multiply NamedParameter Not NotLikeAll NotLikeAny Or PosParameter RLike
    Remainder ScalarSubquery SortOrder SpecifiedWindowFrame StartsWith StringTrim StringTrimLeft StringTrimRight Subtract
    UnaryMinus UnaryPositive UnboundedFollowing$ UnboundedPreceding$ UnspecifiedFrame$ CurrentRow$ UnresolvedAlias
    UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable
    UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedWindowExpression WindowExpression WindowSpecDefinition""".split())
SUBQUERIES = frozenset(("Exists", "LateralSubquery", "ListQuery", "ScalarSubquery"))
# Functions of the values in a row, group or window alone: nothing that reads files, settings, the
# session or the clock's host, calls code by name or raises errors at will.
FUNCTIONS = frozenset("""
    abs acos add_months aggregate any any_value approx_count_distinct approx_percentile array array_agg array_contains
    array_distinct array_except array_intersect array_join array_max array_min array_position array_size array_sort
    array_union arrays_overlap ascii asin atan atan2 avg between bit_length bool_and bool_or btrim bround cardinality cbrt ceil ceiling
    char_length character_length chr coalesce collect_list collect_set concat concat_ws contains corr cos count count_if
    covar_pop covar_samp cume_dist current_date date_add date_diff date_format date_part date_sub date_trunc datediff day
    dayofmonth dayofweek dayofyear decode degrees dense_rank element_at elt endswith every exists exp explode explode_outer expm1
    extract filter find_in_set first first_value flatten floor forall format_number format_string get greatest hour hypot if
    ifnull ilike initcap inline inline_outer instr isnan isnotnull isnull kurtosis lag last last_day last_value lcase lead least
    left length like ln locate log log10 log1p log2 lower lpad ltrim make_date map map_concat map_contains_key map_entries
    map_from_arrays map_keys map_values max max_by mean median min min_by minute mod mode month months_between named_struct nanvl
    negative next_day ntile nth_value nullif nullifzero nvl nvl2 octet_length overlay percent_rank percentile percentile_approx
    percentile_cont percentile_disc pmod position positive posexplode posexplode_outer pow power quarter radians rank reduce
    regexp_count regexp_extract regexp_extract_all regexp_instr regexp_like regexp_replace regexp_substr regr_avgx regr_avgy
    regr_count regr_intercept regr_r2 regr_slope repeat replace reverse right rint rlike round row_number rpad rtrim second
    sign signum sin size skewness slice some sort_array soundex split split_part sqrt stack startswith std stddev
    stddev_pop stddev_samp strpos struct substr substring substring_index sum tan tanh to_char to_date to_number to_timestamp
    transform translate trim trunc try_add try_divide try_element_at try_multiply try_subtract try_sum try_to_number ucase
    unix_date upper var_pop var_samp variance weekday weekofyear width_bucket year zeroifnull zip_with""".split())
MESSAGE = "screen SQL must be a single SELECT or WITH query over the screened table"


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


class _Screen:
    """Walks a parsed plan and refuses what is not listed.  ``scope`` holds the relation
    names that may be read where the walk stands: the view's, and those of the common table
    expressions that are visible there."""

    def _refuse(self, what: str):
        raise ValueError(f"{MESSAGE}: {what} is not allowed")

    def plan(self, node, scope: frozenset[str]) -> None:
        name = node.getClass().getSimpleName()
        if name not in QUERY_NODES:
            self._refuse(name)
        if name == "UnresolvedRelation":
            parts = [str(p) for p in _seq(node.multipartIdentifier())]
            if len(parts) != 1 or parts[0].lower() not in scope:
                self._refuse(f"relation {'.'.join(parts)}")
        if name == "UnresolvedWith":
            for entry in _seq(node.cteRelations()):             # each sees those before it, and itself if it is recursive
                own = str(entry._1()).lower()
                self.plan(entry._2(), scope | {own} if node.allowRecursion() else scope)
                scope = scope | {own}
        if name == "WithWindowDefinition":                      # a map, which expressions() leaves out
            for spec in _seq(node.windowDefinitions().values().toSeq()):
                self.expression(spec, scope)
        for e in _seq(node.expressions()):
            self.expression(e, scope)
        for child in _seq(node.children()):
            self.plan(child, scope)

    def expression(self, e, scope: frozenset[str]) -> None:
        name = e.getClass().getSimpleName()
        if name not in EXPRESSIONS:
            self._refuse(name)
        if name == "UnresolvedFunction":
            self._function([str(p) for p in _seq(e.nameParts())])
        if name == "UnresolvedGenerator":
            self._function([e.name().funcName()] if e.name().database().isEmpty() else [e.name().unquotedString(), ""])
        if name == "UnresolvedStarExceptOrReplace" and not e.replacements().isEmpty():
            self._refuse("REPLACE")
        if name in SUBQUERIES:
            self.plan(e.plan(), scope)
        for child in _seq(e.children()):
            self.expression(child, scope)

    def _function(self, parts: list[str]) -> None:
        if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
            self._refuse(f"function {'.'.join(p for p in parts if p)}")


def validate_select(sql: str, spark: SparkSession | None = None, views: str | tuple[str, ...] = "company_view") -> str:
    """Accept one query over ``views`` (a trailing ';' is dropped).  The statement is parsed,
    not run.  Every plan node, expression and function of it must be listed, in
    subqueries, common table expressions and window definitions too, and it may read ``views`` and its own
    common table expressions only: no other table, no path, no table function.  A function that the session has
    registered under a listed name is the caller's own doing."""
    spark = spark or SparkSession.active()
    body = sql.strip().rstrip(";").strip()
    if not _STARTS.match(body):
        raise ValueError(MESSAGE)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except Exception as e:      # the parser's own error says where
        raise ValueError(f"{MESSAGE}: {e}") from None
    _Screen().plan(plan, frozenset(v.lower() for v in ([views] if isinstance(views, str) else views)))
    return body


def screen_sql(spark: SparkSession, companies: DataFrame, sql: str, view: str = "company_view",
               args: dict | None = None, max_rows: int = 10) -> DataFrame:
    """Q2 + K5: run caller SQL on ``companies`` registered as ``view``, if
    ``validate_select`` accepts it; values go in through named parameters (``:name``)."""
    body = validate_select(sql, spark, view)
    companies.createOrReplaceTempView(view)
    return spark.sql(body, args=args or {}).limit(max_rows)


def value_risk_points(screen: DataFrame, key: str = "ticker") -> DataFrame:
    """Q3: (Value, Risk) pairs of a screen result."""
    return screen.select(key, F.col("value_score").alias("Value"), F.col("risk_score").alias("Risk"))
