"""Caller SQL: what a screen may hold, and what is refused wherever it stands."""

import pytest

from alphaloom.operators import screen as sc

GOOD = [
    "SELECT ticker, alpha FROM company_view WHERE alpha > :min ORDER BY alpha DESC NULLS LAST LIMIT 5;",
    "select * from COMPANY_VIEW v where sector in ('a', 'b') and not (alpha between 1 and 2 or ticker like 'T%')",
    "WITH top AS (SELECT * FROM company_view), named(t, s) AS (SELECT ticker, sector FROM top) SELECT t FROM named JOIN top ON t = ticker",
    "SELECT sector, count(*) n, round(avg(alpha), 2) FROM company_view GROUP BY sector HAVING count(*) > 1",
    "SELECT ticker, rank() OVER w r, sum(alpha) OVER (PARTITION BY sector ORDER BY ticker ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) "
    "FROM company_view WINDOW w AS (PARTITION BY sector ORDER BY alpha)",
    "SELECT ticker FROM company_view c WHERE alpha > (SELECT avg(alpha) FROM company_view d WHERE d.sector = c.sector) "
    "AND EXISTS (SELECT 1 FROM company_view) AND sector IN (SELECT sector FROM company_view)",
    "SELECT ticker, CASE WHEN alpha > 5 THEN 'high' ELSE 'low' END, cast(alpha AS int), coalesce(sector, 'none') || '!', "
    "try_divide(alpha, 0), transform(array(1, 2), x -> x + 1)[0], struct(alpha AS a).a FROM company_view",
    "SELECT * EXCEPT (alpha) FROM company_view UNION ALL SELECT ticker, sector FROM company_view",
    "SELECT t.x FROM company_view LATERAL VIEW explode(array(1, 2)) t AS x",
    "SELECT s FROM (SELECT sector s FROM company_view) q CROSS JOIN (VALUES (1), (2)) AS k(n)",
    "SELECT * FROM company_view PIVOT (sum(alpha) FOR sector IN ('a', 'b'))",
]
CALLS = ["reflect('java.lang.System', 'exit', '1')", "java_method('java.util.UUID', 'randomUUID')", "input_file_name()",
         "raise_error('x')", "current_user()", "version()", "session_user()", "current_catalog()", "assert_true(false)",
         "aes_encrypt('a', 'b')", "spark_partition_id()", "try_reflect('java.lang.System', 'getenv', 'PATH')", "my_udf(1)",
         "spark_catalog.default.abs(1)", "IDENTIFIER('abs')(1)", "read_files('/x')", "sequence(1, 1000000000)", "uuid()"]
PLACES = ["SELECT {} FROM company_view", "SELECT ticker FROM company_view WHERE {} IS NOT NULL",
          "SELECT ticker FROM company_view ORDER BY {}", "SELECT count(*) FROM company_view GROUP BY {}",
          "SELECT sector FROM company_view GROUP BY sector HAVING max({}) IS NULL",
          "WITH a AS (SELECT {} x FROM company_view) SELECT * FROM a",
          "SELECT (SELECT max({}) FROM company_view) FROM company_view",
          "SELECT ticker FROM company_view WHERE EXISTS (SELECT {} FROM company_view)",
          "SELECT ticker FROM company_view WHERE sector IN (SELECT {} FROM company_view)",
          "SELECT q.x FROM (SELECT {} x FROM company_view) q", "SELECT ticker FROM company_view a JOIN company_view b ON {} IS NULL",
          "SELECT sum(alpha) OVER (PARTITION BY {}) FROM company_view",
          "SELECT rank() OVER w FROM company_view WINDOW w AS (ORDER BY {})",
          "SELECT coalesce(abs(alpha), CASE WHEN true THEN {} END) FROM company_view",
          "SELECT transform(array(1), x -> {}) FROM company_view",
          "SELECT x FROM company_view LATERAL VIEW explode(array({})) t AS x",
          "SELECT count(*) FILTER (WHERE {} IS NULL) FROM company_view",
          "SELECT ticker FROM company_view UNION SELECT {} FROM company_view", "SELECT * FROM (VALUES ({})) AS k(n)",
          "SELECT ticker FROM company_view, LATERAL (SELECT {} y)"]
RELATIONS = ["other", "parquet.`/tmp/x`", "json.`/etc/passwd`", "default.company_view", "spark_catalog.default.company_view",
             "range(10)", "IDENTIFIER('company_view')", "other VERSION AS OF 1", "explode(array(1))", "`company_view.x`"]
FROM_PLACES = ["SELECT * FROM {}", "SELECT * FROM company_view JOIN {} USING (ticker)",
               "SELECT ticker FROM company_view WHERE alpha > (SELECT max(alpha) FROM {})",
               "WITH a AS (SELECT * FROM {}) SELECT * FROM a", "SELECT ticker FROM company_view WHERE sector IN (SELECT sector FROM {})",
               "SELECT ticker FROM company_view UNION ALL SELECT ticker FROM {}"]


@pytest.fixture(scope="module")
def companies(spark):
    return spark.createDataFrame([("T1", "a", 1.0), ("T2", "a", 7.0), ("T3", "b", 9.0)], "ticker string, sector string, alpha double")


@pytest.mark.parametrize("sql", GOOD)
def test_screens_run(spark, companies, sql):
    args = {"min": 2.0} if ":min" in sql else {}
    assert len(sc.screen_sql(spark, companies, sql, args=args, max_rows=2).collect()) <= 2


@pytest.mark.parametrize("call", CALLS)
def test_unlisted_functions_are_refused_everywhere(spark, call):
    for place in PLACES:
        with pytest.raises(ValueError):
            sc.validate_select(place.format(call), spark)


@pytest.mark.parametrize("relation", RELATIONS)
def test_foreign_relations_are_refused_everywhere(spark, relation):
    for place in FROM_PLACES:
        with pytest.raises(ValueError):
            sc.validate_select(place.format(relation), spark)


def test_a_common_table_expression_is_visible_only_in_its_query(spark):
    hidden = "SELECT * FROM (WITH other AS (SELECT 1 x) SELECT * FROM other) q JOIN other"
    with pytest.raises(ValueError, match="relation other"):
        sc.validate_select(hidden, spark)
    with pytest.raises(ValueError, match="relation b"):
        sc.validate_select("WITH a AS (SELECT * FROM b), b AS (SELECT 1 x) SELECT * FROM a", spark)
    with pytest.raises(ValueError, match="relation a"):
        sc.validate_select("WITH a AS (SELECT * FROM a) SELECT * FROM a", spark)
    assert sc.validate_select("WITH a AS (SELECT 1 x) SELECT * FROM (SELECT * FROM a)", spark)


@pytest.mark.parametrize("sql", [
    "DROP TABLE company_view", "INSERT INTO t SELECT * FROM company_view", "SELECT 1; SELECT 2", "", "SET spark.x = 1",
    "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "FROM company_view INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT *",
    "SELECT TRANSFORM(ticker) USING 'cat' AS (x) FROM company_view", "CACHE TABLE company_view", "EXPLAIN SELECT 1",
    "SELECT * FROM company_view TABLESAMPLE (10 PERCENT)", "SELECT * FROM company_view |> WHERE true", "ADD JAR '/tmp/x.jar'"])
def test_other_statements_are_refused(spark, sql):
    with pytest.raises(ValueError):
        sc.validate_select(sql, spark)


def test_refused_sql_has_no_effect(spark, companies):
    key = "alphaloom.screen.probe"
    spark._jvm.System.clearProperty(key)
    with pytest.raises(ValueError):
        sc.screen_sql(spark, companies, f"SELECT reflect('java.lang.System', 'setProperty', '{key}', 'x') FROM company_view")
    assert spark._jvm.System.getProperty(key) is None


def test_another_view_name(spark, companies):
    assert sc.screen_sql(spark, companies, "SELECT ticker FROM mine", view="mine").count() == 3
    with pytest.raises(ValueError):
        sc.validate_select("SELECT * FROM company_view", spark, "mine")
