"""Queries in the SELECT dialect over wide tables of the driver data, each with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wideleaf.dialect import Catalog, Table, run
from wideleaf.errors import WideleafError
from wideleaf.sources import cells as C

#: What the wide tables hold, for DuckDB: a row per event, versions per user and type, a row per order.
_SOURCES = """ev AS (SELECT printf('u%06d#%08d', user_id, event_id) AS k, printf('u%06d', user_id) AS usr, event_type AS t, CAST(round(value * 100) AS BIGINT) AS c, props AS p FROM events),
hist AS (SELECT printf('u%06d', user_id) AS k, event_type AS t, epoch_us(ts) AS us, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS v FROM events),
ord AS (SELECT printf('c%06d#%08d', o_custkey, o_orderkey) AS k, o_orderstatus AS s, o_orderpriority AS p, CAST(round(o_totalprice * 100) AS BIGINT) AS c, CAST(o_orderdate AS DATE) AS d FROM orders)
"""
_CENTS, _TYPE = "CAST(CAST(cf['cents'] AS STRING) AS INT64)", "CAST(cf['type'] AS STRING)"
_PRICE, _DATE, _PRIORITY = "CAST(CAST(o['cents'] AS STRING) AS INT64)", "CAST(CAST(o['date'] AS STRING) AS DATE)", "CAST(o['priority'] AS STRING)"
_KEY = "CAST(_key AS STRING) AS row_key"

#: name: (query, SQL for DuckDB or None)
SELECTS: dict[str, tuple[str, str | None]] = {
    "sql_group": (f"SELECT {_TYPE} AS event_type, COUNT(*) AS n, SUM({_CENTS}) AS cents, MIN({_CENTS}) AS least, MAX({_CENTS}) AS most FROM ev GROUP BY event_type", "SELECT t AS event_type, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents, min(c) AS least, max(c) AS most FROM ev GROUP BY 1"),
    "sql_key_range": (f"SELECT {_KEY}, {_TYPE} AS event_type FROM ev WHERE _key BETWEEN 'u000002' AND 'u000005'", "SELECT k AS row_key, t AS event_type FROM ev WHERE k BETWEEN 'u000002' AND 'u000005'"),
    "sql_key_prefix": (f"SELECT {_KEY}, {_CENTS} AS cents FROM ev WHERE STARTS_WITH(_key, 'u000003#') OR _key LIKE 'u000007%'", "SELECT k AS row_key, c AS cents FROM ev WHERE k LIKE 'u000003#%' OR k LIKE 'u000007%'"),
    "sql_key_fields": (f"SELECT person, COUNT(*) AS n, COUNT(DISTINCT {_TYPE}) AS types FROM ev GROUP BY person", "SELECT usr AS person, count(*) AS n, count(DISTINCT t) AS types FROM ev GROUP BY 1"),
    "sql_distinct": (f"SELECT DISTINCT {_TYPE} AS event_type, MOD({_CENTS}, 2) AS odd FROM ev", "SELECT DISTINCT t AS event_type, c % 2 AS odd FROM ev"),
    "sql_having": (f"SELECT person, SUM({_CENTS}) AS cents FROM ev GROUP BY 1 HAVING cents > 100000", "SELECT usr AS person, CAST(sum(c) AS BIGINT) AS cents FROM ev GROUP BY 1 HAVING sum(c) > 100000"),
    "sql_limit_offset": (f"SELECT {_KEY}, {_TYPE} AS event_type FROM ev ORDER BY _key LIMIT 20 OFFSET 7", "SELECT k AS row_key, t AS event_type FROM ev ORDER BY k LIMIT 20 OFFSET 7"),
    "sql_whole_family": (f"SELECT {_KEY}, ARRAY_LENGTH(MAP_KEYS(ev)) AS n, CAST(MAP_VALUES(ev)[OFFSET(0)] AS STRING) AS first FROM hist", "SELECT k AS row_key, count(*) AS n, arg_min(v, t) AS first FROM (SELECT k, t, arg_max(v, us) AS v FROM hist GROUP BY 1, 2) GROUP BY 1"),
    "sql_as_of": (f"SELECT {_KEY}, CAST(ev['click'] AS STRING) AS click, CAST(ev['view'] AS STRING) AS view FROM hist(as_of => TIMESTAMP '2024-01-15 00:00:00+00')", "SELECT k AS row_key, arg_max(v, us) FILTER (WHERE t = 'click') AS click, arg_max(v, us) FILTER (WHERE t = 'view') AS view FROM hist WHERE us <= 1705276800000000 GROUP BY 1"),
    "sql_history": (f"SELECT {_KEY}, ARRAY_LENGTH(ev['click']) AS n, CAST(ev['click'][SAFE_OFFSET(1)].value AS STRING) AS second FROM hist(with_history => TRUE, latest_n => 3, before => TIMESTAMP '2024-01-20 00:00:00+00')", "SELECT k AS row_key, nullif(least(count(*) FILTER (WHERE t = 'click'), 3), 0) AS n, (list(v ORDER BY us DESC) FILTER (WHERE t = 'click'))[2] AS second FROM hist WHERE us < 1705708800000000 GROUP BY 1"),
    "sql_unpack": ("SELECT CAST(_key AS STRING) AS row_key, UNIX_MICROS(_timestamp) AS us, CAST(click AS STRING) AS click FROM UNPACK(SELECT _key, ev['click'] AS click FROM hist(with_history => TRUE))", "SELECT k AS row_key, us, v AS click FROM hist WHERE t = 'click'"),
    "sql_text": (f"SELECT {_KEY}, UPPER(SUBSTR({_PRIORITY}, -4)) AS tail, STRPOS({_PRIORITY}, '-') AS dash, LPAD(CAST(o['status'] AS STRING), 3, '*') AS padded, REGEXP_EXTRACT({_PRIORITY}, '([A-Z]+)') AS word, ARRAY_LENGTH(SPLIT({_PRIORITY}, '-')) AS parts, TO_HEX(o['status']) AS hex FROM ord", "SELECT k AS row_key, upper(right(p, 4)) AS tail, CAST(instr(p, '-') AS BIGINT) AS dash, lpad(s, 3, '*') AS padded, nullif(regexp_extract(p, '([A-Z]+)', 1), '') AS word, CAST(len(string_split(p, '-')) AS BIGINT) AS parts, lower(hex(s)) AS hex FROM ord"),
    "sql_dates": (f"SELECT FORMAT_DATE('%Y-%m', {_DATE}) AS month, EXTRACT(QUARTER FROM {_DATE}) AS quarter, COUNT(*) AS n, SUM(DATE_DIFF(LAST_DAY({_DATE}), {_DATE}, DAY)) AS days, SUM(EXTRACT(ISOWEEK FROM DATE_ADD({_DATE}, INTERVAL 1 MONTH))) AS weeks FROM ord GROUP BY month, quarter", "SELECT strftime(d, '%Y-%m') AS month, quarter(d) AS quarter, count(*) AS n, CAST(sum(last_day(d) - d) AS BIGINT) AS days, CAST(sum(weekofyear(d + INTERVAL 1 MONTH)) AS BIGINT) AS weeks FROM ord GROUP BY 1, 2"),
    "sql_numbers": (f"SELECT {_KEY}, ROUND(SQRT({_PRICE}), 4) AS root, DIV({_PRICE}, 7) AS sevenths, {_PRICE} & 255 AS low, {_PRICE} >> 3 AS eighth, SAFE_DIVIDE({_PRICE}, MOD({_PRICE}, 2)) IS NULL AS even FROM ord", "SELECT k AS row_key, round(sqrt(c), 4) AS root, c // 7 AS sevenths, c & 255 AS low, c >> 3 AS eighth, c % 2 = 0 AS even FROM ord"),
    "sql_json": ("SELECT JSON_VALUE(cf['props'], '$.k') AS k, COUNT(*) AS n FROM ev GROUP BY k", "SELECT json_extract_string(p, '$.k') AS k, count(*) AS n FROM ev GROUP BY 1"),
    "sql_conditions": (f"SELECT CASE WHEN {_CENTS} < 1000 THEN 'low' WHEN {_TYPE} IN ('click', 'view') THEN 'seen' ELSE IF({_TYPE} LIKE '%r%', 'r', NULL) END AS class, COUNT(*) AS n, COUNTIF({_CENTS} BETWEEN 500 AND 5000) AS some FROM ev GROUP BY class", "SELECT CASE WHEN c < 1000 THEN 'low' WHEN t IN ('click', 'view') THEN 'seen' WHEN t LIKE '%r%' THEN 'r' END AS class, count(*) AS n, count(*) FILTER (WHERE c BETWEEN 500 AND 5000) AS some FROM ev GROUP BY 1"),
    "sql_errors": (f"SELECT MOD({_CENTS}, 5) AS r, COUNTIF(ISERROR(DIV(1, MOD({_CENTS}, 3)))) AS failed, SUM(IFERROR(DIV({_CENTS}, MOD({_CENTS}, 3)), -1)) AS total, COUNT(SAFE_CAST({_TYPE} AS INT64)) AS numbers FROM ev GROUP BY r", "SELECT c % 5 AS r, count(*) FILTER (WHERE c % 3 = 0) AS failed, CAST(sum(CASE WHEN c % 3 = 0 THEN -1 ELSE c // (c % 3) END) AS BIGINT) AS total, count(TRY_CAST(t AS BIGINT)) AS numbers FROM ev GROUP BY 1"),
    "sql_ordered_aggregates": (f"SELECT person, STRING_AGG({_TYPE}, '|' ORDER BY {_CENTS} DESC, _key LIMIT 3) AS top, ARRAY_TO_STRING(ARRAY_AGG(DISTINCT {_TYPE} ORDER BY {_TYPE}), ',') AS types, ANY_VALUE({_TYPE}) AS first FROM ev GROUP BY person", "SELECT usr AS person, array_to_string((list(t ORDER BY c DESC, k))[1:3], '|') AS top, string_agg(DISTINCT t, ',' ORDER BY t) AS types, arg_min(t, k) AS first FROM ev GROUP BY 1"),
    "sql_statistics": (f"SELECT {_TYPE} AS event_type, ROUND(AVG({_CENTS}), 4) AS mean, ROUND(STDDEV({_CENTS}), 4) AS spread, ROUND(VAR_POP({_CENTS}) / 1000000, 4) AS variance, ROUND(CORR({_CENTS}, LENGTH({_TYPE}) + MOD({_CENTS}, 7)), 6) AS corr, LOGICAL_OR({_CENTS} > 9000) AS high, BIT_XOR({_CENTS}) AS bits FROM ev GROUP BY 1", "SELECT t AS event_type, round(avg(c), 4) AS mean, round(stddev(c), 4) AS spread, round(var_pop(c) / 1000000, 4) AS variance, round(corr(c, length(t) + c % 7), 6) AS corr, bool_or(c > 9000) AS high, bit_xor(c) AS bits FROM ev GROUP BY 1"),
    "sql_views": ("SELECT event_type, COUNT(*) AS n FROM dear WHERE STARTS_WITH(event_type, 'p') OR cents > 5000 GROUP BY event_type", "SELECT t AS event_type, count(*) AS n FROM ev WHERE c > 3000 AND (t LIKE 'p%' OR c > 5000) GROUP BY 1"),
    "sql_parameters": (f"SELECT {_KEY} FROM ev WHERE _key >= @low AND {_CENTS} > @cents", "SELECT k AS row_key FROM ev WHERE k >= 'u000010' AND c > 4000"),
    "sql_sketches": (f"SELECT {_TYPE} AS event_type, HLL_COUNT.EXTRACT(HLL_COUNT.INIT(person)) > 0 AS any, ABS(APPROX_COUNT_DISTINCT(person) - COUNT(DISTINCT person)) <= 0.05 * COUNT(DISTINCT person) AS near FROM ev GROUP BY event_type", "SELECT t AS event_type, true AS any, true AS near FROM ev GROUP BY 1"),
    "sql_structs": (f"SELECT {_KEY}, STRUCT({_TYPE} AS a, {_CENTS} AS b).b AS b, [1, {_CENTS}, 3][ORDINAL(2)] AS second, TO_JSON_STRING(STRUCT({_TYPE} AS t, {_CENTS} AS c)) AS json FROM ev", "SELECT k AS row_key, c AS b, c AS second, '{\"t\":\"' || t || '\",\"c\":' || c || '}' AS json FROM ev"),
    "sql_no_source": ("SELECT 1 AS one, 'a' AS letter, [1, 2][OFFSET(1)] AS two", "SELECT 1::BIGINT AS one, 'a' AS letter, 2::BIGINT AS two"),
    "sql_nested_query": (f"(SELECT {_KEY}, {_CENTS} AS cents FROM ev WHERE {_CENTS} > 3000) ORDER BY _key LIMIT 25", "SELECT k AS row_key, c AS cents FROM ev WHERE c > 3000 ORDER BY k LIMIT 25"),
    "sql_star": ("SELECT * EXCEPT (cents) REPLACE (UPPER(event_type) AS event_type) FROM all_events WHERE cents > 4000", "SELECT k::BLOB AS _key, upper(t) AS event_type FROM ev WHERE c > 4000"),
    "sql_range_star": (f"SELECT e.* EXCEPT (_key), CAST(e._key AS STRING) AS row_key FROM all_events AS e WHERE e.cents <= 100", "SELECT t AS event_type, c AS cents, k AS row_key FROM ev WHERE c <= 100"),
    "sql_limit_zero": ("SELECT COUNT(*) AS n FROM nothing", "SELECT 0::BIGINT AS n"),
    "sql_hints": (f"@{{allow_incomplete_view=true}} SELECT {_TYPE} AS event_type, COUNT(*) AS n FROM ev @{{allow_incomplete_view=true}} GROUP BY 1", "SELECT t AS event_type, count(*) AS n FROM ev GROUP BY 1"),
    "sql_group_ordinal": (f"SELECT {_TYPE} AS event_type, MOD({_CENTS}, 3) AS r, COUNT(*) AS n, MIN({_TYPE}) AS same FROM ev GROUP BY 1, 2 HAVING COUNT(*) > 1", "SELECT t AS event_type, c % 3 AS r, count(*) AS n, min(t) AS same FROM ev GROUP BY 1, 2 HAVING count(*) > 1"),
    "sql_grouped_expression": (f"SELECT CONCAT({_TYPE}, '!') AS loud, SUM({_CENTS}) + COUNT(*) AS total, SUM({_CENTS}) AS cents FROM ev GROUP BY {_TYPE}", "SELECT t || '!' AS loud, CAST(sum(c) + count(*) AS BIGINT) AS total, CAST(sum(c) AS BIGINT) AS cents FROM ev GROUP BY t"),
    "sql_array_aggregates": (f"SELECT person, ARRAY_TO_STRING(ARRAY_CONCAT_AGG([{_TYPE}, 'x'] ORDER BY _key LIMIT 2), ',') AS both, ARRAY_LENGTH(ARRAY_AGG(NULLIF({_TYPE}, 'view') IGNORE NULLS)) AS others, STRING_AGG(DISTINCT {_TYPE} ORDER BY {_TYPE} DESC) AS types FROM ev GROUP BY person", "SELECT usr AS person, array_to_string(flatten(list([t, 'x'] ORDER BY k)[1:2]), ',') AS both, count(*) FILTER (WHERE t <> 'view') AS others, array_to_string(list(DISTINCT t ORDER BY t DESC), ',') AS types FROM ev GROUP BY 1"),
    "sql_delimiters": (f"SELECT person, STRING_AGG({_TYPE}, CONCAT('<', LEFT({_TYPE}, 1), '>') ORDER BY _key LIMIT 3) AS t, STRING_AGG({_TYPE}, NULLIF({_TYPE}, 'view') ORDER BY _key LIMIT 2) AS u FROM ev GROUP BY person", "SELECT usr AS person, list_reduce(l[1:3], lambda a, b: a || '<' || left(l[1], 1) || '>' || b) AS t, CASE WHEN l[1] <> 'view' THEN list_reduce(l[1:2], lambda a, b: a || l[1] || b) WHEN len(l) > 1 AND l[2] <> 'view' THEN l[2] END AS u FROM (SELECT usr, list(t ORDER BY k) AS l FROM ev GROUP BY 1)"),
    "sql_null_order": (f"SELECT person, STRING_AGG(IFNULL(t, '-'), '' ORDER BY t NULLS LAST, _key LIMIT 4) AS last, STRING_AGG(IFNULL(t, '-'), '' ORDER BY t DESC NULLS FIRST, _key LIMIT 4) AS first FROM lettered GROUP BY person", "SELECT usr AS person, array_to_string(list(coalesce(t, '-') ORDER BY t NULLS LAST, k)[1:4], '') AS last, array_to_string(list(coalesce(t, '-') ORDER BY t DESC NULLS FIRST, k)[1:4], '') AS first FROM (SELECT usr, k, CASE WHEN t <> 'view' THEN left(t, 1) END AS t FROM ev) GROUP BY 1"),
    "sql_bits": (f"SELECT {_TYPE} AS event_type, BIT_AND({_CENTS} | 1) AS a, BIT_OR(MOD({_CENTS}, 64)) AS o, BIT_XOR({_CENTS}) AS x, LOGICAL_AND({_CENTS} > 100) AS every, LOGICAL_OR({_CENTS} > 9000) AS some FROM ev GROUP BY 1", "SELECT t AS event_type, bit_and(c | 1) AS a, bit_or(c % 64) AS o, bit_xor(c) AS x, bool_and(c > 100) AS every, bool_or(c > 9000) AS some FROM ev GROUP BY 1"),
    "sql_spreads": (f"SELECT {_TYPE} AS event_type, ROUND(STDDEV_POP({_CENTS}), 4) AS sp, ROUND(STDDEV_SAMP({_CENTS}), 4) AS ss, ROUND(VAR_SAMP({_CENTS}) / 1000000, 4) AS vs, ROUND(VARIANCE({_CENTS}) / 1000000, 4) AS v, ROUND(COVAR_POP({_CENTS}, MOD({_CENTS}, 7)), 3) AS cp, ROUND(COVAR_SAMP({_CENTS}, MOD({_CENTS}, 7)), 3) AS cs FROM ev GROUP BY 1", "SELECT t AS event_type, round(stddev_pop(c), 4) AS sp, round(stddev_samp(c), 4) AS ss, round(var_samp(c) / 1000000, 4) AS vs, round(var_samp(c) / 1000000, 4) AS v, round(covar_pop(c, c % 7), 3) AS cp, round(covar_samp(c, c % 7), 3) AS cs FROM ev GROUP BY 1"),
    "sql_merged_sketches": ("SELECT COUNT(*) AS n, HLL_COUNT.MERGE(sketch) AS people, HLL_COUNT.EXTRACT(HLL_COUNT.MERGE_PARTIAL(sketch)) = HLL_COUNT.MERGE(sketch) AS same FROM sketched", "SELECT count(DISTINCT t) AS n, count(DISTINCT usr) AS people, true AS same FROM ev"),
    "sql_as_of_or_later": (f"SELECT {_KEY}, IFNULL(ARRAY_LENGTH(ev['view']), 0) AS n FROM hist(with_history => TRUE, after_or_equal => TIMESTAMP '2024-01-10 00:00:00+00', before => TIMESTAMP '2024-01-20 00:00:00+00')", "SELECT k AS row_key, count(*) FILTER (WHERE t = 'view') AS n FROM hist WHERE us >= epoch_us(TIMESTAMP '2024-01-10') AND us < epoch_us(TIMESTAMP '2024-01-20') GROUP BY 1"),
    "sql_safe": (f"SELECT {_KEY}, SAFE.SUBSTR({_TYPE}, 1, 3 - MOD({_CENTS}, 5)) AS head, SAFE_CAST({_TYPE} AS INT64) IS NULL AS text, {_TYPE} || '-' || CAST({_CENTS} AS STRING) AS joined FROM ev", "SELECT k AS row_key, CASE WHEN c % 5 <= 3 THEN substr(t, 1, 3 - c % 5) END AS head, true AS text, t || '-' || c AS joined FROM ev"),
}
#: What isn't served: group, statement, and the error that turns it away.
TURNED_AWAY = [
    ("statement", "WITH a AS (SELECT 2) SELECT 2", "InvalidArgument"), ("statement", "INSERT INTO ev VALUES (1)", "InvalidArgument"), ("statement", "CREATE TABLE q (a INT64)", "InvalidArgument"), ("set", "SELECT 2 UNION ALL SELECT 3", "InvalidArgument"), ("set", "SELECT 2 INTERSECT DISTINCT SELECT 2", "InvalidArgument"), ("set", "SELECT 2 EXCEPT DISTINCT SELECT 2", "InvalidArgument"),
    ("source", "SELECT q.a FROM (SELECT 2 AS a) AS q", "InvalidArgument"), ("source", "SELECT a FROM UNNEST([2, 3]) AS a", "Unimplemented"), ("source", "SELECT _key FROM ev TABLESAMPLE SYSTEM (5 PERCENT)", "Unimplemented"), ("join", "SELECT 2 FROM ev LEFT JOIN hist ON TRUE", "InvalidArgument"), ("join", "SELECT 2 FROM ev CROSS JOIN hist", "InvalidArgument"), ("join", "SELECT 2 FROM ev, hist", "InvalidArgument"),
    ("subquery", "SELECT (SELECT 2) + 1", "InvalidArgument"), ("subquery", "SELECT 2 IN (SELECT 2)", "InvalidArgument"), ("subquery", "SELECT EXISTS (SELECT 2)", "InvalidArgument"), ("subquery", "SELECT ARRAY(SELECT 2)", "InvalidArgument"), ("projection", "SELECT AS VALUE 2", "Unimplemented"), ("projection", "SELECT AS STRUCT 2 AS a", "Unimplemented"),
    ("grouping", "SELECT COUNT(*) FROM ev GROUP BY ROLLUP(_key)", "Unimplemented"), ("grouping", "SELECT COUNT(*) FROM ev GROUP BY CUBE(_key)", "Unimplemented"), ("window", "SELECT SUM(2) OVER () FROM ev", "Unimplemented"), ("window", "SELECT ROW_NUMBER() FROM ev", "Unimplemented"), ("window", "SELECT _key FROM ev QUALIFY TRUE", "Unimplemented"), ("window", "SELECT _key FROM ev WINDOW w AS ()", "Unimplemented"),
    ("aggregate", "SELECT APPROX_TOP_COUNT(_key, 2) FROM ev", "Unimplemented"), ("aggregate", "SELECT MIN(_key HAVING MAX _key) FROM ev", "Unimplemented"), ("aggregate", "SELECT SUM(COUNT(*)) FROM ev", "InvalidArgument"), ("aggregate", "SELECT SAFE.SUM(2) FROM ev", "InvalidArgument"), ("pattern", "SELECT 'p' LIKE ANY ('p', 'q')", "Unimplemented"), ("pattern", "SELECT REGEXP_CONTAINS('p', '(?=p)')", "InvalidArgument"), ("type", "SELECT NUMERIC '2'", "Unimplemented"), ("type", "SELECT CAST(2 AS NUMERIC)", "Unimplemented"), ("type", "SELECT CAST('p' AS STRING(4))", "Unimplemented"),
    ("order", "SELECT _key FROM ev ORDER BY cf['type']", "InvalidArgument"), ("order", "SELECT 2 OFFSET 2", "InvalidArgument"), ("name", "SELECT ev FROM ev", "Unimplemented"), ("name", "SELECT nope FROM ev", "InvalidArgument"), ("name", "SELECT 2 FROM nowhere", "NotFound"), ("name", "SELECT NO_SUCH(2)", "InvalidArgument"), ("type", "SELECT 2 + 'p'", "InvalidArgument"), ("hint", "@{fast=true} SELECT 2", "Unimplemented"), ("time", "SELECT TIMESTAMP_SECONDS(2) - TIMESTAMP_SECONDS(1)", "Unimplemented"),
    ("argument", "SELECT _key FROM ev(latest_n => 2)", "InvalidArgument"), ("argument", "SELECT _key FROM ev(before => TIMESTAMP_SECONDS(2))", "InvalidArgument"), ("nesting", "SELECT " + "(" * 400 + "2" + ")" * 400, "InvalidArgument"),
]


def turned_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement with the error that it gets."""
    made, found = catalog(spark, sf_dir), []
    for group, sql, _ in TURNED_AWAY:
        try:
            run(spark, made, sql)
            found.append((group, sql, "none"))
        except WideleafError as e:
            found.append((group, sql, type(e).__name__))
    return spark.createDataFrame(found, "kind string, statement string, error string")


_PARAMS = {"sql_parameters": {"low": b"u000010", "cents": 4000}}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    fields = (("person", "STRING"), ("item", "STRING"))
    tables = {"ev": Table(C.events_by_row(spark, sf_dir), {"cf": "bytes"}, fields), "hist": Table(C.events_by_user(spark, sf_dir), {"ev": "bytes"}), "ord": Table(C.orders(spark, sf_dir), {"o": "bytes"}, fields)}
    return Catalog(tables, views={"all_events": f"SELECT _key, {_TYPE} AS event_type, {_CENTS} AS cents FROM ev", "dear": "SELECT * FROM all_events WHERE cents > 3000", "lettered": f"SELECT _key, person, LEFT(NULLIF({_TYPE}, 'view'), 1) AS t FROM ev", "sketched": f"SELECT {_TYPE} AS t, HLL_COUNT.INIT(person) AS sketch FROM ev GROUP BY 1", "nothing": "SELECT _key FROM ev LIMIT 0"})


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, catalog(spark, sf_dir), SELECTS[name][0], _PARAMS.get(name), ordered=False)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in SELECTS} | {"sql_turned_away": turned_away}


def oracle_sql() -> dict[str, str]:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({', '.join(map(quoted, row))})" for row in TURNED_AWAY)
    return {name: f"WITH {_SOURCES}{sql}" for name, (_, sql) in SELECTS.items() if sql} | {"sql_turned_away": f"SELECT * FROM (VALUES {listed}) AS v(kind, statement, error)"}
