"""Functions and operators of the SELECT dialect over the orders' cells: each expression beside what DuckDB calls the same.

Every query selects the key and a group of expressions for all rows.  P, S, C, D and T stand for a row's priority, status, cents (an
integer), date and the time of its date; in DuckDB's they are p, s, c, d and t.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wideleaf import selects
from wideleaf.dialect import run

_NAMES = {"P": "CAST(o['priority'] AS STRING)", "S": "CAST(o['status'] AS STRING)", "C": "CAST(CAST(o['cents'] AS STRING) AS INT64)", "D": "CAST(CAST(o['date'] AS STRING) AS DATE)", "T": "TIMESTAMP(CAST(CAST(o['date'] AS STRING) AS DATE))"}
_A, _a = "(MOD({C}, 97) / 100)", "((c % 97) / 100)"

#: group: (expression in the dialect, expression in DuckDB); both give text, whole numbers, booleans or rounded floats.
PAIRS: dict[str, list[tuple[str, str]]] = {
    "text_lengths": [
        ("CONCAT({P}, {S})", "p || s"), ("CHAR_LENGTH({P})", "length(p)"), ("CHARACTER_LENGTH(CONCAT({P}, 'ß'))", "length(p) + 1"), ("BYTE_LENGTH(CONCAT({P}, 'ß'))", "length(p) + 2"), ("OCTET_LENGTH({P})", "strlen(p)"), ("LENGTH(CAST({P} AS BYTES))", "strlen(p)"),
        ("ASCII({S})", "ascii(s)::BIGINT"), ("UNICODE({S})", "unicode(s)::BIGINT"), ("CHR(65 + MOD({C}, 26))", "chr((65 + c % 26)::INT)"), ("{P} || {S}", "p || s"), ("LOWER({P})", "lower(p)"), ("SOUNDEX({S})", "s || '000'"),
        ("INITCAP({P})", "substr(p, 1, 2) || array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN string_split(substr(p, 3), ' ')], ' ')"),
    ],
    "text_parts": [
        ("SUBSTRING({P}, 2, 3)", "substr(p, 2, 3)"), ("ENDS_WITH({P}, 'W')", "suffix(p, 'W')"), ("STARTS_WITH({P}, '1-')", "prefix(p, '1-')"), ("LEFT({P}, 4)", "left(p, 4)"), ("RIGHT({P}, 4)", "right(p, 4)"), ("REPLACE({P}, 'I', '*')", "replace(p, 'I', '*')"), ("REPEAT({S}, 3)", "repeat(s, 3)"), ("REVERSE({P})", "reverse(p)"),
        ("TRIM(CONCAT('  ', {P}, ' '))", "trim('  ' || p || ' ')"), ("LTRIM({P}, '123')", "ltrim(p, '123')"), ("RTRIM({P}, 'HW')", "rtrim(p, 'HW')"), ("LPAD({S}, 4, 'ab')", "lpad(s, 4, 'ab')"), ("RPAD({S}, 4, 'ab')", "rpad(s, 4, 'ab')"), ("TRANSLATE({P}, '-ABC', '_xyz')", "translate(p, '-ABC', '_xyz')"), ("INSTR({P}, 'E')", "instr(p, 'E')"), ("STRPOS({P}, 'E')", "strpos(p, 'E')"),
        ("SPLIT({P}, '-')[OFFSET(1)]", "string_split(p, '-')[2]"),
    ],
    "text_patterns": [
        ("REGEXP_CONTAINS({P}, '^[1-3]')", "regexp_matches(p, '^[1-3]')"), ("REGEXP_SUBSTR({P}, '[[:upper:]]+')", "regexp_extract(p, '[A-Z]+')"), ("REGEXP_EXTRACT({P}, r'-(\\w)')", "regexp_extract(p, '-(\\w)', 1)"), ("ARRAY_TO_STRING(REGEXP_EXTRACT_ALL({P}, '[A-M]'), '.')", "array_to_string(regexp_extract_all(p, '[A-M]'), '.')"),
        ("REGEXP_REPLACE({P}, '[AEIOU]', '_')", "regexp_replace(p, '[AEIOU]', '_', 'g')"), ("REGEXP_REPLACE({P}, r'(\\d)-(.)', r'\\2:\\1')", "regexp_replace(p, '(\\d)-(.)', '\\2:\\1')"), ("REGEXP_INSTR({P}, '[A-Z]')", "3::BIGINT"), ("{P} LIKE '%E%'", "p LIKE '%E%'"), ("{P} NOT LIKE '_-H%'", "p NOT LIKE '_-H%'"), ("REGEXP_CONTAINS({P}, r'\\Q-\\E\\pL{{3}}$')", "regexp_matches(p, '-[A-Z]{{3}}$')"),
    ],
    "by_row": [
        ("REGEXP_CONTAINS({P}, CONCAT('^[', LEFT({P}, 1), '3]'))", "true"), ("REGEXP_EXTRACT({P}, CONCAT('(.)', RIGHT({P}, 1), '$'))", "substr(p, length(p) - 1, 1)"), ("ARRAY_LENGTH(REGEXP_EXTRACT_ALL({P}, IF({S} = 'F', '[A-M]', '[N-Z]')))", "len(regexp_extract_all(p, CASE WHEN s = 'F' THEN '[A-M]' ELSE '[N-Z]' END))"), ("REGEXP_REPLACE({P}, {S}, CONCAT('<', {S}, r'\\0>'))", "replace(p, s, '<' || s || s || '>')"),
        ("ROUND({C} / 700, MOD({C}, 3))", "CASE c % 3 WHEN 0 THEN round(c / 700, 0) WHEN 1 THEN round(c / 700, 1) ELSE round(c / 700, 2) END"), ("TRUNC({C} / 700, 0 - MOD({C}, 2))", "CASE c % 2 WHEN 0 THEN trunc(c / 700) ELSE trunc(c / 7000) * 10 END"), ("IFERROR(CAST(REGEXP_CONTAINS({P}, CONCAT({S}, '(')) AS STRING), 'bad')", "'bad'"),
    ],
    "codes": [
        ("TO_HEX(CAST({P} AS BYTES))", "lower(hex(p))"), ("CAST(FROM_HEX(TO_HEX(CAST({P} AS BYTES))) AS STRING)", "p"), ("TO_BASE64(CAST({P} AS BYTES))", "to_base64(encode(p))"), ("CAST(FROM_BASE64(TO_BASE64(CAST({P} AS BYTES))) AS STRING)", "p"), ("TO_BASE32(CAST({S} AS BYTES))", "CASE s WHEN 'F' THEN 'IY======' WHEN 'O' THEN 'J4======' ELSE 'KA======' END"),
        ("CAST(FROM_BASE32(TO_BASE32(CAST({P} AS BYTES))) AS STRING)", "p"), ("SAFE_CONVERT_BYTES_TO_STRING(CAST({P} AS BYTES))", "p"), ("TO_CODE_POINTS({S})[OFFSET(0)]", "unicode(s)::BIGINT"), ("CODE_POINTS_TO_STRING([65, 66 + MOD({C}, 10)])", "'A' || chr((66 + c % 10)::INT)"), ("TO_HEX(CODE_POINTS_TO_BYTES([255, 16 + MOD({C}, 10)]))", "'ff1' || (c % 10)"),
        ("TO_INT64(CODE_POINTS_TO_BYTES([0, 0, 0, 0, 0, 0, MOD({C}, 256), 7]))", "c % 256 * 256 + 7"), ("TO_FLOAT64(CODE_POINTS_TO_BYTES([64, IF(MOD({C}, 2) = 0, 8, 0), 0, 0, 0, 0, 0, 0]))", "CASE WHEN c % 2 = 0 THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END"), ("TO_FLOAT32(CODE_POINTS_TO_BYTES([64, IF(MOD({C}, 2) = 0, 64, 0), 0, 0])) > 2.5", "c % 2 = 0"),
        ("ARRAY_LENGTH(TO_VECTOR32(CODE_POINTS_TO_BYTES([64, 0, 0, 0, 64, 64, 0, 0])))", "2::BIGINT"), ("TO_VECTOR64(CODE_POINTS_TO_BYTES([64, MOD({C}, 2) * 8, 0, 0, 0, 0, 0, 0]))[OFFSET(0)]", "CASE WHEN c % 2 = 1 THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END"), ("FORMAT('%d-%s', {C}, {S})", "c::VARCHAR || '-' || s"), ("CAST({C} AS STRING)", "c::VARCHAR"),
    ],
    "numbers": [
        ("SIGN({C} - 10000000)", "sign(c - 10000000)::BIGINT"), ("ABS(5000000 - {C})", "abs(5000000 - c)"), ("TRUNC({C} / 700)", "trunc(c / 700)"), ("TRUNC({C} / 700, 1)", "trunc(c / 700 * 10) / 10"), ("CEIL({C} / 700)", "ceil(c / 700)"), ("CEILING({C} / 700)", "ceil(c / 700)"), ("FLOOR({C} / 700)", "floor(c / 700)"), ("ROUND({C} / 700)", "round(c / 700)"), ("POW(MOD({C}, 11), 3)", "pow(c % 11, 3)"), ("POWER(MOD({C}, 7), 2)", "pow(c % 7, 2)"),
        ("ROUND(EXP(MOD({C}, 10)), 4)", "round(exp(c % 10), 4)"), ("ROUND(LN({C} + 1), 6)", "round(ln(c + 1), 6)"), ("ROUND(LOG10({C} + 1), 6)", "round(log10(c + 1), 6)"), ("ROUND(LOG({C} + 1, 2), 6)", "round(ln(c + 1) / ln(2), 6)"), ("ROUND(SQRT({C}), 6)", "round(sqrt(c), 6)"), ("IS_INF(IEEE_DIVIDE(1, MOD({C}, 2)))", "c % 2 = 0"), ("IS_NAN(IEEE_DIVIDE(0, MOD({C}, 2)))", "c % 2 = 0"),
        ("GREATEST({C}, 9000000, MOD({C}, 7))", "greatest(c, 9000000, c % 7)"), ("LEAST({C}, 9000000)", "least(c, 9000000)"), ("DIV({C}, 13)", "c // 13"), ("MOD({C}, 13)", "c % 13"), ("-{C}", "-c"), ("+{C}", "c"), ("~{C}", "~c"), ("{C} | 5", "c | 5"), ("{C} ^ 5", "xor(c, 5::BIGINT)"), ("{C} << 2", "c << 2"), ("{C} * 3 - 7", "c * 3 - 7"),
    ],
    "safe_numbers": [
        ("CAST(SAFE_ADD({C}, 9223372036854775000) AS STRING)", "CASE WHEN c <= 807 THEN c + 9223372036854775000 END::VARCHAR"), ("SAFE_SUBTRACT({C}, 1000)", "c - 1000"), ("CAST(SAFE_MULTIPLY({C}, 4611686018427387904) AS STRING)", "CASE WHEN c <= 1 THEN c * 4611686018427387904 END::VARCHAR"), ("SAFE_NEGATE({C})", "-c"), ("SAFE_DIVIDE({C}, MOD({C}, 2))", "CASE WHEN c % 2 = 1 THEN c::DOUBLE END"), ("CAST(SAFE.DIV({C}, MOD({C}, 3)) AS STRING)", "CASE WHEN c % 3 > 0 THEN c // (c % 3) END::VARCHAR"),
        ("SAFE.SQRT(5 - MOD({C}, 10)) IS NULL", "c % 10 > 5"), ("SAFE_CAST({P} AS INT64) IS NULL", "TRY_CAST(p AS BIGINT) IS NULL"), ("SAFE_CAST(LEFT({P}, 1) AS INT64)", "left(p, 1)::BIGINT"), ("CAST(MOD({C}, 2) AS BOOL)", "c % 2 = 1"), ("RAND() BETWEEN 0 AND 1", "true"),
    ],
    "trigonometry": [
        (f"ROUND(ACOS({_A}), 6)", f"round(acos({_a}), 6)"), (f"ROUND(ASIN({_A}), 6)", f"round(asin({_a}), 6)"), (f"ROUND(ATAN({_A}), 6)", f"round(atan({_a}), 6)"), (f"ROUND(ATAN2({_A}, 2), 6)", f"round(atan2({_a}, 2), 6)"), (f"ROUND(COS({_A}), 6)", f"round(cos({_a}), 6)"), (f"ROUND(SIN({_A}), 6)", f"round(sin({_a}), 6)"), (f"ROUND(TAN({_A}), 6)", f"round(tan({_a}), 6)"),
        (f"ROUND(COSH({_A}), 6)", f"round(cosh({_a}), 6)"), (f"ROUND(SINH({_A}), 6)", f"round(sinh({_a}), 6)"), (f"ROUND(TANH({_A}), 6)", f"round(tanh({_a}), 6)"), (f"ROUND(ACOSH({_A} + 1.5), 6)", f"round(acosh({_a} + 1.5), 6)"), (f"ROUND(ASINH({_A}), 6)", f"round(asinh({_a}), 6)"), (f"ROUND(ATANH({_A} / 2), 6)", f"round(atanh({_a} / 2), 6)"),
        (f"ROUND(COT({_A} + 0.5), 6)", f"round(1 / tan({_a} + 0.5), 6)"), (f"ROUND(COTH({_A} + 0.5), 6)", f"round(1 / tanh({_a} + 0.5), 6)"), (f"ROUND(CSC({_A} + 0.5), 6)", f"round(1 / sin({_a} + 0.5), 6)"), (f"ROUND(CSCH({_A} + 0.5), 6)", f"round(1 / sinh({_a} + 0.5), 6)"), (f"ROUND(SEC({_A}), 6)", f"round(1 / cos({_a}), 6)"), (f"ROUND(SECH({_A}), 6)", f"round(1 / cosh({_a}), 6)"), ("ROUND(PI(), 10)", "round(pi(), 10)"),
    ],
    "arrays": [
        ("ARRAY_LENGTH(ARRAY_CONCAT([{C}], [1, 2]))", "3::BIGINT"), ("ARRAY_REVERSE([{C}, 2, 3])[OFFSET(2)]", "c"), ("ARRAY_FIRST([{C}, 1])", "c"), ("ARRAY_LAST([1, {C}])", "c"), ("ARRAY_TO_STRING(ARRAY_FIRST_N(SPLIT({P}, ''), 3), '.')", "array_to_string(string_split(p, '')[1:3], '.')"), ("ARRAY_TO_STRING(ARRAY_LAST_N(SPLIT({P}, ''), 2), '.')", "array_to_string(string_split(p, '')[-2:], '.')"), ("ARRAY_TO_STRING(ARRAY_SLICE(SPLIT({P}, ''), 1, 3), '')", "p[2:4]"),
        ("ARRAY_INCLUDES([1, 2, 3], MOD({C}, 6))", "c % 6 BETWEEN 1 AND 3"), ("ARRAY_INCLUDES_ALL([1, 2, 3], [1, MOD({C}, 6)])", "c % 6 BETWEEN 1 AND 3"), ("ARRAY_INCLUDES_ANY([1, 2, 3], [7, MOD({C}, 6)])", "c % 6 BETWEEN 1 AND 3"), ("ARRAY_IS_DISTINCT([1, MOD({C}, 3)])", "c % 3 <> 1"), ("CAST(ARRAY_OFFSET([5, 6, 7], 5 + MOD({C}, 4)) AS STRING)", "CASE WHEN c % 4 < 3 THEN c % 4 END::VARCHAR"), ("ARRAY_LENGTH(ARRAY_OFFSETS([0, 1, 0], MOD({C}, 2)))", "2 - c % 2"),
        ("ARRAY_LENGTH(GENERATE_ARRAY(1, MOD({C}, 9), 2))", "len(range(1, c % 9 + 1, 2))"), ("ROUND(EUCLIDEAN_DISTANCE([0.0, 3.0], [MOD({C}, 5) + 0.0, 0.0]), 6)", "round(sqrt(9 + (c % 5) * (c % 5)), 6)"), ("ROUND(COSINE_DISTANCE([1.0, 0.0], [1.0, MOD({C}, 5) + 0.0]), 6)", "round(1 - 1 / sqrt(1 + (c % 5) * (c % 5)), 6)"), ("CAST([1, 2, 3][SAFE_OFFSET(MOD({C}, 5))] AS STRING)", "[1, 2, 3][(c % 5 + 1)::INT]::VARCHAR"), ("MOD({C}, 5) IN UNNEST([1, 2])", "c % 5 IN (1, 2)"),
        ("MAP_CONTAINS_KEY(o, b'cents')", "true"), ("MAP_EMPTY(o)", "false"), ("ARRAY_LENGTH(MAP_ENTRIES(o))", "4::BIGINT"), ("CAST(MAP_ENTRIES(o)[OFFSET(3)].value AS STRING)", "s"), ("CAST(MAP_KEYS(o)[OFFSET(0)] AS STRING)", "'cents'"),
    ],
    "conditions": [
        ("COALESCE(IF(MOD({C}, 2) = 0, NULL, {S}), 'none')", "CASE WHEN c % 2 = 0 THEN 'none' ELSE s END"), ("IFNULL(NULLIF({S}, 'F'), 'f')", "coalesce(nullif(s, 'F'), 'f')"), ("CAST(NULLIFERROR(DIV({C}, MOD({C}, 2))) AS STRING)", "CASE WHEN c % 2 = 1 THEN c END::VARCHAR"), ("IFERROR(DIV({C}, MOD({C}, 2)), 0)", "CASE WHEN c % 2 = 1 THEN c ELSE 0 END"), ("NULLIF({S}, 'F') IS DISTINCT FROM 'O'", "nullif(s, 'F') IS DISTINCT FROM 'O'"), ("NULLIF({S}, 'F') IS NOT DISTINCT FROM NULL", "s = 'F'"),
        ("(NULLIF({S}, 'F') = 'O') IS UNKNOWN", "s = 'F'"), ("({S} = 'O') IS TRUE", "s = 'O'"), ("({S} = 'O') IS NOT FALSE", "s = 'O'"), ("CASE {S} WHEN 'F' THEN 'one' WHEN 'O' THEN 'two' END", "CASE s WHEN 'F' THEN 'one' WHEN 'O' THEN 'two' END"), ("{S} = 'F' OR MOD({C}, 2) = 0 AND NOT {S} = 'O'", "s = 'F' OR c % 2 = 0 AND NOT s = 'O'"), ("{S} NOT IN ('F', 'O')", "s NOT IN ('F', 'O')"), ("{C} NOT BETWEEN 5000000 AND 9000000", "c NOT BETWEEN 5000000 AND 9000000"), ("{S} <> 'F'", "s <> 'F'"), ("{S} >= 'O'", "s >= 'O'"),
    ],
    "json": [
        ("JSON_EXTRACT_SCALAR(CONCAT('{{\"a\": ', CAST({C} AS STRING), '}}'), '$.a')", "c::VARCHAR"), ("JSON_VALUE(CONCAT('[\"', {S}, '\"]'), '$[0]')", "s"), ("JSON_QUERY(CONCAT('{{\"a\": [', CAST({C} AS STRING), ', null]}}'), '$.a')", "'[' || c || ',null]'"), ("JSON_EXTRACT(CONCAT('{{\"a\": \"', {S}, '\"}}'), '$.a')", "'\"' || s || '\"'"), ("ARRAY_TO_STRING(JSON_QUERY_ARRAY(CONCAT('[1, \"', {S}, '\"]')), ';')", "'1;\"' || s || '\"'"), ("ARRAY_LENGTH(JSON_EXTRACT_ARRAY('[1, [2, 3]]'))", "2::BIGINT"),
        ("ARRAY_TO_STRING(JSON_VALUE_ARRAY(CONCAT('[1, \"', {S}, '\"]')), ';')", "'1;' || s"), ("ARRAY_TO_STRING(JSON_EXTRACT_STRING_ARRAY(CONCAT('[\"', {S}, '\"]')), ';')", "s"), ("TO_JSON_STRING([{C}, 1])", "'[' || c || ',1]'"), ("JSON_VALUE('{{\"a\": {{}}}}', '$.a') IS NULL", "true"),
    ],
    "times": [
        ("CURRENT_TIMESTAMP() > {T}", "true"), ("CURRENT_DATE() > {D}", "true"), ("UNIX_MICROS(TIMESTAMP({D}))", "epoch_us(t)"), ("UNIX_SECONDS(TIMESTAMP(CONCAT(CAST({D} AS STRING), ' 01:02:03+00')))", "epoch_us(t) // 1000000 + 3723"), ("UNIX_MILLIS({T})", "epoch_us(t) // 1000"), ("UNIX_SECONDS({T})", "epoch_us(t) // 1000000"), ("UNIX_MICROS(TIMESTAMP_MICROS({C}))", "c"), ("UNIX_MILLIS(TIMESTAMP_MILLIS({C}))", "c"), ("UNIX_SECONDS(TIMESTAMP_SECONDS({C}))", "c"),
        ("UNIX_MICROS(TIMESTAMP_FROM_UNIX_MICROS({C}))", "c"), ("UNIX_MILLIS(TIMESTAMP_FROM_UNIX_MILLIS({C}))", "c"), ("UNIX_SECONDS(TIMESTAMP_FROM_UNIX_SECONDS({C}))", "c"), ("UNIX_DATE({D})", "(d - DATE '1970-01-01')::BIGINT"), ("DATE_FROM_UNIX_DATE(UNIX_DATE({D})) = {D}", "true"), ("STRING({T})", "strftime(t, '%Y-%m-%d %H:%M:%S+00')"), ("CAST(DATE({T}) AS STRING)", "d::VARCHAR"), ("CAST(DATE(2000 + MOD({C}, 20), 2, 1 + MOD({C}, 28)) AS STRING)", "make_date((2000 + c % 20)::INT, 2, (1 + c % 28)::INT)::VARCHAR"),
        ("FORMAT_TIMESTAMP('%Y/%m/%d %H', {T})", "strftime(t, '%Y/%m/%d %H')"), ("FORMAT_DATE('%d.%m.%y %j', {D})", "strftime(d, '%d.%m.%y %j')"), ("UNIX_SECONDS(PARSE_TIMESTAMP('%Y-%m-%d %H:%M', CONCAT(CAST({D} AS STRING), ' 05:06')))", "epoch_us(t) // 1000000 + 18360"), ("CAST(PARSE_DATE('%Y%m%d', FORMAT_DATE('%Y%m%d', {D})) AS STRING)", "d::VARCHAR"),
    ],
    "time_steps": [
        ("UNIX_SECONDS(TIMESTAMP_ADD({T}, INTERVAL 90 MINUTE))", "epoch_us(t) // 1000000 + 5400"), ("UNIX_SECONDS(TIMESTAMP_SUB({T}, INTERVAL 1 DAY))", "epoch_us(t) // 1000000 - 86400"), ("CAST(DATE_ADD({D}, INTERVAL 1 MONTH) AS STRING)", "CAST(d + INTERVAL 1 MONTH AS DATE)::VARCHAR"), ("CAST(DATE_SUB({D}, INTERVAL 2 WEEK) AS STRING)", "CAST(d - INTERVAL 14 DAY AS DATE)::VARCHAR"), ("TIMESTAMP_DIFF({T}, TIMESTAMP '1995-01-01 12:00:00+00', HOUR)", "(epoch_us(t) - epoch_us(TIMESTAMP '1995-01-01 12:00:00')) // 3600000000"),
        ("DATE_DIFF({D}, DATE '1995-01-31', MONTH)", "date_diff('month', DATE '1995-01-31', d)"), ("STRING(TIMESTAMP_TRUNC(TIMESTAMP_ADD({T}, INTERVAL 100 MINUTE), HOUR))", "strftime(t + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S+00')"), ("CAST(DATE_TRUNC({D}, QUARTER) AS STRING)", "date_trunc('quarter', d)::DATE::VARCHAR"), ("CAST(DATE_TRUNC({D}, ISOWEEK) AS STRING)", "date_trunc('week', d)::DATE::VARCHAR"), ("CAST(LAST_DAY({D}) AS STRING)", "last_day(d)::VARCHAR"),
        ("ARRAY_LENGTH(GENERATE_DATE_ARRAY({D}, LAST_DAY({D})))", "(last_day(d) - d + 1)::BIGINT"), ("ARRAY_LENGTH(GENERATE_TIMESTAMP_ARRAY({T}, TIMESTAMP_ADD({T}, INTERVAL 1 DAY), INTERVAL 6 HOUR))", "5::BIGINT"), ("EXTRACT(YEAR FROM {D})", "extract(year FROM d)"), ("EXTRACT(DAYOFWEEK FROM {D})", "extract(dow FROM d) + 1"), ("EXTRACT(DAYOFYEAR FROM {D})", "extract(doy FROM d)"), ("EXTRACT(HOUR FROM TIMESTAMP_ADD({T}, INTERVAL 7 HOUR))", "7::BIGINT"), ("CAST({D} + 3 AS STRING)", "(d + 3)::VARCHAR"), ("CAST({D} - 3 AS STRING)", "(d - 3)::VARCHAR"),
        ("UNIX_SECONDS({T} + INTERVAL 2 HOUR)", "epoch_us(t) // 1000000 + 7200"),
    ],
}


def _columns(group: str) -> tuple[str, str]:
    ours = ", ".join(f"{x.format(**_NAMES)} AS x{i}" for i, (x, _) in enumerate(PAIRS[group]))
    theirs = ", ".join(f"{y.replace('{{', '{').replace('}}', '}')} AS x{i}" for i, (_, y) in enumerate(PAIRS[group]))
    return f"SELECT CAST(_key AS STRING) AS row_key, {ours} FROM ord", f"WITH {selects._SOURCES}, o AS (SELECT *, d::TIMESTAMP AS t FROM ord) SELECT k AS row_key, {theirs} FROM o"


def _query(group: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, selects.catalog(spark, sf_dir), _columns(group)[0], ordered=False)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"fn_{group}": _query(group) for group in PAIRS}


def oracle_sql() -> dict[str, str]:
    return {f"fn_{group}": _columns(group)[1] for group in PAIRS}
