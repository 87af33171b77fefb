"""The library from SQL: its expressions as functions, and its reports as tables of a year or of a range of years.

``register_functions`` needs no data. ``register_reports`` names label traces and the reports on them; Spark works a report
out when a query reads it, with the query's own filters and columns pushed into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.operators.paths import links
from tracemill.plans.analyses import PAIRS_AS_MIN_COUNT, reports

# Name, arguments, result and the expression behind a function; each says in SQL what the column function of that name does.
SCALARS = [
    (
        "ip_to_number", "ip STRING", "BIGINT",
        "CASE WHEN size(split(ip, '[.]')) >= 4 THEN aggregate(slice(split(ip, '[.]'), 1, 4), 0L, "
        "(number, part) -> try_add(shiftleft(number, 8), try_cast(part AS BIGINT))) END",
    ),
    (
        "number_to_ip", "number BIGINT", "STRING",
        "concat_ws('.', shiftright(number, 24) & 255, shiftright(number, 16) & 255, shiftright(number, 8) & 255, number & 255)",
    ),
    ("prefix_length", "prefix STRING", "INT", "try_cast(get(split(prefix, '/'), 1) AS INT)"),
    (
        "prefix_start", "prefix STRING", "BIGINT",
        "CASE WHEN prefix_length(prefix) BETWEEN 0 AND 32 "
        "THEN ip_to_number(get(split(prefix, '/'), 0)) & shiftleft(-1L, 32 - prefix_length(prefix)) END",
    ),
    ("slash24", "number BIGINT", "BIGINT", "number & -256L"),
    ("slash24_text", "ip STRING", "STRING", "CASE WHEN contains(ip, '.') THEN regexp_replace(ip, '[.][^.]*$', '') ELSE '' END"),
    ("utc_date", "ts TIMESTAMP", "DATE", "date_from_unix_date(CAST(floor(unix_seconds(ts) / 86400) AS INT))"),
    ("utc_year", "ts TIMESTAMP", "INT", "year(utc_date(ts))"),
    ("month_text", "ts TIMESTAMP", "STRING", "date_format(utc_date(ts), 'yyyyMM')"),
    ("day_text", "ts TIMESTAMP", "STRING", "date_format(utc_date(ts), 'yyyyMMdd')"),
    (
        "month_start", "month STRING", "TIMESTAMP",
        "timestamp_seconds(unix_date(CAST(try_to_timestamp(left(month, 6), 'yyyyMM') AS DATE)) * 86400L)",
    ),
    (
        "day_start", "day STRING", "TIMESTAMP",
        "timestamp_seconds(unix_date(CAST(try_to_timestamp(day, 'yyyyMMdd') AS DATE)) * 86400L)",
    ),
    ("coefficient_of_variation", "mean DOUBLE, stdev DOUBLE", "DOUBLE", "CASE WHEN mean <= 0 THEN 0D ELSE stdev / mean END"),
    ("path_text", "hops ARRAY<STRING>", "STRING", "array_join(hops, '-')"),
    ("has_cycle", "hops ARRAY<STRING>", "BOOLEAN", "size(hops) <> size(array_distinct(hops))"),
]


def register_functions(spark: SparkSession) -> list[str]:
    """Define the scalar functions for this session; returns their names. They are inlined, so no call costs anything."""
    for name, arguments, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return [name for name, *_ in SCALARS]


def register_reports(
    spark: SparkSession, label_traces: DataFrame, kind: str, min_count: int = PAIRS_AS_MIN_COUNT
) -> list[str]:
    """Define ``label_traces``, ``links`` and each report of an analysis (``as``, ``geo``, ...); returns their names.

    Each is a view, and as ``<name>_of(first_year, last_year)`` a table function. Pass a stored table of traces.
    """
    tables = {"label_traces": label_traces, "links": links(label_traces), **reports(label_traces, kind, min_count)}
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in table.schema.fields)
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_of(first_year INT, last_year INT) RETURNS TABLE({columns}) "
            f"RETURN SELECT * FROM {name} WHERE year BETWEEN first_year AND last_year"
        )
    return list(tables)
