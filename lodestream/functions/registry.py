"""The date, text and JSON functions under SQL names: SQL functions of the session, whose bodies Catalyst puts in place of the call."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, result and body of each function.
FUNCTIONS = (
    ("date_number", "d DATE", "INT", "coalesce(year(d) * 10000 + month(d) * 100 + day(d), 0)"),
    ("number_date", "n INT", "DATE", "to_date(try_to_timestamp(lpad(cast(n AS STRING), 8, '0'), 'yyyyMMdd'))"),
    ("stamp_number", "t TIMESTAMP", "BIGINT", "coalesce(cast(date_format(t, 'yyyyMMddHHmm') AS BIGINT), 0)"),
    ("add_days_number", "n INT, days INT", "INT", "cast(date_format(date_add(to_date(try_to_timestamp(lpad(cast(n AS STRING), 8, '0'), 'yyyyMMdd')), days), 'yyyyMMdd') AS INT)"),
    ("take_left", "s STRING, n INT", "STRING", "rpad(left(s, n), n, ' ')"),
    ("token_estimate", "s STRING", "INT", "cast(greatest(1, floor(length(s) / 4)) AS INT)"),
    ("snippet_of", "s STRING, n INT", "STRING", "CASE WHEN length(s) > n THEN concat(left(s, n), '...') ELSE coalesce(s, '') END"),
    ("round_half_up", "x DOUBLE, places INT", "DOUBLE", "sign(x) * floor(abs(x) * power(10, places) + 0.5) / power(10, places)"),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
