"""SQL functions for the columns, and a table function for locating."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from textquarry.operators.search import find_all

FUNCTIONS = {
    "count_literal(t STRING, p STRING) RETURNS BIGINT": "CASE WHEN t IS NULL OR p = '' THEN NULL WHEN contains(t, p) THEN CAST(regexp_count(t, concat('(?=', chr(92), 'Q', replace(p, concat(chr(92), 'E'), concat(chr(92), 'E', chr(92), chr(92), 'E', chr(92), 'Q')), chr(92), 'E)')) AS BIGINT) ELSE 0 END",
    "extract_range(t STRING, a BIGINT, b BIGINT) RETURNS STRING": "CASE WHEN a >= 0 AND b >= a AND b <= length(t) THEN substring(t, CAST(a AS INT) + 1, CAST(b - a AS INT)) END",
    "extract_around(t STRING, i BIGINT, c STRING) RETURNS STRING": "CASE WHEN i < 0 OR i >= length(t) THEN NULL WHEN substring(t, CAST(i AS INT) + 1, 1) = c THEN '' ELSE concat(substring_index(left(t, CAST(i AS INT)), c, -1), substring_index(substring(t, CAST(i AS INT) + 1), c, 1)) END",
    "extract_left(t STRING, i BIGINT, c STRING) RETURNS STRING": "CASE WHEN i < 0 OR i >= length(t) THEN NULL WHEN substring(t, CAST(i AS INT) + 1, 1) = c THEN '' ELSE substring_index(left(t, CAST(i AS INT) + 1), c, -1) END",
    "extract_right(t STRING, i BIGINT, c STRING) RETURNS STRING": "CASE WHEN i < 0 OR i >= length(t) THEN NULL WHEN substring(t, CAST(i AS INT) + 1, 1) = c THEN '' ELSE substring_index(substring(t, CAST(i AS INT) + 2), c, 1) END",
    "symbol_rank(t STRING, k BIGINT, c STRING) RETURNS BIGINT": "CAST(length(left(t, CAST(greatest(k, 0) AS INT))) - length(replace(left(t, CAST(greatest(k, 0) AS INT)), c, '')) AS BIGINT)",
    "redundancy(t STRING) RETURNS DOUBLE": "CASE WHEN length(t) > 0 THEN length(t) / length(regexp_replace(t, concat('(?s)(.)', chr(92), '1+'), '$1')) END",
    "min_bits(v BIGINT) RETURNS INT": "length(bin(v))",
}


@udtf(returnType="pos bigint")
class _LocateAll:
    def eval(self, text: str, pattern: str):
        if text is not None and pattern:
            for i in find_all(text, pattern):
                yield (i,)


def register(spark: SparkSession) -> None:
    """Temporary functions, and ``LATERAL locate_all(text, pattern)``."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("locate_all", _LocateAll)
