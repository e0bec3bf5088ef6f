"""The library's functions by name in SQL: expressions that Catalyst inlines, and a table function of lines."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Name, arguments, type and expression of each scalar function.
SCALARS = (
    ("speech_seconds", "chars BIGINT", "DOUBLE", "chars / 15.0D"),
    ("stable_seed", "base BIGINT, key STRING", "BIGINT", "base + crc32(encode(key, 'UTF-8')) % 100000"),
    ("clamp", "x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN x IS NOT NULL THEN least(greatest(x, low), high) END"),
    ("word_count", "words STRING", "INT", r"regexp_count(words, '[^\\x20\\x09-\\x0D]+')"),
)


@udtf(returnType="pos int, line string")
class TextLines:
    """Lines of a text with their places, without those that hold white space only; none for null."""

    def eval(self, text: str):
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip():
                yield pos, line


def register(spark: SparkSession) -> SparkSession:
    for name, arguments, kind, expression in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {expression}")
    spark.udtf.register("text_lines", TextLines)
    return spark
