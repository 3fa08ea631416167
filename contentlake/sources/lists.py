"""Keyword files: weighted filter keywords and the ordered strip list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlake.functions.text import ascii_lower
from contentlake.settings import DEFAULTS

SPACES = " \t\n\x0b\f\r"


def _trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def parse_keywords(lines: DataFrame, line: str = "value") -> DataFrame:
    """(keyword, weight) from ``keyword[:weight]`` lines: default 5, clamped to 1..10, the highest
    weight of a repeated keyword. Blank and ``#`` lines are skipped."""
    text = lines.select(_trimmed(F.col(line)).alias("_t")).filter((F.col("_t") != "") & ~F.startswith("_t", F.lit("#")))
    after = F.regexp_extract("_t", r"^[^:]*:\s*([+-]?[0-9]{1,9})", 1)
    # no number after the colon reads as 0, which clamps to 1
    number = F.when(after == "", 0).otherwise(after.try_cast("int"))
    weight = F.when(F.contains("_t", F.lit(":")), F.greatest(F.lit(1), F.least(F.lit(10), number))).otherwise(
        DEFAULTS.default_weight
    )
    keyword = _trimmed(ascii_lower(F.substring_index("_t", ":", 1)))
    parsed = text.select(keyword.alias("keyword"), weight.cast("int").alias("weight")).filter("keyword != ''")
    return parsed.groupBy("keyword").agg(F.max("weight").alias("weight"))


def parse_strip_list(lines: DataFrame, line: str = "value", number: str = "line_no") -> DataFrame:
    """(keyword, line_no): folded, first occurrence kept; apply in ``line_no`` order."""
    text = lines.select(ascii_lower(_trimmed(F.col(line))).alias("keyword"), number)
    kept = text.filter((F.col("keyword") != "") & ~F.startswith("keyword", F.lit("#")))
    return kept.groupBy("keyword").agg(F.min(number).alias(number))


def load_keywords(spark: SparkSession, path: str) -> DataFrame:
    return parse_keywords(spark.read.text(path))


def load_strip_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines are numbered inside one text value per file: a strip list is a small hand-written file."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return parse_strip_list(lines)


def strip_words(strip_list: DataFrame) -> list[str]:
    """The keywords in list order, as the literal list :func:`strip_keywords` takes."""
    return [r["keyword"] for r in strip_list.orderBy("line_no").collect()]
