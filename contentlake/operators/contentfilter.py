"""Layered content filter: weighted keywords, weighted patterns, heuristic score.

Keywords and patterns are the user's tables. Layers, first hit wins: keyword in the name, keyword
in a path, pattern in the name, pattern in a path, heuristic score; each against its threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.functions.paths import has_adjacent_digits, is_image, is_video
from contentlake.functions.text import ascii_lower, is_special_dense
from contentlake.settings import DEFAULTS

GIB = 1 << 30

Weighted = Sequence[tuple[str, int]]


def max_keyword_weight(folded: Column, keywords: Weighted) -> Column:
    """The highest weight among keywords contained in the ASCII-folded text, else 0.

    Tests run from the highest weight down and stop at the first hit.
    """
    best: dict[str, int] = {}
    for word, weight in keywords:
        if word:
            best[word] = max(weight, best.get(word, 0))
    if not best:
        return F.lit(0)
    out = None
    for word, weight in sorted(best.items(), key=lambda kw: (-kw[1], kw[0])):
        found = F.contains(folded, F.lit(word))
        out = F.when(found, weight) if out is None else out.when(found, weight)
    return out.otherwise(0)


def max_regex_weight(text: Column, patterns: Weighted) -> Column:
    """The highest weight among case-insensitive patterns found in the text, else 0."""
    out = None
    for pattern, weight in sorted(patterns, key=lambda p: -p[1]):
        found = F.regexp_like(text, F.lit(f"(?i){pattern}"))
        out = F.when(found, weight) if out is None else out.when(found, weight)
    return F.lit(0) if out is None else out.otherwise(0)


def file_signals(files: DataFrame, keywords: Weighted, patterns: Weighted) -> DataFrame:
    """Per item everything the filter needs from its files, in one partial aggregate."""
    weighed = (
        files.select("item_id", "path", "size_bytes", ascii_lower(F.col("path")).alias("_folded"))
        .withColumn("_kw", max_keyword_weight(F.col("_folded"), keywords))
        .withColumn("_re", max_regex_weight(F.col("path"), patterns))
    )
    path = F.col("path")
    points = F.when(F.col("_kw") >= 5, 2).when(F.col("_kw") > 0, 1).otherwise(0)
    return weighed.groupBy("item_id").agg(
        F.max("_kw").alias("file_keyword"),
        F.max("_re").alias("file_regex"),
        F.sum(points).alias("file_points"),
        F.count(F.lit(1)).alias("n_files"),
        F.count(F.when(is_video(path), 1)).alias("n_video"),
        F.count(F.when(is_image(path), 1)).alias("n_image"),
        F.count(F.when(has_adjacent_digits(path), 1)).alias("n_numbered"),
        F.sum("size_bytes").alias("total_size"),
    )


def has_numbered_files() -> Column:
    return (F.col("n_files") >= 10) & (F.col("n_numbered") * 2 > F.col("n_files"))


def score_of(name: Column) -> Column:
    """The heuristic score from :func:`file_signals` columns and the name."""

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    def signal(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0))

    return (
        signal("file_points")
        + points(signal("n_video") >= 1, 2)
        + points(has_numbered_files(), 1)
        + points(F.octet_length(name) > 100, 1)
        + points(is_special_dense(name), 1)
        + points((signal("n_video") > 0) & (signal("total_size") > GIB), 1)
        + points(signal("n_image") > 50, 2)
    ).cast("bigint")


def heuristic_score(items: DataFrame, files: DataFrame, keywords: Weighted) -> DataFrame:
    signals = file_signals(files, keywords, ())
    joined = items.join(signals, "item_id", "left")
    return joined.withColumn("score", score_of(F.col("name"))).select(*items.columns, "score")


def filter_content(
    items: DataFrame,
    files: DataFrame,
    keywords: Weighted,
    patterns: Weighted = (),
    keyword_threshold: int = DEFAULTS.keyword_threshold,
    regex_threshold: int = DEFAULTS.regex_threshold,
    heuristic_threshold: int = DEFAULTS.heuristic_threshold,
) -> DataFrame:
    """``items`` with ``layer`` (NULL when accepted), ``rejected`` and the heuristic ``score``."""
    joined = items.join(file_signals(files, keywords, patterns), "item_id", "left").withColumn(
        "_folded", ascii_lower(F.col("name"))
    )
    weighed = joined.withColumn("_kw", max_keyword_weight(F.col("_folded"), keywords)).withColumn(
        "score", score_of(F.col("name"))
    )
    layer = (
        F.when(F.col("_kw") >= keyword_threshold, "keyword")
        .when(F.col("file_keyword") >= keyword_threshold, "keyword")
        .when(max_regex_weight(F.col("name"), patterns) >= regex_threshold, "regex")
        .when(F.col("file_regex") >= regex_threshold, "regex")
        .when(F.col("score") >= heuristic_threshold, "heuristic")
    )
    decided = weighed.withColumn("layer", layer).withColumn("rejected", F.col("layer").isNotNull())
    return decided.select(*items.columns, "score", "layer", "rejected")


def filter_stats(decided: DataFrame) -> DataFrame:
    def layer(name: str) -> Column:
        return F.count(F.when(F.col("layer") == name, 1))

    checked, rejected = F.count(F.lit(1)), F.count("layer")
    return decided.agg(
        checked.alias("total_checked"),
        rejected.alias("total_filtered"),
        layer("keyword").alias("filtered_by_keyword"),
        layer("regex").alias("filtered_by_regex"),
        layer("heuristic").alias("filtered_by_heuristic"),
        F.when(checked > 0, rejected * 100.0 / checked).otherwise(0.0).alias("filter_rate_percent"),
    )


def evaluate_filter(predicted: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Confusion counts and rates of a boolean ``rejected`` against a 0/1 label."""
    pairs = predicted.select(key, "rejected").join(labels.select(key, label), key)
    yes, no = F.col("rejected"), ~F.col("rejected")
    true, false = F.col(label) == 1, F.col(label) == 0
    counts = pairs.agg(
        F.count(F.when(yes & true, 1)).alias("tp"),
        F.count(F.when(yes & false, 1)).alias("fp"),
        F.count(F.when(no & true, 1)).alias("fn"),
        F.count(F.when(no & false, 1)).alias("tn"),
    )

    def share(top: str, bottom: str) -> Column:
        return F.expr(f"CASE WHEN {bottom} > 0 THEN round(({top}) * 1.0D / ({bottom}), 6) ELSE 0.0D END")

    return counts.select(
        "tp", "fp", "fn", "tn",
        share("tp + tn", "tp + fp + fn + tn").alias("accuracy"),
        share("tp", "tp + fp").alias("precision"),
        share("tp", "tp + fn").alias("recall"),
    )


def split_filtered(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted items for the sink, rejected keys for the seen set)."""
    accepted = decided.filter(~F.col("rejected")).drop("score", "layer", "rejected")
    return accepted, decided.filter("rejected").select("info_hash", "layer")
