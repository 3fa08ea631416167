"""Golden cases of the layered filter; thresholds and order of layers."""

import pytest
from pyspark.sql import functions as F

from contentlake.functions.text import ascii_lower
from contentlake.operators import contentfilter as cf

KEYWORDS = [("ring", 9), ("gear", 5), ("nut", 2)]
PATTERNS = [("b[o0]lt", 10), ("x+y", 6)]
GIB = 1 << 30


def decide(spark, name, files, **thresholds):
    items = spark.createDataFrame([(1, "h", name)], "item_id int, info_hash string, name string")
    rows = [(1, path, size) for path, size in files]
    paths = spark.createDataFrame(rows, "item_id int, path string, size_bytes bigint")
    out = cf.filter_content(items, paths, KEYWORDS, PATTERNS, **thresholds).first()
    return out["score"], out["layer"]


@pytest.mark.parametrize(
    "name, files, wanted",
    [
        ("a RING", [], (0, "keyword")),
        ("plain", [("x/earring.txt", 1)], (2, "keyword")),
        ("a b0lt", [("gear", 1)], (2, "regex")),
        ("plain", [("B0LT.nfo", 1)], (0, "regex")),
        ("plain", [("gear.mkv", 1), ("gear", 1), ("nut", 1)], (7, "heuristic")),
        ("plain", [("gear.mkv", 1)], (4, None)),
        ("plain", [(f"{i}.jpg", 1) for i in range(50)], (1, None)),
        ("plain", [(f"{i}.jpg", 1) for i in range(51)], (3, None)),
        ("plain", [("a.mkv", GIB)], (2, None)),
        ("plain", [("a.mkv", GIB), ("b.txt", 1)], (3, None)),
        ("plain", [("b.txt", 2 * GIB)], (0, None)),
        ("é" * 51, [], (2, None)),
        ("a" * 100, [], (0, None)),
        ("a" * 101, [], (1, None)),
        ("aaaa!", [], (0, None)),
        ("aaa!", [], (1, None)),
        ("plain", [(f"f{i:02d}", 1) for i in range(9)], (0, None)),
        ("plain", [(f"f{i:02d}", 1) for i in range(6)] + [(c, 1) for c in "abcd"], (1, None)),
        ("plain", [(f"f{i:02d}", 1) for i in range(5)] + [(c, 1) for c in "abcde"], (0, None)),
    ],
)
def test_layers(spark, name, files, wanted):
    assert decide(spark, name, files) == wanted


def test_thresholds_move_the_layer(spark):
    files = [("gear.mkv", 1)]
    assert decide(spark, "a ring bolt", files, keyword_threshold=10) == (4, "regex")
    assert decide(spark, "a ring bolt", files, keyword_threshold=10, regex_threshold=11) == (4, None)
    assert decide(spark, "a ring bolt", files, keyword_threshold=10, regex_threshold=11, heuristic_threshold=4) == (4, "heuristic")


def test_long_lists_and_short_ones_agree(spark):
    words = [(f"w{i}x", 1 + i % 10) for i in range(450)]
    df = spark.createDataFrame([("a W7X",), ("w9x w3x",), ("none",), (None,)], "t string").withColumn("f", ascii_lower(F.col("t")))
    assert [r[0] for r in df.select(cf.max_keyword_weight(F.col("f"), words)).collect()] == [8, 10, 0, 0]
    few = [(w, n) for w, n in words if n > 7][:50] + [("w7x", 3)]
    assert [r[0] for r in df.select(cf.max_keyword_weight(F.col("f"), few)).collect()] == [8, 10, 0, 0]


def test_stats_and_routes(spark):
    items = spark.createDataFrame([(i, f"h{i}", n) for i, n in enumerate(["ring", "bolt", "plain", "ok"])], "item_id int, info_hash string, name string")
    files = spark.createDataFrame([(2, "gear.mkv", 1), (2, "gear.avi", 1)], "item_id int, path string, size_bytes bigint")
    decided = cf.filter_content(items, files, KEYWORDS, PATTERNS)
    assert tuple(cf.filter_stats(decided).first()) == (4, 3, 1, 1, 1, 75.0)
    assert tuple(cf.filter_stats(decided.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0)
    accepted, rejected = cf.split_filtered(decided)
    assert [r["info_hash"] for r in accepted.collect()] == ["h3"] and rejected.count() == 3
