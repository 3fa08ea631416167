"""Content filter queries F1-F6. Keywords and patterns are neutral tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentlake.functions.text import ascii_lower
from contentlake.operators import contentfilter as cf
from contentlake.plans.registry import over, query
from contentlake.plans.text import EXT, FOLDED, IMAGE_LIST, KEYWORDS, PATTERNS, SPECIAL, VIDEO_LIST, regex_sql, weight_sql
from contentlake.sources.tables import Lake

# a second keyword table whose weights let all layers decide
LIGHT = [("ring", 7), ("gear", 9), ("red", 5), ("bolt", 3)]


def weighted(sql: str, keywords) -> str:
    cases = " ".join(f"WHEN contains({sql}, '{w}') THEN {n}" for w, n in sorted(keywords, key=lambda k: -k[1]))
    return f"CASE {cases} ELSE 0 END"


def decided(keywords, kw: int, rx: int, score: int) -> str:
    folded_path, folded_name = FOLDED.format("path"), FOLDED.format("name")
    return over(
        "items",
        "item_files",
        w=f"SELECT item_id, path, size_bytes, {weighted(folded_path, keywords)} AS kw, {regex_sql('path')} AS rx FROM item_files",
        f=f"""SELECT item_id, max(kw) AS fkw, max(rx) AS frx, sum(CASE WHEN kw >= 5 THEN 2 WHEN kw > 0 THEN 1 ELSE 0 END) AS points,
              count(*) AS n, count(CASE WHEN {EXT} IN {VIDEO_LIST} THEN 1 END) AS nv, count(CASE WHEN {EXT} IN {IMAGE_LIST} THEN 1 END) AS ni,
              count(CASE WHEN regexp_matches(path, '[0-9][0-9]') THEN 1 END) AS nd, sum(size_bytes) AS size FROM w GROUP BY item_id""",
        s=f"""SELECT i.item_id, i.info_hash, i.name, {weighted(folded_name, keywords)} AS nkw, {regex_sql('name')} AS nrx, fkw, frx,
              CAST(coalesce(points, 0) + CASE WHEN nv >= 1 THEN 2 ELSE 0 END + CASE WHEN n >= 10 AND nd * 2 > n THEN 1 ELSE 0 END
              + CASE WHEN strlen(name) > 100 THEN 1 ELSE 0 END + CASE WHEN {SPECIAL.format('name')} * 5 > strlen(name) THEN 1 ELSE 0 END
              + CASE WHEN nv > 0 AND size > 1073741824 THEN 1 ELSE 0 END + CASE WHEN ni > 50 THEN 2 ELSE 0 END AS BIGINT) AS score
              FROM items i LEFT JOIN f USING (item_id)""",
        d=f"""SELECT *, CASE WHEN nkw >= {kw} OR fkw >= {kw} THEN 'keyword' WHEN nrx >= {rx} OR frx >= {rx} THEN 'regex'
              WHEN score >= {score} THEN 'heuristic' END AS layer FROM s""",
    )


@query("f1_heuristic_score", decided(LIGHT, 8, 9, 5) + "SELECT item_id, score FROM d")
def heuristic_score(lake: Lake):
    return cf.heuristic_score(lake.items, lake.item_files, LIGHT).select("item_id", "score")


@query("f2_layered_decision", decided(LIGHT, 8, 10, 7) + "SELECT item_id, score, layer, layer IS NOT NULL AS rejected FROM d")
def layered_decision(lake: Lake):
    out = cf.filter_content(lake.items, lake.item_files, LIGHT, PATTERNS, 8, 10, 7)
    return out.select("item_id", "score", "layer", "rejected")


STATS = """SELECT count(*) AS total_checked, count(layer) AS total_filtered, count(CASE WHEN layer = 'keyword' THEN 1 END) AS filtered_by_keyword,
count(CASE WHEN layer = 'regex' THEN 1 END) AS filtered_by_regex, count(CASE WHEN layer = 'heuristic' THEN 1 END) AS filtered_by_heuristic,
round(count(layer) * 100.0::DOUBLE / count(*), 6) AS filter_rate_percent FROM d"""


@query("f3_filter_stats", decided(LIGHT, 8, 10, 7) + STATS)
def filter_stats(lake: Lake):
    stats = cf.filter_stats(cf.filter_content(lake.items, lake.item_files, LIGHT, PATTERNS, 8, 10, 7))
    return stats.withColumn("filter_rate_percent", F.round("filter_rate_percent", 6))


@query("f4_thresholds", decided(LIGHT, 10, 11, 9) + STATS)
def thresholds(lake: Lake):
    out = cf.filter_content(lake.items, lake.item_files, LIGHT, PATTERNS, keyword_threshold=10, regex_threshold=11, heuristic_threshold=9)
    return cf.filter_stats(out).withColumn("filter_rate_percent", F.round("filter_rate_percent", 6))


@query("f5_accuracy", f"""
WITH p AS (SELECT doc_id, {weight_sql(FOLDED.format('text'))} >= 5 AS rejected FROM documents),
c AS (SELECT count(CASE WHEN rejected AND toxic = 1 THEN 1 END) AS tp, count(CASE WHEN rejected AND toxic = 0 THEN 1 END) AS fp,
      count(CASE WHEN NOT rejected AND toxic = 1 THEN 1 END) AS fn, count(CASE WHEN NOT rejected AND toxic = 0 THEN 1 END) AS tn
      FROM p JOIN labels USING (doc_id))
SELECT *, round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn)::DOUBLE / (tp + fp + fn + tn) ELSE 0 END, 6) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall FROM c
""")
def accuracy(lake: Lake):
    folded = lake.documents.select("doc_id", ascii_lower(F.col("text")).alias("f"))
    predicted = folded.select("doc_id", (cf.max_keyword_weight(F.col("f"), KEYWORDS) >= 5).alias("rejected"))
    return cf.evaluate_filter(predicted, lake.labels, "doc_id", "toxic")


@query("f6_routed", decided(LIGHT, 8, 10, 7) + """
SELECT CASE WHEN layer IS NULL THEN 'sink' ELSE 'seen' END AS route, info_hash FROM d
""")
def routed(lake: Lake):
    accepted, rejected = cf.split_filtered(cf.filter_content(lake.items, lake.item_files, LIGHT, PATTERNS, 8, 10, 7))
    return accepted.select(F.lit("sink").alias("route"), "info_hash").unionAll(
        rejected.select(F.lit("seen").alias("route"), "info_hash")
    )
