"""Queries Q1-Q4 and Q7 over a stored search index that was filled in two epochs, the second of which replaces items."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentlake.operators.searchindex import SearchIndex
from contentlake.plans.catalog import BOTH_WAYS, BOTH_WAYS_SQL, FILENAME, SEARCH_PAGE, TOKENS, hits
from contentlake.plans.registry import over, query, scratch
from contentlake.sources.tables import Lake

STALE = "item_id % 9 = 0"


def stored_index(lake: Lake, stemming: bool = False, files: bool = True) -> SearchIndex:
    """All items as they once were (a ninth under other names, with other files), then that ninth as it is now."""
    index_files = lake.item_files if files else lake.item_files.filter("false")
    index = SearchIndex.create(lake.spark, scratch(lake.spark, "index"), lake.items, index_files, stemming)
    stale = F.expr(STALE)
    old_name = F.when(stale, F.concat(F.lit("ring gear season 2 "), "name")).otherwise(F.col("name"))
    old_path = F.when(stale, F.concat("path", F.lit("_ring_0.mp4"))).otherwise(F.col("path"))
    index.add(lake.items.withColumn("name", old_name), index_files.withColumn("path", old_path), 0)
    index.add(lake.items.filter(stale), index_files.filter(stale), 1)
    return SearchIndex.open(lake.spark, index.path)


@query("q1_indexed_search", over("items") + f"""
SELECT item_id, info_hash, name FROM items
WHERE (list_contains({TOKENS}, 'ring') AND contains('|' || array_to_string({TOKENS}, '|') || '|', '|season|2|'))
   OR (list_contains({TOKENS}, 'gear') AND NOT contains('|' || array_to_string({TOKENS}, '|'), '|blu'))
""")
def indexed_search(lake: Lake):
    found = stored_index(lake, files=False).search_names('ring "season 2" OR gear NOT blu*')
    return found.select("item_id", "info_hash", "name")


@query("q1_indexed_stemmed", over("items") + f"""
SELECT item_id, name FROM items
WHERE list_contains({TOKENS}, 'ring') AND (list_contains({TOKENS}, 'complete') OR list_contains({TOKENS}, 'completed'))
""")
def indexed_stemmed(lake: Lake):
    return stored_index(lake, stemming=True, files=False).search_names("rings completed").select("item_id", "name")


@query("q1_indexed_brackets", BOTH_WAYS_SQL)
def indexed_brackets(lake: Lake):
    return stored_index(lake, files=False).search_names(BOTH_WAYS).select("item_id")


@query("q2_indexed_files", over("item_files") + f"""
SELECT item_id, path, size_bytes FROM item_files
WHERE contains({FILENAME}, 'ring_0') AND contains({FILENAME}, '.mp4')
""")
def indexed_files(lake: Lake):
    return stored_index(lake).search_files('"Ring_0" .mp4 xy').select("item_id", "path", "size_bytes")


@query("q3_indexed_search", over("items", "item_files") + f"""
SELECT item_id, name FROM items WHERE item_id IN ({hits('ring')})
""")
def indexed_combined(lake: Lake):
    return stored_index(lake).search("ring").select("item_id", "name")


@query("q4_indexed_count", over("items", "item_files") + f"""
SELECT count(DISTINCT item_id) AS total_count FROM items WHERE item_id IN ({hits('ring')})
""")
def indexed_count(lake: Lake):
    return stored_index(lake).search_count("ring")


@query("q7_indexed_page", SEARCH_PAGE + """
SELECT p.item_id, p.info_hash, p.name, p.total_peers, count(f.item_id) AS num_files,
       CAST(to_json(list({'file_index': f.file_index, 'path': f.path, 'size_bytes': f.size_bytes} ORDER BY f.file_index)
               FILTER (f.file_index < 10)) AS VARCHAR) AS files
FROM page p LEFT JOIN item_files f USING (item_id) GROUP BY ALL
""")
def indexed_page(lake: Lake):
    """The page of ``q7_search_page`` from a compacted index."""
    page = stored_index(lake).compact(scratch(lake.spark, "index"), keep=False).result_page("ring")
    return page.select("item_id", "info_hash", "name", "total_peers", "num_files", F.to_json("files").alias("files"))
