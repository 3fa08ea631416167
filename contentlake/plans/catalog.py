"""Catalogue queries Q1-Q13."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentlake.operators import catalog as c
from contentlake.plans.registry import over, query, scratch
from contentlake.sources.tables import Lake

# items with their size from the file list
SIZED = "SELECT i.*, s.size_bytes FROM items i LEFT JOIN (SELECT item_id, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM item_files GROUP BY item_id) s USING (item_id)"
TOKENS = "list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: w <> '')"
FILENAME = "lower(regexp_extract(path, '([^/]*)$', 1))"


def hits(word: str) -> str:
    return f"""SELECT item_id FROM items WHERE list_contains({TOKENS}, '{word}')
               UNION SELECT item_id FROM item_files WHERE contains({FILENAME}, '{word}')"""


@query("q1_name_search", over("items") + f"""
SELECT item_id, info_hash, name FROM items
WHERE (list_contains({TOKENS}, 'ring') AND contains('|' || array_to_string({TOKENS}, '|') || '|', '|season|2|'))
   OR (list_contains({TOKENS}, 'gear') AND NOT contains('|' || array_to_string({TOKENS}, '|'), '|blu'))
""")
def name_search(lake: Lake):
    found = c.search_names(lake.items, 'ring "season 2" OR gear NOT blu*', stemming=False)
    return found.select("item_id", "info_hash", "name")


@query("q1_name_search_stemmed", over("items") + f"""
SELECT item_id, name FROM items
WHERE list_contains({TOKENS}, 'ring') AND (list_contains({TOKENS}, 'complete') OR list_contains({TOKENS}, 'completed'))
""")
def name_search_stemmed(lake: Lake):
    return c.search_names(lake.items, "rings completed").select("item_id", "name")


@query("q1_name_postings", over("items") + f"""
, words AS (SELECT item_id, unnest({TOKENS}) AS term FROM items)
SELECT term, count(DISTINCT item_id) AS items, count(*) AS occurrences FROM words GROUP BY term
""")
def name_postings(lake: Lake):
    postings = c.name_postings(lake.items, stemming=False)
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.size("positions")).cast("bigint").alias("occurrences")
    )


@query("q1_postings_search", over("items") + f"""
SELECT item_id FROM items WHERE list_contains({TOKENS}, 'ring') AND list_contains({TOKENS}, 'hdtv')
""")
def postings_search(lake: Lake):
    return c.search_postings(c.name_postings(lake.items, stemming=False), "ring HDTV", stemming=False)


BOTH_WAYS = '(rin* OR gear) NOT (season OR blu) OR "season 2"'
BOTH_WAYS_SQL = over("items") + f"""
SELECT item_id FROM items
WHERE ((contains('|' || array_to_string({TOKENS}, '|'), '|rin') OR list_contains({TOKENS}, 'gear'))
       AND NOT (list_contains({TOKENS}, 'season') OR list_contains({TOKENS}, 'blu')))
   OR contains('|' || array_to_string({TOKENS}, '|') || '|', '|season|2|')
"""


@query("q1_brackets_scan", BOTH_WAYS_SQL)
def brackets_scan(lake: Lake):
    return c.search_names(lake.items, BOTH_WAYS, stemming=False).select("item_id")


@query("q1_brackets_postings", BOTH_WAYS_SQL)
def brackets_postings(lake: Lake):
    return c.search_postings(c.name_postings(lake.items, stemming=False), BOTH_WAYS, stemming=False)


@query("q2_file_search", over("item_files") + f"""
SELECT item_id, path, size_bytes FROM item_files
WHERE contains({FILENAME}, 'ring_0') AND contains({FILENAME}, '.mp4')
""")
def file_search(lake: Lake):
    return c.search_files(lake.item_files, '"Ring_0" .mp4 xy').select("item_id", "path", "size_bytes")


@query("q3_combined_search", over("items", "item_files") + f"""
SELECT item_id, name FROM items WHERE item_id IN ({hits('ring')})
""")
def combined_search(lake: Lake):
    return c.search(lake.items, lake.item_files, "ring").select("item_id", "name")


@query("q4_search_count", over("items", "item_files") + f"""
SELECT count(DISTINCT item_id) AS total_count FROM items WHERE item_id IN ({hits('ring')})
""")
def search_count(lake: Lake):
    return c.search_count(lake.items, lake.item_files, "ring")


@query("q5_file_count", over("items", "item_files") + """
SELECT i.item_id, count(f.item_id) AS num_files FROM items i LEFT JOIN item_files f USING (item_id) GROUP BY i.item_id
""")
def file_count(lake: Lake):
    return c.with_file_count(lake.items, lake.item_files).select("item_id", "num_files")


RANK = "ORDER BY total_peers DESC, added_ts DESC, item_id"


@query("q6_ranked_page", over("items") + f"""
SELECT item_id, name, total_peers FROM items {RANK} LIMIT 50 OFFSET 100
""")
def ranked_page(lake: Lake):
    return c.page_of(lake.items, 3).select("item_id", "name", "total_peers")


@query("q6_page_after", over("items") + f"""
SELECT item_id, name, total_peers FROM items {RANK} LIMIT 7 OFFSET 6993
""")
def page_after(lake: Lake):
    """Page 1,000 of 7 items, read on from the last row of page 999 in a table laid out by rank."""
    path = scratch(lake.spark, "ranked")
    c.ranked_layout(lake.items, path)
    items = lake.spark.read.parquet(path)
    before = c.page_of(items, 999, 7).orderBy(F.asc("total_peers"), F.asc("added_ts"), F.desc("item_id")).first()
    return (c.page_after(items, before, 7) if before else items.limit(0)).select("item_id", "name", "total_peers")


@query("q6_page_info", over("items") + """
, t AS (SELECT count(*) AS n FROM items)
SELECT n AS total_count, CAST(3 AS BIGINT) AS page, CAST(greatest(0, least(50, n - 100)) AS BIGINT) AS count,
       100 + greatest(0, least(50, n - 100)) < n AS has_more, CAST(ceil(n / 50.0) AS BIGINT) AS total_pages,
       true AS has_prev, 3 < ceil(n / 50.0) AS has_next FROM t
""")
def page_info(lake: Lake):
    return c.page_info(lake.items, 3)


@query("q7_first_files", over("item_files") + """
SELECT item_id, CAST(to_json(list({'file_index': file_index, 'path': path, 'size_bytes': size_bytes} ORDER BY file_index)) AS VARCHAR) AS files
FROM item_files WHERE file_index < 10 GROUP BY item_id
""")
def first_files(lake: Lake):
    return c.first_files(lake.item_files).select("item_id", F.to_json("files").alias("files"))


SEARCH_PAGE = over("items", "item_files") + f"""
, hit AS (SELECT * FROM items WHERE item_id IN ({hits('ring')})),
page AS (SELECT * FROM hit {RANK} LIMIT 50)
"""


@query("q7_search_page", SEARCH_PAGE + """
SELECT p.item_id, p.info_hash, p.name, p.total_peers, count(f.item_id) AS num_files,
       CAST(to_json(list({'file_index': f.file_index, 'path': f.path, 'size_bytes': f.size_bytes} ORDER BY f.file_index)
               FILTER (f.file_index < 10)) AS VARCHAR) AS files
FROM page p LEFT JOIN item_files f USING (item_id) GROUP BY ALL
""")
def search_page(lake: Lake):
    """Search, rank by peers, first page with file counts and first files."""
    found = c.search(lake.items, lake.item_files, "ring")
    page = c.result_page(found, lake.item_files)
    return page.select("item_id", "info_hash", "name", "total_peers", "num_files", F.to_json("files").alias("files"))


VIDEO = "lower(path) LIKE '%.mp4' OR lower(path) LIKE '%.avi' OR lower(path) LIKE '%.mkv' OR lower(path) LIKE '%.wmv' OR lower(path) LIKE '%.mov' OR lower(path) LIKE '%.flv' OR lower(path) LIKE '%.mpg' OR lower(path) LIKE '%.mpeg' OR lower(path) LIKE '%.m4v' OR lower(path) LIKE '%.webm'"
VIDEO_SUMS = f"""SELECT item_id, CAST(sum(CASE WHEN {VIDEO} THEN size_bytes ELSE 0 END) AS BIGINT) AS video_bytes,
CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM item_files GROUP BY item_id"""


@query("q8_video_items", over("item_files") + f"""
, s AS ({VIDEO_SUMS}) SELECT *, total_bytes > 0 AND video_bytes * 2 > total_bytes AS is_video FROM s
""")
def video_items(lake: Lake):
    return c.video_items(lake.item_files)


@query("q9_sample_pool", over("items", "item_files") + f"""
, s AS ({VIDEO_SUMS})
SELECT i.item_id, i.name FROM items i JOIN s USING (item_id)
WHERE total_peers = 50 AND total_bytes > 0 AND video_bytes * 2 > total_bytes
""")
def sample_pool(lake: Lake):
    return c.sample_pool(lake.items, lake.item_files).select("item_id", "name")


@query("q9_sample_videos", over("items", "item_files") + f"""
, s AS ({VIDEO_SUMS})
SELECT i.item_id, i.info_hash, i.name FROM items i JOIN s USING (item_id)
WHERE total_peers = 50 AND total_bytes > 0 AND video_bytes * 2 > total_bytes ORDER BY md5('7:' || i.info_hash), i.info_hash LIMIT 100
""")
def sample_videos(lake: Lake):
    return c.sample_videos(lake.items, lake.item_files, 100, seed=7).select("item_id", "info_hash", "name")


@query("q10_latest", over("items") + """
SELECT item_id, name, CAST(epoch(added_ts) AS BIGINT) AS added FROM items ORDER BY added_ts DESC, item_id DESC LIMIT 100
""")
def latest(lake: Lake):
    return c.latest(lake.items, 100).select("item_id", "name", F.unix_timestamp("added_ts").alias("added"))


@query("q11_lookup", over("items") + """
, hit AS (SELECT * FROM items WHERE info_hash = sha1('42'))
SELECT upper(sha1('42')) AS query, true AS valid, count(*) > 0 AS found, max(name) AS name, max(total_peers) AS total_peers FROM hit
""")
def lookup(lake: Lake):
    return c.lookup(lake.items, "92CFCEB39D57D914ED8B14D0E37643DE0797AE56")


@query("q11_lookup_many", over("items") + """
, asked AS (SELECT CASE c_custkey % 3 WHEN 0 THEN sha1(CAST(c_custkey AS VARCHAR)) WHEN 1 THEN upper(sha1(CAST(c_custkey AS VARCHAR)))
                   ELSE left(sha1(CAST(c_custkey AS VARCHAR)), 39) END AS query FROM customer)
SELECT query, length(query) = 40 AS valid, i.info_hash IS NOT NULL AS found, i.name
FROM asked LEFT JOIN items i ON length(query) = 40 AND i.info_hash = lower(query)
""")
def lookup_many(lake: Lake):
    digest = F.sha1(F.col("c_custkey").cast("string"))
    asked = F.when(F.col("c_custkey") % 3 == 0, digest).when(F.col("c_custkey") % 3 == 1, F.upper(digest)).otherwise(F.left(digest, F.lit(39)))
    return c.lookup_many(lake.items, lake.customer.select(asked.alias("query")))


@query("q12_bounds", over("items", "item_files") + """
SELECT (SELECT max(item_id) FROM items) AS max_id, (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM item_files) AS files
""")
def bounds(lake: Lake):
    return c.catalog_bounds(lake.items, lake.item_files)


@query("q13_peer_class", over("items") + """
SELECT CASE WHEN total_peers > 100 THEN 'high' WHEN total_peers > 10 THEN 'medium' ELSE 'low' END AS class, count(*) AS items
FROM items GROUP BY 1
""")
def peer_class(lake: Lake):
    return lake.items.groupBy(c.peer_class(F.col("total_peers")).alias("class")).agg(F.count(F.lit(1)).alias("items"))
