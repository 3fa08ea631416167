"""The given tables, and the catalogue views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# The index is numbered over the renamed key, so that a filter on item_id reaches the scan.
ITEM_FILES = """
SELECT item_id,
       row_number() OVER (PARTITION BY item_id ORDER BY l_linenumber, l_partkey, l_suppkey,
                          l_extendedprice, l_quantity) - 1 AS file_index,
       concat(CASE WHEN l_returnflag = 'N' THEN ''
                   ELSE concat(p_type, '/', replace(p_brand, '#', ''), '/') END,
              replace(p_name, ' ', '_'), '_', lpad(CAST(l_linenumber AS STRING), 2, '0'),
              CASE l_linenumber % 5 WHEN 0 THEN '.mkv' WHEN 1 THEN '.jpg' WHEN 2 THEN '.txt'
                                    WHEN 3 THEN '.MP4' ELSE '.nfo' END) AS path,
       CAST(round(l_extendedprice * 1000) AS BIGINT) AS size_bytes
FROM (SELECT l_orderkey AS item_id, * FROM lineitem) AS lines JOIN part ON l_partkey = p_partkey
"""

ITEMS = """
SELECT o_orderkey AS item_id, sha1(CAST(o_orderkey AS STRING)) AS info_hash,
       CASE o_orderkey % 6
         WHEN 0 THEN concat(replace(p_name,' ','.'), '.(1999).1080p.BluRay.x264-YTS')
         WHEN 1 THEN concat(replace(p_name,' ','.'), '.S01E0', CAST(o_orderkey % 9 + 1 AS STRING), '.720p.HDTV')
         WHEN 2 THEN concat('[Group] ', p_name, ' [1080p][HEVC]')
         WHEN 3 THEN concat(replace(p_name,' ','_'), '_Season_2_Complete')
         WHEN 4 THEN concat(p_name, ' (2160p HDR)')
         ELSE p_name END AS name,
       CAST(o_orderkey % 120 AS INT) AS total_peers, o_orderdate AS added_ts
FROM orders JOIN part ON p_partkey = o_orderkey % 200
"""

ATTEMPTS = """
SELECT event_id, sha1(CAST(user_id AS STRING)) AS info_hash, ts,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'fetched'
                       WHEN 'signup' THEN 'filtered' ELSE 'observed' END AS outcome,
       CASE WHEN event_type = 'error' THEN
         CASE event_id % 7 WHEN 0 THEN 'connect timeout' WHEN 1 THEN 'connection failed'
           WHEN 2 THEN 'handshake failed' WHEN 3 THEN 'no extension support'
           WHEN 4 THEN 'metadata rejected' WHEN 5 THEN 'hash verification failed'
           ELSE 'info_hash mismatch' END
       END AS close_reason
FROM events
"""

NODES = """
SELECT sha1(CAST(c_custkey AS STRING)) AS node_id, count(o_orderkey) AS queries_sent,
       count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS responses_received,
       max(o_orderdate) AS last_responded_at, CAST(c_custkey % 4 AS INT) AS fail_count
FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey
"""

VIEWS = {"items": ITEMS, "item_files": ITEM_FILES, "attempts": ATTEMPTS, "nodes": NODES}


class Lake:
    """Lazy access to the tables of one folder: ``lake.orders``, ``lake.items``, ``lake.sql(...)``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS or name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    def sql(self, query: str) -> DataFrame:
        """SQL over the given tables by their own names, bound to this folder."""
        words = set(query.replace(",", " ").replace("(", " ").replace(")", " ").split())
        for name in TABLES:
            if name in words:
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(query)
