"""Text and scalar queries T1-T19."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentlake.functions.paths import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from contentlake.functions import net, paths, text
from contentlake.operators import contentfilter as cf
from contentlake.plans.registry import over, query
from contentlake.sources.tables import Lake

SEASON = r"(?:s[0-9]+|season\s*[0-9]+|series\s*[0-9]+|episode\s*[0-9]+|ep\s*[0-9]+)"

# titles of all sources: item names and page addresses
TITLES = "SELECT item_id AS id, name AS t FROM items UNION ALL SELECT -1 - page_id, url FROM pages"


def titles(lake: Lake):
    items = lake.items.select(F.col("item_id").alias("id"), F.col("name").alias("t"))
    return items.unionAll(lake.pages.select((-1 - F.col("page_id")).alias("id"), F.col("url").alias("t")))


def separators_sql(t: str) -> str:
    return f"translate({t}, '._', '  ')"


def brackets_sql(t: str) -> str:
    for _ in range(4):
        t = rf"regexp_replace({t}, '\[[^\[\]]*\]', '', 'g')"
    return rf"regexp_replace({t}, '(?s)\[.*$', '')"


def parens_sql(t: str) -> str:
    """Years are first marked, then every other pair goes, then the marks turn into the year."""
    marked = rf"regexp_replace({t}, '\(\s*((19|20)[0-9][0-9])\s*\)', '<<\1>>', 'g')"
    bare = rf"regexp_replace({marked}, '\([^)]*\)', '', 'g')"
    return rf"regexp_replace({bare}, '<<([0-9]+)>>', '\1 ', 'g')"


def season_sql(t: str) -> str:
    return rf"CASE WHEN regexp_matches({t}, '(?i)^[^a-z]?{SEASON}') THEN {t} ELSE regexp_replace({t}, '(?is)^(.+?)[^a-z]{SEASON}.*$', '\1') END"


STRIP = ["1080p", "bluray", "x264", "yts", "hdtv", "720p", "complete", "widget"]


def strip_sql(t: str) -> str:
    for word in STRIP:
        t = rf"regexp_replace({t}, '(?i)(^|[^a-z0-9]){word}($|[^a-z0-9])', '\1\2')"
    return t


def tidy_sql(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({t}, '\s+', ' ', 'g'), '[-(\[ ]+$', ''))"


@query("t1_separators", over("items", titles=TITLES) + f"SELECT id, {separators_sql('t')} AS out FROM titles")
def separators(lake: Lake):
    return titles(lake).select("id", text.norm_separators(F.col("t")).alias("out"))


@query("t2_brackets", over("items", titles=TITLES) + f"SELECT id, {brackets_sql('t')} AS out FROM titles")
def brackets(lake: Lake):
    return titles(lake).select("id", text.drop_brackets(F.col("t")).alias("out"))


@query("t3_year_parens", over("items", titles=TITLES) + f"SELECT id, {parens_sql('t')} AS out FROM titles")
def year_parens(lake: Lake):
    return titles(lake).select("id", text.keep_year_parens(F.col("t")).alias("out"))


@query("t4_season_cut", over("items", titles=TITLES, sep=f"SELECT id, {separators_sql('t')} AS t FROM titles")
       + f"SELECT id, {season_sql('t')} AS out FROM sep")
def season_cut(lake: Lake):
    return titles(lake).select("id", text.cut_at_season(text.norm_separators(F.col("t"))).alias("out"))


@query("t5_strip_keywords", over("items", sep=f"SELECT item_id, {separators_sql('name')} AS t FROM items")
       + f"SELECT item_id, {strip_sql('t')} AS out FROM sep")
def strip_exact(lake: Lake):
    name = text.norm_separators(F.col("name"))
    return lake.items.select("item_id", text.strip_keywords(name, STRIP).alias("out"))


@query("t5_strip_whole_words", over("items", sep=f"SELECT item_id, {separators_sql('name')} AS t FROM items")
       + f"SELECT item_id, {strip_sql('t')} AS out FROM sep")
def strip_words(lake: Lake):
    name = text.norm_separators(F.col("name"))
    return lake.items.select("item_id", text.strip_keywords(name, STRIP, "whole_word").alias("out"))


@query("t6_tidy", f"SELECT doc_id, md5({tidy_sql('text')}) AS out FROM documents")
def tidy(lake: Lake):
    return lake.documents.select("doc_id", F.md5(text.tidy(F.col("text"))).alias("out"))


TITLE_STEPS = over(
    "items",
    a=f"SELECT item_id, info_hash, name, {parens_sql(brackets_sql(separators_sql('name')))} AS t FROM items",
    b=f"SELECT item_id, info_hash, name, {season_sql('t')} AS t FROM a",
    c=f"SELECT item_id, info_hash, name, {tidy_sql(strip_sql('t'))} AS title FROM b",
)


@query("t7_extract_title", TITLE_STEPS + "SELECT item_id, title FROM c")
def extract_title(lake: Lake):
    return lake.items.select("item_id", text.extract_title(F.col("name"), STRIP).alias("title"))


# a neutral keyword table, and patterns for the names, paths and texts of the given tables
KEYWORDS = [("ring", 10), ("gear", 9), ("red", 5), ("bolt", 3), ("the", 2)]
PATTERNS = [
    (r"season[ _.][0-9]", 3),
    (r"x26[0-9]-[a-z]{3}\z", 11),
    (r"^\[[a-z]+\] ", 7),
    (r"_0[37]\.(nfo|mkv)\z", 8),
    (r"[.]s[0-9]{2}e[0-9]{2}[.]", 5),
    (r"hdr\)\z", 10),
    (r"license[^a-z]+version", 4),
]


def weight_sql(folded: str) -> str:
    cases = " ".join(f"WHEN contains({folded}, '{w}') THEN {n}" for w, n in sorted(KEYWORDS, key=lambda k: -k[1]))
    return f"CASE {cases} ELSE 0 END"


def regex_sql(t: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({t}, '(?i){p}') THEN {n}" for p, n in sorted(PATTERNS, key=lambda k: -k[1]))
    return f"CASE {cases} ELSE 0 END"


FOLDED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("t8_keyword_weight", over("items", texts="SELECT item_id AS id, name AS t FROM items UNION ALL SELECT -1 - doc_id, text FROM documents")
       + f"SELECT id, {weight_sql(FOLDED.format('t'))} AS weight FROM texts")
def keyword_weight(lake: Lake):
    folded = names_and_documents(lake).withColumn("f", text.ascii_lower(F.col("t")))
    return folded.select("id", cf.max_keyword_weight(F.col("f"), KEYWORDS).alias("weight"))


def names_and_documents(lake: Lake):
    items = lake.items.select(F.col("item_id").alias("id"), F.col("name").alias("t"))
    return items.unionAll(lake.documents.select((-1 - F.col("doc_id")).alias("id"), F.col("text").alias("t")))


@query("t9_regex_weight", over("items", texts="SELECT item_id AS id, name AS t FROM items UNION ALL SELECT -1 - doc_id, text FROM documents")
       + f"SELECT id, {regex_sql('t')} AS weight FROM texts")
def regex_weight(lake: Lake):
    return names_and_documents(lake).select("id", cf.max_regex_weight(F.col("t"), PATTERNS).alias("weight"))


EXT = "CASE WHEN contains(path, '.') THEN lower(regexp_extract(path, '[^.]*$')) END"
VIDEO_LIST, IMAGE_LIST = (f"({', '.join(map(repr, names))})" for names in (VIDEO_EXTENSIONS, IMAGE_EXTENSIONS))


@query("t10_extension_class", over("item_files") + f"""
SELECT CASE WHEN {EXT} IN {VIDEO_LIST} THEN 'video' WHEN {EXT} IN {IMAGE_LIST} THEN 'image' ELSE 'other' END AS class,
       count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM item_files GROUP BY 1
""")
def extension_class(lake: Lake):
    return lake.item_files.groupBy(paths.extension_class(F.col("path")).alias("class")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    )


SPECIAL = r"CAST(strlen({0}) - length(regexp_replace({0}, '[^A-Za-z0-9\s\x0b]', '', 'g')) AS BIGINT)"


@query("t11_special_ratio", over("items", texts="SELECT item_id AS id, name AS t FROM items UNION ALL SELECT -1 - doc_id, text FROM documents")
       + f"""SELECT id, {SPECIAL.format('t')} AS special, {SPECIAL.format('t')} * 5 > strlen(t) AS dense,
       round(CASE WHEN strlen(t) > 0 THEN CAST({SPECIAL.format('t')} AS DOUBLE) / strlen(t) ELSE 0 END, 6) AS ratio FROM texts""")  # fmt: skip
def special_ratio(lake: Lake):
    t = F.col("t")
    return names_and_documents(lake).select(
        "id", text.special_count(t).alias("special"), text.is_special_dense(t).alias("dense"),
        F.round(text.special_ratio(t), 6).alias("ratio"),
    )


@query("t12_numbered_files", over("item_files") + """
SELECT item_id, count(*) AS n_files, count(CASE WHEN regexp_matches(path, '[0-9][0-9]') THEN 1 END) AS n_numbered,
       count(*) >= 10 AND count(CASE WHEN regexp_matches(path, '[0-9][0-9]') THEN 1 END) * 2 > count(*) AS numbered
FROM item_files GROUP BY item_id
""")
def numbered_files(lake: Lake):
    signals = cf.file_signals(lake.item_files, (), ())
    return signals.select("item_id", "n_files", "n_numbered", cf.has_numbered_files().alias("numbered"))


# sizes over all units, with exact ties
SIZES = """SELECT l_orderkey * 8 + l_linenumber AS id,
  CAST(l_quantity * 1152 AS BIGINT) * CASE l_linenumber % 5 WHEN 0 THEN 1 WHEN 1 THEN 16 WHEN 2 THEN 1024 WHEN 3 THEN 1048576 ELSE 34359738368 END AS n
  FROM lineitem"""


@query("t13_format_size", over(sizes=SIZES) + """
SELECT id, n, CASE WHEN n >= 1099511627776 THEN printf('%.2f TB', n / 1099511627776.0::DOUBLE)
  WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0::DOUBLE)
  WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0::DOUBLE) ELSE printf('%.2f B', n::DOUBLE) END AS shown FROM sizes
""")
def format_size(lake: Lake):
    return lake.sql(SIZES).select("id", "n", text.format_size(F.col("n")).alias("shown"))


@query("t14_hex", over("items") + """
SELECT item_id, lower(hex(unhex(info_hash))) AS h, octet_length(unhex(info_hash)) AS bytes FROM items
""")
def hex_codec(lake: Lake):
    from contentlake.functions.ids import from_hex, to_hex

    raw = from_hex(F.col("info_hash"))
    return lake.items.select("item_id", to_hex(raw).alias("h"), F.octet_length(raw).cast("bigint").alias("bytes"))


@query("t15_percent_encode", over("items", titles=TITLES) + """
SELECT id, url_encode(t) AS out FROM titles
""")
def percent_encode(lake: Lake):
    return titles(lake).select("id", text.percent_encode(F.col("t")).alias("out"))


@query("t16_percent_decode", """
SELECT page_id, url_decode(replace(url, '+', ' ')) AS once, url_decode(url_encode(url)) AS back FROM pages
""")
def percent_decode(lake: Lake):
    url = F.col("url")
    return lake.pages.select(
        "page_id", text.percent_decode(url).alias("once"), text.percent_decode(text.percent_encode(url)).alias("back")
    )


@query("t17_links", TITLE_STEPS + """
SELECT item_id, 'magnet:?xt=urn:btih:' || info_hash || '&dn=' || url_encode(name) AS magnet,
       'https://titles.example/find?q=' || url_encode(title) AS title_url FROM c
""")
def links(lake: Lake):
    from contentlake.operators.catalog import with_links

    title = text.extract_title(F.col("name"), STRIP)
    return with_links(lake.items, title, "https://titles.example/find?q=").select("item_id", "magnet", "title_url")


@query("t18_counts_and_uptime", """
WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (1 + o_orderkey % 9001) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n >= 1000000 THEN (n // 1000000)::VARCHAR || ',' || lpad((n // 1000 % 1000)::VARCHAR, 3, '0') || ',' || lpad((n % 1000)::VARCHAR, 3, '0')
         WHEN n >= 1000 THEN (n // 1000)::VARCHAR || ',' || lpad((n % 1000)::VARCHAR, 3, '0') ELSE n::VARCHAR END AS shown,
       (n // 3600)::VARCHAR || ':' || lpad((n % 3600 // 60)::VARCHAR, 2, '0') AS uptime FROM n
""")
def counts_and_uptime(lake: Lake):
    n = F.floor("o_totalprice") * (1 + F.col("o_orderkey") % 9001)
    return lake.orders.select("o_orderkey", text.format_count(n).alias("shown"), text.format_uptime(n).alias("uptime"))


# addresses spread over all ranges, some private, some without a port
ADDRESSES = """SELECT event_id, user_id,
  CASE event_id % 9 WHEN 0 THEN 167772160 + event_id WHEN 1 THEN 3232235520 + event_id % 65536
                    WHEN 2 THEN 2886729728 + event_id WHEN 3 THEN 2130706433 WHEN 4 THEN 0 WHEN 5 THEN 4294967295
                    ELSE event_id * 2654435761 % 4294967296 END AS ip,
  event_id * 7919 % 256 AS port FROM events"""


@query("t19_public_peer", over(a=ADDRESSES) + """
SELECT event_id, ip <> 0 AND port <> 0 AND ip & 4278190080 <> 167772160 AND ip & 4294901760 <> 3232235520
       AND ip & 4293918720 <> 2886729728 AND ip & 4278190080 <> 2130706432 AS public,
       concat_ws('.', ip >> 24, (ip >> 16) & 255, (ip >> 8) & 255, ip & 255) AS dotted FROM a
""")
def public_peer(lake: Lake):
    a = lake.sql(ADDRESSES)
    ip, port = F.col("ip"), F.col("port")
    return a.select("event_id", net.is_public_peer(ip, port).alias("public"), net.dotted(ip).alias("dotted"))
