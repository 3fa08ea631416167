"""Catalogue queries: search, ranking, pages, nested files, lookups.

Tables: items(info_hash, name, size_bytes, total_peers, added_ts, item_id) and
item_files(item_id, file_index, path, size_bytes).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from unicodedata import category, normalize

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from contentlake.functions.ids import is_id
from contentlake.functions.paths import VIDEO_EXTENSIONS, path_filename
from contentlake.functions.stems import stem, stem_tokens
from contentlake.functions.text import ascii_lower, format_size, magnet_link, percent_encode
from contentlake.operators.frames import join_nullable, side_by_side
from contentlake.operators.keyspace import sample_k
from contentlake.settings import DEFAULTS



def _accented(c: str) -> bool:
    """A letter that decomposes into another one and marks."""
    parts = normalize("NFD", c)
    return len(parts) > 1 and c == c.lower() and parts[0].isalpha() and all(category(m) == "Mn" for m in parts[1:])


# Accented letters of all scripts and their bare forms, folded for token search.
DIACRITICS = "".join(filter(_accented, map(chr, range(0xC0, 0x2100))))
BARE = "".join(normalize("NFD", c)[0] for c in DIACRITICS)
MARKS = r"\p{Mn}+"

WORD_BREAK = r"[^\p{L}\p{N}]+"


# --- tokens and match expressions -------------------------------------------------------------


def folded(text: Column) -> Column:
    """Lower case without diacritics, composed or not; plain-ASCII rows need no translation."""
    lowered = F.lower(text)
    bare = F.regexp_replace(F.translate(lowered, DIACRITICS, BARE), MARKS, "")
    return F.when(F.length(text) == F.octet_length(text), lowered).otherwise(bare)


def tokens(text: Column) -> Column:
    """Lower-case words with diacritics folded."""
    return F.filter(F.split(folded(text), WORD_BREAK), lambda w: w != "")


def stemmed_tokens(text: Column) -> Column:
    return stem_tokens(tokens(text))


def plain_tokens(text: str) -> list[str]:
    bare = text.lower().translate(str.maketrans(DIACRITICS, BARE))
    bare = "".join(c for c in bare if category(c) != "Mn")
    return [w for w in re.split(r"[\W_]+", bare) if w]


Leaf = Callable[[str, bool], Column | None]
Tree = tuple  # ("term", text, is_prefix), ("all" | "and" | "or", [trees]) or ("not", wanted, unwanted)


def parse(query: str) -> Tree | None:
    """``a b``, ``a AND b``, ``a OR b``, ``a NOT b``, ``"a phrase"``, ``pre*`` and brackets; None for an empty query.

    Terms side by side ("all", an implied AND) bind closest, then NOT, AND and OR. What cannot be read is a ValueError.
    """
    marks = re.findall(r'"[^"]*"\*?|[()]|[^\s()"]+|"', query)
    at = 0

    def peek() -> str | None:
        return marks[at] if at < len(marks) else None

    def take() -> str:
        nonlocal at
        at += 1
        return marks[at - 1]

    def unit() -> Tree:
        mark = peek()
        if mark is None or mark in ("AND", "OR", "NOT", ")", '"'):
            raise ValueError(f"a term is missing in {query!r} before {mark or 'its end'}")
        take()
        if mark == "(":
            inner = either()
            if peek() != ")":
                raise ValueError(f"a bracket is not closed in {query!r}")
            take()
            return inner
        return ("term", mark.rstrip("*").strip('"'), mark.endswith("*"))

    def together() -> Tree:
        parts = [unit()]
        while peek() not in (None, "AND", "OR", "NOT", ")"):
            parts.append(unit())
        return parts[0] if len(parts) == 1 else ("all", parts)

    def difference() -> Tree:
        tree = together()
        while peek() == "NOT":
            take()
            tree = ("not", tree, together())
        return tree

    def every() -> Tree:
        parts = [difference()]
        while peek() == "AND":
            take()
            parts.append(difference())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def either() -> Tree:
        parts = [every()]
        while peek() == "OR":
            take()
            parts.append(every())
        return parts[0] if len(parts) == 1 else ("or", parts)

    if not marks:
        return None
    tree = either()
    if at < len(marks):
        raise ValueError(f"a bracket is closed that was not opened in {query!r}")
    return tree


def match(query: str, leaf: Leaf) -> Column:
    """A predicate for a query as :func:`parse` reads it. A term without tokens is skipped among terms side by side and
    matches nothing where it stands alone."""

    def test(tree: Tree | None) -> Column | None:
        if tree is None:
            return None
        if tree[0] == "term":
            return leaf(tree[1], tree[2])
        if tree[0] == "not":
            wanted, unwanted = test(tree[1]), test(tree[2])
            return wanted if wanted is None or unwanted is None else wanted & ~unwanted
        found = list(map(test, tree[1]))
        if tree[0] == "and":
            found = [F.lit(False) if c is None else c for c in found]
        out = None
        for column in found:
            if column is not None:
                out = column if out is None else (out | column if tree[0] == "or" else out & column)
        return out

    found = test(parse(query))
    return F.lit(False) if found is None else found


def _name_leaf(words: Column, stemming: bool) -> Leaf:
    def leaf(term: str, is_prefix: bool) -> Column | None:
        wanted = plain_tokens(term)
        if not wanted:
            return None
        if stemming:
            wanted = [stem(w) for w in wanted]
        if len(wanted) == 1 and not is_prefix:
            return F.array_contains(words, wanted[0])
        # a phrase: neighbouring words, the last one open when it is a prefix
        sep = "\x01"
        joined = F.concat(F.lit(sep), F.array_join(words, sep), F.lit(sep))
        return F.contains(joined, F.lit(sep + sep.join(wanted) + ("" if is_prefix else sep)))

    return leaf


def name_matches(words: Column, query: str, stemming: bool = True) -> Column:
    return match(query, _name_leaf(words, stemming))


def file_matches(path: Column, query: str) -> Column:
    """Case-insensitive substring of the file name; terms under three characters carry no trigram."""
    name = F.lower(path_filename(path))

    def leaf(term: str, is_prefix: bool) -> Column | None:
        return F.contains(name, F.lit(term.lower())) if len(term) >= 3 else None

    return match(query, leaf)


# --- search -----------------------------------------------------------------------------------


def _needed_words(query: str) -> list[str] | None:
    """Words that every matching name holds: those of all terms if only ANDs join them, else None."""

    def words(tree: Tree | None) -> list[str] | None:
        if tree is None:
            return []
        if tree[0] == "term":
            return plain_tokens(tree[1])
        if tree[0] not in ("all", "and"):
            return None
        parts = [words(t) for t in tree[1]]
        return None if None in parts else [w for part in parts for w in part]

    return words(parse(query))


def _may_match(query: str) -> Column | None:
    """A cheap native test every matching name passes, or None.

    With implied AND, a name must contain the first letters of every word: a stem of three or more
    letters keeps the first two of its word, a shorter one the first.
    """
    name = folded(F.col("name"))
    test = None
    for word in _needed_words(query) or ():
        kept = stem(word)
        has = F.contains(name, F.lit(kept[:2] if len(kept) > 2 else kept[:1]))
        test = has if test is None else test & has
    return test


def _filter_names(items: DataFrame, query: str, stemming: bool, also: Column) -> DataFrame:
    """Rows whose name matches, or for which ``also`` holds; Python only sees names that may match."""
    if not stemming:
        return items.filter(also | name_matches(tokens(F.col("name")), query, False))
    test = _may_match(query)
    open_ = ~also if test is None else ~also & test
    # A filter below the Python step would be merged with the one above it; a NULL name costs it nothing wherever it stands.
    words = items.withColumn("_words", stemmed_tokens(F.when(open_, F.col("name"))))
    found = F.coalesce(name_matches(F.col("_words"), query, True), F.lit(False))
    return words.filter(also | found).drop("_words")


def search_names(items: DataFrame, query: str, stemming: bool = True) -> DataFrame:
    """Items whose name matches: a filter over the scan, no shuffle."""
    return _filter_names(items, query, stemming, F.lit(False))


def search_files(files: DataFrame, query: str) -> DataFrame:
    return files.filter(file_matches(F.col("path"), query))


def search(items: DataFrame, files: DataFrame, query: str, stemming: bool = True) -> DataFrame:
    """Items hit by name or by one of their file names: one scan of each table, one join."""
    # distinct pre-aggregates per task, so an item with very many hits moves once per task
    hits = search_files(files, query).select("item_id").distinct().withColumn("_hit", F.lit(True))
    flagged = items.join(hits, "item_id", "left")
    return _filter_names(flagged, query, stemming, F.col("_hit").isNotNull()).drop("_hit")


def search_count(items: DataFrame, files: DataFrame, query: str, stemming: bool = True) -> DataFrame:
    found = search(items, files, query, stemming)
    return found.agg(F.countDistinct("item_id").alias("total_count"))


def name_postings(items: DataFrame, stemming: bool = True, buckets: int = 256) -> DataFrame:
    """Search postings (bucket, term, item_id, positions) to be written partitioned by bucket.

    Built row by row without a shuffle: one posting per distinct word of a name.
    """
    words = stemmed_tokens(F.col("name")) if stemming else tokens(F.col("name"))
    exploded = items.select("item_id", words.alias("_words")).withColumn("term", F.explode(F.array_distinct("_words")))
    places = F.transform("_words", lambda word, i: F.when(word == F.col("term"), i))
    rows = exploded.select("term", "item_id", F.filter(places, lambda i: i.isNotNull()).alias("positions"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))


def search_postings(postings: DataFrame, query: str, stemming: bool = True, buckets: int = 256) -> DataFrame:
    """item_ids that match a query as :func:`parse` reads it, from postings alone, with the rows of :func:`search_names`.

    A word reads the bucket of its term, a prefix the terms that begin with it; phrases are words at neighbouring positions.
    """

    def of_word(word: str) -> DataFrame:
        bucket = F.pmod(F.xxhash64(F.lit(word)), F.lit(buckets)).cast("int")
        return postings.filter((F.col("bucket") == bucket) & (F.col("term") == word))

    def of_term(text: str, is_prefix: bool) -> DataFrame | None:
        words = [stem(w) if stemming else w for w in plain_tokens(text)]
        if not words:
            return None
        hits = [of_word(w) for w in words[:-1]]
        hits.append(postings.filter(F.startswith("term", F.lit(words[-1]))) if is_prefix else of_word(words[-1]))
        if len(words) == 1:
            return hits[0].select("item_id").distinct()
        places = None  # where the phrase would begin, for each of its words
        for k, found in enumerate(hits):
            own = found.select("item_id", F.explode("positions").alias("at"), F.lit(k).alias("k"))
            own = own.withColumn("at", F.col("at") - k).distinct()
            places = own if places is None else places.union(own)
        whole = places.groupBy("item_id", "at").agg(F.count("*").alias("n")).filter(F.col("n") == len(words))
        return whole.select("item_id").distinct()

    def ids(tree: Tree | None) -> DataFrame | None:
        if tree is None:
            return None
        if tree[0] == "term":
            return of_term(tree[1], tree[2])
        if tree[0] == "not":
            wanted, unwanted = ids(tree[1]), ids(tree[2])
            return wanted if wanted is None or unwanted is None else wanted.join(unwanted, "item_id", "left_anti")
        found = list(map(ids, tree[1]))
        if tree[0] == "and" and any(d is None for d in found):
            return postings.select("item_id").limit(0)
        out = None
        for frame in found:
            if frame is not None and out is not None:
                out = out.union(frame).distinct() if tree[0] == "or" else out.join(frame, "item_id", "left_semi")
            elif frame is not None:
                out = frame
        return out

    found = ids(parse(query))
    return postings.select("item_id").limit(0) if found is None else found


# --- pages ------------------------------------------------------------------------------------


def ranked(items: DataFrame) -> list[Column]:
    return [F.desc("total_peers"), F.desc("added_ts"), F.asc("item_id")]


def page_of(items: DataFrame, page: int = 1, size: int = DEFAULTS.page_size) -> DataFrame:
    """One page by peers, then newest, then id (top-k per task, no full sort)."""
    page = max(page, 1)
    return items.orderBy(*ranked(items)).offset((page - 1) * size).limit(size)


def page_after(items: DataFrame, last: Row | None, size: int = DEFAULTS.page_size) -> DataFrame:
    """The page that follows the row ``last`` of the page before (None: the first page).

    A page costs as much at the end as at the beginning: top-k of ``size`` rows per task, and the test on peers and time is
    one that files and row groups answer by their statistics where the table is laid out by them (:func:`ranked_layout`).
    """
    if last is None:
        return page_of(items, 1, size)
    peers, added, key = F.col("total_peers"), F.col("added_ts"), F.col("item_id")
    same_peers, same_time = peers == F.lit(last["total_peers"]), added == F.lit(last["added_ts"])
    behind = (peers < F.lit(last["total_peers"])) | (same_peers & (added < F.lit(last["added_ts"])))
    behind = behind | (same_peers & same_time & (key > F.lit(last["item_id"])))
    return items.filter((peers <= F.lit(last["total_peers"])) & behind).orderBy(*ranked(items)).limit(size)


def ranked_layout(items: DataFrame, path: str, files: int | None = None) -> None:
    """Write items in the order of their rank, so that a page opens the few files that hold it."""
    order = ranked(items)
    spread = items.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    spread.write.mode("overwrite").parquet(path)


def page_info(items: DataFrame, page: int = 1, size: int = DEFAULTS.page_size) -> DataFrame:
    page = max(page, 1)
    total = F.count(F.lit(1))
    pages = F.ceil(total / size)
    shown = F.greatest(F.lit(0), F.least(F.lit(size), total - (page - 1) * size))
    return items.agg(
        total.alias("total_count"),
        F.lit(page).cast("bigint").alias("page"),
        shown.cast("bigint").alias("count"),
        ((page - 1) * size + shown < total).alias("has_more"),
        pages.cast("bigint").alias("total_pages"),
        F.lit(page > 1).alias("has_prev"),
        (F.lit(page) < pages).alias("has_next"),
    )


def with_file_count(items: DataFrame, files: DataFrame) -> DataFrame:
    """Every item with its number of files, zero included."""
    counts = files.groupBy("item_id").agg(F.count(F.lit(1)).alias("num_files"))
    return items.join(counts, "item_id", "left").withColumn("num_files", F.coalesce("num_files", F.lit(0)))


def first_files(files: DataFrame, n: int = DEFAULTS.files_per_result) -> DataFrame:
    """(item_id, files): the first ``n`` files by index as an array of (file_index, path, size_bytes).

    The rank filter is pushed below the shuffle, so at most ``n`` rows per item and task move.
    """
    first = Window.partitionBy("item_id").orderBy("file_index")
    top = files.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= n)
    entry = F.struct("file_index", "path", "size_bytes")
    return top.groupBy("item_id").agg(F.array_sort(F.collect_list(entry)).alias("files"))


def attach_files(items: DataFrame, files: DataFrame, n: int = DEFAULTS.files_per_result) -> DataFrame:
    return items.join(first_files(files, n), "item_id", "left")


def fetch_page(found: DataFrame, page: int = 1, size: int = DEFAULTS.page_size) -> tuple[DataFrame, int]:
    """(the page, the total number of rows).

    The page has at most ``size`` rows and is brought to the driver, so that what follows reads
    its ids as literals. The total is an aggregate of its own, which no repeated task can raise.
    """
    rows = page_of(found, page, size).toArrow()
    total = found.agg(F.count(F.lit(1)).alias("total")).first()["total"]
    return found.sparkSession.createDataFrame(rows, found.schema), total


def with_file_details(page: DataFrame, files: DataFrame) -> DataFrame:
    """A fetched page with file counts and first files.

    The (at most page size) ids become an IN filter that reaches the scan of the file table.
    """
    ids = [row["item_id"] for row in page.select("item_id").collect()]
    own = files.filter(F.col("item_id").isin(ids))
    return attach_files(with_file_count(page, own), own)


def result_page(found: DataFrame, files: DataFrame, page: int = 1, size: int = DEFAULTS.page_size) -> DataFrame:
    """A ranked page with file counts and first files. The order needs no file data, so the page is
    cut first and files are read for its ids only."""
    top = found.sparkSession.createDataFrame(page_of(found, page, size).toArrow(), found.schema)
    return with_file_details(top, files)


def latest(items: DataFrame, n: int) -> DataFrame:
    return items.orderBy(F.desc("added_ts"), F.desc("item_id")).limit(n)


def lookup(items: DataFrame, key: str) -> DataFrame:
    """(query, valid, found, name, total_peers): always one row."""
    valid = re.fullmatch(r"[0-9a-fA-F]{40}", key) is not None
    hit = items.filter(F.col("info_hash") == F.lit(key.lower() if valid else ""))
    return hit.agg(
        F.lit(key).alias("query"),
        F.lit(valid).alias("valid"),
        (F.count(F.lit(1)) > 0).alias("found"),
        F.max("name").alias("name"),
        F.max("total_peers").alias("total_peers"),
    )


def lookup_many(items: DataFrame, keys: DataFrame, key: str = "query") -> DataFrame:
    """Each asked key with its validity and the item it names."""
    asked = keys.withColumn("valid", is_id(F.col(key))).withColumn(
        "info_hash", F.when(F.col("valid"), F.lower(F.col(key)))
    )
    known = items.select("info_hash", "name", F.lit(True).alias("found"))
    return join_nullable(asked, known, "info_hash").select(
        key, "valid", F.coalesce("found", F.lit(False)).alias("found"), "name"
    )


def catalog_bounds(items: DataFrame, files: DataFrame) -> DataFrame:
    item_side = items.agg(F.max("item_id").alias("max_id"), F.count(F.lit(1)).alias("items"))
    file_side = files.agg(F.count(F.lit(1)).alias("files"))
    return side_by_side(item_side, file_side)


def peer_class(peers: Column) -> Column:
    return F.when(peers > 100, "high").when(peers > 10, "medium").otherwise("low")


# --- video ------------------------------------------------------------------------------------


def video_items(files: DataFrame) -> DataFrame:
    """(item_id, video_bytes, total_bytes, is_video): most bytes lie in video files."""
    suffix = r"\.(" + "|".join(VIDEO_EXTENSIONS) + r")\z"
    video = F.regexp_like(ascii_lower(path_filename(F.col("path"))), F.lit(suffix))
    sums = files.groupBy("item_id").agg(
        F.sum(F.when(video, F.col("size_bytes")).otherwise(0)).alias("video_bytes"),
        F.sum("size_bytes").alias("total_bytes"),
    )
    return sums.withColumn(
        "is_video", (F.col("total_bytes") > 0) & (F.col("video_bytes") * 2 > F.col("total_bytes"))
    )


def sample_pool(items: DataFrame, files: DataFrame, peers: int = DEFAULTS.sample_peers) -> DataFrame:
    """Items with exactly ``peers`` peers that are mostly video."""
    wanted = items.filter(F.col("total_peers") == peers)
    own = files.join(wanted.select("item_id"), "item_id", "left_semi")
    return wanted.join(video_items(own).filter("is_video"), "item_id", "left_semi")


def sample_videos(
    items: DataFrame, files: DataFrame, n: int = DEFAULTS.sample_size, seed: int = 0,
    peers: int = DEFAULTS.sample_peers,
) -> DataFrame:
    """A uniform sample, repeatable for a seed: ranked by a seeded hash of the key."""
    pool = sample_pool(items, files, peers)
    return sample_k(pool, "info_hash", n, seed)


# --- shown columns ----------------------------------------------------------------------------


def with_links(items: DataFrame, title: Column, search_url: str) -> DataFrame:
    return items.withColumn("magnet", magnet_link(F.col("info_hash"), F.col("name"))).withColumn(
        "title_url", F.concat(F.lit(search_url), percent_encode(title))
    )


def result_json(page: DataFrame) -> DataFrame:
    """One JSON object per result row, with the columns that rank it."""
    files = F.transform(
        F.col("files"),
        lambda f: F.struct(
            f["path"].alias("path"), format_size(f["size_bytes"]).alias("size"), f["size_bytes"].alias("size_bytes")
        ),
    )
    row = F.struct(
        "info_hash",
        "name",
        format_size(F.col("size_bytes")).alias("size"),
        "size_bytes",
        "total_peers",
        F.col("added").alias("added"),
        "num_files",
        files.alias("files"),
    )
    return page.select("item_id", "total_peers", "added_ts", F.to_json(row).alias("json"))


def search_report(found: DataFrame, files: DataFrame, page: int, size: int, now: int) -> DataFrame:
    """The whole answer of a search page as one JSON document (at most ``size`` results)."""
    page = max(page, 1)
    top, total = fetch_page(found, page, size)
    results = result_json(with_file_details(top, files).withColumn("added", F.unix_timestamp("added_ts")))
    place = F.struct((-F.col("total_peers")).alias("a"), (-F.unix_timestamp("added_ts")).alias("b"), "item_id", "json")
    rows = results.agg(F.array_sort(F.collect_list(place)).alias("rows"))
    head = F.struct(
        F.size("rows").alias("count"),
        F.lit(total).alias("total_count"),
        F.lit(page).alias("page"),
        F.lit(size).alias("limit"),
        ((page - 1) * size + F.size("rows") < total).alias("has_more"),
        F.lit(now).alias("timestamp"),
    )
    body = F.array_join(F.transform("rows", lambda r: r["json"]), ",")
    opened = F.regexp_replace(F.to_json(head), r"\}$", ',"results":[')
    return rows.select(F.concat(opened, body, F.lit("]}")).alias("json"))
