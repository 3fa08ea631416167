"""The stored index against the scanning search, what its plans read, and its epochs."""

import random

import pytest
from pyspark.sql import functions as F

from contentlake.operators import catalog, postings, searchindex
from contentlake.operators.searchindex import SearchIndex
from contentlake.sources.ranged import EPOCH, Ranged
from test_plans import plan

WORDS = "ring gear blue season two reading cafés house x264 river sound 2 s01e02 état".split()


def tables(spark, count=400, seed=1):
    rng = random.Random(seed)
    items = [(k, ".".join(rng.choice(WORDS) for _ in range(rng.randrange(6))) or None, k % 7) for k in range(count)]
    paths = ["/".join("_".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3))) for _ in range(2 * count)]
    files = [(k // 2, k % 2, path + rng.choice([".mkv", ".MP4", ""]), 10) for k, path in enumerate(paths) if k % 5]
    return (
        spark.createDataFrame(items, "item_id long, name string, total_peers int").withColumn("added_ts", F.timestamp_seconds("item_id")),
        spark.createDataFrame(files, "item_id long, file_index int, path string, size_bytes long"),
    )


QUERIES = [
    "ring", "ring gear", '"season two"', '"two season" OR blue', "rea*", "readings NOT ring", "(ring OR gear) NOT (blue OR house)", "etat", "CAFÉS",
    "ring AND xy", "no_such_word", "zz", "", "ring no_such_word", "x264 riv", ".mp4", '"ring_gear"', "gear_blue.mkv", "ing_", "_ring ring_ mkv", "s01* NOT 2",
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    items, files = tables(spark)
    index = SearchIndex.create(spark, str(tmp_path_factory.mktemp("index")), items, files, parts=6)
    stale = F.col("item_id") % 5 == 0
    index.add(items.withColumn("name", F.when(stale, "ring gear old").otherwise(F.col("name"))), files.withColumn("path", F.when(stale, "ring_gear.mp4").otherwise(F.col("path"))), 0)
    index.add(items.filter(stale), files.filter(stale & (F.col("item_id") % 10 == 0)), 1)
    index.items.write(items.withColumn("name", F.lit("ring")), 2)  # never committed
    now = files.filter(~stale | (F.col("item_id") % 10 == 0))  # some items lost their files
    return SearchIndex.open(spark, index.path), items, now


def rows(df):
    return sorted(map(repr, df.collect()))


def agree(stored, text):
    index, items, files = stored
    assert rows(index.search(text)) == rows(catalog.search(items, files, text)), text


@pytest.mark.parametrize("text", QUERIES)
def test_index_equals_scan(stored, text):
    agree(stored, text)


@pytest.mark.parametrize("text", ['(ring OR gear) NOT (blue OR house)', "gear_blue.mkv", "s01* NOT 2"])
def test_each_form_and_many_hits(stored, text, monkeypatch):
    index, items, files = stored
    assert rows(index.search_names(text)) == rows(catalog.search_names(items, text))
    assert rows(index.search_files(text)) == rows(catalog.search_files(files, text))
    assert index.search_count(text).first() == catalog.search_count(items, files, text).first()
    monkeypatch.setattr(searchindex, "FEW", 3)  # too many hits to name: joins instead of lists of ids
    agree(stored, text)


def test_compacted_index_and_pages(stored, tmp_path):
    index, items, files = stored
    small = index.compact(str(tmp_path / "small"))
    for text in ("ring", "gear NOT blue"):
        want = rows(catalog.result_page(catalog.search(items, files, text), files, 2, 10))
        assert rows(index.result_page(text, 2, 10)) == want == rows(small.result_page(text, 2, 10))
    assert small.items.all().count() == items.count()
    assert small.names.rows.ranges().filter("rows = 0").count() == 0


def test_no_table_is_read_whole_or_stemmed(stored, spark):
    index, _, _ = stored
    hits = index.names.hits("river sound")
    text = plan(hits)
    assert "ArrowEvalPython" not in text and "MapInArrow" not in text
    whole = spark.read.parquet(f"{index.path}/names/rows").inputFiles()
    opened = [f for f in hits.inputFiles() if "/names/rows/" in f]
    assert 0 < len(opened) < len(whole) / 2
    few = index.items.read([17, 399])
    assert len(few.inputFiles()) <= 4 < len(spark.read.parquet(f"{index.path}/items/rows").inputFiles())
    assert not any("/items/" in f or "/item_files/" in f for f in index.item_hits("river sound").inputFiles())


def test_a_rare_term_narrows_a_frequent_one(spark, tmp_path):
    items = spark.range(20000).select(F.col("id").alias("item_id"), F.when(F.col("id") == 777, "common rare").otherwise("common").alias("name"))
    files = spark.createDataFrame([], "item_id long, file_index int, path string")
    index = SearchIndex.create(spark, str(tmp_path / "i"), items, files, parts=16)
    index.add(items, files, 0)
    narrow, wide = index.names.hits("common rare"), index.names.hits("common")
    assert len(narrow.inputFiles()) <= 3 < 12 <= len(wide.inputFiles())
    assert [r["item_id"] for r in index.search_names("common rare").collect()] == [777]
    assert wide.count() == 20000


def test_repeated_epoch_replaces_itself(spark, tmp_path):
    items, files = tables(spark, 50)
    index = SearchIndex.create(spark, str(tmp_path / "i"), items, files)
    for _ in range(2):
        index.add(items, files, 0)
    assert rows(index.search("ring")) == rows(catalog.search(items, files, "ring"))


def test_empty_index(spark, tmp_path):
    items, files = tables(spark, 10)
    index = SearchIndex.create(spark, str(tmp_path / "i"), items, files)
    index.add(items.limit(0), files.limit(0), 0)
    assert index.search("ring").count() == 0 and index.search_count("ring OR gear").first()["total_count"] == 0
    assert index.result_page("ring").count() == 0


def test_ranged_read_of_prefixes_and_seconds(spark, tmp_path):
    df = spark.createDataFrame([(w, k) for w in ("a", "ab", "abc", "b", "ba") for k in range(30)], "term string, n int")
    table = Ranged(spark, str(tmp_path), "t", df.schema, ["term", "n"], 10)
    table.write(df, 0)
    from contentlake.sources.ranged import commit

    assert table.all().count() == 0  # not committed yet
    commit(spark, str(tmp_path), 0)
    assert table.all().count() == 150
    assert sorted({r["term"] for r in table.read((), ["ab"]).collect()}) == ["ab", "abc"]
    assert table.read(["b", "zz"]).count() == 30 and table.read(["b"], [], [3, 40]).count() == 1 and table.read(["b"], [], []).count() == 0
    assert set(table.read(["a"]).columns) == {"term", "n", EPOCH}


def test_accents_are_folded_composed_or_not(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate(["Café", "Café", "CAFE", "caf", "Tiếng Việt", "tiếng"])], "item_id long, name string")
    assert [r["item_id"] for r in catalog.search_names(df, "café").orderBy("item_id").collect()] == [0, 1, 2]
    assert [r["item_id"] for r in catalog.search_names(df, "café").orderBy("item_id").collect()] == [0, 1, 2]
    assert [r["item_id"] for r in catalog.search_names(df, "tieng").orderBy("item_id").collect()] == [4, 5]


def test_trigrams_are_blocks_of_places(spark, tmp_path):
    """Lists of file names are moved as blocks: far fewer rows than places, and no place is lost."""
    names = ["ring", "a\0b\0c", "ab", "", "😀ring😀", "ééé", "\0\0\0\0"] + [f"ring_{k % 7}.mp4" for k in range(3000)]
    names += ["".join(map(chr, range(0x4E00 + 40 * k, 0x4E00 + 40 * k + 40))) for k in range(300)]  # too many letters for one number
    files = spark.createDataFrame([(k % 900, k, name) for k, name in enumerate(names)] + [(None, 1, "ring"), (3, None, "ring"), (4, 9, None)], "item_id long, file_index int, path string")
    items = spark.range(900).select(F.col("id").alias("item_id"), F.lit("x").alias("name"))
    index = SearchIndex.create(spark, str(tmp_path / "i"), items, files, parts=4)
    index.add(items, files, 0)
    want = sorted((name[p : p + 3], k % 900, k, p + 1) for k, name in enumerate(names) for p in range(len(name) - 2))
    want += [("ing", 3, None, 2), ("rin", 3, None, 1)]
    blocks = index.grams.rows.all()
    got = [tuple(r)[:4] for r in postings.unfolded(blocks).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert blocks.filter("term = 'rin'").count() < 3000 / 8
    assert blocks.filter(f"size(places) > {postings.BLOCK} OR item_id <> array_min(item_ids) OR last_id <> array_max(item_ids)").isEmpty()
    assert {r["term"]: r["n"] for r in index.grams.counts.all().collect()}["rin"] == sum(t == "rin" for t, *_ in want)


def shuffle_bytes(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(held.apply(k).length() for k in range(held.size()) if held.apply(k).getName().startswith("shuffle_"))


def saved_tables(spark, path, count):
    items, files = tables(spark, count)
    items.union(items.limit(1).withColumn("item_id", F.lit(None).cast("long"))).write.parquet(f"{path}/items")
    files.union(files.limit(1).withColumn("item_id", F.lit(None).cast("long"))).write.parquet(f"{path}/files")
    return spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/files")


def test_what_is_stored_leaves_no_shuffles(spark, tmp_path):
    """each write of the index drops what it shuffled, and the setting that does so is as it was."""
    items, files = saved_tables(spark, tmp_path, 2000)
    index = SearchIndex.create(spark, str(tmp_path / "i"), items, files, parts=6)
    before = shuffle_bytes(spark)
    index.add(items, files, 0)
    index.compact(str(tmp_path / "small"))
    assert shuffle_bytes(spark) - before < 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_trigrams_stay_where_their_files_are(spark, tmp_path):
    """no shuffle of the longest list, and its places stored as differences; a file of it holds a stretch of items."""
    files = spark.range(40_000).selectExpr("id div 4 AS item_id", "CAST(id % 4 AS int) AS file_index", "substr(sha1(CAST(id AS string)), 1, 16) AS path")
    items = spark.range(10_000).selectExpr("id AS item_id", "'x' AS name")
    index = SearchIndex.create(spark, str(tmp_path / "i"), items, files, parts=5)
    index.add(items, files, 0)
    spans = sorted((r["first"], r["last"]) for r in index.grams.rows.ranges().collect())
    assert len(spans) > 2 and all(low[1] <= high[0] for low, high in zip(spans, spans[1:]))
    stored = sum(f.stat().st_size for f in (tmp_path / "i/grams/rows").rglob("*.parquet"))
    assert stored < 4 * 40_000 * 14
    some = files.filter("item_id = 77").first()["path"]
    assert [r["item_id"] for r in index.search_files(some).collect()] == [77]


def test_stretch_by_stretch(spark, tmp_path, monkeypatch):
    """a large index is written, searched and compacted stretch by stretch, with the same rows."""
    for name, value in {"STRETCH_BYTES": 1, "STRETCH_ROWS": 1, "FEW": 3}.items():
        monkeypatch.setattr(searchindex, name, value)
    items, files = saved_tables(spark, tmp_path, 300)
    index = SearchIndex.create(spark, str(tmp_path / "i"), items, files, parts=3)
    stale = F.col("item_id") % 5 == 0
    index.add(items.withColumn("name", F.when(stale, "ring gear old").otherwise(F.col("name"))), files.withColumn("path", F.when(stale, "ring_gear.mp4").otherwise(F.col("path"))), 0)
    index.add(items.filter(stale), files.filter(stale), 1)
    assert len(index.spans()) == 3
    small = index.compact(str(tmp_path / "small"))
    known = items.filter("item_id IS NOT NULL"), files.filter("item_id IS NOT NULL")
    for own, text in ((index, "(ring OR gear) NOT (blue OR house)"), (small, "ring")):
        assert rows(own.search(text)) == rows(catalog.search(*known, text))
        assert rows(own.search_files(text)) == rows(catalog.search_files(known[1], text))
    assert index.items.all().filter("item_id IS NULL").count() == 1 and small.items.all().count() == 300


def test_compaction_may_give_up_the_old_index(spark, tmp_path):
    """what is merged is not stored twice while the trigrams are cut."""
    items, files = tables(spark, 100)
    index = SearchIndex.create(spark, str(tmp_path / "i"), items, files)
    index.add(items, files, 0)
    small = index.compact(str(tmp_path / "small"), keep=False)
    assert not (tmp_path / "i").exists()
    assert rows(small.search("ring gear")) == rows(catalog.search(items, files, "ring gear"))
