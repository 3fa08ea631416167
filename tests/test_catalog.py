"""Match expressions, pages, nested files and the JSON answer."""

import json

import pytest
from pyspark.sql import functions as F

from contentlake.functions.stems import stem
from contentlake.operators import catalog as c
from test_plans import plan


@pytest.fixture(scope="module")
def items(spark):
    names = ["Running Rings", "the ring", "Éclair ring-gear", "gear box set", "Boxes of gears", "season 2 complete", "complete season 2", "Rhythm"]
    rows = [(i, f"{i:040x}", n, 100 * i, [5, 50, 50, 101, 11, 10, 0, 50][i], f"2024-01-0{i + 1} 00:00:00") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "item_id bigint, info_hash string, name string, size_bytes bigint, total_peers int, added string")
    return df.withColumn("added_ts", F.to_timestamp("added")).drop("added")


@pytest.fixture(scope="module")
def files(spark):
    rows = [(0, i, f"d/Track {i:02d}.mp3", 10) for i in range(12)] + [(1, 0, "x/Ring.MP4", 60), (1, 1, "x.mp4/readme", 40), (7, 0, "ring.mkv", 5), (7, 1, "big.txt", 5)]
    return spark.createDataFrame(rows, "item_id bigint, file_index int, path string, size_bytes bigint")



def ids(df):
    return sorted(r["item_id"] for r in df.select("item_id").collect())


@pytest.mark.parametrize(
    "query, wanted",
    [
        ("ring", [0, 1, 2]),
        ("RINGS", [0, 1, 2]),
        ("run", [0]),
        ("gears box", [3, 4]),
        ("gear AND ring", [2]),
        ("gear NOT ring", [3, 4]),
        ("ring OR box", [0, 1, 2, 3, 4]),
        ("ring OR gear NOT box", [0, 1, 2]),
        ('"season 2"', [5, 6]),
        ('"complete season"', [6]),
        ("ring-gear", [2]),
        ("gear-ring", []),
        ("eclair", [2]),
        ("r*", [0, 1, 2, 7]),
        ('"season 2 co"*', [5]),
        ("-- ring", [0, 1, 2]),
        ("--", []),
        ("nothing", []),
    ],
)
def test_name_search(items, query, wanted):
    assert ids(c.search_names(items, query)) == wanted


def test_unstemmed(items):
    assert ids(c.search_names(items, "ring", stemming=False)) == [1, 2]


@pytest.mark.parametrize(
    "query, wanted",
    [("ring", [1, 7]), ("RING.mp", [1]), ("ack 0", [0]), ("ri", []), ("ring ri", [1, 7]), ("ring AND ri", []), ("readme", [1]), ("x.mp4", []), ("mp4", [1])],
)
def test_file_search(files, query, wanted):
    assert sorted(set(ids(c.search_files(files, query)))) == wanted


def test_combined_search_and_postings(items, files):
    assert ids(c.search(items, files, "ring")) == [0, 1, 2, 7]
    assert ids(c.search(items, files, "ring", stemming=False)) == [1, 2, 7]
    assert c.search_count(items, files, "ring").first()[0] == 4
    postings = c.name_postings(items)
    assert ids(c.search_postings(postings, "gears box")) == [3, 4]
    assert ids(c.search_postings(postings, "!")) == []


def test_pages(items):
    assert [r["item_id"] for r in c.page_of(items, 1, 3).collect()] == [3, 7, 2]
    assert [r["item_id"] for r in c.page_of(items, 0, 3).collect()] == [3, 7, 2]
    assert [r["item_id"] for r in c.page_of(items, 3, 3).collect()] == [0, 6]
    assert tuple(c.page_info(items, 3, 3).first()) == (8, 3, 2, False, 3, True, False)
    assert tuple(c.page_info(items, 9, 3).first()) == (8, 9, 0, False, 3, True, False)
    assert tuple(c.page_info(items.limit(0), 1, 3).first()) == (0, 1, 0, False, 0, False, False)
    page, total = c.fetch_page(items, 2, 3)
    assert total == 8 and [r["item_id"] for r in page.collect()] == [1, 4, 5]


def test_nested_files(items, files):
    rows = {r["item_id"]: r for r in c.result_page(items, files, 1, 8).collect()}
    assert [f["file_index"] for f in rows[0]["files"]] == list(range(10)) and rows[0]["num_files"] == 12
    assert rows[3]["num_files"] == 0 and rows[3]["files"] is None


def test_video(items, files):
    rows = {r["item_id"]: tuple(r)[1:] for r in c.video_items(files).collect()}
    assert rows == {0: (0, 120, False), 1: (60, 100, True), 7: (5, 10, False)}
    assert ids(c.sample_pool(items, files)) == [1]
    assert ids(c.sample_videos(items, files, 5, seed=1)) == [1]


def test_lookup(items):
    assert tuple(c.lookup(items, f"{3:040X}").first())[1:4] == (True, True, "gear box set")
    assert tuple(c.lookup(items, "zz").first())[1:3] == (False, False)
    assert tuple(c.lookup(items, "f" * 40).first())[1:3] == (True, False)


def test_json_answer(items, files):
    found = c.search(items, files, "ring")
    answer = json.loads(c.search_report(found, files, 1, 3, 7).first()["json"])
    assert {k: answer[k] for k in ("count", "total_count", "page", "limit", "has_more", "timestamp")} == {
        "count": 3, "total_count": 4, "page": 1, "limit": 3, "has_more": True, "timestamp": 7,
    }
    assert [r["name"] for r in answer["results"]] == ["Rhythm", "Éclair ring-gear", "the ring"]
    assert answer["results"][2]["files"][0] == {"path": "x/Ring.MP4", "size": "60.00 B", "size_bytes": 60}
    empty = json.loads(c.search_report(found.limit(0), files, 1, 3, 7).first()["json"])
    assert empty["count"] == 0 and empty["results"] == [] and not empty["has_more"]


# Words and stems of the published description of the stemming rules.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "sized": "size", "hopping": "hop", "falling": "fall",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "digitizer": "digit", "operator": "oper", "sensibility": "sensibl", "hopefulness": "hope", "triplicate": "triplic",
    "electrical": "electr", "allowance": "allow", "adjustment": "adjust", "adoption": "adopt", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_stem_prefix_rule():
    """The native pre-test of a search relies on it."""
    from itertools import product

    for letters in product("aeysing", repeat=6):
        for size in (3, 4, 5, 6):
            word = "".join(letters[:size])
            kept = stem(word)
            assert word[:2] == kept[:2] if len(kept) > 2 else word[:1] == kept[:1]



FORMS = {
    "ring OR gear": {1, 2, 3, 5, 6}, '"season 2"': {2}, "rin*": {1, 2, 5, 6}, "ring NOT blu": {1, 2, 5}, "(ring OR gear) NOT blu": {1, 2, 3, 5},
    "ring (season OR blue) ": {2, 6}, "ring AND (NOTHING OR (gear OR season))": {2, 5}, "ring ! gear": {5}, "!": set(), "": set(),
    '"season 2" OR "gear box"': {2, 3}, '"ring sea"*': {2}, "ring NOT season 2": {1, 5, 6}, "ring AND !": set(), "ring NOT (season OR gear) NOT blu": {1},
}


@pytest.mark.parametrize("stemming", [False, True])
@pytest.mark.parametrize("query", FORMS)
def test_scan_and_postings_agree(spark, query, stemming):
    names = ["a ring", "ring season 2", "gear box", "season x 2", "ring gear", "ring blu blue"]
    rows = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "item_id int, name string")
    scan = c.search_names(rows, query, stemming)
    postings = c.search_postings(c.name_postings(rows, stemming), query, stemming)
    assert {r["item_id"] for r in scan.collect()} == {r["item_id"] for r in postings.collect()} == FORMS[query]


@pytest.mark.parametrize("query", ["(ring", "ring)", "ring OR", "NOT ring", "AND", "()", 'ring "open', "ring NOT OR gear"])
def test_what_cannot_be_read_is_an_error(query):
    with pytest.raises(ValueError):
        c.parse(query)


def test_pages_read_on_after_a_row(spark, tmp_path):
    items = spark.range(500).select(
        F.col("id").alias("item_id"), (F.col("id") % 7).cast("int").alias("total_peers"), F.timestamp_seconds(F.col("id") % 11).alias("added_ts")
    )
    c.ranked_layout(items, str(tmp_path / "ranked"), 12)
    stored = spark.read.parquet(str(tmp_path / "ranked"))
    last, seen = None, []
    while True:
        page = c.page_after(stored, last, 40).collect()
        if not page:
            break
        seen += [r["item_id"] for r in page]
        last = max(page, key=lambda r: (-r["total_peers"], -r["added_ts"].timestamp(), r["item_id"]))
    want = [r["item_id"] for r in items.orderBy(*c.ranked(items)).collect()]
    assert sorted(seen) == sorted(want) and [set(seen[k : k + 40]) for k in range(0, 500, 40)] == [set(want[k : k + 40]) for k in range(0, 500, 40)]
    text = plan(c.page_after(stored, last, 40))
    assert "TakeOrderedAndProject" in text and "LessThanOrEqual(total_peers" in text


def test_stored_catalogue_cuts_its_batches_from_rows_written_once(spark, folder, monkeypatch):
    """The views' joins, with what they send through the driver, are not run again for every batch."""
    from contentlake import plans
    from contentlake.sources.catalogstore import CatalogStore

    read, write = [], CatalogStore.write

    def watched(store, items, files, epoch):
        read.extend(items.inputFiles() + files.inputFiles())
        return write(store, items, files, epoch)

    monkeypatch.setattr(CatalogStore, "write", watched)
    plans.QUERIES["d9_catalog_store"](spark, folder)
    assert read and not any(f"/{name}.parquet" in f for f in read for name in ("part", "orders", "lineitem"))
