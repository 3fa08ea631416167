"""Shapes of physical plans that have to hold at scale, and layout rules of the repository."""

import io
import re
from contextlib import redirect_stdout
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from contentlake import plans
from contentlake.operators import catalog, contentfilter, dedup, keyspace, monitor
from contentlake.sources.tables import Lake

ROOT = Path(__file__).resolve().parents[1]


def plan(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def lake(spark, folder):
    return Lake(spark, folder)


STREAMS = [n for n in plans.QUERIES if n.startswith("z") or n == "s_ingest"]
STORED = [n for n in plans.QUERIES if "_indexed_" in n or n == "d9_catalog_store"]  # they write what they then read


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - {*STREAMS, *STORED}))
def test_no_pairing_of_all_rows(name, spark, folder):
    text = plan(plans.QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_files_are_cut_before_the_shuffle(lake):
    stored = lake.lineitem.selectExpr("l_orderkey AS item_id", "l_linenumber AS file_index", "l_returnflag AS path", "l_suppkey AS size_bytes")
    text = plan(catalog.first_files(stored))
    assert re.search(r"WindowGroupLimit.*Partial|Partial.*WindowGroupLimit", text, re.S)


def test_strikes_are_cut_before_the_shuffle(lake):
    assert "WindowGroupLimit" in plan(dedup.two_strike(lake.attempts))


def test_buckets_are_cut_before_the_shuffle(lake):
    nodes = lake.nodes.withColumn("last_responded_at", F.unix_timestamp("last_responded_at"))
    assert "WindowGroupLimit" in plan(keyspace.bounded_buckets(nodes, "5" * 40))


def test_pages_and_samples_are_top_k(lake):
    for df in (catalog.page_of(lake.items, 2), keyspace.sample_k(lake.nodes, "node_id", 9), catalog.latest(lake.items, 5)):
        assert "TakeOrderedAndProject" in plan(df)


def test_search_reads_each_table_once(lake):
    text = plan(catalog.search(lake.items, lake.item_files, "ring", stemming=False))
    assert len(re.findall(r"Location:.*orders\.parquet", text)) == 1
    assert len(re.findall(r"Location:.*lineitem\.parquet", text)) == 1


def test_page_ids_reach_the_file_scan(lake):
    page, _ = catalog.fetch_page(lake.items)
    own = plan(lake.item_files.filter(F.col("item_id").isin([r["item_id"] for r in page.collect()])))
    assert re.search(r"PushedFilters: .*In\(l_orderkey", own)


def test_columns_and_filters_reach_the_scan(lake):
    text = plan(lake.items.filter("total_peers = 50").select("item_id", "total_peers"))
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint>", text)
    assert "PushedFilters: [IsNotNull(s)" not in text
    assert re.search(r"PushedFilters: .*GreaterThan", plan(lake.orders.filter("o_totalprice > 10").select("o_orderkey")))


def test_filter_needs_no_python(lake):
    decided = contentfilter.filter_content(lake.items, lake.item_files, [("ring", 9)], [("x+y", 5)])
    text = plan(decided)
    assert "Python" not in text and "ArrowEval" not in text
    assert text.count("Exchange hashpartitioning") <= 2 or "BroadcastExchange" in text


def test_rolling_hour_has_no_global_window(lake):
    text = plan(monitor.rolling_hour(monitor.minute_counts(lake.events)))
    assert "Window" not in text and "SinglePartition" not in text


def test_tables_are_not_dealt_out(lake):
    assert "RoundRobin" not in plan(lake.orders)


def test_repository_layout():
    code = "\n".join(p.read_text() for p in (ROOT / "contentlake").rglob("*.py"))
    assert "localCheckpoint" not in code and "crossJoin" not in code
    assert ".rdd" not in code and ".toPandas(" not in code
    for name in ("functions", "operators", "plans", "sources", "streaming"):
        assert (ROOT / "contentlake" / name / "__init__.py").exists()
