"""Ordered scans over many small pieces, with one key holding most rows and equal times."""

import random
import re

import pytest
from pyspark.sql import functions as F

from contentlake.operators import monitor as m
from contentlake.operators.normalise import prefix_dictionary
from test_plans import plan
from contentlake.operators.ordering import cut_by_range, last_known, number_rows, run_length


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}"
        out.append((key, rng.randrange(200), i, rng.uniform(0, 100)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, ts bigint, id bigint, v double").repartition(7)


def series(rows):
    keys = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        keys.setdefault(row[0], []).append(row)
    return keys


def test_pieces_are_contiguous_and_bounded(frame):
    cut = cut_by_range(frame, ["key"], ["ts", "id"], 64)
    spans = cut.groupBy("_piece").agg(
        F.min(F.struct("key", "ts", "id")).alias("a"), F.max(F.struct("key", "ts", "id")).alias("b"), F.count("*").alias("n")
    )
    spans = spans.orderBy("_piece").collect()
    assert max(r["n"] for r in spans) <= 64 and len(spans) > 40
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))


def test_last_known(frame, rows):
    mark = F.when(F.col("v") > 97, F.col("id"))
    got = {r["id"]: r["last"] for r in last_known(frame, ["key"], ["ts", "id"], mark, "last", 64).collect()}
    for part in series(rows).values():
        last = None
        for _, _, i, v in part:
            last = i if v > 97 else last
            assert got[i] == last


@pytest.mark.parametrize("limit", [2.0, 50.0, 99.5, 101.0])
def test_run_length(frame, rows, limit):
    got = {r["id"]: r["n"] for r in run_length(frame, ["key"], ["ts", "id"], F.col("v") < limit, "n", 64).collect()}
    assert len(got) == len(rows)
    for part in series(rows).values():
        run = 0
        for _, _, i, v in part:
            run = run + 1 if v < limit else 0
            assert got[i] == run


def test_hysteresis(frame, rows):
    got = {r["id"]: r["on"] for r in m.hysteresis(frame, "key", ["ts", "id"], "v", 98, 2, 64).collect()}
    for part in series(rows).values():
        on = 0
        for _, _, i, v in part:
            on = 1 if v >= 98 else 0 if v < 2 else on
            assert got[i] == on


@pytest.mark.parametrize("alpha", [0.3, 0.01, 1.0])
def test_ema(frame, rows, alpha):
    got = {r["id"]: r["ema"] for r in m.ema(frame, "key", ["ts", "id"], "v", alpha, 64).collect()}
    assert len(got) == len(rows)
    for part in series(rows).values():
        ema = None
        for _, _, i, v in part:
            ema = v if ema is None else alpha * v + (1 - alpha) * ema
            assert got[i] == pytest.approx(ema, rel=1e-9)


def test_number_rows(frame, rows):
    got = number_rows(frame, ["v", "id"], "n", 64).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, len(rows) + 1))
    assert [r["id"] for r in got] == [r[2] for r in sorted(rows, key=lambda r: (r[3], r[2]))]


def test_prefix_dictionary(spark):
    paths = ["/a", "b/c", "b/d", "x//y", "x/", "", "/", "z"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [tuple(r) for r in prefix_dictionary(files).orderBy("prefix_id").collect()] == [(1, "b"), (2, "x"), (3, "x/")]


def test_a_million_rows_of_one_key(spark):
    """A hot key is cut by time: no pin, and no task sees more than a few pieces."""
    rows = spark.range(1_000_000).select(F.lit("hot").alias("key"), "id", (F.xxhash64("id") % 100).cast("double").alias("v"))
    alpha, width = 0.05, 1 << 14
    averaged = m.ema(rows, "key", ["id"], "v", alpha, width)
    switched = m.hysteresis(rows, "key", ["id"], "v", 95, -95, width)
    runs = m.low_streak(rows, "key", ["id"], F.col("v") < 99, width)
    for df in (averaged, switched, runs):
        text = plan(df)
        assert "ExistingRDD" not in text and "Python" not in text and "Pandas" not in text
        assert re.search(r"hashpartitioning\([^)]*_piece#\d+", text)
    got = averaged.join(switched.select("id", "on"), "id").join(runs.select("id", "streak"), "id").orderBy("id").select("v", "ema", "on", "streak").toPandas()
    ema, on, streak = None, 0, 0
    for v, e, o, s in got.itertuples(index=False):
        ema = v if ema is None else alpha * v + (1 - alpha) * ema
        on = 1 if v >= 95 else 0 if v < -95 else on
        streak = streak + 1 if v < 99 else 0
        assert abs(e - ema) < 1e-9 and (o, s) == (on, streak)


def test_pieces_by_time_and_missing_times(spark):
    rows = [("a", t, i, float(v)) for i, (t, v) in enumerate([(None, 99), (5, 1), (5, 2), (-3, 50), (4000, 3), (4001, 99), (90000, 1)])]
    df = spark.createDataFrame(rows, "key string, at long, id long, v double")
    timed = df.withColumn("at", F.timestamp_seconds("at"))
    for frame in (df, timed):
        got = [r["on"] for r in m.hysteresis(frame, "key", ["at", "id"], "v", 90, 2, 100).orderBy("at", "id").collect()]
        assert got == [1, 1, 0, 0, 0, 1, 0]
    with pytest.raises(TypeError):
        m.hysteresis(df, "key", ["key"], "v", 90, 2)
