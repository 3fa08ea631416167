"""K-closest against brute force, on uniform and on crowded key spaces."""

import hashlib
import inspect
import random

import pytest

from contentlake.operators import closest as c
from contentlake.operators.closest import closest
from test_plans import plan


def uniform(n, seed):
    return [hashlib.sha1(b"%d-%d" % (seed, i)).hexdigest() for i in range(n)]


def crowded(n, seed):
    """Half of the ids share their first 100 bits, a quarter differ in the last byte only."""
    rng = random.Random(seed)
    prefix, deep = "ab" * 12 + "c", "cd" * 19
    ids = [prefix + f"{rng.getrandbits(60):015x}" for _ in range(n // 2)]
    ids += [deep + f"{i % 256:02x}" for i in range(n // 4)]
    return ids + uniform(n // 4, seed)


@pytest.mark.parametrize("k", [1, 8])
@pytest.mark.parametrize("make", [uniform, crowded])
@pytest.mark.parametrize("leaf", [3, 64])
def test_brute_force(spark, make, k, leaf):
    ids = make(1200, 1)
    targets = uniform(60, 2) + ids[::60] + ["ab" * 20, "cd" * 20, "0" * 40, "f" * 40]
    nodes = spark.createDataFrame([(h,) for h in ids], "node_id string")
    wanted = spark.createDataFrame([(t,) for t in targets], "target string")
    rows = closest(nodes, wanted, k, leaf=leaf).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["target"], []).append(r["node_id"])
        assert int(r["distance"], 16) == int(r["target"], 16) ^ int(r["node_id"], 16)
    for t in set(targets):
        assert got[t] == sorted(set(ids), key=lambda h: int(h, 16) ^ int(t, 16))[:k]


def test_leaves_cover_all_ids(spark):
    ids = sorted(set(crowded(4000, 3)))
    nodes = spark.createDataFrame([(h,) for h in ids], "id string")
    placed, tree, total = c.split_ids(nodes, 50)
    leaves = {r["prefix"]: r["n"] for r in tree.filter("is_leaf").collect()}
    assert total == len(ids) == sum(leaves.values()) and max(leaves.values()) <= 50
    assert all(sum(h.startswith(p) for p in leaves) == 1 for h in ids)
    assert {r["id"]: r["prefix"] for r in placed.collect()} == {h: next(p for p in leaves if h.startswith(p)) for h in ids}


def test_more_neighbours_than_a_leaf_holds(spark):
    ids = crowded(200, 7)
    nodes, wanted = spark.createDataFrame([(h,) for h in ids], "node_id string"), spark.createDataFrame([(t,) for t in ids[:3]], "target string")
    rows = closest(nodes, wanted, 40, leaf=4).orderBy("rank").collect()
    for t in ids[:3]:
        assert [r["node_id"] for r in rows if r["target"] == t] == sorted(set(ids), key=lambda h: int(h, 16) ^ int(t, 16))[:40]


def test_nothing_is_collected():
    source = inspect.getsource(c)
    assert ".collect(" not in source and "toPandas" not in source and "InPandas" not in source


def test_empty(spark):
    nodes = spark.createDataFrame([], "node_id string")
    targets = spark.createDataFrame([("0" * 40,)], "target string")
    assert closest(nodes, targets).count() == 0


def test_candidates_of_a_target_do_not_meet_again(spark):
    """Searches are ranked where their leaves are: no window, and no shuffle of candidates by target."""
    nodes, wanted = (spark.createDataFrame([(t,) for t in uniform(n, n)], f"{name} string") for n, name in ((900, "node_id"), (300, "target")))
    text = plan(closest(nodes, wanted, 8, leaf=3))
    assert "Window" not in text and "hashpartitioning(target" not in text
