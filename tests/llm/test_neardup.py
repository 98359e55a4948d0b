import random
import re

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import neardup


def brute(rows, k=3, num=7, den=10):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        s = frozenset(zip(*[w[j:] for j in range(k)]))
        if s and i is not None:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randrange(0, 60))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            if t:
                p = rng.randrange(len(t))
                t[p : p + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, seed, small):
    if small:  # every block cut into tiles and over tasks
        monkeypatch.setattr(neardup, "TILE", 3)
        monkeypatch.setattr(neardup, "HOT_BLOCK", 4)
        monkeypatch.setattr(neardup, "CLASS_BLOCK", 3)
    rows = corpus(seed)
    got = neardup.found_pairs(spark.createDataFrame(rows, "note_id long, content string"), "note_id", "content")
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_copies_nulls_long_texts_and_extra_columns(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [(i, "the very same little text here") for i in range(12)] + [(20, None), (21, ""), (22, "one two"), (23, "one two three"), (24, "One, two: THREE!"), (None, "one two three"), (30, long), (31, long + " tail"), (30, long), (40, "漢字 の 文 です"), (41, "漢字 の 文 です")]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "note_id long, content string, runs string, id string, rep int")
    got = [tuple(r) for r in neardup.found_pairs(df, "note_id", "content").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert neardup.found_pairs(df.limit(0), "note_id", "content").count() == 0


def test_groups(spark):
    rows = corpus(5)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, t in rows:
        if len(t.split()) >= 3:
            root(i)
    for a, b in brute(rows):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["id"]: r["group_id"] for r in neardup.near_groups(spark.createDataFrame(rows, "note_id long, content string"), "note_id", "content").collect()}
    assert got == {x: root(x) for x in parent}


def test_a_later_tile_of_larger_sets_is_reached(monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 1)
    n, pop = [100, 50, 130], [20, 48, 50]  # the second is too far from the first, the third is larger and near enough
    bits = [np.packbits(np.arange(neardup.BITS) < p).tobytes() for p in pop]
    batch = pa.RecordBatch.from_pydict({"run": [1] * 3, "bi": [0] * 3, "bj": [0] * 3, "cid": [1, 2, 3], "n": n, "pop": pop, "blk": [0] * 3, "bits": bits})
    got = [p for b in neardup._compare(7, 10)([batch]) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert got == [(1, 3)]


def test_a_large_class_of_copies(spark):
    copies = spark.range(20_000).selectExpr("id note_id", "'one and the same text' content")
    other = spark.createDataFrame([(30_000, "one and the same text here")], "note_id long, content string")
    df = copies.unionByName(other)
    got = neardup.near_groups(df, "note_id", "content", num=1, den=2)
    assert [tuple(r) for r in got.groupBy("group_id", "links").count().collect()] == [(0, 1, 20_001)]
    pairs = neardup.found_pairs(df.where("note_id % 20 = 0"), "note_id", "content")
    assert pairs.count() == pairs.distinct().count() == 1001 * 1000 // 2  # the longer text is similar enough


def test_components_of_a_long_shuffled_path(spark):
    ids = list(range(10_000))
    random.Random(3).shuffle(ids)
    path = spark.createDataFrame(list(zip(ids, ids[1:])) + [(20_001, 20_000), (20_000, 20_002), (20_001, 20_001)], "a long, b long")
    got = {r["id"]: r["root"] for r in neardup.components(path).collect()}
    assert got == {x: 0 for x in ids} | {x: 20_000 for x in (20_000, 20_001, 20_002)}
    assert neardup.components(path.limit(0)).count() == 0


def test_no_broadcast_of_sets(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    df = spark.createDataFrame(corpus(4), "note_id long, content string")
    plan = neardup.found_pairs(df, "note_id", "content")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
