import random
import time
from pathlib import Path

import pytest

from marginalia.llm import mixing as M
from marginalia.llm.tokens import VOCABULARIES

if not Path(VOCABULARIES).exists():
    pytest.skip("no vocabularies", allow_module_level=True)
TARGETS = "source string, target_share double, max_repeats int, tokens string"


def test_flow_prefers_first_uses_and_shares_overlaps():
    targets = [M.Target("a", 0.5, 1), M.Target("b", 0.5, 3)]
    capacity = {("a",): 100, ("a", "b"): 60, ("b",): 20}
    best = M.largest_total(capacity, targets)
    flows, met = M.route(capacity, targets, best)
    assert met and not M.route(capacity, targets, best + 2)[1]
    assert sum(f for (_, s), f in flows.items() if s == "a") == sum(f for (_, s), f in flows.items() if s == "b")
    # A total that needs no repeats gets none.
    flows, met = M.route(capacity, targets, 160)
    assert met and all(sum(f for (p, _), f in flows.items() if p == q) <= n for q, n in capacity.items())


def cost(flows, capacity):
    total = 0
    for p, n in capacity.items():
        used = sum(f for (q, _), f in flows.items() if q == p)
        total += sum(min(n, max(0, used - k * n)) * (k + 1) ** 2 for k in range(9))
    return total


def test_flow_against_all_splits():
    rng = random.Random(2)
    for _ in range(60):
        targets = [M.Target("a", 0.5, rng.randrange(1, 4)), M.Target("b", 0.5, rng.randrange(1, 4))]
        capacity = {("a",): rng.randrange(1, 6), ("b",): rng.randrange(1, 6), ("a", "b"): rng.randrange(1, 6)}
        (ra, rb), (na, nb, nx) = [t.repeats for t in targets], capacity.values()
        can = lambda q: [(x, y) for x in range(nx * ra + 1) for y in range(nx * rb + 1) if x + y <= nx * max(ra, rb) and 0 <= q - x <= na * ra and 0 <= q - y <= nb * rb]  # noqa: B023, E731
        best = M.largest_total(capacity, targets)
        assert can(best // 2) and not can(best // 2 + 1)
        for total in range(2, best + 1, 2):
            flows, met = M.route(capacity, targets, total)
            least = min(cost({(("a",), "a"): total // 2 - x, (("b",), "b"): total // 2 - y, (("a", "b"), "a"): x, (("a", "b"), "b"): y}, capacity) for x, y in can(total // 2))
            assert met and cost(flows, capacity) == least


def test_many_patterns_are_solved_quickly():
    rng, names = random.Random(5), [f"s{i:02}" for i in range(16)]
    targets = [M.Target(x, w / sum(range(1, 17)), rng.randrange(1, 6)) for x, w in zip(names, range(1, 17))]
    capacity = {tuple(sorted(rng.sample(names, rng.randrange(1, 6)))): rng.randrange(1, 10**9) for _ in range(3000)}
    began = time.perf_counter()
    best = M.largest_total(capacity, targets)
    flows, met = M.route(capacity, targets, best)
    assert met and not M.route(capacity, targets, best + 64)[1] and time.perf_counter() - began < 60
    for t in targets:
        assert sum(f for (_, x), f in flows.items() if x == t.source) == int(t.share * best)
        assert all(f <= capacity[p] * t.repeats for (p, x), f in flows.items() if x == t.source)


def mix(spark, n=400, **kw):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["river", "lamp", "canal", "heron"]) for _ in range(rng.randrange(1, 40))) + f" {i}", rng.choice(["a", "a", "a", "b", "c", "zz", None])) for i in range(n)]
    rows += [(n + i, rows[i][1], "b") for i in range(0, min(60, n), 2)] + [(9000, None, "a"), (9001, "", "b"), (9002, "x", None)]
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, source string, n int, pattern string")
    targets = spark.createDataFrame([("a", 0.6, 1, "t"), ("b", 0.3, 4, "t"), ("c", 0.1, 2, "t"), ("gone", 0.0, 1, "t"), (None, 0.5, 1, "t")], TARGETS)
    return docs, targets, M.select_mix(docs, "doc_id", "text", "source", targets, **kw)


def test_shares_and_caps(spark):
    docs, targets, chosen = mix(spark)
    report = {r["source"]: r for r in M.mix_report(chosen, targets).collect()}
    assert set(report) == {"a", "b", "c", "gone"} and report["gone"]["tokens"] == 0
    for s, share, most in (("a", 0.6, 1), ("b", 0.3, 4), ("c", 0.1, 2)):
        assert abs(report[s]["actual_share"] - share) < 0.03 and report[s]["repeats"] <= most
    assert chosen.groupBy("doc_id", "source").count().where("count > 1").count() == 0
    again = mix(spark)[2]
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))


def test_a_larger_total_fills_as_far_as_it_can(spark):
    _, targets, chosen = mix(spark, total=10_000_000)
    assert {r["source"]: r["repeats"] for r in M.mix_report(chosen, targets).collect()} == {"a": 1, "b": 4, "c": 2, "gone": 0}


def test_nothing_to_mix(spark):
    docs, targets, _ = mix(spark, 5)
    assert M.select_mix(docs.limit(0), "doc_id", "text", "source", targets).count() == 0
    assert M.select_mix(docs, "doc_id", "text", "source", targets.limit(0)).count() == 0
    assert [r["actual_share"] for r in M.mix_report(M.select_mix(docs.limit(0), "doc_id", "text", "source", targets), targets).collect()] == [None] * 4
