import datetime as dt
import random

import pytest

from marginalia.operators import orphans
from marginalia.operators.orphans import found_orphans

T = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
LINKS = "link_id long, vault_key string, target string, seen_at timestamp_ntz, key string, live string"
RES = "resolution_id long, vault_key string, matches array<string>, resolved_at timestamp_ntz"
NODES = "node_row_id long, vault_key string, node_type string, label string, warning string, seen_at timestamp_ntz"
FILES = "vault_key string, file_path string, added_at timestamp_ntz, deleted_at timestamp_ntz, state string"
HUB = "hub_id long, file_path string, added_at timestamp_ntz, deleted_at timestamp_ntz"


def run(spark, links=(), res=(), nodes=(), files=(), hub=()):
    mk = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    got = found_orphans(mk(links, LINKS), mk(res, RES), mk(nodes, NODES), mk(files, FILES), mk(hub, HUB)).collect()
    return {(r["tbl"], r["ref_id"], r["pos"]): (r["state"], r["ref_month"]) for r in got}


def link(i, target, day, vault="v"):
    return (i, vault, target, T(day) if day is not None else None, "k", "l")


def test_states_and_names(spark):
    files = [("v", "notes/A b.md", T(10), T(20), "x"), ("v", "notes/p/Pic.PNG", T(0), None, "x"), ("w", "notes/other.md", T(0), None, "x"), ("v", "notes/café.md", T(0), None, None), (None, "notes/n.md", T(0), None, None)]
    hub = [(1, "notes/Home.md", T(0), T(50))]
    links = [
        link(1, "a B", 5), link(2, " x/A B ", 10), link(3, "a b", 20), link(4, "a b.md", 15), link(5, "pic.png", 5), link(6, "zzz/pic.png", 5), link(7, "other", 5), link(8, "HOME", 5), link(9, "home", 60), link(10, "café", 5),
        link(11, None, 5), link(12, " ", 5), link(13, "HTTPS://x.y", 5), link(14, "mailto:a@b", 5), link(15, "gone", None), link(16, "pic", 5), link(1, "a B", 5), link(17, "Home", 5, None), link(18, "n", 5, None), link(19, "home", 5, "nowhere"),
    ]
    got = run(spark, links, [(1, "v", ["notes/a b.md", None, "", "notes/x.md"], T(30)), (2, "v", None, T(1)), (3, "v", [], T(1))], [(1, "v", "file", "notes/p/pic.png", "file not found", T(1)), (2, "v", "file", "p/pic.png", None, T(1)), (3, "v", "text", "nope", None, T(1)), (4, "v", None, "nope", None, T(1)), (5, "v", "file", None, None, T(1))], files, hub)
    assert got == {
        ("parsed_links", 1, 0): ("late", "2024-01"), ("parsed_links", 3, 0): ("deleted", "2024-01"), ("parsed_links", 7, 0): ("missing", "2024-01"), ("parsed_links", 9, 0): ("deleted", "2024-03"),
        ("parsed_links", 16, 0): ("missing", "2024-01"), ("parsed_links", 18, 0): ("missing", "2024-01"), ("resolutions", 1, 1): ("deleted", "2024-01"), ("resolutions", 1, 4): ("missing", "2024-01"), ("canvas_nodes", 2, 0): ("missing", "2024-01"),
    }
    assert run(spark) == {}


@pytest.mark.parametrize("span", [20_000, 5])
def test_against_brute_force_with_a_hot_key(spark, monkeypatch, span):
    monkeypatch.setattr(orphans, "HOT_SPAN", span)
    rng = random.Random(3)
    files = []
    for _ in range(60):
        a = rng.randrange(400)
        d = a + rng.randrange(-3, 80)
        files.append(("v", f"notes/{rng.choice('abc')}/{rng.choice(['hot', 'x', 'y'])}.md", T(a), T(d) if rng.random() < 0.6 else None, "s"))
    links = [link(i, rng.choice(["hot", "hot", "hot", "x", "y", "z"]), rng.randrange(-5, 500)) for i in range(400)]
    want = {}
    for i, _, target, at, *_ in links:
        named = [f for f in files if f[1].rsplit("/", 1)[1] == f"{target}.md"]
        if any(f[2] <= at and (f[3] is None or f[3] > at) for f in named):
            continue
        state = "deleted" if any(f[3] is not None and f[3] <= at for f in named) else "late" if any(f[2] > at for f in named) else "missing"
        want["parsed_links", i, 0] = (state, f"{at:%Y-%m}")
    assert run(spark, links, files=files) == want
