import datetime as dt
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from marginalia.operators import guards, history, toolbox
from marginalia.sources import commits, files, sinks


@pytest.fixture
def root(tmp_path):
    for name, data in {"notes/a.md": b"# A", "notes/_draft.md": b"d", "notes/empty.md": b"", "notes/.hid/s.md": b"s", "notes/.x.md": b"", "notes/sub/UP.MD": b"\xff\xfe", "notes/sub/p.png": b"p", "references/r.pdf": b"r"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return tmp_path


def test_vault_source(spark, root):
    paths = lambda df: sorted(r["path"] for r in df.select("path").collect())
    every = files.vault_files(spark, str(root), "notes")
    assert paths(every) == ["notes/_draft.md", "notes/a.md", "notes/empty.md", "notes/sub/UP.MD", "notes/sub/p.png"]
    assert paths(every.where(F.col("ext") == "png")) == ["notes/sub/p.png"] and paths(every.where(F.col("path").startswith("notes/sub/"))) == ["notes/sub/UP.MD", "notes/sub/p.png"]
    assert paths(files.vault_files(spark, str(root), "notes", recursive=False)) == ["notes/_draft.md", "notes/a.md", "notes/empty.md"]
    assert len(paths(files.vault_files(spark, str(root), "notes", hidden=True))) == 7
    assert paths(files.vault_files(spark, str(root), "none")) == []
    assert len(paths(files.text_notes(every))) == 3 and len(paths(files.text_notes(every, "empty"))) == 4
    with pytest.raises(Exception, match="outside"):
        files.vault_files(spark, str(root), "../x").count()


def test_guards(spark, root):
    assert guards.check_relative("notes/a b.md", ("notes",), ("md",)) == "notes/a b.md"
    for bad in ("", "/etc/x", "notes/../x", "notes/%2e%2e/x", "other/a.md", "notes/a.txt"):
        with pytest.raises(guards.GuardError):
            guards.check_relative(bad, ("notes",), ("md",))
    (root / "notes/out").symlink_to("/etc")
    with pytest.raises(guards.GuardError):
        guards.resolve(str(root), "notes/out/hosts")
    df = spark.createDataFrame([(x,) for x in ("notes/a.md", "", None, "/a", "notes/%2e%2e/a.md", "x/a.md", "notes/a.txt")], "p string")
    assert [r["v"] for r in df.select(guards.path_problem(F.col("p"), ["notes"], ["md"]).alias("v")).collect()] == [None, "empty", "empty", "absolute", "traversal", "outside", "extension"]


def test_sinks(spark, root, tmp_path_factory):
    sinks.atomic_write(str(root), "notes/new.md", b"1")
    with pytest.raises(guards.GuardError):
        sinks.atomic_write(str(root), "notes/new.md", b"2", overwrite=False)
    sinks.write_json(str(root), "notes/j.json", {"b": 1, "a": "é"})
    assert (root / "notes/j.json").read_text().startswith('{\n  "a": "é"') and not list((root / "notes").glob(".*.part"))
    png = tmp_path_factory.mktemp("out") / "i.png"
    png.write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (2).to_bytes(4, "big") + (3).to_bytes(4, "big"))
    assert sinks.import_image(str(root), str(png), "notes/i.jpg") == ("notes/i.png", 2, 3)
    for source, to in ((str(png), "notes/i.png"), (str(root / "notes/i.png"), "notes/k.png"), (str(png.parent), "notes/k.png"), (str(png), "x/k.png")):
        with pytest.raises((guards.GuardError, FileExistsError)):
            sinks.import_image(str(root), source, to)
    assert sinks.read_instructions(None) is None and sinks.read_instructions(str(root / "notes/a.md")) == "# A"


def test_commits(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(3):
        (tmp_path / f"f{i % 2}.md").write_text(str(i))
        git("add", "-A")
        git("commit", "-qm", f"Step {i}")
    assert [r["subject"] for r in commits.commits(spark, str(tmp_path), limit=2).collect()] == ["Step 2", "Step 1"]
    assert [r["subject"] for r in commits.commits(spark, str(tmp_path), path="f1.md").collect()] == ["Step 1"]
    (tmp_path / "new").mkdir()
    subprocess.run(["git", "-C", str(tmp_path / "new"), "init", "-q"], check=True)
    assert commits.commits(spark, str(tmp_path / "new")).count() == 0
    with pytest.raises(Exception, match="git log failed"):
        commits.commits(spark, str(tmp_path / "none")).count()
    assert commits.parse_log("h\nd\ns\n\nx\ny\n") == [("h", "d", "s")]


def test_toolbox(spark):
    now = dt.datetime(2025, 3, 1)
    v = toolbox.Vault(spark, spark.createDataFrame([], history.VERSION), clock=lambda: now)
    call = lambda name, **a: toolbox.call(v, name, **a).collect()
    call("create_note", path="notes/a.md", content="# A\n[[b]] canal", tags=["X"])
    call("create_note", path="notes/b.md", content="---\ntags: y\n---\nriver")
    call("update_note", path="notes/b.md", mode="patch", patches=[{"old_text": "river", "new_text": "river canal"}])
    call("create_canvas", path="notes/c.canvas", content='{"nodes":[]}')
    assert [r["path"] for r in call("search_notes", query="canal")] == ["notes/a.md", "notes/b.md"]
    assert [r["match"] for r in call("resolve_link", link="[[B]]")] == ["notes/b.md"]
    assert [r["path"] for r in call("find_backlinks", path="notes/b.md")] == ["notes/a.md"]
    call("move_notes", moves=[{"source": "notes/a.md", "destination": "notes/d.md"}])
    assert {r["tag"]: r["n"] for r in call("resource_tags")} == {"x": 1, "y": 1}
    assert [r["path"] for r in call("list_canvas")] == ["notes/c.canvas"]
    assert [r["op"] for r in call("note_history", path="notes/b.md")] == ["update", "create"]
    for name, args in (("nope", {}), ("read_note", {}), ("read_note", {"path": "../x.md"}), ("create_note", {"path": "notes/b.md", "content": ""}), ("create_canvas", {"path": "notes/x.canvas", "content": "{"}), ("update_note", {"path": "notes/b.md", "mode": "patch", "patches": []})):
        assert call(name, **args)[0]["error"]
    v.read_only = True
    assert "read-only" in call("delete_note", path="notes/b.md")[0]["error"] and call("read_note", path="notes/b.md")
    assert toolbox.audit_table(v).where("operation = 'DELETE'").count() == 1


def test_refresh_rebuilds_what_was_touched(spark, tmp_path):
    from marginalia.streaming import refresh

    src, out = str(tmp_path / "pages"), str(tmp_path / "cache")

    def arrive(*rows):
        spark.createDataFrame(list(rows), refresh.PAGES).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # file times are told apart by seconds
        refresh.refresh_cache(spark, src, out, str(tmp_path / "state"), buckets=2).awaitTermination()
        got = spark.read.parquet(out).collect()
        assert len(got) == len({r["path"] for r in got})
        return {r["path"]: r["content"] for r in got}

    page = lambda n, t: f"--- Page {n} ---\n{t}"
    assert arrive(("a", 1, None, "one"), ("b", 1, None, "x")) == {"a": page(1, "one"), "b": page(1, "x")}
    assert arrive(("a", 2, None, "two"), ("c", 1, None, "y")) == {"a": page(1, "one") + "\n\n" + page(2, "two"), "b": page(1, "x"), "c": page(1, "y")}
    assert arrive(("a", 1, None, "new"), (None, 1, None, "z"))["a"] == page(1, "new") + "\n\n" + page(2, "two")
