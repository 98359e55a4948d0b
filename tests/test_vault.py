import datetime as dt

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import attachments, canvas, history, images, links, notes, references, search

NOTE = "path string, content string, modified timestamp"
T = lambda d: dt.datetime(2025, 1, d)


def frame(spark, texts):
    return spark.createDataFrame([(p, c, T(i % 27 + 1)) for i, (p, c) in enumerate(texts.items())], NOTE)


def test_front_matter(spark):
    texts = {
        "notes/a-b_c.md": None, "notes/full.md": "\n---\nTitle: A: b\ntags: [X, y ,, X]\ncreated: 2024-01-01\nTitle: Last\nMood: good\n---\n# Head\none two", "notes/open.md": "---\ntitle: x\n# Head one",
        "notes/h1.md": "text\n  # The Head  \n# Other", "notes/tags.md": "---\ntags: a, B\n---\nbody", "notes/late.md": "---foo\nlost\n---\ntitle: late\n---\nrest", "notes/crlf.md": "---\r\ntitle: x\r\n---\r\nbody", "notes/empty.md": "---\n---\n", "notes/et.md": "---\ntitle:\n---\n# H",
    }
    got = {r["path"][6:]: r for r in notes.parsed(frame(spark, texts)).collect()}
    assert {k: r["title"] for k, r in got.items()} == {"a-b_c.md": "a b c", "full.md": "Last", "open.md": "Head one", "h1.md": "The Head", "tags.md": "tags", "late.md": "late", "crlf.md": "crlf", "empty.md": "empty", "et.md": ""}
    full = got["full.md"]
    assert (full["tags"], full["created"], full["custom_fields"], full["body"], full["word_count"]) == (["x", "y", "x"], "2024-01-01", {"mood": "good"}, "# Head\none two", 4)
    assert got["tags.md"]["tags"] == ["a", "b"] and got["late.md"]["body"] == "rest" and got["crlf.md"]["body"].startswith("---\r\n")


def test_listing(spark):
    df = frame(spark, {"notes/a.md": "---\ntags: X\n---", "notes/p/b.MD": "", "notes/.h/c.md": "", "notes/d.txt": "", "references/e.md": "", "notesx/f.md": ""})
    assert [r["path"] for r in notes.list_notes(df).collect()] == ["notes/p/b.MD", "notes/a.md"]
    assert [r["path"] for r in notes.list_notes(df, recursive=False, tag="x").collect()] == ["notes/a.md"]
    assert [r["path"] for r in notes.recent_notes(df, T(12)).collect()] == ["notesx/f.md", "references/e.md"]
    got = notes.read_notes(spark, df, ["notes/p/b.MD", "no.md"] + ["notes/a.md"] * 19).collect()
    assert [r["error"] for r in got] == [None, "not found"] + [None] * 18 + ["skipped"]


def test_search(spark):
    df = frame(spark, {"notes/a.md": "Canal canal. " + "x" * 200, "notes/b.md": "# The canal\nno river", "notes/c.md": "river", "notes/d.md": "y" * 100 + " Canal\nriver " + "z" * 100, "notes/canal.md": "none"})
    got = search.search_notes(df, "CANAL!").collect()
    assert [(r["path"], r["score"]) for r in got] == [("notes/b.md", 6.0), ("notes/a.md", 2.0), ("notes/d.md", 1.0)]
    assert got[2]["snippet"] == "..." + ("y" * 100 + " Canal river " + "z" * 100)[41:191] + "..."
    assert [r["path"] for r in search.search_notes(df, "canal river").collect()] == ["notes/b.md", "notes/d.md"]
    assert search.search_notes(df, "canal canal").first()["score"] == 12.0
    for query, most in (("", 20), ("a !", 20), (None, 20), ("canal", 0), ("canal", -1)):
        assert search.search_notes(df, query, most).count() == 0
    assert [r["path"] for r in search.search_notes(df, "canal", 1).collect()] == ["notes/b.md"]


def test_search_plan_has_no_python(spark):
    df = search.search_notes(frame(spark, {"notes/a.md": "x"}), "abc")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "TakeOrderedAndProject" in plan


def test_search_references(spark):
    rows = [("r1", "Canals", 0, "--- Page 1 ---\nx\n\n--- Page 2 ---\nthe canal canal"), ("r1", "Canals", 1, "canal"), ("r1", "Canals", 2, "canal"), ("r2", None, 0, "a canal --- Page x ---")]
    df = spark.createDataFrame(rows, "path string, title string, part int, content string")
    got = search.search_references(df, "canal", 10, 2).collect()
    assert [(r["path"], r["part"], r["page"], r["score"]) for r in got] == [("r1", 0, 2, 7.0), ("r1", 1, None, 6.0), ("r2", 0, None, 1.0)]
    assert search.search_references(df, "page").where("part = 0 and path = 'r1'").first()["page"] is None
    assert search.search_references(df, "").count() == 0


def test_links(spark):
    text = "![[pic.png|100]] [[A b#sec|x|y]] [[ ]] [t](n%20o.md#h \"title\") ![](img.png) [e](HTTPS://x) [m](mailto:a@b) [q](a+b%zz.md)"
    got = [tuple(r)[2:6] for r in links.extract_links(frame(spark, {"notes/a.md": text, "notes/b.md": None})).orderBy("pos").collect()]
    assert got == [("pic.png", None, "100", True), ("A b", "#sec", "x|y", False), ("n o.md", "#h", "t", False), ("img.png", None, None, True), ("a+b%zz.md", None, "q", False)]


def test_resolution_and_backlinks(spark):
    paths = ["notes/p/_a/x.png", "notes/q/_a/x.png", "notes/My Note.md", "notes/q/my note.md", "notes/my note.canvas", "notes/deep/er/My Note.md"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    asked = [(1, "notes/q/n.md", "x.png"), (2, "notes/p/n.md", "X.PNG"), (3, None, "my note"), (4, "notes/q/n.md", "q/my note"), (5, "z.md", "Q/My Note"), (6, "z.md", "miss"), (7, "z.md", "/"), (8, "z.md", "../deep/er/My Note"), (9, "z.md", "deep/er/My Note")]
    got = {}
    for r in links.resolve_links(spark.createDataFrame(asked, "link_id int, source string, target string"), files).orderBy("link_id", "rank").collect():
        got.setdefault(r["link_id"], []).append(r["match"])
    three = ["notes/My Note.md", "notes/q/my note.md", "notes/deep/er/My Note.md"]
    assert got == {1: paths[1::-1], 2: paths[:2], 3: three, 4: ["notes/q/my note.md"], 5: three, 8: three, 9: ["notes/deep/er/My Note.md"]}
    df = frame(spark, {"notes/q/n.md": "[[my note]] [[x.png]] [[my note]]", "notes/n.markdown": "[[my note]]", "notes/My Note.md": "[[My Note]]"})
    assert [tuple(r) for r in links.find_backlinks(df, files, "notes/q/my note.md").collect()] == [("notes/q/n.md", "[[my note]]", False)] * 2
    assert [tuple(r)[0] for r in links.find_backlinks(df, files, "my note").collect()] == ["notes/My Note.md"]
    assert links.find_backlinks(df, files, "nothing").count() == 0


GOOD = '{"nodes":[{"id":"a","type":"text","x":1,"y":2.5,"width":3,"height":4,"text":"one\\n\\n two Needle x","color":"#fff","extra":1},{"id":"b","type":"group","x":1,"y":2,"width":3,"height":4,"label":"needle"},{"id":"c","type":"file","x":1,"y":2,"width":3,"height":4,"file":"notes/a.md","subpath":"#h"},{"id":"d","type":"link","x":1,"y":2,"width":3,"height":4,"url":"needle"}],"edges":[{"id":"e","fromNode":"a","toNode":"b","fromSide":"top","toEnd":"arrow"}]}'


def test_canvas(spark):
    node = lambda **k: '{"nodes":[' + ",".join('{"id":"%s","type":"text","x":1,"y":1,"width":1,"height":1,"text":"t"%s}' % (i, x) for i, x in k.items()) + "]"  # noqa: E731, UP031
    bad = {
        "good": GOOD, "none": "{}", "nulls": '{"nodes":null}', "json": "{", "list": "[]", "member": '{"nodes":[1]}', "dup": node(a="") [:-1] + "," + node(a="")[10:] + "}", "color": node(a=',"color":"7"') + "}", "number": '{"nodes":[{"id":1}]}',
        "width": '{"nodes":[{"id":"a","type":"text","x":1,"y":1,"height":1,"text":"t"}]}', "type": '{"nodes":[{"id":"a","type":"blob","x":1,"y":1,"width":1,"height":1}]}', "edge": node(a="") + ',"edges":[{"id":"e","fromNode":"z","toNode":"y"}]}', "side": node(a="") + ',"edges":[{"id":"e","fromNode":"a","toNode":"a","toSide":"up"}]}',
    }
    df = frame(spark, {f"notes/{k}.canvas": v for k, v in bad.items()} | {"notes/null.canvas": None})
    got = {}
    for r in canvas.violations(df).orderBy("stage", "pos", "part").collect():
        got.setdefault(r["path"][6:-7], []).append((r["code"], r["ref"]))
    assert got == {
        "json": [("malformed", None)], "list": [("malformed", None)], "member": [("malformed", None)], "null": [("malformed", None)], "dup": [("duplicate id", "a")], "color": [("color", "a")], "number": [("id", None)], "width": [("width", "a")],
        "type": [("unknown type", "a")], "edge": [("dangling edge", "z"), ("dangling edge", "y")], "side": [("toSide", "e")],
    }
    good = df.where("path = 'notes/good.canvas'")
    assert [tuple(r)[2:] for r in canvas.search_canvases(good, "NEEDLE", 1).collect()] == [("a", "text", "text", "one / two Needle x", 2)]
    assert canvas.search_canvases(good, "").count() == 0
    files = spark.createDataFrame([("notes/b.md",)], "path string")
    assert [(r["label"], r["warning"]) for r in canvas.read_canvas(df, files, "notes/good.canvas").collect()] == [("one", None), ("needle", None), ("notes/a.md", "file not found"), ("needle", None)]
    assert [tuple(x) for x in canvas.canvas_summary(good).first()["breakdown"]] == [("file", 1), ("group", 1), ("link", 1), ("text", 1)]
    counts = {r["path"]: (r["node_count"], r["edge_count"]) for r in canvas.list_canvases(df).collect()}
    assert counts["notes/good.canvas"] == (4, 1) and counts["notes/json.canvas"] == (0, 0)


def test_history(spark):
    v = spark.createDataFrame([], history.VERSION)
    v = v.unionByName(history.create(v, "notes/a-b.md", "text", T(1), [" X "]))
    assert history.state(v).first()["content"] == "---\ntitle: a b\ncreated: 2025-01-01\ntags: [x]\n---\n\ntext"
    with pytest.raises(history.EditError):
        history.create(v, "notes/a-b.md", "again", T(2))
    v = v.unionByName(history.update(v, "notes/a-b.md", "more", T(2), "append"))
    v = v.unionByName(history.move(v, [("notes/a-b.md", "notes/c.md")], T(3)))
    v = v.unionByName(history.revert(v, "notes/a-b.md", 1, T(4)))
    v = v.unionByName(history.delete(v, "notes/c.md", T(5)))
    assert [r["path"] for r in history.state(v).collect()] == ["notes/a-b.md"]
    assert sorted(r["path"] for r in history.state(v, 4).collect()) == ["notes/a-b.md", "notes/c.md"]
    assert [r["op"] for r in history.file_history(v, "notes/a-b.md").collect()] == ["revert", "move", "update", "create"]
    assert [r["seq"] for r in history.changelog(v, 2, "2025-01-02 00:00:00").collect()] == [5, 4]
    assert {r["path"] for r in history.files_changed(v, 3).collect()} == {"notes/a-b.md", "notes/c.md"}
    files = spark.createDataFrame([("notes/a-b.md", "other"), ("notes/n.md", "")], "path string, content string")
    assert {r["path"]: r["change"] for r in history.dirty(v, files).collect()} == {"notes/a-b.md": "changed", "notes/n.md": "added"}
    v = v.unionByName(history.snapshot(v, files, T(6)))
    assert history.dirty(v, files).count() == 0
    with pytest.raises(history.EditError):
        history.revert(v, "notes/zz.md", 1, T(7))


def test_patches(spark):
    cases = [
        ("a b", [("a", "x")], ("x b", None, 1)), ("a b", [("a", "c"), ("c b", "d")], ("d", None, 2)), ("a a", [("a", "x")], (None, "ambiguous", 0)), ("a", [("z", "x")], (None, "not found", 0)), ("a", [("", "x")], (None, "not found", 0)),
        ("a", [("a", "a")], ("a", None, 0)), ("a b", [("a", "b"), ("b", "c")], (None, "ambiguous", 0)), ("a", [], (None, "1 to 20 patches", 0)), ("a", [("a", "a")] * 21, (None, "1 to 20 patches", 0)), (None, [("a", "b")], (None, "no such file", 0)),
    ]
    df = spark.createDataFrame([(str(i), c) for i, (c, _, _) in enumerate(cases) if c is not None], "path string, content string")
    ops = spark.createDataFrame([(str(i), p) for i, (_, p, _) in enumerate(cases)], "path string, patches array<struct<old_text:string,new_text:string>>")
    got = {r["path"]: tuple(r)[1:] for r in history.patch_notes(df, ops).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [w for _, _, w in cases]


def test_move_conflicts(spark):
    files = spark.createDataFrame([(p,) for p in ("a", "b", "c")], "path string")
    check = lambda *m: sorted((r["pos"], r["code"]) for r in history.move_conflicts(spark.createDataFrame([(i, *x) for i, x in enumerate(m)], "pos int, source string, destination string"), files).collect())
    assert check(("a", "x"), ("b", "B")) == []
    assert check(("a", "x"), ("A", "y")) == [(0, "source twice"), (1, "missing source"), (1, "source twice")]
    assert check(("a", "x"), ("b", "X")) == [(0, "destination twice"), (1, "destination twice")]
    assert check(("a", "b"), ("b", "z")) == [(0, "destination exists"), (1, "source is a destination")]


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x02\0\0\0"
    frame_ = b"\x21\xf9\x04\0\x0a\0\0\0" + b"\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x4c\x01\0"
    gif = b"GIF89a\x02\0\x03\0\0\0\0" + frame_ * 3 + b"\x3b"
    df = spark.createDataFrame([(png,), (gif,), (b"BM" + b"\0" * 16 + (5).to_bytes(4, "little") + (6).to_bytes(4, "little"),), (b"junk",), (None,), (png[:12],)], "data binary")
    got = [r["i"] and tuple(r["i"]) for r in df.select(images.inspect("data").alias("i")).collect()]
    assert got[:3] == [("png", 640, 480, 1, None), ("gif", 2, 3, 3, [0.1, 0.1, 0.1]), ("bmp", 5, 6, 1, None)] and all(g is None or g[0] is None for g in got[3:])
    plan = spark.createDataFrame([("a", "gif", 1, 10, 10, 50, [0.1] * 50), ("b", "PNG", 1, 3000, 10, 1, None), ("c", "jpg", 1, 100, 10, 1, None), ("d", "png", 26 << 20, 1, 1, 1, None), ("e", "png", 1, 10000, 6000, 1, None), ("f", "bmp", 1, 1, 1, 1, None)], "path string, ext string, bytes long, width int, height int, frames int, delays array<double>")
    rows = {r["path"]: r for r in images.image_plan(plan).collect()}
    assert {p: r["action"] for p, r in rows.items()} == {"a": "frames", "b": "re_encode", "c": "pass_through", "d": "reject_size", "e": "reject_pixels", "f": "re_encode"}
    assert rows["a"]["frames"] == [0, 7, 14, 21, 28, 35, 42, 49] and abs(rows["a"]["offsets"][1] - 0.7) < 1e-9 and abs(rows["a"]["total_duration"] - 5) < 1e-9
    counts = spark.createDataFrame([(0,), (5,), (8,)], "n int").select(images.sample_indices(F.col("n")).alias("i"))
    assert [r["i"] for r in counts.collect()] == [[], [0, 1, 2, 3, 4], list(range(8))]


def test_references(spark):
    pages = spark.createDataFrame([("a", i, str(i - 2) if i > 2 else "i" * i, f"text {i}") for i in range(1, 31)] + [("b", 1, "1", None)], "path string, page int, label string, text string")
    numbers = lambda **k: [r["page"] for r in references.select_pages(pages, "a", **k).collect()]
    assert numbers() == [1, 2, 3, 4, 5] and numbers(page=9) == [9] and numbers(book_page="9") == [11] and numbers(book_page="30") == [30] and numbers(page_range="3-4") == [3, 4] and numbers(page_range="x", max_pages=99) == list(range(1, 11))
    assert numbers(query="TEXT 1", max_pages=50) == [1, *range(10, 20)] and numbers(page_range="9-3") == [] and len(numbers(page_range="1-30", max_pages=50)) == 20
    text = {r["path"]: r["content"] for r in references.marked_text(pages).collect()}
    assert text["b"] == "--- Page 1 ---\n" and text["a"].startswith("--- Page 1 ---\ntext 1\n\n--- Page 2 ---\ntext 2")
    assert [r["path"] for r in references.page_labels(pages).collect()] == ["a"]
    files = spark.createDataFrame([("x", T(2)), ("y", T(2)), ("z", T(2))], "path string, modified timestamp")
    cache = spark.createDataFrame([("x", 3, T(2)), ("y", 2, T(9)), ("y", 3, T(1))], "path string, version int, source_modified timestamp")
    assert [r["path"] for r in references.uncached(files, cache).orderBy("path").collect()] == ["y", "z"]


def test_small_expressions(spark):
    one = spark.range(1)
    val = lambda e: one.select(e.alias("v")).first()["v"]
    assert [val(X.human_bytes(F.lit(n))) for n in (5, 2048, 5 << 20, 9472, 9574)] == ["5 B", "2.0 KB", "5.0 MB", "9.2 KB", "9.3 KB"]
    assert val(X.message_line(F.lit("a\nb;`$(x)"))) == "a b(x)" and val(X.safe_ref(F.lit("HEAD~1;x"))) == "HEAD1x"
    assert val(X.trash_name(F.lit(dt.datetime(2025, 1, 2, 3, 4, 5)), F.lit("notes/a.md"))) == "2025-01-02T03-04-05Z_a.md"
    assert len(val(X.cache_key(F.lit("a")))) == 32 and val(X.png_name(F.lit("notes/a.b/c.jpg"))) == "notes/a.b/c.png"
    assert X.query_terms("Ab c, d1-é é́x") == ["ab", "d1", "é́x"] and X.page_range("2-3", 9) == (2, 3)
    assert val(X.new_frontmatter(F.lit("T"), F.lit("2025-01-01"), F.array(F.lit(" A ")))) == "---\ntitle: T\ncreated: 2025-01-01\ntags: [a]\n---\n"
    files = spark.createDataFrame([("notes/a.png", 1, T(1)), ("notes/_x/b.csv", 2, T(2)), ("notes/c.md", 1, T(3)), ("notes/.d/e.png", 1, T(4)), ("notes/f.canvas", 1, T(5))], "path string, size_bytes long, modified timestamp")
    assert [(r["path"], r["readable"]) for r in attachments.list_attachments(files).collect()] == [("notes/_x/b.csv", False), ("notes/a.png", True)]


def test_edits_at_once(spark):
    from marginalia.operators import edits

    v = spark.createDataFrame([(1, T(1), "create", "notes/a.md", None, "one", "m"), (2, T(2), "update", "notes/a.md", None, "two", "m"), (3, T(2), "create", "notes/b-x.md", None, None, "m"), (4, T(3), "delete", "notes/gone.md", None, "g", "m")], history.VERSION)
    asked = [
        (0, "create", "notes/a.md", None, "x", None), (1, "create", "notes/new_one.md", None, "text", None), (2, "create", "notes/own.md", None, " ---\nt: 1\n---", None), (3, "append", "notes/b-x.md", None, "more", None), (4, "delete", "notes/none.md", None, None, None),
        (5, "revert", "notes/gone.md", None, None, 3), (6, "move", "notes/c.md", "notes/d.md", None, None), (7, "burn", "notes/q.md", None, None, None), (8, None, "notes/r.md", None, None, None), (9, "replace", "notes/twice.md", None, "", None), (10, "create", "notes/twice.md", None, "", None),
    ]
    schema = "pos int, op string, path string, new_path string, content string, seq long"
    got = {r["pos"]: (r["content"], r["error"]) for r in edits.edited(v, spark.createDataFrame(asked, schema), T(9)).collect()}
    assert got == {
        0: (None, "exists"), 1: ("---\ntitle: new one\ncreated: 2025-01-09\n---\n\ntext", None), 2: (" ---\nt: 1\n---", None), 3: ("\nmore", None), 4: (None, "no such file"), 5: (None, "no such version"), 6: (None, "no such file"),
        7: (None, "unknown operation"), 8: (None, "unknown operation"), 9: (None, "path twice"), 10: (None, "path twice"),
    }
    good = [(0, "move", "notes/a.md", "notes/A.md", None, None), (1, "revert", "notes/b-x.md", None, None, 3), (2, "delete", "notes/b.md", None, None, None), (3, "create", "notes/z.md", None, "z", None)]
    rows = edits.version_rows(v, spark.createDataFrame(good, schema), T(9))
    assert sorted(r["seq"] for r in rows.collect()) == [5, 6, 7]
    assert {r["path"]: r["content"][-1:] if r["content"] else r["content"] for r in history.state(v.unionByName(rows)).collect()} == {"notes/A.md": "o", "notes/b-x.md": None, "notes/z.md": "z"}
    assert edits.edited(v, spark.createDataFrame([], schema), T(9)).count() == 0
    many = edits.numbered(spark.range(5000).selectExpr("cast(id as string) path"), "path", "seq", F.lit(11))
    assert sorted(r["seq"] for r in many.collect()) == list(range(11, 5011))


def test_deleted_attachments_and_missing_relations(spark):
    from marginalia.operators.toolbox import Vault, call

    v = Vault(spark, spark.createDataFrame([(1, T(1), "create", "notes/a.md", None, "one", "m")], history.VERSION), clock=lambda: T(9))
    for name, args in (("list_references", {}), ("read_reference", {"path": "references/a.pdf"}), ("search_references", {"query": "x"}), ("get_reference_metadata", {"path": "references/a.pdf"}), ("read_image", {"path": "notes/a.png"}), ("list_notes", {"directory": "../x"}), ("move_notes", {"moves": [{}]}), ("note_history", {"path": "../a"})):
        assert call(v, name, **args).columns == ["error"], name
    assert [r["error"] for r in call(v, "read_notes", paths=["/etc/x.md", "notes/a.md"]).collect()] == ["not found", None]
    v.files = spark.createDataFrame([("notes/p.png", 5, T(1)), ("references/r.pdf", 7, T(1))], "path string, size_bytes long, modified timestamp")
    assert [r["path"] for r in call(v, "list_attachments").collect()] == ["notes/p.png"]
    assert call(v, "delete_attachment", path="notes/q.png").columns == ["error"]
    assert call(v, "delete_attachment", path="notes/p.png").first()["op"] == "delete"
    assert call(v, "list_attachments").count() == 0 and call(v, "delete_attachment", path="notes/p.png").columns == ["error"]
    v.pages = spark.createDataFrame([("references/r.pdf", 1, None, "nothing")], "path string, page int, label string, text string")
    v.outline = spark.createDataFrame([("references/r.pdf", 1, "The Harbour", 1)], "path string, pos int, title string, page int")
    assert [r["path"] for r in call(v, "search_references", query="harbour").collect()] == ["references/r.pdf"]


def test_cache_build(spark):
    pages = spark.createDataFrame([(p, i, None, f"{p} {i}") for p in "abc" for i in (1, 2)], "path string, page int, label string, text string")
    files = spark.createDataFrame([("a", T(2)), ("b", T(2)), ("c", T(5)), ("empty", T(1))], "path string, modified timestamp")
    cache = spark.createDataFrame([("a", "fullText", 9, "old a", 3, T(2)), ("c", "fullText", 9, "old c", 3, T(3)), ("lost", "fullText", 1, "x", 3, T(1)), ("b", "fullText", 1, "x", 2, T(9))], references.CACHE)
    outline = spark.createDataFrame([("c", 1, "Part", 2)], "path string, pos int, title string, page int")
    got = {r["path"]: (r["pages"], r["content"], r["source_modified"].day) for r in references.build_cache(files, cache, pages, outline).collect()}
    assert got == {"a": (9, "old a", 2), "b": (2, "--- Page 1 ---\nb 1\n\n--- Page 2 ---\nb 2", 2), "c": (2, "--- Page 1 ---\nc 1\n\n--- Page 2 ---\nc 2\n\n--- Page 2 ---\nPart", 5)}
    assert references.build_cache(files, cache.limit(0), pages.limit(0)).count() == 0


def test_best_matches_are_the_first_ranked(spark):
    import random

    rng = random.Random(8)
    folder = lambda: "notes/" + "".join(f"{rng.choice('aAbc')}/" for _ in range(rng.randrange(4)))
    names = ["x.md", "X.md", "y.md", "x.png", "y.MD", "z.canvas"]
    files = sorted({folder() + rng.choice(names) for _ in range(120)} | {"top.md", "notes//odd.md"})
    targets = ["x", "X.MD", "x.png", "a/x", "b/x.md", "c/a/X", "y", "z", "z.canvas", "a//x", "/x", "top", "notes/x", "odd", "/", ""]
    asked = [(i, rng.choice([None, *files]) if rng.random() < 0.5 else folder() + "n.md", rng.choice(targets)) for i in range(300)]
    df = spark.createDataFrame(asked, "link_id int, source string, target string")
    paths = spark.createDataFrame([(f,) for f in files], "path string")
    ranked = links.resolve_links(df, paths).where("rank = 1").select("link_id", "match")
    best = links.best_matches(df, paths)
    same = df.join(best, (df["target"] == best["target"]) & df["source"].eqNullSafe(best["source"])).select("link_id", "match")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, ranked.collect())) and ranked.count() > 100


def test_more_image_headers(spark):
    import struct

    riff = lambda kind, body: b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBP" + kind + struct.pack("<I", len(body)) + body
    lossy = riff(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 30, 40) + b"\0" * 4)
    lossless = riff(b"VP8L", b"\x2f" + struct.pack("<I", (50 - 1) | (60 - 1) << 14) + b"\0" * 4)
    anmf = b"ANMF" + struct.pack("<I", 16) + b"\0" * 12 + (250).to_bytes(3, "little") + b"\0"
    moving = riff(b"VP8X", b"\0" * 4 + (69).to_bytes(3, "little") + (79).to_bytes(3, "little")) + anmf * 3
    entry = lambda e, tag, v: struct.pack(e + "HHI", tag, 3, 1) + struct.pack(e + "H", v) + b"\0\0"
    tiff = lambda e, head: head + struct.pack(e + "I", 8) + struct.pack(e + "H", 2) + entry(e, 256, 7) + entry(e, 257, 9) + struct.pack(e + "I", 8)
    box = lambda w, h: b"\0\0\0\x14ispe\0\0\0\0" + struct.pack(">II", w, h)
    heic = b"\0\0\0\x18ftypheic" + b"\0" * 12 + box(512, 512) + box(4032, 3024)
    df = spark.createDataFrame([(x,) for x in (lossy, lossless, moving, tiff("<", b"II*\0"), tiff(">", b"MM\0*"), heic, b"RIFF....WEBPjunk", b"II*\0")], "data binary")
    got = [tuple(r["i"])[:4] for r in df.select(images.inspect("data").alias("i")).collect()]
    assert got == [("webp", 30, 40, 1), ("webp", 50, 60, 1), ("webp", 70, 80, 3), ("tiff", 7, 9, 1), ("tiff", 7, 9, 1), ("heic", 4032, 3024, 1), (None,) * 4, (None,) * 4]


def test_rows_of_an_open_pdf():
    from types import SimpleNamespace as N

    from marginalia.sources import pages as P

    def broken():
        raise ValueError("bad stream")

    entry = lambda title, page: N(title=title, page=page)
    deep = [entry("A", 0), [entry("A.1", None), [entry("A.1.1", 2), [entry("too deep", 3)]]], entry("B", 4)]
    pdf = N(page_labels=["i"], pages=[N(extract_text=lambda: "one"), N(extract_text=broken), N(extract_text=lambda: None)], outline=deep, metadata=N(title=" T ", author=""), get_destination_page_number=lambda e: e.page)
    assert P.page_rows(pdf) == [(1, "i", "one", None), (2, None, None, "page not readable: bad stream"), (3, None, "", None)]
    assert P.outline_rows(pdf) == [(1, 0, "A", 1, None), (2, 2, "A.1.1", 3, None), (3, 0, "B", 5, None)]
    assert P.attribute_rows(pdf) == [("T", None, 3, None)] and P.attribute_rows(N(metadata=None, pages=[])) == [(None, None, 0, None)]
