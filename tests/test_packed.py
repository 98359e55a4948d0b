from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.operators.packed import found_items, skeleton, split_packed, split_skeleton, tokens

S = "note_id long, tags string, custom_fields map<string,string>, pos string, item string"


def split(spark, values, mode="list"):
    df = spark.createDataFrame([(i, "f", mode, v) for i, v in enumerate(values)], "id int, field_name string, mode string, value string")
    got = [[] for _ in values]
    for r in split_packed(df).orderBy("id", "pos").collect():
        got[r["id"]].append(r["item"])
        assert r["pos"] == len(got[r["id"]])
    return got


def test_delimiters_and_wrappers(spark):
    cases = {
        "a, b,c": ["a", "b", "c"], "[a, b]": ["a", "b"], '["a b", "c"]': ["a b", "c"], "a | b; c\nd, e": list("abcde"), "a、b，c；d": list("abcd"), "a\tb": ["a", "b"], "a • b · c": list("abc"),
        "x / y": ["x", "y"], "area/home": ["area/home"], "- a\n- b c": ["a", "b c"], "* a\r\n* b": ["a", "b"], r"one\, two, three": ["one, two", "three"], ",a,, b ,": ["a", "b"],
        '"left ""| right"""|x': ['left "| right"', "x"], "“pots; pans”; y": ["pots; pans", "y"], "'one, two', z": ["one, two", "z"], "o'clock tea, rock 'n' roll": ["o'clock tea", "rock 'n' roll"],
        "half-done, c++, ratio 3:2, q&a": ["half-done", "c++", "ratio 3:2", "q&a"], "a, a": ["a", "a"], '"open, b': ['"open', "b"], "  x  ": ["x"], "[": ["["],
    }
    assert dict(zip(cases, split(spark, list(cases)))) == cases
    assert split(spark, [None, "", " ", "[]", "[ ]", ",", " ;, "]) == [[]] * 7
    long = "a-" * 50_000 + "b"
    assert split(spark, [long + "," + "c d " * 50_000]) == [[long, ("c d " * 50_000).strip()]]


def test_tags_and_people(spark):
    assert split(spark, ["#a #b c #area/home", "[#a, #b]"], "tags") == [["a", "b c", "area/home"], ["a", "b"]]
    assert split(spark, ["#a"]) == [["#a"]]
    people = {
        "Dravell, Sefa": ["Dravell, Sefa"], "A B, C D, E F": ["A B", "C D", "E F"], "S, G; T, H": ["S, G", "T, H"], '"S, G","T, H"': ["S, G", "T, H"], "A B / C D": ["A B", "C D"],
        "S, G\nT, H": ["S, G", "T, H"], "S, G, T, H": ["S, G", "T, H"], "S, Anna Maria": ["S, Anna Maria"], "Plato": ["Plato"],
    }
    assert dict(zip(people, split(spark, list(people), "people"))) == people


def test_found_items(spark):
    rows = [(1, "a,b", {"people": "S, G", "status": "x; y", "aliases": "k"}, "p", "i"), (1, "a,b", {"people": "S, G", "status": "x; y", "aliases": "k"}, "p", "i"), (2, None, None, None, None), (None, "z", {}, None, None), (3, "w" * 50_000 + "," + "v", {"topics": ""}, None, None)]
    got = {(r["note_id"], r["field_name"], r["pos"]): r["item"] for r in found_items(spark.createDataFrame(rows, S)).collect()}
    assert got == {(1, "tags", 1): "a", (1, "tags", 2): "b", (1, "people", 1): "S, G", (1, "aliases", 1): "k", (3, "tags", 1): "w" * 50_000, (3, "tags", 2): "v"}
    assert found_items(spark.createDataFrame([], S)).count() == 0


def test_skeleton_has_a_character_for_each_token(spark):
    values = ["a, b", "  [x y]\r\n- z ", "", "é漢字  , 'q' \\", "-*#/", "a-b*c #d"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    from pyspark.sql import functions as F

    for r in df.select("v", tokens(F.col("v")).alias("t"), skeleton(tokens(F.col("v"))).alias("s")).collect():
        assert "".join(r["t"]) == r["v"] and len(r["s"]) == len(r["t"])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab_,;|\"'[]#\\/-* \n\t“”", max_size=30), st.sampled_from(["tags", "people", "list"]))
def test_spans_lie_in_order_without_overlap(sk, mode):
    at = 0
    for start, n, _ in split_skeleton(sk, mode):
        assert start >= at and n > 0 and start + n <= len(sk)
        at = start + n


def test_many_skeletons_are_joined_by_shuffle(spark, monkeypatch):
    from marginalia.operators import packed

    monkeypatch.setattr(packed, "FREQUENT_RULES", 1)
    rows = [(i, "f", "list", v) for i, v in enumerate(["one"] * 40 + ["a, b", "a; b; c", "'x, y', z", None, ""] * 2)]
    df = spark.createDataFrame(rows, "note_id long, field_name string, mode string, value string")
    want = sorted(map(tuple, packed.split_packed(df).collect()))
    assert len(want) == 54 and sorted(map(tuple, packed.split_packed(df, max_rows=2).collect())) == want
