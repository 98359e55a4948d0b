import unicodedata

from marginalia.llm import queries as Q
from marginalia.llm import unify as U
from marginalia.llm.unify import STABLE, _properties, found_disguises, unifier, with_canonical

CASES = {
    "plain text, café 漢字 …“x” ½ m² № Ω": ("plain text, café 漢字 …“x” ½ m² № Ω", []), "１２ ａb 𝐡ello ﬁx": ("12 ab hello fix", ["form"]), "café x̄": ("café x̄", ["accent"]),
    "a​b­c﻿": ("abc", ["invisible"]), "👩‍🔧 🗂️ 👨‍👩‍👧": ("👩‍🔧 🗂️ 👨‍👩‍👧", []), "a‍b": ("ab", ["invisible"]), "a b　c": ("a b c", ["space"]),
    "pаge ɑbout": ("page about", ["lookalike"]), "заметка λόγος книга": ("заметка λόγος книга", []), "Tシャツ": ("Tシャツ", []), "w​оrd": ("word", ["invisible", "lookalike"]), "ｗоrd": ("word", ["form", "lookalike"]),
    "": ("", []), "🏴\U000e0067\U000e0062\U000e007f": ("🏴\U000e0067\U000e0062\U000e007f", []),
}


def test_cases():
    for text, want in CASES.items():
        assert unifier()(text) == want, text


def test_canonical_form_is_stable():
    for text in CASES:
        once = unifier()(text)[0]
        assert unifier()(once) == (once, [])
        assert unicodedata.normalize("NFC", once) == once


def test_quick_check_lets_nothing_slip():
    assert not [hex(p) for p in _properties()[2] if any(a <= p <= b for a, b in STABLE)]


def test_rows(spark):
    rows = [(i, t, "k", "t") for i, t in enumerate(CASES)] + [(90, None, None, None), (None, "１", None, None), (91, "x" * 200_000 + "​", "k", "t"), (1, list(CASES)[1], "k", "t")]
    df = spark.createDataFrame(rows, "page_id long, text string, kind string, tbl string")
    got = [tuple(r) for r in found_disguises([("p", df, "page_id", "text")]).collect()]
    want = {("p", i, k) for i, (_, ks) in enumerate(CASES.values()) for k in ks} | {("p", 91, "invisible")}
    assert len(got) == len(set(got)) and set(got) == want
    assert found_disguises([("p", df.limit(0), "page_id", "text")]).count() == 0
    same = {r["page_id"]: r["c"] for r in with_canonical(df, "text", "c").collect()}
    assert [same[i] for i in range(len(CASES))] == [w for w, _ in CASES.values()] and same[90] is None


def test_pages_and_snippets_get_the_same_form(spark, tmp_path):
    texts = [(i, t) for i, t in enumerate(CASES)] + [(90, None), (1, list(CASES)[1])]
    spark.createDataFrame(texts, "page_id long, text string").write.parquet(str(tmp_path / "ref_pages.parquet"))
    spark.createDataFrame(texts, "result_id long, snippet string").write.parquet(str(tmp_path / "search_results.parquet"))
    got = [tuple(r) for r in Q.p5_canonical(spark, str(tmp_path)).select("tbl", "row_id", "canonical").collect()]
    want = {(tbl, i, w) for tbl in ("ref_pages", "search_results") for i, (t, (w, _)) in enumerate(CASES.items()) if w != t}
    assert len(got) == len(set(got)) and set(got) == want


def test_every_canonical_form_is_composed():
    run = U.Unifier()
    for p in (*range(0x80, 0xD800), *range(0xE000, 0x30000)):
        for text in (chr(p), f"a{chr(p)}b", f"\u1100{chr(p)}"):
            got = run(text)[0]
            assert unicodedata.is_normalized("NFC", got), hex(p)
    for a, b in (("e\u0301\u0323", "e\u0323\u0301"), ("\u1112\u1161\u11ab", "한"), ("\u212b1", "Å1"), ("1\u0307\u0323", "1\u0323\u0307"), ("\u0958", "\u0915\u093c")):
        assert run(a)[0] == run(b)[0]


def test_quick_check_passes_nothing_unstable():
    stable = lambda p: any(a <= p <= b for a, b in U.STABLE)
    assert not [hex(p) for p in {*U._properties()[2], *U.unsettled()} if stable(p)]


def test_letters_given_as_a_parameter():
    assert U.Unifier({"ꭺ": "A"})("ꭺda")[0] == "Ada" and U.Unifier()("ꓮda")[0] == "Ada" and U.Unifier()("ꓮꓐ")[0] == "ꓮꓐ"
