import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import pages as G

SCHEMA = "page_id long, vault_key string, ref_path string, page_number int, text string, extracted_text string, line string, kind string"
CACHE = "vault_key string, ref_path string, title string"
WORDS = "the careful heron crossed linen harbour before evening while nobody counted several lamps under heavy table with borrowed tools".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "."


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(4)
    rows = [(i, "v", "plain.pdf", i, "\n".join(sentence(rng) for _ in range(12)) + "\nA half-finished table.", None) for i in range(1, 25)]
    p = [
        (101, "v", "r.pdf", 1, "Notes on Harbours\n\nThe careful her-\non crossed the linen. A half-\nfinished table\n\nunder hcavy lamps with b0rrowed tools near har-\n\n1", None),
        (102, "v", "r.pdf", 2, "N0tes on Harb0urs   2\nbour before evening.\r\n\r\nNobody counted tооls in 1951. Sheet B12\n\n", "Notes on Harbours 2\nbour before evening."),
        (103, "v", "r.pdf", 3, "Page 3 of 9\nthe linen¬\ned lamps. Nobody\n\n[3]", ""), (104, "v", "r.pdf", 4, None, None), (105, "v", None, None, "", "  "), (101, "v", "r.pdf", 1, "Notes on Harbours\n\nThe careful her-\non crossed the linen. A half-\nfinished table\n\nunder hcavy lamps with b0rrowed tools near har-\n\n1", None),
        (None, "v", "r.pdf", 5, "3", None),
    ]
    return spark.createDataFrame([(*r, "x", "y") for r in rows + p], SCHEMA)


def test_found(noisy):
    got = [tuple(r) for r in G.found_noise(noisy).where("page_id > 100").collect()]
    want = {
        (101, "text", 1, "header"), (101, "text", 3, "hyphen"), (101, "text", 7, "misread"), (101, "text", 7, "hyphen"), (101, "text", 9, "page_number"), (102, "text", 1, "header"), (102, "extracted_text", 1, "header"),
        (103, "text", 1, "page_number"), (103, "text", 2, "hyphen"), (103, "text", 5, "page_number"),
    }
    assert len(got) == len(set(got)) and set(got) == want
    assert G.found_noise(noisy).where("page_id <= 100").count() == 0


def test_repaired(noisy):
    got = {(r["page_id"], r["field_name"]): r["text"] for r in G.repaired_pages(noisy).where("page_id > 100").collect()}
    assert got[101, "text"] == "The careful heron crossed the linen. A half-finished table\n\nunder heavy lamps with borrowed tools near harbour"
    assert got[102, "text"] == "before evening.\n\nNobody counted tools in 1951. Sheet B12"
    assert got[103, "text"] == "the linened lamps. Nobody"


def test_empty_tables_and_titles(spark, noisy):
    assert G.found_noise(noisy.limit(0)).count() == 0
    assert G.repaired_pages(noisy.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "v", "a.pdf", 1, "a quiet view of harbours\nThe careful heron.\n" + "x " * 60_000, None, None, None)], SCHEMA)
    cache = spark.createDataFrame([("v", "a.pdf", "A Quiet View of Harbours"), (None, None, None)], CACHE)
    assert [tuple(r) for r in G.found_noise(one, cache).collect()] == [(1, "text", 1, "header")]


def test_page_numbers(spark):
    lines = ["3", "[3]", "- 3 -", "· iii ·", "p. 3", "Page 3 of 9", "Page l3 of I9", "IO", "- ll -", "[lO]", "so", "1951.", "is", "Sis"]
    rows = [(i, "v", f"{i}.pdf", 10, f"The careful heron crossed linen.\n\n{x}", None, None, None) for i, x in enumerate(lines)]
    got = {r["page_id"] for r in G.found_noise(spark.createDataFrame(rows, SCHEMA)).where("kind = 'page_number'").collect()}
    assert {lines[i] for i in got} == set(lines[:10])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefghiklmnoqrstuvwz", min_size=1, max_size=9), st.data())
def test_a_misreading_keeps_its_skeleton(word, data):
    places = [(i, a, b) for a, b in G.CONFUSIONS for i in range(len(word)) if word.startswith(a, i)]
    if places:
        i, a, b = data.draw(st.sampled_from(places))
        read = word[:i] + b + word[i + len(a) :]
        assert G.strokes_of(read) == G.strokes_of(word)
        assert read == word or G.turns_into(word, read)
