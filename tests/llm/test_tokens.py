import random
from pathlib import Path

import pytest

from marginalia.llm.tokens import PATTERN, VOCABULARIES, BytePairEncoder, read_ranks, vocabulary, with_ids, with_token_count

if not Path(VOCABULARIES).exists():
    pytest.skip("no vocabularies", allow_module_level=True)


@pytest.fixture(scope="module")
def encoder():
    return BytePairEncoder(read_ranks(vocabulary("byte_bpe_50k")))


def public(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_equals_the_public_encoder(encoder):
    rng, theirs = random.Random(1), public(encoder)
    alphabet = "aab etch'sll  \n\t09é漢字🗂️👩‍🔧ß_-.́​"
    texts = ["<|endoftext|>", "it's", "   x", "ab" * 3000, "a" * 5001, "  \n\n  "] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)]
    for text in texts:
        assert encoder.encode(text) == theirs.encode_ordinary(text)


def test_one_endless_piece(encoder):
    text = "".join(random.Random(2).choice("abcde") for _ in range(60_000))
    assert encoder.encode(text) == public(encoder).encode_ordinary(text)


def test_decodes_to_the_text(encoder):
    back = {v: k for k, v in encoder.ranks.items()}
    text = "Zoë’s 12 cafés — 地図 🗂️\r\n\tend"
    assert b"".join(back[i] for i in encoder.encode(text)).decode() == text


def test_rows(spark, encoder):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (3, None, "x"), (None, "a", None)], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in with_ids(df, "doc_id", "text").collect())
    assert got == [(0, encoder.encode("a")), (1, encoder.encode("hello world")), (2, []), (3, []), (3, [])]
    assert with_ids(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(r["n"] for r in with_token_count(df, "text", "n").collect()) == [0, 0, 0, 1, 2]
