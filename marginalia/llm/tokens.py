"""Encoding of whole tables with a public byte-level BPE vocabulary.

A text is cut by the vocabulary's pattern; each piece is merged by its own algorithm here: a segment tree over the
piece's byte positions stores the leftmost minimum rank of the pairs of live neighbours. A merge takes the root, joins
the pair and makes at most three point updates of logarithmic cost, so one endless piece of n bytes takes
O(n log n). Short pieces repeat, so each worker keeps a bounded memo of them.

The vocabulary's path is a parameter of the driver; its bytes (at most 8 MB, checked) are broadcast, so executors need
no file. Null and empty texts have the ids ``[]``. Special tokens are never produced, their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public vocabularies lie by default.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the pattern by which these vocabularies cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MAX_VOCABULARY_BYTES = 8 << 20
_MEMO_ENTRIES, _MEMO_BYTES = 400_000, 48


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line for each token, its base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class BytePairEncoder:
    """Byte-level BPE by a segment tree of leftmost minimum pair ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.memo: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ranks, n = self.ranks, len(piece)
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if n < 2:
            raise ValueError("the vocabulary lacks a byte")
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        none = 1 << 62
        # Leaf width + i: rank * width + i of the pair that starts at byte i, so the least value is the leftmost least rank.
        tree = [none] * (2 * width)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                tree[width + i] = r * width + i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                other = tree[i ^ 1]
                value = other if other < value else value
                i >>= 1
                if tree[i] == value:
                    break
                tree[i] = value

        while (least := tree[1]) < none:
            i = least & (width - 1)
            j = after[i]
            k = after[j]
            end[i], after[i] = end[j], k
            if j < width:
                put(j, none)
            if k < n:
                before[k] = i
                r = ranks.get(piece[i : end[k]])
                put(i, none if r is None else r * width + i)
            else:
                put(i, none)
            if (h := before[i]) >= 0:
                r = ranks.get(piece[h : end[i]])
                put(h, none if r is None else r * width + h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; [] for null and empty ones."""
        if not text:
            return []
        memo, out = self.memo, []
        for piece in self.find(text):
            ids = memo.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                ids = self.merge(raw)
                if len(raw) <= _MEMO_BYTES:
                    if len(memo) >= _MEMO_ENTRIES:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


_ENCODERS: dict[str, BytePairEncoder] = {}


def encoder_of(content: bytes) -> BytePairEncoder:
    """This process's encoder of a vocabulary file's content."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = BytePairEncoder(read_ranks(content))
    return _ENCODERS[key]


def vocabulary(name: str, folder: str = VOCABULARIES) -> bytes:
    """The content of a vocabulary file, read on the driver; its size is checked, as it goes to every executor."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        content = f.read(_MAX_VOCABULARY_BYTES + 1)
    if len(content) > _MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    return content


def with_ids(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, ids): the token ids of each row's text, one row for each row of df. Only these two columns are read."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(shared.value).encode
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                ids = [encode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int64()))], [key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<bigint>")


def with_token_count(df: DataFrame, text: str, out: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """df with the number of tokens of a text column; 0 for null and empty texts."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(shared.value).encode
        for batch in batches:
            sizes = [len(encode(x)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64())], [*batch.schema.names[1:], out])

    rest = [x for x in df.columns if x != text]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.select(*rest).dtypes)
    return df.select(text, *rest).mapInArrow(run, f"{schema}, `{out}` bigint")
