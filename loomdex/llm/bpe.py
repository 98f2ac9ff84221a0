"""Byte-pair encoding with public vocabularies.

A word is merged in a contiguous rank array: ``ends`` holds the part boundaries and ``pair`` the rank of
each adjacent pair; the minimum is found by scanning, its boundary deleted and the two neighbouring ranks
refreshed. Words too long for scanning use a heap over the same boundaries, with the same result.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: scanning is quadratic; words of more bytes than this use the heap
SCAN_BYTES = 160
#: entries of the chunk cache of a worker; it is emptied when full
CACHE_ENTRIES = 400_000
NO_RANK = 1 << 30


def tokenizer_dir() -> str:
    """Folder of the vocabulary files: ``LOOMDEX_TOKENIZERS`` or the place where they are installed."""
    return os.environ.get("LOOMDEX_TOKENIZERS", "/opt/tokenizers")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a .tiktoken file (base64 token, blank, rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    if n > SCAN_BYTES:
        return _merge_long(word, ranks)
    get = ranks.get
    ends = list(range(n + 1))
    pair = [get(word[i : i + 2], NO_RANK) for i in range(n - 1)]
    while pair:
        least = min(pair)
        if least == NO_RANK:
            break
        i = pair.index(least)
        del ends[i + 1]
        del pair[i]
        if i < len(pair):
            pair[i] = get(word[ends[i] : ends[i + 2]], NO_RANK)
        if i:
            pair[i - 1] = get(word[ends[i - 1] : ends[i + 1]], NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(ends, ends[1:], strict=False)]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n, get = len(word), ranks.get
    nxt = list(range(1, n + 2))
    prev = list(range(-1, n))
    alive = bytearray(b"\x01") * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, mid, end = heapq.heappop(heap)
        # a pair is stale once either of its parts has changed
        if not (alive[a] and nxt[a] == mid and mid < n and alive[mid] and nxt[mid] == end):
            continue
        alive[mid] = 0
        nxt[a] = end
        if end < n:
            prev[end] = a
            if (r := get(word[a : nxt[end]])) is not None:
                heapq.heappush(heap, (r, a, end, nxt[end]))
        if a and (r := get(word[prev[a] : end])) is not None:
            heapq.heappush(heap, (r, prev[a], a, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : nxt[i]]])
        i = nxt[i]
    return out


class _Chunks(dict):
    """Chunk (blanks and the non-blanks after them) to ids, filled on demand."""

    def __init__(self, ranks: dict[bytes, int], pattern) -> None:
        super().__init__()
        self.ranks, self.words = ranks, pattern.findall
        self.word_ids: dict[str, tuple[int, ...]] = {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for w in self.words(chunk):
            ids = self.word_ids.get(w)
            if ids is None:
                ids = tuple(merge_word(w.encode("utf-8", "replace"), self.ranks))
                if len(w) < 40:
                    self.word_ids[w] = ids
            out += ids
        got = tuple(out)
        if len(chunk) < 40:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            if len(self.word_ids) >= CACHE_ENTRIES:
                self.word_ids.clear()
            self[chunk] = got
        return got


class Encoder:
    """Encodes texts without special tokens; strings that look like one are ordinary text.

    A text is first cut before each run of white space that follows a non-blank: the tokenizer's own
    pattern never joins across such a place, so each chunk is encoded, and cached, on its own. Texts with
    the separators U+001C to U+001F, on which regex engines disagree, go through the pattern whole.
    """

    def __init__(self, name: str = "byte_bpe_50k", folder: str | None = None) -> None:
        import re

        import public_tokenizers
        import regex

        self.ranks = load_ranks(os.path.join(folder or tokenizer_dir(), f"{name}.tiktoken"))
        self.chunks = _Chunks(self.ranks, regex.compile(public_tokenizers.PATTERN))
        self.cut = re.compile(r"\s*\S+|\s+").findall
        self.odd = re.compile("[\x1c-\x1f]").search

    def parts(self, text: str) -> Iterator[tuple[int, ...]]:
        if self.odd(text):
            return iter([self.chunks.__missing__(text)])
        return map(self.chunks.__getitem__, self.cut(text))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.parts(text))) if text else 0


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, folder: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (name, folder)
    if key not in _encoders:
        _encoders[key] = Encoder(name, folder)
    return _encoders[key]


def one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` without repeated keys; the rows are shuffled only if a key does repeat."""
    twice = df.groupBy(key).count().where("count > 1").limit(1).count()
    return df.dropDuplicates([key]) if twice else df


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>) of each row; null and empty texts give an empty list. Other columns are ignored."""
    folder = folder or tokenizer_dir()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            lists = [list(chain.from_iterable(enc.parts(t))) if t else [] for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    src = spread(docs.select(F.col(key), F.col(text)))
    return src.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, n_tokens INT); null and empty texts count 0."""
    folder = folder or tokenizer_dir()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            n = pa.array([enc.count(t) for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=[key, "n_tokens"])

    src = spread(docs.select(F.col(key), F.col(text)))
    return src.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens int")
