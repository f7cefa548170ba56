"""Token counts (operator 4): byte-pair merging with a heap and a linked list.

For each distinct white-space-delimited chunk the merges are played through: a
heap gives the lowest-ranked adjacent pair (the leftmost of equals), a linked list
joins it, and the count is the initial symbols minus the merges; no identifiers
are made.  Counts per chunk are kept in a bounded table, as chunks repeat.

Edge cases: a null or empty text has no bytes and no tokens; a special string in
a text counts one token, the library's default; texts are taken whole; each of repeated rows
is counted; an empty table gives an empty result.  Columns of the input other than the id and
the text are not read.  Chunks with characters newer than Python's Unicode tables are counted by
the library itself.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import arrow_map

#: Entries of each of the two tables of counts that a Python worker keeps.
CACHE_ENTRIES = 250_000
#: Characters of the longest chunk or word that is kept there.
CACHE_CHARS = 64
#: Vocabulary files over this size are not broadcast.
MAX_VOCABULARY_BYTES = 64 << 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + n)
            n += 1
    return [table[b] for b in range(256)]


class _Table(dict):
    """A dict that makes missing values and starts anew when it is full."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        if len(key) > CACHE_CHARS:
            return self.make(key)
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.make(key)
        return value


def count_merges(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many merges the rank table makes in a word of these symbols."""
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = (symbols[i], symbols[i + 1])
        if (found := ranks.get(pair)) is not None:
            heap.append((found[0], i, found[1], pair))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, made, pair = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != pair[0] or symbols[j] != pair[1]:
            continue  # one of the two went into another merge
        symbols[i], symbols[j] = made, -1
        after[i] = k = after[j]
        merges += 1
        if k < n:
            before[k] = i
            pair = (made, symbols[k])
            if (found := ranks.get(pair)) is not None:
                heapq.heappush(heap, (found[0], i, found[1], pair))
        if (h := before[i]) >= 0:
            pair = (symbols[h], made)
            if (found := ranks.get(pair)) is not None:
                heapq.heappush(heap, (found[0], h, found[1], pair))
    return merges


class TokenCounter:
    """Counts for one vocabulary file of the tokenizers library: a BPE model with word
    ends, whose pre-tokens never hold white space."""

    def __init__(self, vocabulary: bytes, entries: int = CACHE_ENTRIES):
        self.vocabulary, self.library = vocabulary, None
        spec = json.loads(vocabulary)
        model = spec["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = byte_characters()
        self.inner = [ids[c] for c in chars]
        self.last = [ids[c + suffix] for c in chars]
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            joined = a + b  # only the last symbol of a word carries the suffix
            self.ranks[ids[a], ids[b]] = (rank, ids[joined])
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.split_specials = regex.compile("|".join(map(regex.escape, self.specials)))
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.by_word = _Table(self._count_word, entries)
        self.by_chunk = _Table(self._count_chunk, entries)

    def _count_word(self, word: str) -> int:
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return len(symbols) - count_merges(symbols, self.ranks) if len(symbols) > 1 else 1

    def _count_chunk(self, chunk: str) -> int:
        """chunk: text without special strings, taken apart at white space or whole."""
        if not chunk.isascii():
            if any(unicodedata.category(c) == "Cn" for c in chunk):
                return self._library_count(chunk)
            # each character is lowered by itself: no final sigma
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return sum(map(self.by_word.__getitem__, self.words.findall(chunk.lower())))

    def _library_count(self, chunk: str) -> int:
        """For characters that are newer than Python's Unicode tables: which of them are
        letters, the library knows by tables of its own version."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.vocabulary.decode())
        return len(self.library.encode(chunk, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        n = 0
        parts = [text]
        if any(s in text for s in self.specials):
            parts = self.split_specials.split(text)
            n = len(parts) - 1
        for part in parts:
            # str.split() also cuts at the separators 0x1c-0x1f, which are no white space here
            if any(c in part for c in "\x1c\x1d\x1e\x1f"):
                n += self._count_chunk(part)
            else:
                n += sum(map(self.by_chunk.__getitem__, part.split()))
        return n


_COUNTERS: dict[str, TokenCounter] = {}


def counter_for(path: str, vocabulary: bytes) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(vocabulary)
    return _COUNTERS[path]


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file, read on the driver to be broadcast; its size is checked."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {MAX_VOCABULARY_BYTES} bytes; a vocabulary that is broadcast must be smaller")
    return content


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, n_bytes, n_tokens and over_limit (more tokens than limit).

    One pass without a shuffle; the vocabulary is broadcast behind a check of its size.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(path, shared.value)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            counts = pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, counts, pc.greater(counts, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
