"""Byte-level BPE encoding and decoding (operator 9), with the tokenizers library.

Texts arrive as Arrow batches.  A pre-token of the pattern begins at a space or
after one, so a text taken apart before single spaces has the same pre-tokens;
the library encodes each distinct piece of a batch once, and its ids are kept in a
bounded table.  Where white-space characters meet, the text is not taken apart.  Decoding reverses the byte-to-character table: ids
give bytes, and characters that ids split come together again when joined.

Edge cases: a null or empty text has no ids and decodes to no bytes; strings of
special tokens are ordinary text; texts are taken whole; each of repeated rows is encoded;
an empty table gives an empty result.  Columns of the input other than the id and the text
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import arrow_map
from tidemark.llm.token_counts import byte_characters, read_vocabulary

#: Entries of the table of encoded pieces that a Python worker keeps between groups, and the longest piece kept.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 64
#: Pieces that go to the library at once.
LEARN_PIECES = 2048
#: Texts are encoded this many characters at a time.
GROUP_CHARS = 2 << 20


#: A text without this has no space to look at twice.
_MEET = re.compile(r"\s\s|^\s|\s\Z|^\Z")


class ByteBpe:
    """Encoder and decoder for a vocabulary file and the rank file it must agree with."""

    def __init__(self, vocabulary: bytes, ranks: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.tokenizer.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        ids = self.tokenizer.get_vocab(with_added_tokens=False)
        self.id_bytes: list[bytes] = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.id_bytes[i] = bytes(byte_of[c] for c in token)
        for line in ranks.splitlines():
            token, rank = line.split()
            if self.id_bytes[int(rank)] != base64.b64decode(token):
                raise ValueError(f"rank {int(rank)} of the rank file is another token than in the vocabulary")
        self.pieces: dict[str, bytes] = {}

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of pieces, packed as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        for first in range(0, len(missing), LEARN_PIECES):  # the library's encodings are large
            some = missing[first : first + LEARN_PIECES]
            encoded = self.tokenizer.encode_batch(some, add_special_tokens=False)
            out.update((p, np.array(e.ids, dtype="<u4").tobytes()) for p, e in zip(some, encoded, strict=True))
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        """Pieces whose pre-tokens are those of the text: cut before each space that stands
        between two characters that are no white space."""
        parts = text.split(" ")
        if not _MEET.search(text):
            pieces = list(map(" ".__add__, parts))
            pieces[0] = parts[0]
            return pieces
        pieces, open_ = [], [parts[0]]
        end = parts[0][-1:]
        for p in parts[1:]:
            if p and end and not p[0].isspace() and not end.isspace():
                pieces.append(" ".join(open_))
                open_ = ["", p]
            else:
                open_.append(p)
            end = p[-1:]
        pieces.append(" ".join(open_))
        return pieces if pieces[0] else pieces[1:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[bytes] = []
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self.split(text))
            size += len(text)
            if size >= GROUP_CHARS:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, group: list[list[str]]) -> list[bytes]:
        known = self.pieces
        missing = list({p for pieces in group for p in pieces if p not in known})
        known.update(self._learn(missing))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in group]
        for p in missing:
            if len(p) > CACHE_CHARS:
                del known[p]
        if len(known) > CACHE_ENTRIES:
            known.clear()
        return out

    def offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids of one text and the code points that each covers; ids that split a
        character both cover it."""
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        return encoding.ids, encoding.offsets

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids, by the reversed byte table."""
        return b"".join(map(self.id_bytes.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def bpe_for(paths: tuple[str, str], vocabulary: bytes, ranks: bytes) -> ByteBpe:
    if paths not in _LOADED:
        _LOADED[paths] = ByteBpe(vocabulary, ranks)
    return _LOADED[paths]


def _shared(spark: SparkSession, path: str, rank_path: str):
    return spark.sparkContext.broadcast((read_vocabulary(path), read_vocabulary(rank_path)))


def bpe_encode(docs: DataFrame, path: str, rank_path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Per row: its id and packed ids (binary, little-endian unsigned 32-bit); with
    offsets also starts and ends, the code points of each id."""
    shared, paths = _shared(docs.sparkSession, path, rank_path), (path, rank_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_for(paths, *shared.value)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            columns = [batch.column(0), pa.array(bpe.encode(texts), pa.binary())]
            names = ["doc_id", "ids"]
            if offsets:
                spans = [bpe.offsets(t)[1] for t in texts]
                for k, name in enumerate(("starts", "ends")):
                    columns.append(pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())))
                    names.append(name)
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, ids binary" + ", starts array<int>, ends array<int>" * offsets
    return arrow_map(docs.select(id_col, text_col), encode, schema)


def bpe_decode(encoded: DataFrame, path: str, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: its id, the packed ids and the bytes they decode to."""
    shared, paths = _shared(encoded.sparkSession, path, rank_path), (path, rank_path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_for(paths, *shared.value)
        for batch in batches:
            ids = batch.column(1).fill_null(b"")
            decoded = pa.array(map(bpe.decode, ids.to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], ["doc_id", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return arrow_map(encoded.select(id_col, ids_col), decode, f"doc_id {kind}, ids binary, decoded binary")


def bpe_pairs(docs: DataFrame, path: str, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass: doc_id, n_tokens, ids (packed), ids_sha256 and
    decoded_sha256, and whether the decoded bytes are the text's."""
    shared, paths = _shared(docs.sparkSession, path, rank_path), (path, rank_path)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_for(paths, *shared.value)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            encoded = bpe.encode(texts)
            decoded = [bpe.decode(x) for x in encoded]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in encoded], pa.int64()),
                    pa.array(encoded, pa.binary()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                    pa.array([x == t.encode() for x, t in zip(decoded, texts, strict=True)], pa.bool_()),
                ],
                ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "decodes"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), both, f"doc_id {kind}, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string, decodes boolean")


def bpe_digests(docs: DataFrame, path: str, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass: doc_id, n_tokens, ids_sha256 and
    decoded_sha256, for stores that keep the texts elsewhere."""
    shared, paths = _shared(docs.sparkSession, path, rank_path), (path, rank_path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_for(paths, *shared.value)
        for batch in batches:
            encoded = bpe.encode(batch.column(1).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in encoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), digest, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary_paths())
