"""Substring dedup (operator 6): suffix automata over shards of the repeated passages.

Every window of `window` words is owned by its minimizer, the least hash of the
shorter word sequences in it, so equal windows are owned by equal minimizers.
Consecutive windows with one owner form a stretch; a minimizer and its stretches
are a reference shard.  Minimizers are counted in a pass of their own, and a stretch
whose minimizer occurs nowhere else is left out there and then.  Stretches of equal
content are summed; each shard's suffix automaton is built of its contents, they are
streamed through it, and the matching statistics tell which windows occur more than once.

A shard of over `limit` contents is dealt again before it reaches a task, window by window:
by the first `gram` words of each, and where that is still too many by the last `gram` as well.
Equal windows agree in both, so no repeat is lost; and as the two cover a window, a shard
then holds a single content.

Shards are dealt by minimizer rather than broadcast: the repeated passages of a
corpus grow with it, and broadcasting them in bounded parts would stream all
documents once for each part (README has the figures).

Edge cases: a null or empty text has no words; texts are taken whole; repeated
rows are occurrences of their own, so their windows are repeated; rows with one id, or none,
and different texts are told apart by 128 bits; under `window` words nothing is removed; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, boundaries, cut, discard, is_empty, join_of_keys, named, row_key, runs
from tidemark.llm.kernels import Piece, gram_hashes, mix64, pieces

WINDOW, GRAM = 35, 18
#: Contents of a shard whose automaton is built in one task at most.
LIMIT = 512
_NONE = ~np.uint64(0)


def stretches(piece: Piece, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Word hashes of a piece and, per stretch: minimizer, content hash, first word and
    number of windows.  gram must be over half of window, so that a mask of a
    stretch's windows fits into a long."""
    words = piece.word_hashes() if len(piece.starts) else np.zeros(0, np.uint64)
    none = np.zeros(0, dtype=np.int64)
    at = np.arange(max(len(words) - window + 1, 0))
    if len(at):
        at = at[at + window <= np.repeat(piece.row_words[1:], np.diff(piece.row_words))[: len(at)]]
    if not len(at):
        return words, none.view(np.uint64), none.view(np.uint64), none, none
    hashes, where = gram_hashes(words, piece.row_words, gram)
    grams = np.full(len(words), _NONE)
    grams[where] = hashes
    owner = at + np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)[at].argmin(axis=1)
    begin = boundaries([owner])
    count = np.diff(np.append(begin, len(owner)))
    first = at[begin]
    content = _sequence_hashes(words, first, first + count + window - 1)
    return words, grams[owner[begin]], content, first, count


def _sequence_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each word sequence words[first:last]."""
    base = 0xD6E8FEB86659FD93
    up = np.cumprod(np.full(len(words) + 1, base, dtype=np.uint64)) * np.uint64(pow(base, -1, 1 << 64))
    down = np.cumprod(np.full(len(words) + 1, pow(base, -1, 1 << 64), dtype=np.uint64)) * np.uint64(base)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1])])
    return mix64((run[last] - run[first]) * down[first] + (last - first).astype(np.uint64))


class SuffixAutomaton:
    """Of several sequences, with the number of places where each state's strings end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends = [0]

    def _split(self, p: int, q: int, c) -> int:
        """A copy of state q for the strings that p's extension by c reaches."""
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.ends.append(0)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, c) -> int:
        q = self.next[p].get(c)
        if q is not None:  # another sequence went this way before
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[p] + 1)
        self.link.append(0)
        self.ends.append(0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def add(self, sequence, weight: int) -> None:
        state = 0
        for c in sequence:
            state = self._extend(state, c)
            self.ends[state] += weight

    def count(self) -> None:
        """Sum the ends along suffix links; once, when all sequences are added."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] += self.ends[state]

    def repeated(self, sequence, window: int) -> int:
        """Bit i is set if the window of the sequence from i on ends at two places or more."""
        mask = state = matched = 0
        for i, c in enumerate(sequence):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                matched += 1
            if matched >= window:
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                matched = min(matched, self.length[state])
                if self.ends[state] > 1:
                    mask |= 1 << (i - window + 1)
        return mask


def _match(window: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(mh, content, weight, mask) of each content: the windows that its shard's automaton
        has at two places or more."""
        for table, _ in runs(batches, ["mh"], 1 << 62):  # shards have been dealt to the limit
            mh, weights = table.column("mh").to_numpy(), table.column("weight").to_numpy()
            column = table.column("words").combine_chunks()
            values, at = column.values.to_numpy(), column.offsets.to_numpy()
            starts = boundaries([mh])
            masks = np.zeros(len(mh), dtype=np.int64)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(mh)], strict=True):
                own = [values[at[i] : at[i + 1]].tolist() for i in range(a, b)]
                automaton = SuffixAutomaton()
                for sequence, weight in zip(own, weights[a:b].tolist(), strict=True):
                    automaton.add(sequence, min(weight, 2))
                automaton.count()
                masks[a:b] = [automaton.repeated(sequence, window) for sequence in own]
            some = np.flatnonzero(masks)
            columns = [table.column(k).combine_chunks().take(pa.array(some)) for k in ("mh", "content", "weight")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(masks[some])], ["mh", "content", "weight", "mask"])

    return match


def _deal(window: int, gram: int, end: bool):
    """The windows of contents, each a content of its own, by their first or last words."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("words")
            words, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy().astype(np.int64)
            hashes, where = gram_hashes(words, at, gram)
            grams = np.zeros(len(words), np.uint64)
            grams[where] = hashes
            count = np.diff(at) - window + 1
            row = np.repeat(np.arange(batch.num_rows), count)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = at[row] + offset
            mh, of, weight = (batch.column(k).to_numpy()[row] for k in ("mh", "content", "weight"))
            key = mix64(mh.view(np.uint64) ^ mix64(grams[first + (window - gram if end else 0)] + np.uint64(1 + end)))
            content = _sequence_hashes(words, first, first + window)
            spread = words[(first[:, None] + np.arange(window)[None, :]).reshape(-1)].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * window), pa.array(spread))
            columns = [key.view(np.int64), content.view(np.int64), weight, lists, mh, of, offset.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mh", "content", "weight", "words", "of_mh", "of_content", "offset"])

    return deal


def _sized(contents: DataFrame) -> DataFrame:
    """contents with often, the number of those in their shard."""
    sizes = cut(contents.groupBy("mh").agg(F.count("*").alias("often")))
    sized = cut(join_of_keys(contents, sizes, ["mh"], "often"))
    discard(sizes)
    return sized


def _marks(contents: DataFrame, window: int, gram: int, limit: int) -> DataFrame:
    """mh, content, weight and mask of the contents (mh, content, weight, often, words;
    distinct) that have repeated windows."""
    settled, dealt, used = [], [], []
    for level in range(3):
        large = F.col("often") > limit if level < 2 else F.lit(False)
        ready = contents.where(~large).select("mh", "content", "weight", "words").repartition("mh").sortWithinPartitions("mh", "content")
        settled.append(cut(arrow_map(ready, _match(window), "mh bigint, content bigint, weight bigint, mask bigint")))
        open_ = contents.where(large)
        if level == 2 or is_empty(open_):
            break
        schema = "mh bigint, content bigint, weight bigint, words array<bigint>, of_mh bigint, of_content bigint, offset int"
        dealt.append(cut(arrow_map(open_.select("mh", "content", "weight", "words"), _deal(window, gram, level == 1), schema)))
        contents = cut(dealt[-1].groupBy("mh", "content").agg(F.sum("weight").alias("weight"), F.any_value("words").alias("words")))
        used.append(contents)
        if level == 0:
            contents = _sized(contents)
            used.append(contents)
    marks = settled[-1]
    for level in range(len(dealt) - 1, -1, -1):  # what windows have, the contents they come from have
        parts = dealt[level].select("mh", "content", F.col("weight").alias("of_weight"), "of_mh", "of_content", "offset")
        found = join_of_keys(parts, marks, ["mh", "content"], "weight").groupBy("of_mh", "of_content").agg(F.max("of_weight").alias("weight"), F.bit_or(F.expr("shiftleft(mask, offset)")).alias("mask"))
        marks = cut(settled[level].unionByName(found.withColumnsRenamed({"of_mh": "mh", "of_content": "content"})))
    discard(*used, *dealt)
    return marks


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs with what tells them apart: equal rows get equal spans."""
    return docs.select(*row_key(id_col, text_col), named(id_col).alias("doc_id"), named(text_col).alias("text"))


def repeated_spans(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """k1, k2 and marks (array of (first word, mask of the windows from there that are
    repeated)) of the documents that have repeated windows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(2)):
                _, mh, content, first, count = stretches(piece, window, gram)
                row = np.searchsorted(piece.row_words, first, side="right") - 1
                of = pa.array(row + piece.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), pa.array(mh.view(np.int64)), pa.array(content.view(np.int64)), pa.array((first - piece.row_words[row]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["k1", "k2", "mh", "content", "first", "windows"],
                )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of the stretches that a document stands for."""
        for batch in batches:
            wanted = batch.column(1)
            rows = np.flatnonzero(wanted.is_valid().to_numpy(zero_copy_only=False))
            if not len(rows):
                continue
            lists = wanted.take(pa.array(rows)).to_pylist()
            texts = batch.column(0).take(pa.array(rows))
            for piece in pieces(texts):
                words = piece.word_hashes().view(np.int64) if len(piece.starts) else np.zeros(0, np.int64)
                own = [(x, piece.row_words[r]) for r in range(piece.rows) for x in lists[piece.first + r]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([x[k] for x, _ in own], pa.int64()) for k in ("mh", "content", "weight", "often")),
                        pa.array([words[b + x["first"] : b + x["first"] + x["windows"] + window - 1] for x, b in own], pa.list_(pa.int64())),
                    ],
                    ["mh", "content", "weight", "often", "words"],
                )

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(0)):
                mh, often = np.unique(stretches(piece, window, gram)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(mh.view(np.int64)), pa.array(often)], ["mh", "often"])

    # most stretches are alone with their minimizer: only the others are written down
    shared = cut(arrow_map(keyed.select("text"), minimizers, "mh bigint, often bigint").groupBy("mh").agg(F.sum("often").alias("often")).where("often > 1").select("mh"))
    found = arrow_map(keyed.select("k1", "k2", "text"), find, "k1 bigint, k2 bigint, mh bigint, content bigint, first int, windows int")
    places = cut(found.join(shared, "mh", "left_semi"))
    discard(shared)
    heads = cut(places.groupBy("mh", "content").agg(F.count("*").alias("weight"), F.min(F.struct("k1", "k2", "first", "windows")).alias("at")))
    sized = _sized(heads)
    discard(heads)
    wanted = sized.select("mh", "content", "weight", "often", "at.*").groupBy("k1", "k2").agg(F.collect_list(F.struct("mh", "content", "weight", "often", "first", "windows")).alias("wanted"))
    texts = keyed.select("k1", "k2", "text").join(wanted, ["k1", "k2"], "left").select("text", "wanted")
    # rows equal in id and text give the same contents
    contents = cut(arrow_map(texts, fetch, "mh bigint, content bigint, weight bigint, often bigint, words array<bigint>").dropDuplicates(["mh", "content"]))
    discard(sized)
    marks = _marks(contents, window, gram, limit)
    discard(contents)
    spans = cut(join_of_keys(places, marks, ["mh", "content"], "weight").groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "mask")).alias("marks")))
    discard(places, marks)
    return spans


def covered(marks: list[dict], n: int, window: int) -> np.ndarray:
    """Which of n words lie in a marked window."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for m in marks:
        mask, i = m["mask"], m["first"]
        while mask:
            if mask & 1:
                edge[i] += 1
                edge[i + window] -= 1
            mask >>= 1
            i += 1
    return np.cumsum(edge)[:n] > 0


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with keep_text, kept: the words that no
    repeated window covers, joined by single spaces."""
    if not window / 2 < gram <= window <= 64:
        raise ValueError("gram must be over half of window, and window 64 at most")
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed, window, gram, limit)

    def cleanse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            counts, removed, digests, kept = [], [], [], []
            for text, marks in zip(texts, batch.column(2).to_pylist(), strict=True):
                words = text.split()  # on bytes: at 0x20 and 0x09-0x0D
                counts.append(len(words))
                if marks:
                    out = covered(marks, len(words), window)
                    words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                removed.append(counts[-1] - len(words))
                joined = b" ".join(words)
                digests.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    kept.append(joined.decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string())][: 5 if keep_text else 4], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 5 if keep_text else 4])

    joined = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "marks")
    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    return arrow_map(joined, cleanse, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep_text)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
