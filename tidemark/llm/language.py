"""Language identification (operator 7): script ranges, word scores, Viterbi spans.

Learning counts, over all labelled training texts, hashed byte n-grams of words and
the scripts of their first letters, per language.  A word's score for a language is
the log-likelihood of its n-grams; languages that hardly use the word's script are
no candidates for it.  Viterbi with a penalty for each switch labels every word,
so mixed texts fall into spans; a text's language is the one with most letters.

The distinct words of a piece of a batch are scored once, and the Viterbi steps of
all its texts are taken together.  The model is a table of a fixed number of cells that the
languages share, so what is broadcast has a bound.

Edge cases: a null text, or one without a letter, is `und` with score 0; so is every
text when there is nothing to learn from; texts are read whole; ties go to the
language first by code point; each of repeated rows is learnt from and labelled; in the query a row without an id is never held out;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tidemark.llm.common import arrow_map, cut, discard, named, shuffles_end
from tidemark.llm.kernels import Piece, mix64, pieces

BUCKETS = 1 << 15
SIZES = (1, 2, 3, 4)
#: Cells of a model's table: beyond 256 languages each has fewer buckets.
CELLS = 1 << 23
#: Bytes of text whose distinct words are scored together.
SCORED_BYTES = 1 << 20
#: Log-likelihood that a change of language between two words costs.
SWITCH = 12.0
#: A language is a candidate for a script that so many of its words begin in.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: First code points of ranges, and their scripts; 0 is for what belongs to no range.
_SCRIPTS = [
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00C0, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3),
    (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 0), (0x0B80, 9), (0x0C00, 0),
    (0x0E00, 10), (0x0E80, 0), (0x10A0, 11), (0x1100, 12), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0),
    (0x3040, 13), (0x3100, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0x20000, 14),
]
_SCRIPT_FROM = np.array([s[0] for s in _SCRIPTS])
_SCRIPT_OF = np.array([s[1] for s in _SCRIPTS])
N_SCRIPTS = 15
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[ord("a") : ord("z") + 1] = _ASCII_LETTER[ord("A") : ord("Z") + 1] = True
_ANY_LETTER = regex.compile(r"\p{L}")


class Words(NamedTuple):
    """The distinct words of a piece: number of each word's distinct one, its letter
    bytes, its script, and n-gram buckets with the distinct word that each is of."""

    which: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    buckets: np.ndarray
    owner: np.ndarray


def _code_points(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that begin at `at`."""
    padded = np.concatenate([b, np.zeros(4, np.uint8)]).astype(np.int64)
    b0, b1, b2, b3 = (padded[at + k] for k in range(4))
    two = (b0 & 0x1F) << 6 | b1 & 0x3F
    three = (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F
    four = (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F
    return np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four)))


def distinct_words(piece: Piece) -> Words:
    if not len(piece.starts):
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, none, none)
    _, first, which = np.unique(piece.word_hashes(), return_index=True, return_inverse=True)
    starts, sizes = piece.starts[first], (piece.ends - piece.starts)[first]
    n = len(first)
    word = np.repeat(np.arange(n), sizes)
    at = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    raw = _LOWER[piece.data[at]]
    keep = _LETTER[raw]
    raw, word = raw[keep], word[keep]
    letters = np.bincount(word, minlength=n)
    # letters between marks: 1 before and 2 after each word
    padded_size = letters + 2
    begin = np.cumsum(padded_size) - padded_size
    text = np.empty(int(padded_size.sum()), dtype=np.uint8)
    owner = np.repeat(np.arange(n), padded_size)
    text[begin], text[begin + padded_size - 1] = 1, 2
    inner = np.ones(len(text), dtype=bool)
    inner[begin] = inner[begin + padded_size - 1] = False
    text[inner] = raw
    script = np.zeros(n, dtype=np.int64)
    has = letters > 0
    head = begin[has] + 1
    script[has] = _SCRIPT_OF[np.searchsorted(_SCRIPT_FROM, _code_points(text, head), side="right") - 1]
    buckets, owners = [], []
    gram = np.zeros(len(text), dtype=np.uint64)
    for size in SIZES:
        m = len(text) - size + 1
        if m <= 0:
            break
        gram = gram[:m] << np.uint64(8) | text[size - 1 :]
        whole = (owner[:m] == owner[size - 1 :]) & has[owner[:m]]
        buckets.append((mix64(gram[whole] + np.uint64(size << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(owner[:m][whole])
    return Words(which, letters, script, np.concatenate(buckets), np.concatenate(owners))


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # [buckets, languages] log-likelihoods; buckets is a power of two
    allowed: np.ndarray  # [N_SCRIPTS, languages]


def learn(train: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Counts over all rows of train whose lang isn't null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "feature", "n"])
            counts.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for piece in pieces(batch.column(1), SCORED_BYTES):
                words = distinct_words(piece)
                if not len(words.which):
                    continue
                row = piece.word_rows()
                mine = langs[piece.first : piece.first + piece.rows]
                for lang in set(mine):
                    on = (mine == lang)[row]
                    often = np.bincount(words.which[on], minlength=len(words.letters)).astype(np.float64)
                    own = counts.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, dtype=np.int64))
                    own[:BUCKETS] += np.bincount(words.buckets, often[words.owner], BUCKETS).astype(np.int64)
                    has = words.letters > 0
                    own[BUCKETS:] += np.bincount(words.script[has], often[has], N_SCRIPTS).astype(np.int64)
            if len(counts) > 64:
                yield from rows()
        yield from rows()

    labelled = train.where(F.col(lang_col).isNotNull()).select(lang_col, text_col)
    summed = cut(arrow_map(labelled, count, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")))
    with shuffles_end(train.sparkSession):
        languages = sorted((r.lang for r in summed.select("lang").distinct().collect()), key=lambda s: s.encode("utf-32-be"))
    size = BUCKETS
    while size > 1 and size * len(languages) > CELLS:
        size >>= 1
    folded = F.when(F.col("feature") < BUCKETS, F.col("feature") % size).otherwise(F.col("feature") - BUCKETS + size).alias("feature")
    table = summed.groupBy("lang", folded).agg(F.sum("n").alias("n")).toArrow()  # CELLS counts at most, but for scripts
    discard(summed)
    counts = np.zeros((size + N_SCRIPTS, len(languages)))
    if languages:
        index = {s: i for i, s in enumerate(languages)}
        counts[table.column("feature").to_numpy(), np.array([index[s] for s in table.column("lang").to_pylist()])] = table.column("n").to_numpy()
    grams, scripts = counts[:size] + 0.5, counts[size:]
    scores = np.log(grams / grams.sum(axis=0)).astype(np.float32)
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    allowed = share >= SCRIPT_SHARE
    allowed[~allowed.any(axis=1)] = True  # a script that nobody uses leaves all of them
    return Model(languages, scores, allowed)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """[distinct words, languages]; words without a letter say nothing."""
    n, k = len(words.letters), len(model.languages)
    out = np.empty((n, k), dtype=np.float32)
    buckets = words.buckets & (len(model.scores) - 1)
    for j in range(k):
        out[:, j] = np.bincount(words.owner, model.scores[buckets, j], n)
    out /= len(SIZES)  # n-grams of several sizes tell the same letters again
    out -= out.max(axis=1, keepdims=True)
    out[~model.allowed[words.script] & (words.letters > 0)[:, None]] -= 1000.0
    out[words.letters == 0] = 0.0
    return out


def viterbi(scores: np.ndarray, row_words: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of each word: one step for the n-th words of all rows."""
    sizes = np.diff(row_words)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    begin, sizes = row_words[order], sizes[order]
    kind = np.int16 if scores.shape[1] < 1 << 15 else np.int32
    labels = np.zeros(len(scores), dtype=kind)
    if not len(order):
        return labels
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # rows with over t words
    total = scores[begin].copy()
    came = np.empty(scores.shape, dtype=kind)
    own = np.arange(scores.shape[1], dtype=kind)
    for t in range(1, int(sizes[0])):
        d = active[t]
        v = total[:d]
        best = v.argmax(axis=1)
        top = v[np.arange(d), best] - penalty
        stay = v >= top[:, None]
        at = begin[:d] + t
        came[at] = np.where(stay, own, best[:, None])
        total[:d] = np.where(stay, v, top[:, None]) + scores[at]
    label = total.argmax(axis=1).astype(kind)
    for t in range(int(sizes[0]) - 1, -1, -1):
        d = active[t]
        at = begin[:d] + t
        labels[at] = label[:d]
        if t:
            label[:d] = came[at, label[:d]]
    return labels


def _has_letter(piece: Piece) -> np.ndarray:
    ascii_letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[piece.data])])
    has = np.diff(ascii_letters[piece.row_bytes]) > 0
    for i in np.flatnonzero(~has):
        raw = piece.data[piece.row_bytes[i] : piece.row_bytes[i + 1]]
        if (raw >= 0x80).any():
            has[i] = _ANY_LETTER.search(raw.tobytes().decode()) is not None
    return has


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (the share of letters in spans of that language); with spans
    also an array of (lang, first word, words) that covers the words of the text.  Columns
    of docs named in keep come along as keep_<name>."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [named(c).alias(f"keep_{c}") for c in keep]
    schema = StructType([*docs.select(named(id_col).alias("doc_id")).schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    if spans:
        span = StructType([StructField("lang", StringType()), StructField("first_word", IntegerType()), StructField("words", IntegerType())])
        schema.add("spans", ArrayType(span))
    schema = StructType([*schema, *docs.select(*kept).schema])
    names_out = ["doc_id", "lang_pred", "score", *["spans"] * spans, *(f"keep_{c}" for c in keep)]
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        k = len(model.languages)
        for batch in batches:
            for piece in pieces(batch.column(1), SCORED_BYTES):
                words = distinct_words(piece)
                chosen, score = np.full(piece.rows, k), np.zeros(piece.rows)
                found: list[list[dict]] = [[] for _ in range(piece.rows)]
                if k and len(words.which):
                    labels = viterbi(word_scores(words, model)[words.which], piece.row_words)
                    row = piece.word_rows()
                    letters = words.letters[words.which]
                    by = np.bincount(row * k + labels, letters, piece.rows * k).reshape(piece.rows, k)
                    sums = by.sum(axis=1)
                    known = (sums > 0) & _has_letter(piece)
                    chosen[known] = by[known].argmax(axis=1)
                    score[known] = by[known].max(axis=1) / sums[known]
                    if spans:
                        new = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])))
                        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(labels)], strict=True):
                            found[row[a]].append({"lang": names[labels[a]], "first_word": int(a - piece.row_words[row[a]]), "words": b - a})
                columns = [batch.column(0).slice(piece.first, piece.rows), pa.array(names[chosen], pa.string()), pa.array(score)]
                if spans:
                    columns.append(pa.array(found, span_type))
                columns += [batch.column(2 + i).slice(piece.first, piece.rows) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns, names_out)

    return arrow_map(docs.select(named(id_col), named(text_col), *kept), label, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
