"""Line dedup (operator 1): an exact set-similarity join of lines.

A line is the set of its words; lines with equal sets are one class.  Words are
ordered by rarity (counts over the whole corpus in a table of fixed size, then by
hash), and two sets with a Jaccard similarity of at least `NUM / DEN` share a word of
their prefixes.  Under each prefix word the classes meet; length, position and
parity-bitmap bounds drop pairs that can't be similar.  What is left of a word's
classes is written as a spanning forest, not as pairs; connected classes form a
group, whose lines are fetched once and compared exactly.  Similar pairs are
counted in the tasks, never written.  Words and groups with very many classes are
dealt in block pairs, so no task holds more than two blocks.

A line that its task has met before brings no prefix, so a hot line has as many postings as
tasks at most, not as many as it has copies.  Every table goes as soon as what is made of it has been written.

A line is removed if an earlier line, by (doc_id, line number), has an equal or a
similar set; both are judged on the input.

Edge cases: lines without words are kept and match nothing; a null text is kept as
null and has no lines; texts are read whole; rows equal in id and text are one document,
kept or cut alike; rows with one id, or none, and different texts are told apart by 128 bits;
a null id comes first in order (ids are integers); an empty table gives an empty result; other
columns of the input are read only where they are to be kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import arrow_map, boundaries, cut, discard, is_empty, join_of_keys, named, row_key, runs
from tidemark.llm.components import components
from tidemark.llm.kernels import Piece, mix64, pieces
from tidemark.llm.similar import MOST, block_count, in_block_pairs, similar_pairs
from tidemark.llm.simhash import forest

NUM, DEN = 4, 5
#: Cells of the table of word counts; more words than cells share them.
CELL_BITS = 20
#: Classes under one word whose bounds are looked at in one task at most.
LIMIT = 4096
NO_ID = -(1 << 63)
#: A count's rank is its binary logarithm times this: 21 bits hold it, however often a word occurs.
_RANK = 1 << 15
_BLOCK_CELLS = 1 << 14
#: Sizes and places are packed into 16 bits; lines of so many words or more aren't bounded.
_LONGEST = (1 << 16) - 1
#: Bytes of a piece whose words are counted, and of one that is split into lines: the C library keeps
#: arrays of that size for the next piece instead of asking the system for their pages again.
COUNTED_BYTES, SPLIT_BYTES = 1 << 16, 1 << 17
#: Classes that a task remembers, to leave out the prefixes of their copies.
_REMEMBERED = 1 << 18
#: Lines of a piece whose numbers fit a sort key beside a word's rank.
KEYED_LINES = 1 << 22


def _cells(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def word_rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often the words of each cell occur, as ranks: the same small table whatever the corpus.

    Tasks give blocks of counts, which are added block by block.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, dtype="<i8")
        for batch in batches:
            for piece in pieces(batch.column(0), COUNTED_BYTES):
                if len(piece.starts):
                    np.add.at(total, _cells(piece.word_hashes()), 1)
        blocks = total.astype("<i4" if total.max() < 1 << 31 else "<i8").reshape(-1, _BLOCK_CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # the blocks are of a fixed number
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(block, np.zeros(_BLOCK_CELLS, dtype=np.int64))
                sums[block] += np.frombuffer(counts, dtype="<i4" if len(counts) == 4 * _BLOCK_CELLS else "<i8")
        rows = [np.minimum(np.log2(x + 1.0) * _RANK, (1 << 21) - 1).astype("<i4").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(rows, pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    found = arrow_map(arrow_map(docs.select(named(text_col)), count, schema).repartition("block"), add, schema).collect()  # 1 << CELL_BITS counts in all
    table = np.zeros((1 << CELL_BITS) // _BLOCK_CELLS * _BLOCK_CELLS, dtype=np.int32).reshape(-1, _BLOCK_CELLS)
    for r in found:
        table[r.block] = np.frombuffer(r.counts, dtype="<i4")
    return table.reshape(-1)


def line_sets(piece: Piece, rarity: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Distinct words of the lines of a piece that have words: the words of all lines by
    (rarity, hash), where each line's begin (and the end), its row, its number in the row.
    Without rarity all words count as equally rare."""
    words = piece.word_hashes()
    row = piece.word_rows()
    breaks = np.flatnonzero(piece.data == 10)
    before = np.repeat(np.arange(len(breaks) + 1), np.diff(np.concatenate([[0], np.searchsorted(piece.starts, breaks), [len(words)]])))
    number = before - np.searchsorted(breaks, piece.row_bytes[:-1])[row]
    begin = boundaries([row, number])
    line = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(words))))
    rare = np.zeros(len(words), dtype=np.int64) if rarity is None else rarity[_cells(words)]
    middle = (words >> np.uint64(23)) & np.uint64((1 << 21) - 1)
    # lines beyond those that the key has room for are told apart by an order of their own
    many = len(begin) > KEYED_LINES
    key = rare.astype(np.uint64) << np.uint64(21) | middle
    if not many:
        key |= line.astype(np.uint64) << np.uint64(42)
    order = np.lexsort((words, key, line)) if many else np.argsort(key)
    sorted_words, sorted_key = words[order], key[order]
    if not many and ((sorted_key[1:] == sorted_key[:-1]) & (sorted_words[1:] != sorted_words[:-1])).any():
        order = np.lexsort((words, key))  # two words of a line fell together in the key
        sorted_words = words[order]
    sorted_line = line[order]
    first = boundaries([sorted_line, sorted_words])
    sorted_words, sorted_line = sorted_words[first], sorted_line[first]
    starts = np.append(boundaries([sorted_line]), len(sorted_line))
    return sorted_words, starts, row[begin], number[begin]


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (NUM * n + DEN - 1) // DEN + 1


def least_overlap(total: np.ndarray) -> np.ndarray:
    """Common words that two sets need, given the sum of their sizes."""
    return (NUM * total + NUM + DEN - 1) // (NUM + DEN)


class Remembered:
    """Classes that were met before, those in the same slot forgotten."""

    def __init__(self, slots: int):
        self.c1, self.c2, self.last = (np.zeros(slots, dtype=np.int64) for _ in range(3))
        self.c1[0] = 1  # a class of number 1 has another slot

    def fresh(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """Which of these haven't been met; of equal ones in a call one is fresh, or more where their slot is another's."""
        slot, at = c1 & (len(self.c1) - 1), np.arange(len(c1))
        met = (self.c1[slot] == c1) & (self.c2[slot] == c2)
        self.last[slot] = at
        last = self.last[slot]
        met |= (last != at) & (c1[last] == c1) & (c2[last] == c2)
        own = last == at
        self.c1[slot[own]], self.c2[slot[own]] = c1[own], c2[own]
        return ~met


def line_classes(keyed: DataFrame, rarity: np.ndarray) -> DataFrame:
    """did, k1, k2, line, c1, c2 (which tell classes apart), n (words), prefix and two words of parity bits of
    each line with words.  A prefix word is packed into a long: 32 bits of its hash, the
    line's size and its place in the line's order, both up to _LONGEST.  At least one line of each class has the prefix."""
    shared = keyed.sparkSession.sparkContext.broadcast(rarity)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = Remembered(_REMEMBERED)
        for batch in batches:
            for piece in pieces(batch.column(3), SPLIT_BYTES):
                if not len(piece.starts):
                    continue
                words, starts, row, number = line_sets(piece, shared.value)
                n = np.diff(starts)
                c1, c2 = _set_hashes(words, starts[:-1], n)
                bit, half = np.uint64(1) << (words & np.uint64(63)), words & np.uint64(64) > 0
                bits = [np.bitwise_xor.reduceat(np.where(half == k, bit, np.uint64(0)), starts[:-1]).view(np.int64) for k in (False, True)]
                size = np.where((n > 1) & before.fresh(c1, c2), prefix_length(n), 0)  # a single word has no similar set but its own
                offsets = np.concatenate([[0], np.cumsum(size)])
                at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat(starts[:-1], size)
                place = at - np.repeat(starts[:-1], size)
                packed = (words[at] >> np.uint64(32) << np.uint64(32)).view(np.int64) | np.minimum(np.repeat(n, size), _LONGEST) << 16 | np.minimum(place, _LONGEST)
                met = shared.value[_cells(words[at])] > _RANK  # a word alone in its cell occurs nowhere else
                offsets = np.concatenate([[0], np.cumsum(met)])[offsets]
                prefix = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(packed[met]))
                of = pa.array(row + piece.first)
                columns = [*(batch.column(k).take(of) for k in range(3)), pa.array(number.astype(np.int32)), pa.array(c1), pa.array(c2), pa.array(n), prefix, *map(pa.array, bits)]
                yield pa.RecordBatch.from_arrays(columns, ["did", "k1", "k2", "line", "c1", "c2", "n", "prefix", "bits1", "bits2"])

    return arrow_map(keyed.select("did", "k1", "k2", "text"), find, "did bigint, k1 bigint, k2 bigint, line int, c1 bigint, c2 bigint, n bigint, prefix array<bigint>, bits1 bigint, bits2 bigint")


def _set_hashes(words: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c1 = mix64(np.add.reduceat(words, starts) + n.astype(np.uint64))
    return c1.view(np.int64), mix64(np.add.reduceat(mix64(words), starts)).view(np.int64)


def _possible_pairs(n: np.ndarray, pos: np.ndarray, bits: list[np.ndarray], ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one run, sizes ascending, that the bounds leave."""
    at, rest = np.arange(len(n)), n - pos
    step = 1
    while True:
        at = at[at + step < ends[at]]
        at = at[n[at] * DEN >= n[at + step] * NUM]  # longer ones are further on
        if not len(at):
            return
        other = at + step
        need = least_overlap(n[at] + n[other])
        near = np.flatnonzero((rest[at] >= need) & (rest[other] >= need) | (n[other] == _LONGEST))
        if len(near):
            i, j, need = at[near], other[near], need[near]
            # each word of one set alone flips one of the 128 parities
            apart = sum(np.bitwise_count(b[i] ^ b[j]).astype(np.int64) for b in bits)
            near = ((n[i] + n[j] - apart) // 2 >= need) | (n[j] == _LONGEST)
            yield i[near], j[near]
        step += 1


def _meet(keys: list[str], limit: int):
    """Edges (a, b) that connect the classes of each word that may be similar, from rows
    sorted by keys and size; of a word over the limit, itself (token) instead."""

    def with_token(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("token", pa.array(batch.column("packed").to_numpy() >> 32))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, over in runs(with_token(batches), keys, limit):
            if over:
                token = table.column("token").to_numpy()[:1]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array(token)], ["a", "b", "token"])
                continue
            starts = boundaries([table.column(k).to_numpy() for k in keys])
            ends = np.repeat(np.append(starts[1:], table.num_rows), np.diff(np.append(starts, table.num_rows)))
            packed = table.column("packed").to_numpy()
            n, pos = packed >> 16 & _LONGEST, packed & _LONGEST
            root = np.arange(table.num_rows)
            for i, j in _possible_pairs(n, pos, [table.column(b).to_numpy().view(np.uint64) for b in ("bits1", "bits2")], ends):
                new = root[i] != root[j]
                if new.any():
                    root = forest(len(root), np.concatenate([np.arange(len(root)), i[new]]), np.concatenate([root, j[new]]))
            c1 = table.column("c1").to_numpy()
            child = np.flatnonzero(c1 != c1[root])  # a class comes again where several tasks have met it
            a, b = c1[child], c1[root[child]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.nulls(len(child), pa.int64())], ["a", "b", "token"])

    return meet


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c1, c2, links and earlier of classes: how many similar ones they have in their group,
    and whether one of them occurs before."""
    keys = ["group", "b1", "b2"]
    for table, _ in runs(batches, keys, 1 << 62):  # two blocks at most
        group, b1, b2 = (table.column(k).to_numpy() for k in keys)
        c1, c2, block = (table.column(k).to_numpy() for k in ("c1", "c2", "block"))
        column = table.column("words").combine_chunks()
        values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
        links, earlier = np.zeros(len(c1), dtype=np.int64), np.zeros(len(c1), dtype=bool)
        place = np.empty(len(c1), dtype=np.int64)
        place[np.lexsort([table.column(k).to_numpy() for k in ("k2", "k1", "line", "did")])] = np.arange(len(c1))
        starts = boundaries([group, b1, b2])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(c1)], strict=True):
            if b - a < 2:
                continue
            for i, j in similar_pairs([values[offsets[k] : offsets[k + 1]] for k in range(a, b)], NUM, DEN):
                i, j = i + a, j + a
                if b1[a] != b2[a]:
                    across = block[i] != block[j]
                    i, j = i[across], j[across]
                np.add.at(links, np.concatenate([i, j]), 1)
                earlier[np.where(place[i] > place[j], i, j)] = True
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (c1, c2, links, earlier)], ["c1", "c2", "links", "earlier"])


def candidate_groups(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """c1 and group of the classes that may be similar to another: no similar pair is split."""
    schema = "a bigint, b bigint, token bigint"
    postings = found.select(F.explode("prefix").alias("packed"), "c1", "bits1", "bits2")
    token = F.shiftright("packed", 32)
    met = postings.repartition(token).sortWithinPartitions("packed")  # by one column: Spark sorts by its digits
    joined = cut(arrow_map(met, _meet(["token"], limit), schema))
    edges = joined.where("token is null").select("a", "b")
    large = cut(joined.where("token is not null").select(F.col("token").alias("of")).distinct())
    more = None
    if not is_empty(large):
        known = cut(postings.withColumn("of", token).join(large, "of").dropDuplicates(["packed", "c1"]))
        sizes = cut(known.groupBy("of").agg(F.count("*").alias("often")))
        dealt = in_block_pairs(join_of_keys(known, sizes, ["of"], "often").withColumn("blocks", F.ceil(F.col("often") * 2 / limit).cast("int")), "c1")
        placed = dealt.repartition("of", "b1", "b2").sortWithinPartitions("of", "b1", "b2", "packed", "c1")
        more = cut(arrow_map(placed.select("packed", "c1", "bits1", "bits2", "b1", "b2"), _meet(["token", "b1", "b2"], 1 << 62), schema))
        discard(known, sizes)
        edges = edges.unionByName(more.select("a", "b"))
    tied = components(edges)
    discard(joined, large, *([more] if more is not None else []))
    return tied.select(F.col("node").alias("c1"), F.col("root").alias("group")).unionByName(tied.select(F.col("root").alias("c1"), F.col("root").alias("group")).distinct())


def similar_classes(keyed: DataFrame, classes: DataFrame, groups: DataFrame, most: int = MOST) -> DataFrame:
    """c1, c2, links, earlier of the classes that have a similar one."""
    members = cut(classes.select("c1", "c2", "at", "n").join(groups.hint("shuffle_hash"), "c1"))
    sizes = cut(members.groupBy("group").agg(F.count("*").alias("often"), block_count(F.count("*"), F.sum("n"), most).alias("blocks")))
    dealt = join_of_keys(members, sizes, ["group"], "often").select("group", "blocks", "c1", "c2", "at.*")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of the lines that candidates stand for."""
        names = ["group", "blocks", "c1", "c2", "did", "line", "k1", "k2"]
        types = [pa.int32() if k in ("blocks", "line") else pa.int64() for k in names]
        for batch in batches:
            own, texts = [], []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = text.split("\n")
                own += wanted
                texts += [lines[x["line"]] for x in wanted]
            for piece in pieces(pa.array(texts, pa.string())):
                words, starts, _, _ = line_sets(piece, None)  # one line to a row, each with words
                mine = own[piece.first : piece.first + piece.rows]
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(words.view(np.int64)))
                columns = [pa.array([x[k] for x in mine], t) for k, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, lists], [*names, "words"])

    by_doc = dealt.groupBy("k1", "k2").agg(F.collect_list(F.struct("group", "blocks", "c1", "c2", "did", "line", "k1", "k2")).alias("wanted"))
    fetched = arrow_map(keyed.select("k1", "k2", "text").join(by_doc.hint("shuffle_hash"), ["k1", "k2"]).select("text", "wanted"), fetch, "`group` bigint, blocks int, c1 bigint, c2 bigint, did bigint, line int, k1 bigint, k2 bigint, words array<bigint>")
    sets = cut(fetched.dropDuplicates(["c1", "c2"]))  # of rows equal in id and text each gives the lines
    keys = ["group", "b1", "b2"]
    verified = arrow_map(in_block_pairs(sets, "c1").repartition(*keys).sortWithinPartitions(*keys, "c1", "c2"), _verify, "c1 bigint, c2 bigint, links bigint, earlier boolean")
    similar = cut(verified.groupBy("c1", "c2").agg(F.sum("links").alias("links"), F.max("earlier").alias("earlier")))
    discard(members, sizes, sets)
    return similar


def removed_lines(keyed: DataFrame, limit: int = LIMIT, most: int = MOST) -> DataFrame:
    """k1, k2, n_links and lines (the numbers of those to remove) of documents that have any."""
    found = cut(line_classes(keyed, word_rarity(keyed)))
    groups = cut(candidate_groups(found.select("c1", "prefix", "bits1", "bits2"), limit))
    classes = cut(found.groupBy("c1", "c2").agg(F.count("*").alias("often"), F.min(F.struct("did", "line", "k1", "k2")).alias("at"), F.min("n").alias("n")))
    similar = similar_classes(keyed, classes, groups, most)
    repeated = classes.where("often > 1").select("c1", "c2")
    judged = cut(repeated.join(similar, ["c1", "c2"], "full").select("c1", "c2", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("earlier", F.lit(False)).alias("earlier")))
    verdict = cut(classes.select("c1", "c2", "at", "often").join(judged.hint("shuffle_hash"), ["c1", "c2"]))
    discard(classes, groups, similar, judged)
    mine = F.struct("did", "line", "k1", "k2") == F.col("at")
    removed = cut(
        join_of_keys(found.select("did", "k1", "k2", "line", "c1", "c2"), verdict, ["c1", "c2"], "often", hint="shuffle_hash")
        .groupBy("k1", "k2")
        .agg(F.sum("links").alias("links"), F.size(F.collect_set("line")).alias("own"), F.count("*").alias("rows"), F.collect_set(F.when(F.col("earlier") | ~mine, F.col("line"))).alias("lines"))
        # rows equal in id and text come together here: their links are one row's
        .select("k1", "k2", F.expr("links div (rows div own)").alias("n_links"), "lines")
    )
    discard(found, verdict)
    return removed


def dedup_lines(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), most: int = MOST) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines, n_removed, n_links (similar classes of its
    lines, summed); columns of docs named in keep come along as keep_<name>."""
    kept = [named(c).alias(f"keep_{c}") for c in keep]
    keyed = docs.select(*row_key(id_col, text_col), F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)).alias("did"), named(id_col).alias("doc_id"), named(text_col).alias("text"), *kept)
    removed = removed_lines(keyed.select("k1", "k2", "did", "text"), limit, most)

    def cleanse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines = batch.column("text"), batch.column("lines")
            counts = pc.add(pc.count_substring(texts, "\n").cast(pa.int64()), 1).fill_null(0)
            gone = pc.list_value_length(lines).cast(pa.int64()).fill_null(0)
            rows = np.flatnonzero(gone.to_numpy(zero_copy_only=False))
            if len(rows):
                out = texts.to_pylist()
                for i, own in zip(rows.tolist(), lines.take(pa.array(rows)).to_pylist(), strict=True):
                    away = set(own)
                    out[i] = "\n".join(x for k, x in enumerate(out[i].split("\n")) if k not in away)
                texts = pa.array(out, texts.type)
            others = [batch.column(c) for c in batch.schema.names[4:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, counts, gone, batch.column("n_links"), *others], ["doc_id", "text", "n_lines", "n_removed", "n_links", *batch.schema.names[4:]])

    joined = keyed.join(removed.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "lines", F.coalesce("n_links", F.lit(0)).alias("n_links"), *(named(f"keep_{c}") for c in keep))
    schema = StructType([*docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text")).schema, *(StructField(c, LongType()) for c in ("n_lines", "n_removed", "n_links")), *docs.select(*kept).schema])
    return arrow_map(joined, cleanse, schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
