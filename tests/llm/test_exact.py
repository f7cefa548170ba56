"""Operators whose results are exact, against brute force or the library they must agree with."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import SCHEMA, corpus, frame, ordered, words_of
from tidemark.llm import byte_bpe, flac, kernels, lines, mixing, registry, simhash, substring, token_counts


def test_word_hashes_tell_words_apart(spark):
    import pyarrow as pa

    texts = ["a b a", "", "b\x0bé a", None, "é" * 70000]
    got = [h for p in kernels.pieces(pa.array(texts), 100) for h in (p.word_hashes().tolist() if len(p.starts) else [])]
    wanted = [w for t in texts for w in words_of(t)]
    assert len(got) == len(wanted)
    assert len(set(zip(got, wanted, strict=True))) == len(set(wanted))


# --- 1: lines


def brute_lines(rows):
    flat = []
    for d, t, *_ in rows:
        for k, line in enumerate(t.split("\n") if t is not None else []):
            if w := frozenset(words_of(line)):
                flat.append((lines.NO_ID if d is None else d, k, w))
    first = {}
    for d, k, w in flat:
        first[w] = min(first.get(w, (d, k)), (d, k))
    sets = list(first)
    similar = {w: [v for v in sets if v != w and 9 * len(w & v) >= 4 * (len(w) + len(v))] for w in sets}
    out = []
    for d, t, *_ in rows:
        kept, n_links, removed = [], 0, 0
        for k, line in enumerate(t.split("\n") if t is not None else []):
            w = frozenset(words_of(line))
            if w:
                n_links += len(similar[w])
                if first[w] != (lines.NO_ID if d is None else d, k) or any(first[v] < first[w] for v in similar[w]):
                    removed += 1
                    continue
            kept.append(line)
        out.append((d, None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")), removed, n_links))
    return out


def line_rows():
    rng = random.Random(3)
    bases = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 30))] for _ in range(6)]
    rows = []
    for i in range(120):
        own = []
        for _ in range(rng.randint(0, 4)):
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = str(rng.randint(0, 9))
            own.append(" ".join(w[1:] if rng.random() < 0.2 else w))
        rows.append((i, "\n".join([*own, "", "  "] if i % 7 == 0 else own), "en", "s", 0))
    return [*rows, (None, None, None, None, None), (900, "", "en", "s", 0)]


@pytest.mark.parametrize("limit", [4096, 8])
def test_line_dedup(spark, limit):
    # a limit below the sizes of words' classes and groups takes the ways for large ones
    rows = line_rows()
    assert ordered(lines.dedup_lines(frame(spark, rows), limit, most=limit).collect()) == ordered(brute_lines(rows))


def colliding_texts(spark, make):
    """Two texts with one value of Spark's 32-bit hash."""
    found = spark.createDataFrame([(make(i),) for i in range(150_000)], "text string").selectExpr("text", "hash(text) h")
    least = found.groupBy("h").agg({"text": "min", "*": "count"}).where("`count(1)` > 1").limit(1).select("h")
    return [r.text for r in found.join(least, "h").collect()][:2]


def test_rows_of_one_id_are_told_apart(spark):
    a, b = colliding_texts(spark, lambda i: f"line {i} of few words that is there")
    rows = [(1, a, "en", "s", 0), (3, a, "en", "s", 0), (3, b.replace(" of few words that is there", " alone"), "en", "s", 0), (None, a, "en", "s", 0), (None, "x y z", "en", "s", 0), (3, b, "en", "s", 0)]
    got = {(r.doc_id, r.text): (r.n_removed, r.n_links) for r in lines.dedup_lines(frame(spark, rows)).collect()}
    # the null id comes first: its line stays, those of 1 and 3 go; b differs from a in a word of eight
    assert got == {(1, ""): (1, 0), (3, ""): (1, 0), (3, b.replace(" of few words that is there", " alone")): (0, 0), (None, a): (0, 0), (None, "x y z"): (0, 0), (3, b): (0, 0)}
    spread = " ".join(f"w{i}" for i in range(40))
    a, b = colliding_texts(spark, lambda i: f"{i} q r")
    rows = [(None, a, "en", "s", 0), (None, f"{spread} {a}", "en", "s", 0), (None, b, "en", "s", 0), (7, f"{b} {spread}", "en", "s", 0)]
    assert ordered(substring.remove_repeated(frame(spark, rows)).collect()) == ordered(brute_substrings(rows, 35))


def test_line_dedup_breaks_ties_of_null_ids(spark):
    words = [f"w{i}" for i in range(20)]
    rows = [(None, " ".join([*words, f"x{k}"]), "en", "s", 0) for k in range(6)]
    got = lines.dedup_lines(frame(spark, rows)).collect()
    assert sorted(r.n_removed for r in got) == [0, 1, 1, 1, 1, 1] and all(r.n_links == 5 for r in got)


def test_line_dedup_of_awkward_documents(spark):
    # rows equal in id and text are one document: brute force sees them once, the result has each
    rows = corpus()
    once = list(dict.fromkeys(rows))
    wanted = {r[:2]: r for r in brute_lines(once)}
    got = lines.dedup_lines(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(tuple(r)[1:4])
    assert by_id == {d: {w[1:4] for w in brute_lines(once) if w[0] == d} for d, *_ in wanted}


@pytest.mark.parametrize("limit", [2, 1 << 22])
def test_lines_beyond_a_sort_key(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "KEYED_LINES", limit)
    rows = line_rows()
    assert ordered(lines.dedup_lines(frame(spark, rows)).collect()) == ordered(brute_lines(rows))


def test_five_million_short_lines_in_one_text():
    import pyarrow as pa

    n = 5_000_000
    text = "\n".join([f"{k % 7} x" for k in range(n - 2)] + ["a b", "last"])
    (piece,) = kernels.pieces(pa.array([text]))
    words, starts, row, number = lines.line_sets(piece, None)
    assert len(starts) == n + 1 and (number == np.arange(n)).all() and not row.any()
    assert (np.diff(starts)[:-1] == 2).all() and np.diff(starts)[-1] == 1
    classes = {tuple(sorted(words[starts[k] : starts[k + 1]].tolist())) for k in [*range(100), *range(n - 100, n)]}
    assert len(classes) == 9


def test_copies_of_a_line_bring_no_prefix(spark):
    """A task gives the prefix words of a class once, however many of its lines it has; every class has them."""
    rows = [(i, "\n".join(["the very common line of all", f"own{i % 50} words{i % 50} of{i % 50} row{i % 50}", "alone"]), "en", "s", 0) for i in range(400)]
    keyed = frame(spark, rows).repartition(3).select(F.col("doc_id").alias("did"), F.col("doc_id").alias("k1"), F.col("doc_id").alias("k2"), "text")
    found = lines.line_classes(keyed, np.full(1 << lines.CELL_BITS, 2 * lines._RANK, dtype=np.int32)).withColumn("with prefix", (F.size("prefix") > 0).cast("int"))
    got = sorted((r.n, r.rows, r.often) for r in found.groupBy("c1", "c2").agg(F.min("n").alias("n"), F.count("*").alias("rows"), F.sum("with prefix").alias("often")).collect())
    assert [(n, k) for n, k, _ in got] == [(1, 400), *[(4, 8)] * 50, (6, 400)]
    assert all((1 if n > 1 else 0) <= often <= (3 if n > 1 else 0) for n, _, often in got)


@pytest.mark.parametrize("slots", [2, 8, 1024])
def test_remembered_classes(slots):
    """Of equal classes the first is fresh in any case, and with room enough no other."""
    rng = np.random.default_rng(slots)
    c1 = np.concatenate([rng.integers(-20, 20, 500), [0, 0, 1, 1]])
    c2 = np.concatenate([rng.integers(0, 2, 500), [0, 0, 0, 0]])
    seen, fresh = lines.Remembered(slots), Counter()
    for k in range(0, len(c1), 50):
        for key, new in zip(zip(c1[k : k + 50].tolist(), c2[k : k + 50].tolist(), strict=True), seen.fresh(c1[k : k + 50], c2[k : k + 50]), strict=True):
            fresh[key] += bool(new)
        assert all(fresh[key] for key in zip(c1[: k + 50].tolist(), c2[: k + 50].tolist(), strict=True))
    assert slots < 1024 or sum(fresh.values()) < len(c1)


def test_a_line_in_a_tenth_of_all_documents(spark):
    """Its rows get their verdict by broadcast: no task of a join holds more than its share."""
    rows = [(i, (f"the very common line of all\n" if i % 10 == 0 else "") + f"own{i} words{i} of{i} row{i}", "en", "s", 0) for i in range(3000)]
    got = {r.doc_id: (r.n_removed, r.text) for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == {i: (1 if i % 10 == 0 and i else 0, t.split("\n")[-1] if i else t) for i, t, *_ in rows}
    groups = simhash.simhash_groups(frame(spark, [(i, "" if i % 3 else f"a{i} b{i} c{i} d{i}", "en", "s", 0) for i in range(300)]))
    assert {r.component_id for r in groups.where("doc_id % 3 <> 0").collect()} == {1}


OPS = {n: f for n, f in registry.QUERIES.items() if n not in ("op11_vector_codes", "op12_warc", "op13_hard_negatives")}


@pytest.mark.parametrize("name", sorted(OPS))
def test_registered_queries_on_awkward_tables(spark, tmp_path, name):
    """An empty table gives no row; nulls, repeated rows and columns of clashing names give one row each."""
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert OPS[name](spark, f"{tmp_path}/none").collect() == []
    frame(spark).withColumn("a.b", F.lit(1)).withColumn("row key 1", F.lit(2)).write.parquet(f"{tmp_path}/some/documents.parquet")
    got = OPS[name](spark, f"{tmp_path}/some").collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in corpus())


def test_line_dedup_of_nothing(spark):
    assert lines.dedup_lines(frame(spark, [])).count() == 0


# --- 2: FLAC


def test_flac_round_trip(spark):
    rng = np.random.default_rng(1)
    payloads = [b"", b"a", bytes(range(256)) * 9, rng.bytes(3000), b"\x00" * 960, b"\x00\xff" * 480, (b" " * 190 + b"\xff") * 9]
    padded = [flac.pad(p) for p in payloads]
    streams = flac.encode_streams(padded)
    assert flac.decode_streams(streams) == padded
    assert flac.encode_streams(padded[3:4])[0] == streams[3]  # a stream doesn't depend on its neighbours
    assert flac.seek(streams[3], 1000, 700) == padded[3][1000:1700]
    for at in (-1, -40, 30, len(streams[3]) // 2):
        broken = bytearray(streams[3])
        broken[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(broken)])


def test_flac_points_of_long_streams(monkeypatch):
    monkeypatch.setattr(flac, "BLOCK_POINTS", 18 * 5)
    payload = flac.pad(np.random.default_rng(2).bytes(192 * 17))
    stream = flac.encode_streams([payload])[0]
    assert flac.decode_streams([stream]) == [payload] and flac.seek(stream, 192 * 12 + 3, 400) == payload[192 * 12 + 3 :][:400]


def test_flac_reads_escaped_and_far_codes():
    # a partition of plain 9-bit samples, and Rice codes whose zeros fill more than one window
    bits = ""
    values = [(-1) ** i * (i % 200) for i in range(192)]
    bits = "00" + "0000" + "1111" + "01001" + "".join(format(v & 511, "09b") for v in values)
    data = np.frombuffer(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big"), dtype=np.uint8)
    assert flac._residuals(flac._Bits.over(data), np.array([0]), 192, 0)[:, 0].tolist() == values
    coded = "00" + "0000" + "0001" + "".join("0" * ((v << 1 ^ v >> 31) >> 1) + "1" + str((v << 1 ^ v >> 31) & 1) for v in values)
    data = np.frombuffer(int(coded.ljust(-(-len(coded) // 8) * 8, "0"), 2).to_bytes(-(-len(coded) // 8), "big"), dtype=np.uint8)
    assert flac._residuals(flac._Bits.over(data), np.array([0]), 192, 0)[:, 0].tolist() == values


def test_flac_query(spark):
    rows = corpus()
    media = flac.flac_encode(frame(spark, rows))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in flac.flac_features(media).collect())
    wanted = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        p = flac.pad(raw)
        wanted.append((d is None, d or 0, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert got == sorted(wanted)
    blocks = flac.flac_blocks(media.where("doc_id = 403"), 960).orderBy("sample_offset").collect()
    assert b"".join(b.pcm for b in blocks) == flac.pad(next(t for d, t, *_ in rows if d == 403).encode())
    assert [b.sample_offset for b in blocks] == list(range(0, 960 * len(blocks), 960))


# --- 3: SimHash


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(lowered)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    fps[100:300] = fps[:200] ^ np.uint64(5)
    fps[300:400] = fps[100:200] ^ np.uint64(1 << 40)
    ends = np.repeat([100, 400, 650, 700], [100, 300, 250, 50])
    distances = np.bitwise_count(fps[:, None] ^ fps[None, :])
    i, j = simhash.close_pairs(fps, ends, radius)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(700) for b in range(a + 1, ends[a]) if distances[a, b] <= radius}


def least_reachable(fps, radius):
    linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("limit", [2048, 4])
def test_near_edges_keep_components(spark, limit):
    # chains and dense clouds; a limit below their sizes deals buckets again and again
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    cloud = [b ^ np.uint64(sum(1 << int(x) for x in rng.integers(0, 64, rng.integers(0, 5)))) for b in base for _ in range(12)]
    fps = np.unique(np.array(cloud, dtype=np.uint64))
    label = least_reachable(fps, 3)
    distinct = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    from tidemark.llm.components import components

    root = {r.node: r.root for r in components(simhash.near_edges(distinct, 3, limit)).collect()}
    groups, wanted = {}, {}
    for k, x in enumerate(fps.view(np.int64).tolist()):
        groups.setdefault(root.get(x, x), set()).add(x)
        wanted.setdefault(int(label[k]), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_simhash_query(spark):
    rows = corpus()
    fps = np.array([plain_fingerprint(t) for _, t, *_ in rows], dtype=np.uint64)
    label = least_reachable(fps, 3)
    least = {}
    for k, (d, *_) in enumerate(rows):
        if d is not None:
            least[label[k]] = min(least.get(label[k], d), d)
    wanted = [(d, format(int(f), "016x"), least.get(g)) for (d, *_), f, g in zip(rows, fps, label, strict=True)]
    assert ordered(simhash.simhash_groups(frame(spark, rows)).collect()) == ordered(wanted)
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


# --- 4 and 9: tokens


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(1)
    alphabet = "aAbΣσς́̇İßﬁ'sre   \n\t\r\x1c\x85\xa0 é1٣२!?\U0001f4a3‍中文ﷺ"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    out += [s[:4] + x + s[4:] for s in out[:400] for x in ("<|endoftext|>", "<|startoftext|>")]
    return out + [f"ab{chr(c)}c1'S {chr(c)} {chr(c)}{chr(c)}" for c in [*range(0xD800), *range(0xE000, 0x30000, 37)]]


def test_token_counts_are_the_library_s(strings):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        counter = token_counts.TokenCounter(f.read(), entries=500)
    assert [counter.count(s) for s in strings] == [len(e.ids) for e in library.encode_batch(strings, add_special_tokens=False)]


def test_token_count_query(spark):
    rows = corpus()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_counts.token_counts(frame(spark, rows), public_tokenizers.path("word_bpe_49k.json")).collect()
    wanted = []
    for d, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        wanted.append((d, len((t or "").encode()), n, n > 2048))
    assert ordered(got) == ordered(wanted)


@pytest.fixture(scope="module")
def reference_bpe():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_ids_are_the_ranks(strings, reference_bpe, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 2000)
    contents = []
    for path in byte_bpe.vocabulary_paths():
        with open(path, "rb") as f:
            contents.append(f.read())
    bpe = byte_bpe.ByteBpe(*contents)
    packed = bpe.encode(strings)
    assert [np.frombuffer(x, "<u4").tolist() for x in packed] == [reference_bpe.encode_ordinary(s) for s in strings]
    assert [bpe.decode(x) for x in packed] == [s.encode() for s in strings]
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe(contents[0], base64.b64encode(b"zz") + b" 5\n")


def test_bpe_query(spark, reference_bpe):
    rows = corpus()
    got = byte_bpe.bpe_digests(frame(spark, rows), *byte_bpe.vocabulary_paths()).collect()
    wanted = []
    for d, t, *_ in rows:
        ids = np.array(reference_bpe.encode_ordinary(t or ""), dtype="<u4")
        wanted.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert ordered(got) == ordered(wanted)
    encoded = byte_bpe.bpe_encode(frame(spark, rows), *byte_bpe.vocabulary_paths(), offsets=True)
    row = encoded.where("doc_id = 405").first()
    assert len(row.starts) == len(row.ids) // 4 and row.ends[-1] == len("Ünï\U0001f4a3中文 mixed")
    assert byte_bpe.bpe_decode(encoded, *byte_bpe.vocabulary_paths()).where("doc_id = 405").first().decoded.decode() == "Ünï\U0001f4a3中文 mixed"


# --- 5: mixing


def plain_targets(sizes, weights, share, cap):
    """The contract's words, step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    rest, targets, left = share * sum(sizes.values()), {}, list(names)
    while left:
        total = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / total > cap * sizes[s]]
        if not over:
            return targets | {s: rest * weight[s] / total for s in left}
        for s in over:
            targets[s] = float(cap * sizes[s])
        rest -= sum(targets[s] for s in over)
        left = [s for s in left if s not in targets]
    return targets


def targets_of(spark, sizes):
    found = spark.createDataFrame([(str(s), s, n) for s, n in sizes.items()], "key string, name string, size long")
    return {r.name: r.target for r in mixing.source_targets(found, (3, 1, 2), 1.5, 2).collect()}


def test_targets_and_flow(spark):
    assert targets_of(spark, {"a": 10, "b": 100, None: 100}) == {"a": 20.0, "b": pytest.approx(295 / 3), None: pytest.approx(590 / 3)}
    rng = random.Random(2)
    many = {f"{chr(rng.choice([97, 0xE9, 0x4E2D, 0x1F4A3]))}{i}": rng.choice([0, 1, 10, 1000]) for i in range(300)}
    assert targets_of(spark, many) == pytest.approx(plain_targets(many, (3, 1, 2), 1.5, 2))
    given = mixing.min_cost_flow({"a": (("A",), 100), "b": (("B",), 100), "ab": (("A", "B"), 100)}, {"A": 150, "B": 100}, 2)
    # repeating nothing is cheapest: the shared pattern fills up what A alone can't give once
    assert given == {"a": 100, "b": 100, "ab": 50}
    assert sum(mixing.min_cost_flow({"a": (("A",), 10)}, {"A": 99}, 2).values()) == 20


def test_flow_is_of_least_cost():
    """Against all ways to give small whole numbers of words."""
    rng = random.Random(4)
    for _ in range(40):
        names = "ABC"[: rng.randint(1, 3)]
        patterns = {str(k): (tuple(rng.sample(names, rng.randint(1, len(names)))), rng.randint(0, 3)) for k in range(rng.randint(1, 3))}
        quotas = {s: rng.randint(0, 5) for s in names}

        def routable(give):
            return all(sum(g for k, g in give.items() if set(patterns[k][0]) <= set(some)) <= sum(quotas[s] for s in some) for n in range(len(names) + 1) for some in itertools.combinations(names, n))

        ways = [dict(zip(patterns, g, strict=True)) for g in itertools.product(*(range(2 * w + 1) for _, w in patterns.values()))]
        cost = lambda give: (-sum(give.values()), sum(max(0, g - patterns[k][1]) for k, g in give.items()))
        assert cost(mixing.min_cost_flow(patterns, quotas, 2)) == min(cost(g) for g in ways if routable(g))


@pytest.mark.parametrize("whole", [False, True])
def test_mixing(spark, whole):
    from pyspark.sql import functions as F

    rows = corpus()
    docs = frame(spark, rows).select("doc_id", mixing.word_count(F.col("text")).alias("size"), F.array("source").alias("sources"))
    mixed, sources = mixing.mix(docs, whole=whole)
    got = mixed.collect()
    assert ordered(got) == ordered(mixing.mix(docs, whole=whole)[0].collect())  # reruns agree
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r.target is not None
        sizes[r.sources[0]] += r.size
        taken[r.sources[0]] += r.taken
        assert 0 <= r.taken <= 2 * r.size and (not whole or r.size == 0 or r.taken % r.size == 0)
    assert len(got) == len(rows)
    targets = plain_targets(sizes, (3, 1, 2), 1.5, 2)
    assert {r.name: (r.source_size, r.target) for r in sources.collect()} == {s: (float(sizes[s]), pytest.approx(targets[s])) for s in sizes}
    for s in sizes:
        slack = max(r.size for r in got if r.sources[0] == s) if whole else 1
        assert abs(taken[s] - targets[s]) <= slack


def test_mixing_overlapping_sources(spark):
    rows = [(i, 10, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", None]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    mixed, _ = mixing.mix(docs)
    assert all(0 <= r.taken <= 20 for r in mixed.collect())
    assert mixing.mix(docs.where("doc_id < 0"))[0].count() == 0


# --- 6: substrings


def brute_substrings(rows, window):
    words = [words_of(t) for _, t, *_ in rows]
    often = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, *_), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if often[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def substring_rows():
    rng = random.Random(3)
    base = [str(rng.randint(0, 200)) for _ in range(300)]
    rows = []
    for i in range(110):
        w = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 280)
            w += base[a : a + rng.randint(1, 60)] if rng.random() < 0.7 else [str(rng.randint(0, 3)) for _ in range(rng.randint(1, 9))]
        rows.append((i, " ".join(["x"] * rng.randint(1, 90) if i % 9 == 0 else w), "en", "s", 0))
    return [*rows, (None, None, None, None, None), (None, "a b", "en", "s", 3), (7, "", "en", "s", 0), (7, "q " * 50, "en", "s", 0), (5, rows[5][1], "en", "s", 0), (None, rows[11][1] + " zz", "en", "s", 0)]


@pytest.mark.parametrize(("window", "gram", "limit"), [(7, 4, 256), (7, 4, 2), (35, 18, 256)])
def test_substring_dedup(spark, window, gram, limit):
    # a limit below the sizes of shards takes the way for large ones
    rows = substring_rows()
    assert ordered(substring.remove_repeated(frame(spark, rows), window, gram, limit).collect()) == ordered(brute_substrings(rows, window))


def test_substring_dedup_of_awkward_documents(spark):
    rows = corpus()
    assert ordered(substring.remove_repeated(frame(spark, rows)).collect()) == ordered(brute_substrings(rows, 35))
    assert substring.remove_repeated(frame(spark, [])).count() == 0


def test_suffix_automaton_counts():
    rng = random.Random(5)
    sequences = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 30))) for _ in range(12)]
    automaton = substring.SuffixAutomaton()
    for s in sequences:
        automaton.add(s, 1)
    automaton.count()
    often = Counter(s[i : i + 5] for s in sequences for i in range(len(s) - 4))
    for s in sequences:
        assert automaton.repeated(s, 5) == sum(1 << i for i in range(len(s) - 4) if often[s[i : i + 5]] > 1)


def test_schema_is_documents(spark):
    assert frame(spark, extra=False).schema.simpleString().startswith("struct<doc_id:bigint,text:string,lang:string")
    assert re.match("doc_id", SCHEMA)
