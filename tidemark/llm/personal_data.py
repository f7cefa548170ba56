"""Personal data (operator 8): rules, and a character-level BiLSTM with CRF transitions.

The rules give the base spans.  The network is trained in numpy on windows around
digits and @ signs whose tags are the base spans (a bounded sample, in hash order of
the whole corpus' windows), on the same windows with digits and separators varied, and on them with
a card or phone number planted in a form that the rules miss, or a number that is neither (windows of
the corpus that hold such forms are left out).  It decodes all
windows that hold a digit or an @ sign: a span of any of the four kinds holds one,
so no other window can give a span.  Windows overlap by half; their scores are
averaged, the middle of a window counting most, and one Viterbi pass over each
stretch of joined windows settles the spans.  A span is added where the rules have
none, if it is well-formed for its kind (card numbers with dots, phone numbers without + and
country code, or where a rule's match ran on into other digits and was dropped); base spans stay.

Edge cases: a null or empty text has no spans; texts are read whole; without a
base span in the corpus nothing is trained or added; positions are code points; each of repeated
rows has its spans; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bilstm_crf as nn
from tidemark.llm.common import arrow_map, named

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: Windows that the network is trained on at most, and how.
TRAIN_WINDOWS, TRAIN_STEPS, TRAIN_BATCH, TRAIN_RATE, SEED = 768, 320, 48, 0.02, 11
#: Windows that are scored together.
BATCH_WINDOWS = 1024
#: 0 outside, 2k + 1 the first and 2k + 2 each further character of kind k.
TAGS = 1 + 2 * len(KINDS)

_ANCHOR = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match ends where its digits end, so none begins amid digits
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+` finds, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _ip_good(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))


def _card_good(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def _phone_good(found: str) -> bool:
    return 8 <= len(_DIGITS.findall(found)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the rules, leftmost and non-overlapping within a kind."""
    if not _ANCHOR.search(text):
        return []
    spans = [(0, s, e) for s, e in _emails(text)]
    for kind, pattern, good in ((1, _IP, _ip_good), (2, _CARD, _card_good), (3, _PHONE, _phone_good)):
        spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if good(m[0])]
    return spans


_FULL = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    re.compile(r"[0-9](?:[\x20.-]?[0-9])+"),
    re.compile(r"\+?\(?[0-9][\x20().0-9-]+[0-9]"),
)
#: A phone number without + or parentheses: a country code or none, and three groups.
_GROUPS = re.compile(r"(?:[0-9]{1,3}[\x20.-])?[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}")


#: Cards and phone numbers in forms that the rules miss: where one stands that is no base span, a
#: window says nothing about what is personal data and isn't learnt from.
_DOUBTFUL = re.compile(r"(?:[0-9]{4}[.-]){3}[0-9]{4}|\(?[0-9]{3}[)\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}")


def well_formed(kind: int, found: str) -> bool:
    """Whether the text of a decoded span can be of its kind."""
    if not _FULL[kind].fullmatch(found):
        return False
    if kind == 1:
        return _ip_good(found)
    if kind == 2:
        return _card_good(found.replace(".", ""))
    return kind != 3 or (10 <= len(_DIGITS.findall(found)) <= 15 and (any(c in found for c in "+()") or _GROUPS.fullmatch(found) is not None))


def window_starts(text: str) -> list[int]:
    """Beginnings of the windows of the grid that hold a digit or an @ sign."""
    cells = {m.start() // STRIDE for m in _ANCHOR.finditer(text)}
    return sorted({c * STRIDE for x in cells for c in (x - 1, x) if c >= 0})


def tag_row(n: int, spans: list[tuple[int, int, int]], first: int = 0) -> np.ndarray:
    """Tags of characters first .. first + n - 1; a span that is cut goes on with its inner tag."""
    tags = np.zeros(n, dtype=np.int64)
    for kind, start, end in spans:
        a, b = max(start - first, 0), min(end - first, n)
        if a < b:
            tags[a:b] = 2 * kind + 2
            if start >= first:
                tags[a] = 2 * kind + 1
    return tags


def _barred() -> np.ndarray:
    """An inner tag follows only a tag of its kind."""
    barred = np.zeros((TAGS, TAGS))
    for kind in range(len(KINDS)):
        inner = 2 * kind + 2
        barred[:, inner] = nn.NEVER
        barred[[inner - 1, inner], inner] = 0
    return barred


def _varied(text: str, tags: np.ndarray, rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """The window with other digits and, now and then, in a form that the rules miss: a phone
    number without its + and country code, a card number with dots."""
    out, tags = list(text), tags.copy()
    swap = {" ": "-", "-": " "} if rng.random() < 0.3 else {}
    bare, dotted = rng.random() < 0.3, rng.random() < 0.3
    for i, c in enumerate(out):
        if "0" <= c <= "9":
            out[i] = str(rng.integers(0, 10))
        elif dotted and tags[i] == 6 and c in " -":
            out[i] = "."
        elif tags[i] in (6, 8):
            out[i] = swap.get(c, c)
        elif bare and tags[i] == 7 and c == "+":
            at = text.find("(", i, i + 6)
            if at > 0:
                out[i:at] = " " * (at - i)
                tags[i:at], tags[at] = 0, 7
    return "".join(out), tags


def missed_form(rng: np.random.Generator) -> tuple[int, str]:
    """A card (2) or phone number (3) in a form that the rules miss, or (-1) a number that is neither."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    shape = int(rng.integers(0, 10))
    if shape < 3:  # card
        body = str(rng.integers(3, 7)) + digits(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        groups = [body[k : k + 4] for k in range(0, 16, 4)]
        return 2, ".".join(groups) if shape else groups[0] + "".join(".-"[int(rng.integers(0, 2))] + g for g in groups[1:3]) + "." + groups[3]
    if shape < 7:
        area, office, line = str(rng.integers(2, 10)) + digits(2), str(rng.integers(2, 10)) + digits(2), digits(4)
        return 3, (f"({area}) {office}-{line}", f"{area}-{office}-{line}", f"{area}.{office}.{line}", f"{rng.integers(1, 100)}-{area}-{office}-{line}")[shape - 3]
    return -1, (f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(2)}.{digits(2)}.20{digits(2)} {digits(2)}:{digits(2)}", f"{digits(5)}-{digits(5)}", f"{digits(1)}.{digits(2)}.{digits(3)}", f"{digits(3)}.{digits(2)}")[int(rng.integers(0, 6))]


def _planted(text: str, tags: np.ndarray, rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """The window with a missed form between two of its words, where no span stands."""
    kind, form = missed_form(rng)
    free = [i for i, c in enumerate(text) if c == " " and tags[i] == 0 and i + len(form) + 2 < WINDOW]
    if not free:
        return text, tags
    at = int(rng.choice(free))
    own = np.full(len(form), max(2 * kind + 2, 0))
    if kind >= 0:
        own[0] = 2 * kind + 1
    out = np.concatenate([tags[: at + 1], own, [0], tags[at + 1 :]])[:WINDOW]
    return (text[: at + 1] + form + " " + text[at + 1 :])[:WINDOW], out


#: Parts in which the least windows are sought before one task sees what they left.
SAMPLE_PARTS = 32


def train_network(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> nn.Network | None:
    """Fit on at most TRAIN_WINDOWS windows of the corpus: those first in hash order, two
    thirds of them with a base span.  None if no window has one.

    One pass: each task keeps its own first windows, SAMPLE_PARTS tasks those of all, and
    the last one gets theirs."""
    most = {True: TRAIN_WINDOWS * 2 // 3, False: TRAIN_WINDOWS // 3}
    fields = [("some", pa.bool_()), ("h", pa.int64()), ("window", pa.string()), ("tags", pa.binary())]

    def first(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """The first rows (some, hash, window, tags) of either kind; a bounded number."""
        held: dict[bool, list[tuple]] = {True: [], False: []}
        for row in rows:
            own = held[row[0]]
            own.append(row)
            if len(own) >= 4 * most[row[0]]:
                held[row[0]] = sorted(own)[: most[row[0]]]
        found = [r for kind, own in held.items() for r in sorted(own)[: most[kind]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), fields, strict=True)] if found else [pa.array([], t) for _, t in fields], [k for k, _ in fields])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    spans = base_spans(text)
                    unclear = [m.span() for m in _DOUBTFUL.finditer(text) if not any(s < m.end() and m.start() < e for _, s, e in spans)]
                    for start in window_starts(text):
                        if any(s < start + WINDOW and start < e for s, e in unclear):
                            continue
                        own = text[start : start + WINDOW].ljust(WINDOW)
                        tags = tag_row(WINDOW, spans, start)
                        yield bool(tags.any()), xxhash.xxh64_intdigest(own, SEED) >> 1, own, tags.astype(np.int8).tobytes()

        yield from first(rows())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from first(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    schema = "some boolean, h bigint, window string, tags binary"
    able = docs.where(named(text_col).rlike("[0-9@]")).select(named(text_col))
    found = arrow_map(arrow_map(able, windows, schema).repartition(SAMPLE_PARTS, "h"), again, schema)
    sample = arrow_map(found.repartition(1), again, schema).orderBy(F.desc("some"), "h", "window", "tags").collect()  # TRAIN_WINDOWS rows
    if not any(r.some for r in sample):
        return None
    rng = np.random.default_rng(SEED)
    tags = np.array([np.frombuffer(r.tags, dtype=np.int8) for r in sample]).astype(np.int64)
    # each window as it is and varied, and TRAIN_WINDOWS with a form that the rules miss
    varied = [_varied(r.window, t, rng) for r, t in zip(sample, tags, strict=True)]
    varied += [_planted(sample[k % len(sample)].window, tags[k % len(sample)], rng) for k in range(TRAIN_WINDOWS)]
    chars = np.array([nn.char_classes(r.window) for r in sample] + [nn.char_classes(w) for w, _ in varied])
    net = nn.new_network(TAGS, _barred(), SEED)
    return nn.train(net, chars, np.concatenate([tags, [t for _, t in varied]]), TRAIN_STEPS, TRAIN_BATCH, TRAIN_RATE, SEED)


_CENTRE = np.minimum(np.arange(WINDOW) + 1, np.arange(WINDOW, 0, -1)).astype(np.float32)


def decode(net: nn.Network, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans that the network finds: scores of overlapping windows are averaged, and each
    stretch of joined windows is decoded as a whole."""
    where = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    stretch: tuple[int, int] | None = None  # text, first character
    sums, weight = np.zeros((0, TAGS), np.float32), np.zeros(0, np.float32)

    def settle() -> None:
        if stretch is None:
            return
        i, first = stretch
        n = min(len(sums), len(texts[i]) - first)
        path = nn.best_path(sums[:n] / weight[:n, None], net.transitions)
        k = 0
        while k < n:
            tag, k0 = int(path[k]), k
            k += 1
            if tag == 0:
                continue
            kind = (tag - 1) // 2
            while k < n and path[k] == 2 * kind + 2:
                k += 1
            out[i].append((kind, first + k0, first + k))

    for begin in range(0, len(where), BATCH_WINDOWS):
        some = where[begin : begin + BATCH_WINDOWS]
        chars = np.array([nn.char_classes(texts[i][s : s + WINDOW].ljust(WINDOW)) for i, s in some]).T
        scores = nn.emissions(net, chars)
        for w, (i, s) in enumerate(some):
            if stretch is None or stretch[0] != i or s > stretch[1] + len(sums):
                settle()
                stretch, sums, weight = (i, s), np.zeros((0, TAGS), np.float32), np.zeros(0, np.float32)
            at = s - stretch[1]
            grow = at + WINDOW - len(sums)
            if grow > 0:
                sums = np.concatenate([sums, np.zeros((grow, TAGS), np.float32)])
                weight = np.concatenate([weight, np.zeros(grow, np.float32)])
            sums[at : at + WINDOW] += scores[:, w] * _CENTRE[:, None]
            weight[at : at + WINDOW] += _CENTRE
    settle()
    return out


def reconcile(text: str, base: list[tuple[int, int, int]], decoded: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and well-formed decoded ones that stand alone and overlap none of them."""
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken])
    ends = np.maximum.accumulate(np.array([e for _, e in taken])) if taken else starts
    added = []
    for kind, start, end in decoded:
        k = int(np.searchsorted(starts, end))  # base spans that begin before its end
        alone = not text[start - 1 : start].isalnum() and not text[end : end + 1].isalnum()
        if alone and (k == 0 or ends[k - 1] <= start) and well_formed(kind, text[start:end]):
            added.append((kind, start, end))
    return sorted(base + added)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_personal_data(docs: DataFrame, net: nn.Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as text)
    and n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            base = [base_spans(t) for t in texts]
            whole = list(base)
            if net is not None:
                able = [i for i, t in enumerate(texts) if _ANCHOR.search(t)]
                for i, more in zip(able, decode(net, [texts[i] for i in able]), strict=True):
                    whole[i] = reconcile(texts[i], base[i], more)
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *counts,
                    pa.array([hashlib.sha256(span_text(x).encode()).hexdigest() for x in base]),
                    pa.array([span_text(x) for x in whole], pa.string()),
                    pa.array([len(x) - len(y) for x, y in zip(whole, base, strict=True)], pa.int64()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), find, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_personal_data(docs, train_network(docs))
