"""Operators that learn or estimate: held-out accuracy, gradients, bounds of the estimates."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
import re

import numpy as np
import pytest

from tests.llm.fixtures import corpus, frame, ordered, words_of
from tidemark.llm import bilstm_crf as nn
from tidemark.llm import fingerprints, language, registry
from tidemark.llm import personal_data as pd

# --- 7: language


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op7_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges_and_spans(spark):
    model = language.learn(frame(spark))
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language.identify(frame(spark), model, spans=True).collect()}
    assert len(got) == len({r[0] for r in corpus()})
    for d in (400, 401, 402, 404):
        assert (got[d].lang_pred, got[d].score) == (language.UNKNOWN, 0.0)
    mixed = spark.createDataFrame([(1, "the of and that with the of " * 3 + "der die und nicht eine und die " * 3)], "doc_id int, text string")
    row = language.identify(mixed, model, spans=True).first()
    assert [(s.lang, s.words) for s in row.spans] == [("en", 21), ("de", 21)]
    nothing = language.learn(frame(spark, []))
    assert {r.lang_pred for r in language.identify(frame(spark), nothing).collect()} == {language.UNKNOWN}


def test_scripts_narrow_candidates(spark):
    rows = [(i, "привет мир добрый день", "ru", "s", 0) for i in range(5)] + [(9 + i, "hello world good day", "en", "s", 0) for i in range(5)]
    model = language.learn(frame(spark, rows))
    got = language.identify(spark.createDataFrame([(1, "шшш"), (2, "zzz")], "doc_id int, text string"), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in sorted(got)] == [(1, "ru"), (2, "en")]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    scores = rng.normal(size=(9, 3)).astype(np.float32) * 2
    labels = language.viterbi(scores, np.array([0, 5, 5, 9]), 1.5)
    for a, b in ((0, 5), (5, 9)):
        value = lambda p, a=a, b=b: sum(scores[a + i, x] for i, x in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        best = max(value(p) for p in np.ndindex(*(3,) * (b - a)))
        assert value(labels[a:b].tolist()) == pytest.approx(best, abs=1e-4)


# --- 8: personal data

_PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    good = (
        lambda x: True,
        lambda x: all(int(p) <= 255 for p in x.split(".")),
        lambda x: 16 <= len(digits(x)) <= 19 and pd.luhn(digits(x)),
        lambda x: 8 <= len(digits(x)) <= 15,
    )
    return [(k, m.start(), m.end()) for k in range(4) for m in _PLAIN[k].finditer(t) if good[k](m[0])]


def test_base_spans_are_the_patterns():
    rng = random.Random(2)
    found = 0
    for _ in range(20000):
        alphabet = rng.choice(["ab.@-", "019.", "0123456789 -", "+01234() .-", "a0.@+ -"])
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pd.base_spans(t) == plain_spans(t)
        found += len(plain_spans(t))
    assert found > 1000
    assert pd.base_spans("1" * 200000 + "@" * 1000) == []  # linear, not quadratic


def test_gradients():
    rng = np.random.default_rng(0)
    chars, tags = rng.integers(0, nn.CLASSES, (7, 3)), pd.tag_row(7, [(0, 1, 4), (2, 4, 6)])[:, None].repeat(3, 1)
    start = nn.new_network(pd.TAGS, pd._barred(), 1)
    net = nn.Network({k: v.astype(np.float64) for k, v in start.params.items()}, start.barred.astype(np.float64))
    _, grads = nn.loss_and_gradients(net, chars, tags)
    for name, value in net.params.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), value.shape)
        losses = []
        for step in (1e-3, -1e-3):
            moved = value.copy()
            moved[at] += step
            losses.append(nn.loss_and_gradients(nn.Network(net.params | {name: moved}, net.barred), chars, tags)[0])
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(grads[name][at], rel=1e-2, abs=1e-4)


def test_personal_data(spark):
    rng = random.Random(7)
    filler = "the of and that with thing ention edly".split()
    rows = []
    for i in range(160):
        parts = [rng.choice(filler) for _ in range(30)]
        for make in (lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"user{rng.randint(0, 99)}@mail.example.com"):
            if rng.random() < 0.6:
                parts.insert(rng.randrange(len(parts)), make())
        rows.append((i, " ".join(parts), "en", "s", 0))
    docs = frame(spark, rows + corpus())
    net = pd.train_network(docs)
    got = pd.find_personal_data(docs, net).collect()
    assert len(got) == len(rows + corpus())
    texts = {d: t or "" for d, t, *_ in corpus()} | {d: t for d, t, *_ in rows}
    for r in got:
        if r.doc_id is None or 0 <= r.doc_id < 90:
            continue  # ids that both parts use
        base = sorted(plain_spans(texts[r.doc_id]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(pd.span_text(base).encode()).hexdigest()
        assert set(filter(None, pd.span_text(base).split(","))) <= set(r.spans.split(","))
    held = [t for d, t, *_ in rows if d >= 120]
    found = pd.decode(net, held)
    base = [set(plain_spans(t)) for t in held]
    assert sum(len(set(f) & b) for f, b in zip(found, base, strict=True)) / sum(map(len, base)) > 0.8
    assert pd.train_network(frame(spark, [(1, "no data", "en", "s", 7)])) is None
    assert pd.find_personal_data(frame(spark, []), None).count() == 0


def test_forms_that_the_rules_miss_are_added(spark, sf_dir, tmp_path):
    """Of cards and phone numbers in forms that the rules miss 0.9 are added, and nothing else is: not to
    numbers that are neither, nor to the corpus' own texts; through the registered query."""
    import numpy as np

    rng, pick = np.random.default_rng(99), random.Random(5)
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    filler = [w for _, t in own for w in (t or "").split()[:20] if not any(c.isdigit() or c == "@" for c in w)]
    planted = {}
    for i in range(300):
        kind, form = pd.missed_form(rng)
        words = [pick.choice(filler) for _ in range(20)]
        words.insert(pick.randrange(1, 19), form)
        text = " ".join(words)
        planted[10**6 + i] = (text, kind, text.index(form), text.index(form) + len(form))
    rows = [(d, t, "en", "s", 0) for d, t in own] + [(d, x[0], "en", "s", 0) for d, x in planted.items()]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op8_personal_data"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    named = lambda kind, start, end: f"{pd.KINDS[kind]}:{start}:{end}"
    base = lambda t: set(filter(None, pd.span_text(plain_spans(t or "")).split(",")))
    added = {d: set(filter(None, got[d].spans.split(","))) - base(t) for d, t in own + [(d, x[0]) for d, x in planted.items()]}
    missing = [x for d, x in planted.items() if x[1] >= 0 and named(*x[1:]) not in added[d]]
    wanted = sum(x[1] >= 0 for x in planted.values())
    assert len(missing) <= 0.1 * wanted
    right = wanted - len(missing)
    assert sum(len(x) for x in added.values()) - right <= 0.02 * right
    assert sum(r.n_added for r in got.values()) == sum(len(x) for x in added.values())


def test_added_spans_are_well_formed():
    text = "call 12 4111111111111111 now"
    assert pd.base_spans(text) == []
    assert pd.reconcile(text, [], [(2, 8, 24), (2, 5, 24), (3, 0, 4)]) == [(2, 8, 24)]
    assert pd.well_formed(3, "415-555-1234") and pd.well_formed(3, "1.415.555.1234") and pd.well_formed(2, "4111.1111.1111-1111")
    assert not pd.well_formed(3, "415-55-1234") and not pd.well_formed(3, "4155551234") and not pd.well_formed(3, "415-555.1234") and not pd.well_formed(2, "4111.1111.1111.1112")
    assert pd.reconcile("x4111111111111111", [], [(2, 1, 17)]) == []  # not alone
    assert pd.reconcile("a@b.cc 1.2.3.4", [(0, 0, 6)], [(0, 0, 6), (1, 7, 14)]) == [(0, 0, 6), (1, 7, 14)]


# --- 10: fingerprints


def shingles(t):
    w = words_of(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_edit_fingerprints(spark):
    rows = [r for r in dict.fromkeys(corpus()) if r[0] is not None]
    got = {r.doc_id: r for r in fingerprints.edit_fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(order)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    by_text = {}
    for i, (d, t, *_) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        changed = fingerprints.edited(t, following)
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(shingles(t), shingles(changed)), abs=0.2)
        assert r.near_next == pytest.approx(jaccard(shingles(t), shingles(following)), abs=0.2)
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint


def test_edit_fingerprints_of_awkward_tables(spark):
    one = fingerprints.edit_fingerprints(frame(spark, [(1, "a b c d e f", "en", "s", 0)])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(1, 1.0)]  # its own successor
    assert fingerprints.edit_fingerprints(frame(spark, [])).count() == 0
    assert fingerprints.edit_fingerprints(frame(spark, corpus())).count() == len(corpus())


def test_edit_order_of_repeated_ids(spark, monkeypatch):
    """Many rows without an id, cut into parts by their hashes: each has one successor, and only
    the last row of all goes back to the first."""
    rows = [(None, f"row {k} of many with no id", "en", "s", 0) for k in range(400)] + [(k, f"text {k} here", "en", "s", 0) for k in range(50)]
    got = fingerprints.edit_fingerprints(frame(spark, rows)).collect()
    order = [t for _, t, *_ in sorted(rows[400:], key=lambda r: -r[0])] + [r.text for r in spark.createDataFrame([r[:2] for r in rows[:400]], "doc_id long, text string").selectExpr("text", "xxhash64(text) h").orderBy("h").collect()]
    wanted = Counter(hashlib.sha256(fingerprints.edited(t, following).encode()).hexdigest() for t, following in zip(order, [*order[1:], order[0]], strict=True))
    assert Counter(r.edited_sha256 for r in got) == wanted


@pytest.mark.parametrize("parts", ["1", "3", "8"])
def test_edit_order_with_one_null_id(spark, parts):
    """The row without an id is the last, whatever rows share its task."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for ids in ([3, 2, None], [*range(-20, 20), None], [None, 5]):
            rows = [(i, f"text of {i} with some words here", "en", "s", 0) for i in ids]
            order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
            wanted = {i: hashlib.sha256(fingerprints.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest() for k, (i, t, *_) in enumerate(order)}
            for docs in (frame(spark, rows), frame(spark, rows).coalesce(1)):
                assert {r.doc_id: r.edited_sha256 for r in fingerprints.edit_fingerprints(docs).collect()} == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_many_languages_share_the_table(spark, monkeypatch):
    monkeypatch.setattr(language, "CELLS", 1 << 13)
    rows = [(i, f"{w} {w}er {w}ing" * 5, f"l{k}", "s", 0) for k, w in enumerate(["alpha", "bravo", "carol", "delta"]) for i in range(k * 10, k * 10 + 10)]
    model = language.learn(frame(spark, rows))
    assert model.scores.shape == (2048, 4)
    assert {(r.doc_id, r.lang_pred) for r in language.identify(frame(spark, rows), model).collect()} == {(i, lang) for i, _, lang, *_ in rows}


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(8)
    a = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(4000))
    b = a[: len(a) // 2] + " " + " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(2000))
    import pyarrow as pa

    sa, sb, whole = fingerprints.sketches(pa.array([a, b, a]))
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert fingerprints.resemblance(sa, sb) == pytest.approx(true, abs=0.15)
    assert fingerprints.containment(sb, sa) == pytest.approx(len(shingles(a) & shingles(b)) / len(shingles(b)), abs=0.2)
    assert fingerprints.distinct_shingles(sa) == pytest.approx(len(shingles(a)), rel=0.35)
    assert (fingerprints.from_text(fingerprints.to_text(sa)) == whole).all()
    parts = spark.createDataFrame([("k", [int(x) for x in sa]), ("k", [int(x) for x in sb])], "key string, sketch array<bigint>")
    assert fingerprints.merge_sketches(parts, "key").first().sketch == fingerprints.merge(sa, sb).tolist()
    assert ordered(fingerprints.sketch_documents(frame(spark)).select("doc_id").collect()) == ordered((r[0],) for r in corpus())
