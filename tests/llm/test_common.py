from __future__ import annotations

import random

import pyarrow as pa
import pytest

from tidemark.llm import common
from tidemark.llm.byte_bpe import ByteBpe
from tidemark.llm.common import cut, runs


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_runs_are_whole_or_marked(limit):
    rng = random.Random(limit)
    for _ in range(60):
        keys = sorted(rng.choices(range(rng.randint(1, 8)), k=rng.randint(0, 40)))
        rows, batches = list(enumerate(keys)), []
        while rows:
            n = rng.randint(1, 7)
            part, rows = rows[:n], rows[n:]
            batches.append(pa.RecordBatch.from_pydict({"i": [i for i, _ in part], "k": [k for _, k in part]}))
        seen, whole = [], set()
        for table, over in runs(iter(batches), ["k"], limit):
            own = table.column("k").to_pylist()
            seen += table.column("i").to_pylist()
            if over:
                assert len(set(own)) == 1 and keys.count(own[0]) > limit and own[0] not in whole
            else:
                for k in set(own):
                    assert own.count(k) == keys.count(k) <= limit
                whole |= set(own)
        assert seen == list(range(len(keys)))


def test_cut_reads_back_what_was_written(spark):
    df = spark.range(5).selectExpr("id", "array(id, null) as a", "cast(null as string) as s")
    again = cut(df)
    assert again.schema.simpleString() == df.schema.simpleString() and sorted(again.collect()) == sorted(df.collect())
    assert all(r.s is None for r in again.collect())


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_slices_keep_all_rows_in_order(monkeypatch, limit):
    monkeypatch.setattr(common, "BATCH_BYTES", limit)
    texts = ["", None, "a" * 100, "b", "c" * 7]
    batches = [pa.RecordBatch.from_pydict({"t": pa.array(t, pa.string())}) for t in (texts, [], texts[:1])]
    out = list(common._slices(iter(batches)))
    assert [x for b in out for x in b.column(0).to_pylist()] == texts + texts[:1]
    assert limit > 1 or all(b.num_rows <= 1 for b in out)


def test_texts_are_taken_apart_between_words_only():
    assert ByteBpe.split("a b  c\n d e") == ["a", " b  c\n d", " e"]
    assert ByteBpe.split(" a b") == [" a", " b"]
    assert ByteBpe.split("a b") == ["a", " b"]
    assert ByteBpe.split("") == []
