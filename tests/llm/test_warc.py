"""WARC archives (12): round trips, and chains against a plain sequential reader."""

from __future__ import annotations

import base64
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import ordered
from tidemark.llm import registry, warc
from tidemark.llm.common import cut

SCHEMA = "page_id long, url string, html string"


def fake(n=9):
    """What looks like a whole record, as text."""
    return f"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nPage-ID: 77\r\nContent-Type: text/plain\r\nContent-Length: {n}\r\n\r\n" + "x" * 9 + "\r\n\r\n"


def pages():
    rows = [(i, f"http://h/{i}", f"<p>page {i} Ünï\U0001f4a3</p>" * (i % 7)) for i in range(60)]
    rows += [(100 + i, "http://copies", "<b>copy</b>") for i in range(30)]
    rows += [(200, None, None), (201, "http://e", ""), (202, "http://a\r\nContent-Length: 3\n", "<i>")]
    rows += [(300, "http://ends-in/WARC/1.1", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (301, "u", "a" + fake() + "b"), (302, "u", fake()), (303, "u", fake(3)), (304, "u", fake() * 3 + "\r\n"), (305, "u", "text\r\n\r\n"), (306, "u", "\n"), (307, "u", "WARC/1.1\r\n")]
    rows += [(400, "u", "y" * 300_000 + fake() + "z" * 300_000 + fake(10**6))]  # over many splits
    rows += [(500, "u", "twice"), (500, "u", "twice"), (499, "u", "twice"), (None, "u", "twice"), (None, "u", "only without an id"), (None, "v", "only without an id")]
    return rows


def frame(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("payload", "digest", "content", "largest", "a.b", "value"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs.repartition(3)


def wanted(rows):
    largest = {}
    for i, _, t in rows:
        if i is not None:
            largest[t or ""] = max(i, largest.get(t or "", i))
    out = []
    for i, _, t in rows:
        t = t or ""
        own = largest.get(t) == i
        digest = base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
        out.append((i, len(t.encode()), digest, "response" if own else "revisit", None if own else largest.get(t)))
    return out


def read_plainly(folder):
    """Every record, one behind the other from each file's start."""
    out = []
    for name in sorted(os.listdir(folder)):
        if name.startswith(("_", ".")):
            continue
        data, at = open(f"{folder}/{name}", "rb").read(), 0
        while at < len(data):
            assert data[at : at + 10] == b"WARC/1.1\r\n"
            head, _, _ = data[at + 10 :].partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n"))
            begin = at + 10 + len(head) + 4
            end = begin + int(fields["Content-Length"])
            assert data[end : end + 4] == b"\r\n\r\n"
            out.append((at, end + 4, int(fields["Page-ID"]) if "Page-ID" in fields else None, fields["WARC-Type"], data[begin:end].partition(b"\r\n\r\n")[2]))
            at = end + 4
    return out


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_query(spark, tmp_path):
    frame(spark, pages()).write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES["op12_warc"](spark, str(tmp_path)).collect()
    assert ordered(tuple(r[c] for c in COLUMNS) for r in got) == ordered(wanted(pages()))


@pytest.mark.parametrize("split", ["64k", "100001b", "1g"])
def test_chains_over_splits(spark, tmp_path, split):
    """Small splits: records begin in one and end in another, and fakes stand between."""
    path = f"{tmp_path}/w"
    warc.write_archives(frame(spark, pages()).coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.read_archives(spark, path, with_payload=True).collect()
    finally:
        for k, v in zip(("maxPartitionBytes", "openCostInBytes"), before, strict=True):
            spark.conf.set(f"spark.sql.files.{k}", v)
    plain = read_plainly(path)
    assert len(plain) == len(pages())
    assert ordered((r["at"], r["next"], r.page_id, r.type, bytes(r.payload)) for r in got) == ordered(plain)


def test_only_chained_records_count(spark, tmp_path):
    """A file that isn't an archive, a chain that breaks, and a revisit of nothing."""
    good = b"WARC/1.1\r\nWARC-Type: resource\r\nPage-ID: 1\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    broken = good.replace(b"Length: 2", b"Length: 5")
    lone = b"WARC/1.1\r\nWARC-Type: revisit\r\nPage-ID: 2\r\nWARC-Refers-To: <x>\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    os.makedirs(f"{tmp_path}/w")
    for name, data in (("a", good * 2 + lone), ("b", b"junk" + good), ("c", good + broken + good), ("d", b""), ("e", good + b"trailing junk")):
        with open(f"{tmp_path}/w/{name}.warc", "wb") as f:
            f.write(data)
    found = cut(warc.read_archives(spark, f"{tmp_path}/w"))
    per_file = {r.file[-6:]: r["n"] for r in found.groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert per_file == {"a.warc": 3, "c.warc": 1, "e.warc": 1}
    got = [tuple(r[c] for c in COLUMNS) for r in warc.resolve(found).collect()]
    assert (2, None, "ABC", "revisit", None) in got and len(got) == 5


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert registry.QUERIES["op12_warc"](spark, str(tmp_path)).collect() == []
