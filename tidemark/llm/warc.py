"""WARC archives (operator 12): written by Spark's text writer, read back by verified boundary chains.

Writing: one record for each page.  Of pages with equal payloads the one with the largest id is
a response, which holds the payload; the others are revisits, which name it and its digest.  A record
ends with an empty line, as a row of the text writer does whose line separator is two line ends.

Reading: Spark's text reader, with the archives' magic as line separator, cuts files of any size
at candidate records; some lie inside payloads.  Each task knows where its split's candidates begin, by their
headers where each one's successor would, and where a chain that enters the split at a candidate leaves it.
Split sizes add up to places in the file; pointer jumping over the splits' entries, from the start of the file,
finds where the true chain enters each split, and a second pass over the narrow table of candidates follows
it inside.  Only records on the chain count.  Payloads are digested where they are read; a record whose payload holds
a magic is put together from its lines by a further scan, which is left out where there is none.

Edge cases: a null payload is empty; equal ids with equal payloads that are the largest are
responses each (their record ids are equal too); pages without an id are responses where no page with an id has their payload, else
revisits; payloads are taken whole; control characters of addresses are percent-encoded; files without the magic at
their start have no records; a chain ends behind a record that no other follows, and before one that doesn't end where its length says; a revisit of a record that isn't there has a null length;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import HOT_SHARE, arrow_map, cut, discard, is_empty, join_of_keys, named, scratch, shuffles_end

#: Fixed values of the format.
MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A record's magic follows the end of a line; no part of this begins again inside it.
SEPARATOR = "\n" + MAGIC
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MAGIC, _BEFORE, _SEPARATOR = MAGIC.encode(), len(MAGIC), len(SEPARATOR)


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 160-bit number given in hexadecimal digits: four letters for each five digits."""
    fives = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letters = F.transform(fives, lambda x: F.concat(*(F.substr(F.lit(_ALPHABET), F.shiftright(x, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4))))
    return F.array_join(letters, "")


#: Cells that hashes of repeated payloads are marked in: as many rows at most are broadcast.
CELLS = 1 << 18


def _with_largest(page: DataFrame) -> DataFrame:
    """page with the largest page_id of those with its payload.

    Only pages whose payload may be repeated are shuffled: those in a marked cell.  Pages of hot
    payloads, with over a thousandth of all pages each, get theirs by broadcast."""
    cell = F.pmod(F.xxhash64("content"), F.lit(CELLS))
    counted = cut(page.groupBy("digest", "content").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1"))
    with shuffles_end(page.sparkSession):
        total = page.count()
    hot = counted.where(F.col("n") > total * HOT_SHARE).select("content", F.col("largest").alias("of hot"), F.lit(True).alias("hot"))
    marked = counted.select(cell.alias("cell")).distinct().withColumn("marked", F.lit(True))
    told = page.withColumn("cell", cell).join(F.broadcast(marked), "cell", "left").join(F.broadcast(hot), "content", "left")
    alone = told.where("marked is null or hot").withColumn("largest", F.when(F.col("hot"), F.col("of hot")).otherwise(F.col("page_id")))
    others = told.where("marked and hot is null").join(counted.select("content", "largest", F.lit(True).alias("again")), "content", "left")
    others = others.withColumn("largest", F.when(F.col("again"), F.col("largest")).otherwise(F.col("page_id")))
    return alone.select(*page.columns, "largest").unionByName(others.select(*page.columns, "largest"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The records of pages as text (without the empty line behind each); date stands in all of them."""
    page = pages.select(named(id_col).cast("long").alias("page_id"), F.coalesce(named(url_col), F.lit("")).alias("url"), F.coalesce(named(payload_col), F.lit("")).alias("payload"))
    page = _with_largest(page.withColumns({"digest": F.sha1("payload"), "content": F.sha2("payload", 256)}))
    own = F.col("page_id").eqNullSafe(F.col("largest"))
    record_id = lambda c: F.concat(F.lit("<urn:md5:"), F.md5(F.concat_ws(" ", F.coalesce(c.cast("string"), F.lit("none")), "content")), F.lit(">"))
    clean = F.replace("url", F.lit("\r"), F.lit("%0D"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.when(own, F.concat(http, "payload")).otherwise(http)
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    header = F.concat_ws(
        "\r\n",
        field("WARC-Type", F.when(own, F.lit("response")).otherwise(F.lit("revisit"))),
        field("WARC-Record-ID", record_id(F.col("page_id"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.replace(clean, F.lit("\n"), F.lit("%0A"))),
        field("Page-ID", F.col("page_id").cast("string")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))),
        F.when(~own, field("WARC-Profile", F.lit(REVISIT_PROFILE))),
        F.when(~own, field("WARC-Refers-To", record_id(F.col("largest")))),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
    )
    return page.select(F.concat(F.lit(MAGIC), header, F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    """Archives of pages below path, a file for each task.  columns: see records()."""
    with shuffles_end(pages.sparkSession):
        records(pages, **columns).write.mode("overwrite").option("lineSep", END).text(path)


class Head(NamedTuple):
    """What a record's header says, and where its block begins and ends behind the magic."""

    fields: dict[str, str]
    start: int
    end: int


def head(content: bytes) -> Head | None:
    """The header of a record given from behind its magic; None if that is no header."""
    stop = content.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields = {}
    for line in content[:stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 19):
        return None
    return Head(fields, stop + 4, stop + 4 + int(length))


def payload(block: bytes, fields: dict[str, str]) -> bytes:
    """What follows the HTTP header, or the block where there is none."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


#: Columns that say what a record holds.
_FIELDS = "type string, record_id string, uri string, page_id bigint, refers_to_id string, digest string, payload_bytes bigint, payload_digest string, payload binary"


def _told(fields: dict[str, str], block: bytes | None, with_payload: bool) -> tuple:
    """The values of _FIELDS; block: None where it isn't whole yet."""
    own = payload(block, fields) if block is not None else None
    digest = base64.b32encode(hashlib.sha1(own).digest()).decode() if own is not None else None
    number = fields.get("page-id", "")
    page = int(number) if number.lstrip("-").isdigit() and -(1 << 63) <= int(number) < 1 << 63 else None
    said = fields.get("warc-payload-digest", "")
    return fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), page, fields.get("warc-refers-to"), said.removeprefix("sha1:") or None, None if own is None else len(own), digest, own if with_payload else None


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in text.split(", "))])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    where = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "split"))]
    return spark.read.option("lineSep", SEPARATOR).option("recursiveFileLookup", "true").text(path).select(*where, F.col("value").cast("binary").alias("value"))


class _Split:
    """Walks the lines of a split: their numbers and the places, in the split, where their content begins."""

    def __init__(self) -> None:
        self.key, self.line, self.place = None, 0, 0

    def next(self, file: str, split: int, size: int) -> tuple[int, int, bool]:
        """Number and place of a line of size bytes, and whether a split begins with it."""
        new = (file, split) != self.key
        if new:
            self.key, self.line, self.place = (file, split), 0, 0
        at = self.line, self.place
        self.line, self.place = self.line + 1, self.place + size + _SEPARATOR
        return *at, new


_CANDIDATES = "file string, split bigint, line bigint, total bigint, begins bigint, next bigint, exit bigint, whole boolean, " + _FIELDS


def candidates(spark: SparkSession, path: str, with_payload: bool) -> DataFrame:
    """A row for each line of each split: where its magic would begin, where its successor and where the chain
    from it leaves the split, all counted from the split's first line; total: bytes of the split's lines."""
    schema = _schema(_CANDIDATES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, rows = _Split(), []

        def close() -> Iterator[pa.RecordBatch]:
            """The split's rows; a chain's exit is found from the end."""
            leaves: dict[int, int | None] = {}
            exits = []
            for *_, begins, following, _whole, _told_ in reversed(rows):
                out = following
                if following is not None and following < walk.place - _BEFORE:
                    out = leaves.get(following)
                leaves[begins] = out
                exits.append(out)
            for first in range(0, len(rows), 1024):
                some = [(*r[:3], walk.place, r[3], r[4], e, r[5], *r[6]) for r, e in zip(rows[first : first + 1024], exits[::-1][first : first + 1024], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for file, split, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (file, split) != walk.key and rows:
                    yield from close()
                    rows = []
                line, place, _ = walk.next(file, split, len(value))
                skipped = 0
                if line == 0 and split == 0:  # the start of the file: its magic follows no line end
                    skipped = _BEFORE if value.startswith(_MAGIC) else -1
                found = head(value[skipped:]) if skipped >= 0 else None
                told, following, whole = (None,) * len(_FIELDS.split(", ")), None, False
                if found is not None:
                    end = skipped + found.end
                    behind = value[end : end + 4]
                    whole = behind == b"\r\n\r\n" or (behind == b"\r\n\r" and end + 3 == len(value))  # the line feed is the separator's
                    if whole or end + 3 > len(value):  # what isn't whole goes on in further lines
                        following = place + end + 4
                        told = _told(found.fields, value[skipped + found.start : end] if whole else None, with_payload)
                rows.append((file, split, line, place + max(skipped, 0) - _BEFORE, following, whole, told))
        if rows:
            yield from close()

    return arrow_map(_lines(spark, path), scan, _CANDIDATES)


def _entries(chain: DataFrame) -> DataFrame:
    """file, at of the candidates through which the chains from the files' starts enter splits, by pointer jumping:
    each round doubles how many splits a jump passes."""
    landed = chain.select("file", F.col("exit").alias("at")).where("at is not null").unionByName(chain.where("at = 0").select("file", "at")).distinct()
    jumps = cut(chain.select("file", "at", "exit").join(landed, ["file", "at"]))
    reached = cut(jumps.where("at = 0").select("file", "at"))
    while True:
        there = jumps.select("file", F.col("at").alias("exit"), F.col("exit").alias("beyond"))
        new = cut(reached.join(jumps, ["file", "at"]).select("file", F.col("exit").alias("at")).join(jumps.select("file", "at"), ["file", "at"]).distinct().join(reached, ["file", "at"], "left_anti"))
        if is_empty(new):
            discard(new, jumps)
            return reached
        further = cut(jumps.join(there, ["file", "exit"], "left").select("file", "at", F.col("beyond").alias("exit")))
        both = cut(reached.unionByName(new))
        discard(new, jumps, reached)
        jumps, reached = further, both


def _on_chain(chain: DataFrame, entries: DataFrame) -> DataFrame:
    """file, split, line, at, next of the candidates on their file's chain."""
    marked = chain.select("file", "split", "line", "at", "next").join(entries.withColumn("enters", F.lit(True)), ["file", "at"], "left")
    schema = "file string, split bigint, line bigint, at bigint, next bigint"

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = expected = None
        for batch in batches:
            keep = []
            for i, (file, split, at, following, enters) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "split", "at", "next", "enters")), strict=True)):
                if (file, split) != key:
                    key, expected = (file, split), None
                if enters or at == expected:
                    keep.append(i)
                    expected = following
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("file", "split", "line", "at", "next")], ["file", "split", "line", "at", "next"])

    dealt = marked.select("file", "split", "line", "at", "next", "enters").repartition("file", "split").sortWithinPartitions("file", "split", "at")
    return arrow_map(dealt, follow, schema)


#: Spans of bytes by which lines meet the records that they are part of.
_REACH = 20


def _put_together(spark: SparkSession, path: str, parts: DataFrame, chain: DataFrame, with_payload: bool) -> DataFrame:
    """The records (file, at, next) of parts, whose payloads hold a magic, from all their lines."""
    spans = parts.select("file", F.col("at").alias("record"), F.col("next").alias("until"), F.explode(F.sequence(F.shiftright("at", _REACH), F.shiftright(F.col("next") - 1, _REACH))).alias("reach"))
    lines = chain.select("file", "split", "line", "at", F.shiftright("at", _REACH).alias("reach"))
    wanted = cut(lines.join(spans, ["file", "reach"]).where("at >= record and at < until").select("file", "split", "line", "record", "until", "at"))
    schema = _schema("file string, split bigint, line bigint, value binary")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Split()
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(2)).to_pylist()
            lines = [walk.next(f, s, n)[0] for f, s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.int64()), batch.column(2)], schema=schema)

    pieces = arrow_map(_lines(spark, path), number, "file string, split bigint, line bigint, value binary").join(wanted, ["file", "split", "line"])
    whole = pieces.groupBy("file", F.col("record").alias("at"), F.col("until").alias("next")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("at").alias("place"), "value"))), lambda x: x["value"]).alias("lines"))
    out = _schema("file string, at bigint, next bigint, " + _FIELDS)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at, following, parts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                content = SEPARATOR.encode().join(parts)
                content = content[_BEFORE:] if at == 0 else content
                found = head(content)
                if content[found.end : found.end + 4] not in (b"\r\n\r", b"\r\n\r\n"):
                    continue  # the length that it gives leads into other records
                row = file, at, following, *_told(found.fields, content[found.start : found.end], with_payload)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out, strict=True)], schema=out)

    return arrow_map(whole.select("file", "at", "next", "lines"), parse, "file string, at bigint, next bigint, " + _FIELDS)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the uncompressed archives below path: file, at, next (bytes from the file's start), type, record_id, uri,
    page_id, refers_to_id, digest (as the header says), payload_bytes, payload_digest (as read) and, if asked for, payload."""
    found = cut(candidates(spark, path, with_payload))
    totals = found.groupBy("file", "split").agg(F.max("total").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.join(totals.select("file", "split", before.alias("base"), (F.sum("total").over(Window.partitionBy("file")) - _SEPARATOR).alias("file_bytes")), ["file", "split"])
    names = [c.split(" ")[0] for c in _FIELDS.split(", ")]
    # the first line of a file begins with its magic, so that its candidate stands at 0
    chain = cut(placed.select("file", "split", "line", (F.col("base") + F.col("begins")).alias("at"), (F.col("base") + F.col("next")).alias("next"), (F.col("base") + F.col("exit")).alias("exit"), "whole", "file_bytes"))
    entries = _entries(chain)
    kept = cut(_on_chain(chain, entries))
    on = found.join(kept, ["file", "split", "line"]).where("whole").select("file", "at", kept["next"], *names)
    parts = kept.join(chain.where("not whole and next <= file_bytes").select("file", "split", "line"), ["file", "split", "line"])
    if is_empty(parts):
        discard(chain, entries)
        return on
    return on.unionByName(_put_together(spark, path, parts, chain, with_payload))


def resolve(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records; a revisit's payload is that of
    the record it names.  found must be a table that cut() wrote."""
    revisit = F.col("type") == "revisit"
    own = found.where(~revisit | F.col("type").isNull()).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = found.where(revisit).select("page_id", "digest", F.coalesce("refers_to_id", F.lit("")).alias("refers_to_id"))
    if is_empty(again):
        return own
    held = found.where(~revisit).groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    asked = again.groupBy("refers_to_id").agg(F.count("*").alias("revisits"))
    table = cut(asked.join(held, asked["refers_to_id"] == held["record_id"], "left").drop("record_id"))
    seen = join_of_keys(again, table, ["refers_to_id"], "revisits")
    return own.unionByName(seen.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolve(cut(read_archives(spark, path)))
