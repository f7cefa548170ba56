"""A data source over landed feeds: spark.read.format("feeds") and spark.readStream.format("feeds").

Payloads lie below a root as <source>/<item>.  The same payloads can lie below several roots, the
mirrors.  A source is a partition; in it each item is asked of the mirrors in order until one answers
with a payload that is accepted.  Nothing raises: an item that no mirror has gives a row without a payload that
says why, and so does a source without any.  Roots are what pyarrow reads (files, s3, gs, hdfs) or http, where items can't
be listed and are given.

A stream's offset is the last item of each source in order of names (fetchers name items by time): a
batch reads what came after it, and one that is tried again reads the same items again.

Options: mirrors (comma list of roots), sources (comma list), items (comma list; else they are listed), folder (how a
source's folder is called, `{source}` stands for its name), accept (a pattern that a payload must have), timeout (seconds).
"""

from __future__ import annotations

import re
import urllib.request
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "feeds"
SCHEMA = "source string, item string, mirror string, payload string, fetched_at timestamp, error string"


class Answer(NamedTuple):
    payload: str
    at: datetime


def _split(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


class Mirrors:
    """The roots and how payloads are asked of them."""

    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.roots, self.sources = _split(options.get("mirrors") or options.get("path")), _split(options.get("sources"))
        self.given, self.accept = _split(options.get("items")), options.get("accept")
        self.folder, self.timeout = options.get("folder", "{source}"), float(options.get("timeout", "12"))
        if not self.roots or not self.sources:
            raise ValueError("a feed needs mirrors and sources")

    def where(self, root: str, source: str) -> str:
        return f"{root.rstrip('/')}/{self.folder.replace('{source}', source)}"

    def items(self, source: str) -> list[str]:
        """Names of the source's items in order, of all mirrors that answer."""
        if self.given:
            return sorted(self.given)
        found: set[str] = set()
        for root in self.roots:
            if root.startswith("http"):
                continue
            try:
                system, path = fs.FileSystem.from_uri(self.where(root, source))
                found |= {f.base_name for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name[0] not in "._"}
            except (OSError, ValueError):
                continue  # the next mirror is asked
        return sorted(found)

    def ask(self, root: str, source: str, item: str) -> Answer:
        """The payload as that mirror has it; raises where it has none that is accepted."""
        where = f"{self.where(root, source)}/{item}"
        if root.startswith("http"):
            with urllib.request.urlopen(where, timeout=self.timeout) as answer:  # noqa: S310  http only, by the root
                raw, at = answer.read(), datetime.now(UTC)
        else:
            system, path = fs.FileSystem.from_uri(where)
            with system.open_input_stream(path) as f:
                raw = f.read()
            at = system.get_file_info(path).mtime or datetime.now(UTC)
        payload = raw.decode("utf-8", "replace")
        if not payload.strip():
            raise ValueError("the payload is empty")
        if self.accept and not re.search(self.accept, payload):
            raise ValueError("the payload is not what is accepted")
        return Answer(payload, at)

    def fetch(self, source: str, items: Sequence[str]) -> Iterator[tuple]:
        """A row for each item, of the first mirror that answers."""
        for item in items:
            errors = []
            for root in self.roots:
                try:
                    found = self.ask(root, source, item)
                except Exception as e:  # noqa: BLE001  a mirror's failure is data: the next one is asked
                    errors.append(f"{root}: {e}")
                    continue
                yield source, item, root, found.payload, found.at, None
                break
            else:
                yield source, item, None, None, datetime.now(UTC), "; ".join(errors)


class OfSource(InputPartition):
    """A source and the items that are read of it; None for all."""

    def __init__(self, source: str, items: tuple[str, ...] | None = None):
        super().__init__(source)
        self.source, self.items = source, items


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.mirrors = Mirrors(options)

    def partitions(self) -> Sequence[InputPartition]:
        return [OfSource(s) for s in self.mirrors.sources]

    def read(self, partition: OfSource) -> Iterator[tuple]:
        items = self.mirrors.items(partition.source)
        if not items:
            yield partition.source, None, None, None, datetime.now(UTC), "no mirror has an item"
        yield from self.mirrors.fetch(partition.source, items)


class FeedStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.mirrors = Mirrors(options)

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.mirrors.sources, "")

    def latestOffset(self) -> dict:
        return {s: max(self.mirrors.items(s), default="") for s in self.mirrors.sources}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for s in self.mirrors.sources:
            items = tuple(x for x in self.mirrors.items(s) if start.get(s, "") < x <= end.get(s, ""))
            if items:
                out.append(OfSource(s, items))
        return out

    def read(self, partition: OfSource) -> Iterator[tuple]:
        yield from self.mirrors.fetch(partition.source, partition.items or ())


class FeedSource(DataSource):
    """The format `feeds`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(dict(self.options))


def _options(mirrors: Sequence[str], sources: Sequence[str], **more: str) -> dict[str, str]:
    return {"mirrors": ",".join(mirrors), "sources": ",".join(sources), **more}


def read_feeds(spark: SparkSession, mirrors: Sequence[str], sources: Sequence[str], **options: str) -> DataFrame:
    """source, item, mirror, payload, fetched_at, error of all items of the sources, now."""
    spark.dataSource.register(FeedSource)
    return spark.read.format(FORMAT).options(**_options(mirrors, sources, **options)).load()


def stream_feeds(spark: SparkSession, mirrors: Sequence[str], sources: Sequence[str], **options: str) -> DataFrame:
    """The same as a stream of what arrives."""
    spark.dataSource.register(FeedSource)
    return spark.readStream.format(FORMAT).options(**_options(mirrors, sources, **options)).load()


def articles(landed: DataFrame, parsers: dict) -> list[DataFrame]:
    """The articles of each source that has a parser, for base.fan_in."""
    return [parse(landed.where((landed["source"] == name) & landed["payload"].isNotNull()).select("payload", "fetched_at")) for name, parse in parsers.items()]
