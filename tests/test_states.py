"""Keyed state over several micro-batches: expiry of each cache, retries that come back later."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tidemark.streaming import states, windows

T = datetime(2024, 1, 1)


def stream(spark, tmp_path, schema, *batches):
    """Each list of rows is a file, and a micro-batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")


@pytest.mark.parametrize("kind", sorted(states.TTL_SECONDS))
def test_each_cache_forgets_in_its_time(spark, tmp_path, kind):
    ttl = timedelta(seconds=states.TTL_SECONDS[kind])
    just = timedelta(milliseconds=1)
    rows = stream(spark, tmp_path, "kind string, key string, at timestamp", [(kind, "a", T), (kind, "b", T), (kind, "a", T + just), ("unknown", "a", T), (kind, None, T)], [(kind, "a", T + ttl - just), (kind, "b", T + ttl)], [(kind, "a", T + ttl), (kind, "b", T + ttl + ttl / 2), (kind, "c", T + 9 * ttl)], [(kind, "a", T + 9 * ttl)])
    got = sorted((r.key, r.at - T) for r in windows.drain(states.once_within(rows)).collect())
    assert got == [("a", timedelta(0)), ("a", ttl), ("a", 9 * ttl), ("b", timedelta(0)), ("b", ttl), ("c", 9 * ttl)]


def test_kinds_have_their_own_time(spark, tmp_path):
    at = [T + timedelta(hours=h) for h in range(6)]
    rows = stream(spark, tmp_path, "kind string, key string, at timestamp", *[[("url", "x", t), ("web", "x", t)] for t in at])
    got = sorted((r.kind, (r.at - T).seconds // 3600) for r in windows.drain(states.once_within(rows)).collect())
    assert got == [("url", 0), ("url", 4), *(("web", h) for h in range(6))]


def test_a_failure_comes_back_in_a_later_batch(spark, tmp_path):
    """Three attempts at most; a success clears the count and what is due after it."""
    m = lambda k: T + timedelta(minutes=k)
    rows = stream(
        spark, tmp_path, "key string, at timestamp, ok boolean",
        [("a", m(0), False), ("b", m(0), False), ("c", m(0), True), ("d", m(0), False)],
        [("a", m(10), False), ("b", m(3), True), ("d", m(5), True)],  # d's success is just when it is due: it has come back
        [("a", m(20), False), ("a", m(21), False), ("b", m(30), False)],
        [("a", m(40), True), ("a", m(41), False), ("x", m(1000), None), (None, m(1000), False)],
        [("y", m(1000), True)],
    )
    got = sorted((r.key, r.attempt, int((r.due - T).total_seconds() // 60)) for r in windows.drain(states.retries(rows, 300, late="5 minutes")).collect())
    assert got == [("a", 2, 5), ("a", 2, 46), ("a", 3, 15), ("b", 2, 35), ("d", 2, 5)]


def test_a_snapshot_then_increments_then_heartbeats(spark, tmp_path):
    """Batches that come while the query runs; when nothing comes, a heartbeat for each topic."""
    import time

    from tidemark.streaming.increments import pushed

    schema, sent = "topic string, value double", []

    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def wait(done):
        until = time.time() + 60
        while not done() and time.time() < until:
            time.sleep(0.2)
        assert done(), sent

    put(("a", 1.0), ("a", None), ("b", 2.0), (None, 1.0))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = pushed(stream, 2).writeStream.outputMode("update").foreachBatch(lambda batch, _: sent.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    try:
        wait(lambda: len(sent) >= 2)
        assert sorted(sent[:2]) == [("a", "snapshot", 2, 1.0), ("b", "snapshot", 1, 2.0)]
        wait(lambda: {r[0] for r in sent if r[1] == "heartbeat"} == {"a", "b"})
        put(("a", 5.0), ("c", 1.0))
        wait(lambda: ("a", "increment", 1, 5.0) in sent and ("c", "snapshot", 1, 1.0) in sent)
        told = len(sent)
        wait(lambda: {r[0] for r in sent[told:] if r[1] == "heartbeat"} == {"a", "b", "c"})
    finally:
        query.stop()
