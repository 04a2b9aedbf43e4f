"""Hit labels against a walk over each post's events, batch and stream."""

import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators.cachehits import cache_hit_labels
from trailmark.streaming.hit_labels import finish_hit_labels, read_hit_labels, stream_hit_labels
from trailmark.streaming.hit_state import request_and_save_events, stream_cache_hit

SCHEMA = "id long, post_id long, created_at string"


def walk(requests, saves, ttl):
    out = {}
    for post in {p for _, p, _ in requests}:
        events = [(t, 0, None) for p, t in saves if p == post] + [(t, 1, i) for i, p, t in requests if p == post]
        until = None
        for t, kind, i in sorted(events, key=lambda e: (e[0], e[1], e[2] or 0)):
            if kind == 0:
                until = None
            else:
                out[i] = int(until is not None and t <= until)
                if not out[i]:
                    until = t + ttl if ttl else float("inf")
    return out


def frames(spark, requests, saves):
    def at(column):
        return F.timestamp_add("SECOND", F.col(column), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))

    asked = spark.createDataFrame(requests, "id long, post_id long, s long").withColumn("created_at", at("s")).drop("s")
    kept = spark.createDataFrame(saves, "post_id long, s long").withColumn("saved_at", at("s")).drop("s")
    return asked, kept


def sample(seed, n, span):
    rng = random.Random(seed)
    # Post 1 draws a third of all requests.
    requests = [(i, 1 if rng.random() < 0.34 else rng.randint(2, 6), rng.randrange(span)) for i in range(n)]
    saves = [(rng.randint(1, 6), rng.randrange(span)) for _ in range(n // 10)]
    return requests, saves


@pytest.mark.parametrize(("seed", "n", "span", "ttl"), [(1, 400, 3000, 60), (2, 300, 100_000, 3600), (3, 200, 500, 1), (4, 50, 90, 500), (6, 300, 400_000, 0)])
def test_batch_equals_walk(spark, seed, n, span, ttl):
    requests, saves = sample(seed, n, span)
    labels = cache_hit_labels(*frames(spark, requests, saves), ttl)
    assert {r.id: r.cache_hit for r in labels.collect()} == walk(requests, saves, ttl)


def test_edges(spark):
    requests = [(1, 7, 0), (2, 7, 0), (3, 7, 10), (4, 7, 11), (5, 7, 15), (6, 7, 15)]
    labels = cache_hit_labels(*frames(spark, requests, [(7, 15)]), 10)
    # live through second 10, missed at 11; the save in second 15 precedes the requests of it
    assert {r.id: r.cache_hit for r in labels.collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1}


def test_stream_equals_walk_over_several_batches(spark, tmp_path):
    requests, saves = sample(5, 300, 5000)
    asked, kept = frames(spark, requests, saves)
    events = request_and_save_events(asked, kept)
    for i, edge in enumerate((0, 1500, 3000, 5000)[:-1]):
        low = 1704067200 + edge
        high = 1704067200 + (1500, 3000, 5001)[i]
        part = events.filter((F.col("at") >= low) & (F.col("at") < high)).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    try:
        writer = stream_cache_hit(stream, 60).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    labels = spark.read.parquet(str(tmp_path / "out"))
    assert {r.id: r.cache_hit for r in labels.collect()} == walk(requests, saves, 60)


@pytest.mark.parametrize(("seed", "ttl", "lateness"), [(7, 600, 0), (8, 0, 200)])
def test_labels_do_not_depend_on_files_and_triggers(spark, tmp_path, seed, ttl, lateness):
    """Both sources come in files of their own, cut at other times; with lateness, neighbouring files also overlap."""
    requests, saves = sample(seed, 300, 5000)
    asked, kept = frames(spark, requests, saves)
    start = 1704067200
    streams = []
    for name, table, column, cuts in (("asked", asked, "created_at", (0, 700, 2100, 5001)), ("kept", kept, "saved_at", (0, 3500, 5001))):
        rows = table.withColumn("s", F.unix_seconds(F.col(column).cast("timestamp")) - start)
        rows = rows.withColumn("file", F.col("s") + (F.pmod(F.xxhash64("s"), F.lit(lateness or 1)) if lateness else 0))
        for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
            top = 10**9 if i == len(cuts) - 2 else high
            part = rows.filter((F.col("file") >= low) & (F.col("file") < top)).drop("s", "file")
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    out, state = str(tmp_path / "labels"), str(tmp_path / "state")
    query = stream_hit_labels(request_and_save_events(*streams), out, state, ttl, lateness=lateness)
    query.awaitTermination()
    early = {r.id: r.cache_hit for r in read_hit_labels(spark, out).collect()}
    finish_hit_labels(spark, out, state, ttl)
    labels = read_hit_labels(spark, out).collect()
    want = walk(requests, saves, ttl)
    assert {r.id: r.cache_hit for r in labels} == want and len(labels) == len(want)
    assert 0 < len(early) < len(want) and all(want[k] == v for k, v in early.items())
