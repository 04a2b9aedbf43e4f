"""Streams over out-of-order input equal the batch result."""

import os

import pytest
from pyspark.sql import functions as F

from checks import queries
from checks.queries import QUERIES
from trailmark import bindings as b
from trailmark.operators import requests, traffic
from trailmark.sources import tables
from trailmark.streaming import jobs

SF = "/root/testdata/sf0.001"


def shuffled_events(spark, tmp_path):
    """The events in seven files, so that each micro-batch jumps back in time."""
    events, path = b.table(spark, SF, "events"), str(tmp_path / "in")
    for k in range(7):
        events.filter(F.col("event_id") % 7 == k).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return b.as_access_events(stream)


def test_classify_stream(spark, tmp_path):
    log, state, heard = str(tmp_path / "log"), str(tmp_path / "state"), []
    query = jobs.stream_classify(
        shuffled_events(spark, tmp_path), log, state, b.LOGGING, salt=b.SALT, logged=lambda rows, i: heard.append(i)
    )
    query.awaitTermination()
    stored, batch = tables.read_log(spark, log).drop("dt"), b.request_log(spark, SF)
    assert stored.count() == batch.count() and stored.exceptAll(batch).count() == 0
    assert heard == list(range(7))


def test_two_checkpoints_fill_one_log_and_prune_leaves_no_expired_row(spark, tmp_path):
    log = str(tmp_path / "log")
    events = shuffled_events(spark, tmp_path)
    for k in (0, 1):
        half = events.filter(F.col("id") % 2 == k)
        jobs.stream_classify(half, log, str(tmp_path / f"state{k}"), b.LOGGING, salt=b.SALT).awaitTermination()
    batch = b.request_log(spark, SF)
    assert tables.read_log(spark, log).count() == batch.count()
    tables.prune_log(spark, log, b.AS_OF, 7)
    left, kept = tables.read_log(spark, log).drop("dt"), traffic.retention_prune(batch, b.AS_OF, 7)
    assert left.count() == kept.count() and left.exceptAll(kept).count() == 0


def test_daily_hits_stream(spark, tmp_path):
    log = requests.classify(shuffled_events(spark, tmp_path), b.LOGGING, salt=b.SALT)
    out = str(tmp_path / "daily")
    jobs.stream_daily_hits(log, out, str(tmp_path / "state")).awaitTermination()
    rollup = tables.read_daily_hits(spark, out)
    batch = traffic.daily_bot_hits(b.request_log(spark, SF), b.AS_OF, 365)
    assert rollup.count() == batch.count() and rollup.select(batch.columns).exceptAll(batch).count() == 0


def test_streams_bound_generated_methods_in_any_session(spark, tmp_path, monkeypatch):
    """A session at Spark's own default would not compile the classification of a stream."""
    key, seen, merge, write = "spark.sql.codegen.hugeMethodLimit", [], jobs.merge_daily_hits, jobs.write_log_batch
    monkeypatch.setattr(jobs, "merge_daily_hits", lambda rows, *a: (seen.append(rows.sparkSession.conf.get(key)), merge(rows, *a)))
    monkeypatch.setattr(jobs, "write_log_batch", lambda rows, *a: (seen.append(rows.sparkSession.conf.get(key)), write(rows, *a)))
    events = b.as_access_events(queries.sample_stream(spark, SF, "events"))
    before = spark.conf.get(key)
    spark.conf.set(key, "65535")
    try:
        log = requests.classify(events, b.LOGGING, salt=b.SALT)
        jobs.stream_daily_hits(log, str(tmp_path / "daily"), str(tmp_path / "s0")).awaitTermination()
        jobs.stream_classify(events, str(tmp_path / "log"), str(tmp_path / "s1"), b.LOGGING, salt=b.SALT).awaitTermination()
        assert seen == ["8000", "8000"] and spark.conf.get(key) == "65535"
    finally:
        spark.conf.set(key, before)


def test_refresh_stream_converts_changed_posts_only(spark, tmp_path):
    store = str(tmp_path / "store")
    tables.write_store(spark, b.markdown_store(spark, SF), store, 4)
    saves = b.post_saves(spark, SF).filter("post_id IN (2, 3)")
    saves.unionByName(saves).coalesce(1).write.parquet(str(tmp_path / "saves"))
    stream = spark.readStream.schema(saves.schema).parquet(str(tmp_path / "saves"))
    jobs.stream_markdown_refresh(
        stream, lambda: b.posts(spark, SF), b.authors(spark, SF), store, str(tmp_path / "state"), as_of=b.AS_OF, buckets=4
    ).awaitTermination()
    rows = {r.post_id: r.markdown for r in tables.read_store(spark, store).collect()}
    before = {r.post_id: r.markdown for r in b.markdown_store(spark, SF).collect()}
    assert {k for k in rows if rows[k] != before.get(k)} == {2, 3}
    assert rows[2].startswith("# ") and "> Source: " in rows[2]


def foldered(spark, tmp_path):
    """The sample tables with events and pages as folders of files, as large tables come."""
    out = tmp_path / "tables"
    out.mkdir()
    for name in os.listdir(SF):
        if name in ("events.parquet", "pages.parquet"):
            spark.read.parquet(f"{SF}/{name}").repartition(3).write.parquet(str(out / name))
        else:
            os.symlink(f"{SF}/{name}", out / name)
    return str(out)


@pytest.mark.parametrize("name", ["stream_cache_hit_state", "stream_markdown_refresh"])
def test_sample_streams_read_tables_that_are_folders(spark, tmp_path, name):
    whole, parts = (QUERIES[name](spark, d) for d in (SF, foldered(spark, tmp_path)))
    assert whole.count() == parts.count() > 0 and parts.exceptAll(whole).count() == 0


def test_a_trigger_of_scattered_events_has_files_for_all_cores(spark, tmp_path):
    queries.scattered_event_stream(spark, SF, str(tmp_path))
    files = spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "events").glob("*.parquet"))) == 4 * files
    times = spark.read.parquet(str(tmp_path / "events")).groupBy(F.input_file_name()).agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    assert times.agg(F.max("a") < F.min("z")).first()[0]


def test_parts_in_time_order_are_whole_and_have_files_for_all_cores(spark):
    events = b.access_events(spark, SF)
    parts = queries.parts_in_time_order(spark, events, F.col("created_at"), "id")
    assert all(p.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism for p in parts)
    spans = [p.agg(F.min("created_at"), F.max("created_at"), F.count("id")).first() for p in parts]
    assert sum(x[2] for x in spans) == events.count() and all(a[1] < z[0] for a, z in zip(spans, spans[1:]))
