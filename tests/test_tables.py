"""Sources and sinks on written tables."""

import csv
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trailmark import bindings as b
from trailmark.operators import store, traffic
from trailmark.sources import tables
from trailmark.sources.schemas import LOG_COLUMNS, MARKDOWN_STORE, REQUEST_LOG

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def log_path(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_log(b.request_log(spark, SF), path)
    return path


def test_log_round_trip_and_pruned_scan(spark, log_path):
    stored = tables.read_log(spark, log_path)
    assert stored.select(LOG_COLUMNS).exceptAll(b.request_log(spark, SF)).count() == 0
    recent = traffic.window_filter(stored, b.AS_OF, 7).select("bot_name")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "dt#" in plan.split("PartitionFilters")[1]
    assert "GreaterThanOrEqual(created_at,2024-01-24T06:30:15)" in plan
    assert "ReadSchema: struct<bot_name:string,created_at:timestamp_ntz>" in plan


def test_batch_replay_adds_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "log"), b.request_log(spark, SF)
    for batch in (0, 1, 1, 0):
        tables.write_log_batch(rows.filter(F.col("id") % 2 == batch), batch, path, "one")
    assert tables.read_log(spark, path).count() == rows.count()


@pytest.mark.parametrize("as_of", ["2024-01-31 00:00:00", "2024-01-20 13:14:15", "2030-01-01 00:00:00"])
def test_prune_equals_filter(spark, log_path, as_of):
    before = b.request_log(spark, SF)
    tables.prune_log(spark, log_path, as_of, 7)
    if as_of.startswith("2030"):
        assert not [p for p in __import__("os").listdir(log_path) if p.startswith("dt=")]
        return
    left = tables.read_log(spark, log_path).select(LOG_COLUMNS)
    kept = traffic.retention_prune(before, as_of, 7)
    assert left.count() == kept.count() and left.exceptAll(kept).count() == 0


def test_purge_keeps_schema(spark, log_path):
    tables.purge_log(spark, log_path)
    left = spark.read.parquet(log_path)
    assert left.count() == 0 and left.schema == REQUEST_LOG
    assert tables.read_log(spark, log_path).count() == 0


def test_csv_reads_back_in_order(spark, tmp_path):
    log = b.request_log(spark, SF).withColumn("user_agent", F.concat("user_agent", F.lit(' "q", x')))
    tables.export_csv(log, str(tmp_path / "csv"), b.AS_OF, 90)
    rows = []
    for part in sorted((tmp_path / "csv").glob("part-*.csv")):
        with part.open(newline="") as f:
            rows += list(csv.DictReader(f))
    want = [r.asDict() for r in traffic.export_rows(log, b.AS_OF, 90).collect()]
    assert rows == [{k: str(v) for k, v in r.items()} for r in want]
    assert list(rows[0]) == ["created_at", "post_id", "url", "user_agent", "bot_name", "bytes_served", "cache_hit"]


def test_unlisted_export_window_is_thirty_days(spark):
    log = b.request_log(spark, SF)
    assert traffic.export_rows(log, b.AS_OF, 5).count() == traffic.export_rows(log, b.AS_OF, 30).count()


def test_text_documents(spark, tmp_path):
    docs = spark.createDataFrame([("a.org", "# A\n\nx\n"), ("b.org", "no end")], "site string, document string")
    tables.write_text_documents(docs, str(tmp_path / "docs"))
    back = {r.site: r.document for r in tables.read_text_documents(spark, str(tmp_path / "docs")).collect()}
    assert back == {"a.org": "# A\n\nx\n", "b.org": "no end\n"}


def entries(spark, *rows):
    schema = "post_id long, markdown string, built_at string, expires_at string"
    frame = spark.createDataFrame(rows, schema)
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("built_at", "expires_at")})


def test_store_merge(spark, tmp_path):
    path = str(tmp_path / "store")
    day = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
    tables.write_store(spark, entries(spark, *[(i, f"old {i}", *day) for i in range(40)]), path, 4)
    tables.write_store(spark, entries(spark, (3, "new 3", *day), (99, "new 99", *day)), path, 4)
    rows = {r.post_id: r.markdown for r in tables.read_store(spark, path).collect()}
    assert rows == {**{i: f"old {i}" for i in range(40)}, 3: "new 3", 99: "new 99"}
    with pytest.raises(ValueError, match="another number of buckets"):
        tables.write_store(spark, entries(spark, (1, "x", *day)), path, 8)


def test_stale_and_invalidated(spark):
    rows = entries(
        spark,
        (1, "fresh", "2024-01-05 00:00:00", b.AS_OF),
        (2, "expired", "2024-01-05 00:00:00", "2024-01-31 06:30:14"),
        (3, "older than post", "2024-01-01 00:00:00", "2024-02-05 00:00:00"),
    )
    posts = spark.createDataFrame([(i, "2024-01-04 00:00:00") for i in (1, 2, 3, 4)], "id long, m string")
    posts = posts.select("id", F.col("m").cast("timestamp_ntz").alias("post_modified"))
    assert sorted(r.id for r in store.markdown_stale(posts, rows, b.AS_OF).collect()) == [2, 3, 4]
    saves = posts.select(F.col("id").alias("post_id"), F.col("post_modified").alias("saved_at"))
    twice = saves.unionByName(saves.withColumn("saved_at", F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")))
    assert sorted(r.post_id for r in store.markdown_store_invalidate(rows, twice).collect()) == [1, 2]
    empty = spark.createDataFrame([], MARKDOWN_STORE)
    assert store.markdown_store_upsert(empty, rows).count() == 3


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_access_events_in_several_formats(spark, tmp_path, fmt):
    path, raw = str(tmp_path / fmt), b.access_events(spark, SF)
    raw.write.format(fmt).save(path)
    back = tables.read_access_events(spark, path, fmt)
    if fmt == "csv":
        back = back.fillna("", subset=["query_string", "user_agent", "remote_addr"])
    assert back.exceptAll(raw).count() == 0 and back.count() == raw.count()


def test_access_events_as_stream(spark, tmp_path):
    raw, path = b.access_events(spark, SF), str(tmp_path / "in")
    raw.repartition(3).write.parquet(path)
    stream = tables.read_access_events(spark, path, stream=True, maxFilesPerTrigger="2")
    writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(raw).count() == 0


def test_removed_sites_and_staged_tables_leave_nothing(spark, tmp_path):
    docs = spark.createDataFrame([("a.org", "# A"), ("b.org", "# B")], "site string, document string")
    for rows in (docs, docs.filter("site = 'a.org'")):
        tables.write_text_documents(rows, str(tmp_path / "docs"))
    assert [r.site for r in tables.read_text_documents(spark, str(tmp_path / "docs")).collect()] == ["a.org"]
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    tables.write_store(spark, b.markdown_store(spark, SF), str(tmp_path / "store"), 4)
    tables.append_log(b.request_log(spark, SF), str(tmp_path / "log"))
    tables.prune_log(spark, str(tmp_path / "log"), b.AS_OF, 7)
    assert set(shared.iterdir()) == before
