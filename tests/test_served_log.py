"""The log of a real site."""

from pyspark.sql import functions as F

from trailmark import bindings as b
from trailmark.config import Settings
from trailmark.plans.request_log import request_log
from trailmark.sources.schemas import ACCESS_EVENTS


def frames(spark, rows):
    events = spark.createDataFrame(rows, "id long, post_id long, user_agent string, second long")
    events = events.select(
        "id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, second)").alias("created_at"), "post_id",
        F.lit("/p").alias("uri"), F.lit("").alias("query_string"), "user_agent", F.lit("a").alias("remote_addr"),
        F.lit(5).cast("long").alias("payload_bytes"), F.lit(1).alias("cache_hit"),
    ).select(ACCESS_EVENTS.fieldNames())
    saves = spark.createDataFrame([], "post_id long, saved_at timestamp_ntz")
    documents = spark.createDataFrame([(1, "abc")], "post_id long, markdown string")
    return events, spark.createDataFrame([(1,)], "id long"), saves, documents


def test_each_request_is_detected_once(spark):
    """The detection's result is a table; of the input, nothing is read again."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(served):
        calls.add(1)
        return served

    rows = [(i, i % 3, ("curl", "GPTBot", "SomeCrawler")[i % 3], i) for i in range(1, 31)]
    settings = Settings(enable_logging=True, cache_ttl=5)
    log = request_log(*frames(spark, rows), settings, salt=b.SALT, serve_override=lambda c: counted(c))
    before = calls.value
    assert log.count() == 20
    assert calls.value == before


def test_rows_of_the_served_log(spark):
    rows = [(1, 1, "GPTBot", 0), (2, 1, "GPTBot", 1), (3, 1, "GPTBot", 9), (4, 2, "GPTBot", 0), (5, 2, "SomeCrawler", 0), (6, 0, "curl", 0)]
    # A request that is there twice gives two rows.
    rows.append(rows[1])
    log = request_log(*frames(spark, rows), Settings(enable_logging=True, cache_ttl=5), salt=b.SALT)
    got = sorted((r.id, r.bot_name, r.bytes_served, r.cache_hit) for r in log.collect())
    assert got == [(1, "GPTBot", 3, 0), (2, "GPTBot", 3, 1), (2, "GPTBot", 3, 1), (3, "GPTBot", 3, 0), (5, "unknown", 0, 0)]


def test_no_log_while_logging_is_off(spark):
    assert request_log(*frames(spark, [(1, 1, "GPTBot", 0)]), Settings(), salt=b.SALT).isEmpty()
