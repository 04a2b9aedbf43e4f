"""Windows, totals and series at their edges."""

import json

import pytest
from pyspark.sql import functions as F

from trailmark.operators import traffic
from trailmark.sources.schemas import REQUEST_LOG

AS_OF = "2024-01-31 12:00:00"


def log(spark, *rows):
    full = [(i, p, "/u", ua, bot, "", 0, hit, at) for i, (at, bot, p, ua, hit) in enumerate(rows)]
    schema = ", ".join(f"{f.name} {'string' if f.name == 'created_at' else f.dataType.simpleString()}" for f in REQUEST_LOG)
    frame = spark.createDataFrame(full, schema)
    return frame.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def hit(at, bot="A", post=1, ua="ua", cached=0):
    return (at, bot, post, ua, cached)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], REQUEST_LOG)


def test_window_edges(spark):
    rows = log(spark, hit("2024-01-30 12:00:00"), hit("2024-01-30 11:59:59"), hit("2024-02-09 00:00:00"))
    assert traffic.window_filter(rows, AS_OF, 1).count() == 2
    assert traffic.window_filter(rows, AS_OF, 0).count() == 2
    assert traffic.window_filter(rows, AS_OF, -9).count() == 2
    assert traffic.total_requests(rows, AS_OF, 2).first().total == 3


def test_empty_log(empty):
    assert traffic.cache_hit_rate(empty, AS_OF).first().hit_rate is None
    assert traffic.summary_scalars(empty, AS_OF).first().hit_rate_label == "—"
    assert traffic.daily_bot_series(empty, AS_OF).count() == 0
    assert traffic.chart_json(traffic.daily_bot_chart(empty, AS_OF)).first().chart == '{"labels":[],"datasets":[]}'
    assert traffic.request_totals(empty, AS_OF).first().asDict() == {"requests_1d": 0, "requests_7d": 0, "requests_30d": 0}


def test_partial_oldest_day_ranks_but_is_not_plotted(spark):
    rows = log(
        spark,
        *[hit("2024-01-29 13:00:00", "Old")] * 3,
        *[hit("2024-01-31 01:00:00", "New")] * 2,
        hit("2024-02-01 01:00:00", "Old"),
        hit("2024-01-31 01:00:00", ""),
    )
    series = traffic.daily_bot_series(rows, AS_OF, 2, 1).orderBy("dt").collect()
    assert [(str(r.dt), r.bot_name, r.hits) for r in series] == [("2024-01-30", "Old", 0), ("2024-01-31", "Old", 0)]
    chart = json.loads(traffic.chart_json(traffic.daily_bot_chart(rows, AS_OF, 2, 0)).first().chart)
    assert chart == {"labels": ["2024-01-30", "2024-01-31"], "datasets": [{"label": "Old", "data": [0, 0]}]}


def test_top_limits_and_ties(spark):
    rows = log(spark, hit("2024-01-31 01:00:00", "B"), hit("2024-01-31 02:00:00", "A"), hit("2024-01-31 02:00:00", ""))
    assert [r.bot_name for r in traffic.top_bots(rows, AS_OF, 1, 0).collect()] == ["A"]
    assert [r.bot_name for r in traffic.top_bots(rows, AS_OF, 1, 9).collect()] == ["A", "B"]


def test_unknown_agents_by_recency(spark):
    rows = log(
        spark,
        hit("2024-01-31 01:00:00", "unknown", 0, "x"), hit("2024-01-31 01:00:00", "unknown", 0, "x"),
        hit("2024-01-31 02:00:00", "unknown", 0, "y"), hit("2024-01-31 03:00:00", "A", 0, "z"),
    )
    assert [(r.user_agent, r.hits) for r in traffic.unknown_uas(rows, AS_OF).collect()] == [("y", 1), ("x", 2)]


def test_known_posts_only(spark):
    rows = log(spark, hit("2024-01-31 01:00:00", post=5), hit("2024-01-31 01:00:00", post=5), hit("2024-01-31 01:00:00", post=6))
    posts = spark.createDataFrame([(6, "six")], "id long, post_title string")
    assert [r.post_id for r in traffic.top_posts(rows, AS_OF, known_posts=posts).collect()] == [6]
    titled = {r.post_id: r.post_title for r in traffic.top_posts_titled(rows, posts, AS_OF).collect()}
    assert titled == {5: "", 6: "six"}


def test_loose_collation_merges_spellings(spark):
    rows = log(spark, *[hit("2024-01-31 01:00:00", b) for b in ("GPTBot", "gptbot", "gptbot ", "X")])
    assert [r.hits for r in traffic.top_bots(rows, AS_OF, collation=traffic.LOOSE_COLLATION).collect()] == [3, 1]
    assert traffic.top_bots(rows, AS_OF).count() == 4


def test_kept_and_expired_make_all(spark):
    rows = log(spark, hit("2024-01-24 12:00:00"), hit("2024-01-24 11:59:59"), hit("2023-01-01 00:00:00"))
    assert traffic.retention_prune(rows, AS_OF, 7).count() == 1
    assert traffic.retention_expired(rows, AS_OF, 7).agg(F.sum("expired")).first()[0] == 2
    # 8 is no retention choice and reads as 30
    assert traffic.retention_prune(rows, AS_OF, 8).count() == 2


def test_rate_label(spark):
    rows = log(spark, *[hit("2024-01-31 01:00:00", cached=c) for c in (1, 0, 0, 0, 0, 0, 0, 0)])
    assert traffic.summary_scalars(rows, AS_OF).first().hit_rate_label == "13%"


def test_titled_top_scans_the_log_once(spark):
    from trailmark import bindings as b

    sf = "/root/testdata/sf0.001"
    top = traffic.top_posts_titled(b.request_log(spark, sf), b.posts(spark, sf), b.AS_OF)
    top.collect()
    final = top._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert final.count("ReusedExchange") == 1 and final.count("FileScan parquet [event_id") == 1
