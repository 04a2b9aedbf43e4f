"""Windowed questions over the request log.

Every window reads ``created_at >= as_of - N days`` with N at least 1 and no upper bound.
Counts and maxima aggregate partially on the map side, so a hot bot, post or agent costs
one row per map task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.config import LOG_WINDOWS, UNKNOWN_BOT, whitelisted
from trailmark.functions.clock import AsOf, date_axis, day_bucket, days_ago, window_days
from trailmark.sources.schemas import EXPORT_COLUMNS

# Spark collation for case-, accent- and trailing-blank-insensitive grouping.
LOOSE_COLLATION = "UNICODE_CI_AI_RTRIM"


def window_filter(log: DataFrame, as_of: AsOf = None, days: int = 30) -> DataFrame:
    """Rows of the past ``days`` days; prunes day partitions when the log has them."""
    cutoff = days_ago(as_of, window_days(days))
    recent = log.filter(F.col("created_at") >= cutoff)
    return recent.filter(F.col("dt") >= F.to_date(cutoff)) if "dt" in log.columns else recent


def named_bot_rows(log: DataFrame) -> DataFrame:
    return log.filter(F.col("bot_name") != "")


def post_rows(log: DataFrame) -> DataFrame:
    return log.filter(F.col("post_id") > 0)


def unknown_rows(log: DataFrame) -> DataFrame:
    return log.filter(F.col("bot_name") == UNKNOWN_BOT)


def total_requests(log: DataFrame, as_of: AsOf = None, days: int = 30) -> DataFrame:
    return window_filter(log, as_of, days).agg(F.count(F.lit(1)).alias("total"))


def request_totals(log: DataFrame, as_of: AsOf = None, windows=(1, 7, 30)) -> DataFrame:
    """Totals of several windows from one scan of the widest."""
    counts = [
        F.count_if(F.col("created_at") >= days_ago(as_of, window_days(n))).alias(f"requests_{n}d")
        for n in windows
    ]
    return window_filter(log, as_of, max(windows)).agg(*counts)


def hit_rate() -> Column:
    """Share of cache hits as an aggregate; null over no rows."""
    return F.sum("cache_hit").cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0))


def hit_rate_label(rate: Column) -> Column:
    # Halves round away from zero, as in decimal rounding by hand.
    percent = F.round(rate * 100).cast("int").cast("string")
    return F.coalesce(F.concat(percent, F.lit("%")), F.lit("—"))


def cache_hit_rate(log: DataFrame, as_of: AsOf = None, days: int = 30) -> DataFrame:
    return window_filter(log, as_of, days).agg(hit_rate().alias("hit_rate"))


def count_and_last_seen(log: DataFrame, key: str, collation: str | None = None) -> DataFrame:
    keyed = log.select(key, "created_at")
    hits, seen = F.count(F.lit(1)).alias("hits"), F.max("created_at").alias("last_seen")
    if collation is None:
        return keyed.groupBy(key).agg(hits, seen)
    loose = F.collate(F.col(key), collation).alias("_key")
    return keyed.groupBy(loose).agg(F.min(key).alias(key), hits, seen).select(key, "hits", "last_seen")


def top_by_hits(counted: DataFrame, key: str, limit: int) -> DataFrame:
    return counted.orderBy(F.desc("hits"), F.asc(key)).limit(max(1, limit))


def top_bots(
    log: DataFrame, as_of: AsOf = None, days: int = 30, limit: int = 5, collation: str | None = None
) -> DataFrame:
    recent = named_bot_rows(window_filter(log, as_of, days))
    return top_by_hits(count_and_last_seen(recent, "bot_name", collation), "bot_name", limit)


def top_bots_by(
    log: DataFrame, by: str = "site", as_of: AsOf = None, days: int = 30, limit: int = 5
) -> DataFrame:
    """Per value of ``by`` the bots with most hits; ranked on one counted row per value and bot."""
    recent = named_bot_rows(window_filter(log, as_of, days))
    hits, seen = F.count(F.lit(1)).alias("hits"), F.max("created_at").alias("last_seen")
    counted = recent.groupBy(by, "bot_name").agg(hits, seen)
    order = Window.partitionBy(by).orderBy(F.desc("hits"), "bot_name")
    return counted.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max(1, limit)).drop("_rn")


def top_posts(
    log: DataFrame,
    as_of: AsOf = None,
    days: int = 30,
    limit: int = 5,
    known_posts: DataFrame | None = None,
) -> DataFrame:
    """Most requested posts; ``known_posts`` drops ids of other page kinds from unknown rows.

    The known-post test joins the per-post counts, not the raw rows.
    """
    counted = count_and_last_seen(post_rows(window_filter(log, as_of, days)), "post_id")
    if known_posts is not None:
        ids = known_posts.select(F.col("id").alias("post_id"))
        counted = counted.join(ids, "post_id", "left_semi")
    return top_by_hits(counted, "post_id", limit)


def top_posts_titled(
    log: DataFrame, posts: DataFrame, as_of: AsOf = None, days: int = 30, limit: int = 5
) -> DataFrame:
    """Top posts with their titles; a missing post has an empty one.

    The ``limit`` top rows are the broadcast side: the post table streams past them and
    only matching titles come back.
    """
    top = top_posts(log, as_of, days, limit)
    titles = posts.select(F.col("id").alias("post_id"), "post_title")
    # Naming last_seen keeps both uses of the aggregate alike, so its shuffle is computed once.
    ids = top.filter(F.col("last_seen").isNotNull()).select("post_id")
    wanted = titles.join(F.broadcast(ids) if limit <= 10_000 else ids, "post_id", "left_semi")
    return top.join(wanted, "post_id", "left").select(
        "post_id",
        F.coalesce("post_title", F.lit("")).alias("post_title"),
        "hits",
        "last_seen",
    )


def unknown_uas(
    log: DataFrame, as_of: AsOf = None, days: int = 30, limit: int = 50, collation: str | None = None
) -> DataFrame:
    """Unlisted bot-like agents, most recently seen first."""
    recent = unknown_rows(window_filter(log, as_of, days))
    counted = count_and_last_seen(recent, "user_agent", collation)
    return counted.orderBy(F.desc("last_seen"), F.asc("user_agent")).limit(max(1, limit))


def daily_bot_hits(log: DataFrame, as_of: AsOf = None, days: int = 30) -> DataFrame:
    """Sparse day counts per bot; order with ``sort_days`` where order matters."""
    recent = named_bot_rows(window_filter(log, as_of, days))
    return recent.groupBy(day_bucket(F.col("created_at")).alias("dt"), "bot_name").agg(
        F.count(F.lit(1)).alias("hits")
    )


def sort_days(daily: DataFrame) -> DataFrame:
    return daily.orderBy("dt", "bot_name")


def bot_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("bot_name").agg(F.sum("hits").alias("hits"))


def bot_calendars(daily: DataFrame) -> DataFrame:
    """Per bot its total and a day-to-hits map: at most one entry per day of the window."""
    days = F.map_from_entries(F.collect_list(F.struct("dt", "hits")))
    return daily.groupBy("bot_name").agg(F.sum("hits").alias("total"), days.alias("by_day"))


def top_bot_calendars(daily: DataFrame, top: int) -> DataFrame:
    return bot_calendars(daily).orderBy(F.desc("total"), F.asc("bot_name")).limit(max(1, top))


def series_fill(calendars: DataFrame, as_of: AsOf, days: int) -> DataFrame:
    """Dense ``dt, bot_name, hits`` over the calendar axis, 0 where a bot has no hits."""
    axis = calendars.select("bot_name", "by_day", F.explode(date_axis(as_of, days)).alias("dt"))
    filled = F.coalesce(F.try_element_at("by_day", F.col("dt")), F.lit(0).cast("long"))
    return axis.select("dt", "bot_name", filled.alias("hits"))


def daily_bot_series(log: DataFrame, as_of: AsOf = None, days: int = 30, top: int = 5) -> DataFrame:
    """Dense daily series of the top bots.

    Ranking counts the whole rolling window; the axis is the last N calendar days, so the
    partial oldest day ranks but is not plotted.
    """
    days = window_days(days)
    return series_fill(top_bot_calendars(daily_bot_hits(log, as_of, days), top), as_of, days)


def daily_bot_chart(log: DataFrame, as_of: AsOf = None, days: int = 30, top: int = 5) -> DataFrame:
    """The series nested for a chart: one row of ``labels`` and ``datasets``, empty if no data."""
    days = window_days(days)
    best = top_bot_calendars(daily_bot_hits(log, as_of, days), top)
    axis = date_axis(as_of, days)
    data = F.transform(
        axis, lambda d: F.coalesce(F.try_element_at(F.col("by_day"), d), F.lit(0).cast("long"))
    )
    ranked = best.select(
        (-F.col("total")).alias("o"), F.col("bot_name").alias("label"), data.alias("data")
    )
    sets = F.transform(
        F.array_sort(F.collect_list(F.struct("o", "label", "data"))),
        lambda s: F.struct(s["label"].alias("label"), s["data"].alias("data")),
    )
    chart = ranked.agg(sets.alias("datasets"))
    labels = F.transform(axis, lambda d: F.date_format(d, "yyyy-MM-dd"))
    none = F.array().cast("array<string>")
    return chart.select(
        F.when(F.size("datasets") > 0, labels).otherwise(none).alias("labels"), "datasets"
    )


def chart_json(chart: DataFrame) -> DataFrame:
    return chart.select(F.to_json(F.struct("labels", "datasets")).alias("chart"))


def export_rows(log: DataFrame, as_of: AsOf = None, days: int = 30) -> DataFrame:
    """Rows for export, newest first; the address hash is not exported."""
    days = whitelisted(abs(int(days)), LOG_WINDOWS, 30)
    recent = window_filter(log, as_of, days)
    return recent.orderBy(F.desc("created_at"), F.desc("id")).select(EXPORT_COLUMNS)


def retention_cutoff(as_of: AsOf, days: int) -> Column:
    return days_ago(as_of, whitelisted(days, LOG_WINDOWS, 30))


def retention_prune(log: DataFrame, as_of: AsOf = None, days: int = 30) -> DataFrame:
    """The rows that stay."""
    cutoff = retention_cutoff(as_of, days)
    rows = log.filter(F.col("created_at") >= cutoff)
    return rows.filter(F.col("dt") >= F.to_date(cutoff)) if "dt" in log.columns else rows


def retention_expired(log: DataFrame, as_of: AsOf = None, days: int = 30) -> DataFrame:
    """How many rows would go, per day."""
    cutoff = retention_cutoff(as_of, days)
    gone = log.filter(F.col("created_at") < cutoff)
    gone = gone.filter(F.col("dt") <= F.to_date(cutoff)) if "dt" in log.columns else gone
    return gone.groupBy(day_bucket(F.col("created_at")).alias("dt")).agg(
        F.count(F.lit(1)).alias("expired")
    )


def summary_scalars(log: DataFrame, as_of: AsOf = None, days: int = 7) -> DataFrame:
    rate = hit_rate()
    return window_filter(log, as_of, days).agg(
        F.count(F.lit(1)).alias("total"), hit_rate_label(rate).alias("hit_rate_label")
    )


