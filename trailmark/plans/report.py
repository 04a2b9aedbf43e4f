"""The two traffic reports, composed from the aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.config import Settings
from trailmark.functions.clock import AsOf
from trailmark.operators import traffic


def _ranked_list(top: DataFrame, *columns: str) -> DataFrame:
    """The few rows of a top list as one array in list order."""
    item = F.struct((-F.col("hits")).alias("o"), *columns, "hits")
    rows = F.array_sort(F.collect_list(item))
    named = F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in (*columns, "hits")]))
    return top.agg(named.alias("rows"))


def traffic_summary(
    log: DataFrame, posts: DataFrame, as_of: AsOf = None, days: int = 7, limit: int = 5
) -> DataFrame:
    """One row: total, hit-rate label, top bots and top posts of the window.

    The lists enter as scalar subqueries, so the three aggregates run side by side unjoined.
    """
    bots = _ranked_list(traffic.top_bots(log, as_of, days, limit), "bot_name")
    pages = _ranked_list(
        traffic.top_posts_titled(log, posts, as_of, days, limit), "post_id", "post_title"
    )
    return traffic.summary_scalars(log, as_of, days).select(
        "total", "hit_rate_label", bots.scalar().alias("top_bots"), pages.scalar().alias("top_posts")
    )


def analytics_report(
    log: DataFrame,
    posts: DataFrame,
    as_of: AsOf = None,
    settings: Settings = Settings(enable_logging=True),
    days: int = 30,
    limit: int = 50,
    series: int = 5,
) -> dict[str, DataFrame]:
    """The parts of the analytics page, lazily; none while logging is off.

    Nothing is cached: every part reads only its own two or three columns of the window's day
    partitions, which costs less than keeping the wide slice.
    """
    if not settings.enable_logging:
        return {}
    return {
        "totals": traffic.request_totals(log, as_of),
        "series": traffic.daily_bot_series(log, as_of, days, series),
        "bots": traffic.top_bots(log, as_of, days, limit),
        "posts": traffic.top_posts_titled(log, posts, as_of, days, limit),
        "unknown": traffic.unknown_uas(log, as_of, days, limit),
    }


def report_rows(report: dict[str, DataFrame]) -> DataFrame | None:
    """All parts of a report as ``part, item, hits, last_seen`` rows."""
    if not report:
        return None
    none = F.lit(None).cast("timestamp_ntz")

    def part(name: str, frame: DataFrame, item, hits, seen=none) -> DataFrame:
        return frame.select(
            F.lit(name).alias("part"),
            item.cast("string").alias("item"),
            hits.cast("long").alias("hits"),
            seen.alias("last_seen"),
        )

    totals = report["totals"]
    wide = F.explode(F.create_map(*[x for c in totals.columns for x in (F.lit(c), F.col(c))]))
    series_item = F.concat_ws(" ", F.date_format("dt", "yyyy-MM-dd"), "bot_name")
    hits, seen = F.col("hits"), F.col("last_seen")
    return (
        part("totals", totals.select(wide.alias("item", "hits")), F.col("item"), hits)
        .unionByName(part("series", report["series"], series_item, hits))
        .unionByName(part("bots", report["bots"], F.col("bot_name"), hits, seen))
        .unionByName(part("posts", report["posts"], F.concat_ws(" ", "post_id", "post_title"), hits, seen))
        .unionByName(part("unknown", report["unknown"], F.col("user_agent"), hits, seen))
    )
