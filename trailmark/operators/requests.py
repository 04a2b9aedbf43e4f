"""Raw requests to log rows: one narrow projection, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.config import (
    BOT_NAME_CHARS,
    UNKNOWN_BOT,
    UNKNOWN_TOKENS,
    URL_CHARS,
    USER_AGENT_CHARS,
    Settings,
)
from trailmark.functions.clock import to_second
from trailmark.functions.detect import (
    bot_tokens,
    contains_any,
    first_in,
    ip_hash,
    is_bot_ua,
    is_unknown_ua,
    match_fold,
    query_param_md,
    resolve_bot_name,
    should_serve,
)
from trailmark.functions.text import byte_length, clean_url, text
from trailmark.sources.schemas import LOG_COLUMNS

ColumnHook = Callable[[Column], Column]


def detect(
    events: DataFrame,
    settings: Settings = Settings(),
    *,
    bots: Sequence[str] | None = None,
    unknown_tokens: Sequence[str] = UNKNOWN_TOKENS,
    serve_override: ColumnHook | None = None,
) -> DataFrame:
    """Add ``is_md``, ``bot_token``, ``served`` and ``unknown_token`` to raw requests."""
    bots = bot_tokens(settings) if bots is None else list(bots)
    is_md = query_param_md(F.col("query_string"), settings.query_param_name)
    agent, folded = F.col("user_agent"), F.col("_folded")
    return (
        events.withColumns({"is_md": is_md, "_folded": match_fold(agent, bots, unknown_tokens)})
        .withColumn("bot_token", first_in(folded, bots))
        .select(
            *events.columns,
            "is_md",
            "bot_token",
            _served(F.col("is_md"), F.col("bot_token").isNotNull(), settings, serve_override).alias("served"),
            text(F.when(F.col("bot_token").isNull(), first_in(folded, unknown_tokens))).alias("unknown_token"),
        )
    )


def _served(is_md: Column, is_bot: Column, settings: Settings, override: ColumnHook | None) -> Column:
    served = should_serve(is_md, is_bot, settings.detection_mode)
    return served if override is None else F.coalesce(override(served), F.lit(False))


def kept_requests(
    settings: Settings,
    bots: Sequence[str],
    unknown_tokens: Sequence[str],
    serve_override: ColumnHook | None = None,
) -> Column:
    """Requests that become log rows, as a test on raw columns.

    It needs no token names, so it runs as one pattern search next to the scan, and the rows it
    keeps are the only ones whose names are looked up.
    """
    is_md = query_param_md(F.col("query_string"), settings.query_param_name)
    agent, unknown = F.col("user_agent"), settings.log_unknown_uas
    if serve_override is None and settings.detection_mode != "query_param":
        # An unlisted bot-like agent is kept as well, so both lists are one search.
        either = contains_any(agent, [*bots, *unknown_tokens] if unknown else bots)
        return either if settings.detection_mode == "ua" else is_md | either
    served = _served(is_md, is_bot_ua(agent, bots), settings, serve_override)
    return served | is_unknown_ua(agent, bots, unknown_tokens) if unknown else served


def unknown_ua_gate(settings: Settings) -> Column:
    """Requests logged as unknown: not served and a heuristic token found."""
    if not (settings.enable_logging and settings.log_unknown_uas):
        return F.lit(False)
    return ~F.col("served") & (F.col("unknown_token") != "")


def log_gate(rows: DataFrame, settings: Settings, allow: Column | None = None) -> DataFrame:
    """No rows while logging is off; otherwise those the optional predicate lets through."""
    # Decided when the plan is built: a switched-off log reads nothing.
    if not settings.enable_logging:
        return rows.filter(F.lit(False))
    return rows if allow is None else rows.filter(F.coalesce(allow, F.lit(False)))


def request_url(uri: Column, site_root: str = "") -> Column:
    return clean_url(F.concat(F.lit(site_root.rstrip("/")), text(uri)))


def log_normalise(context: DataFrame, salt: str, keep: Sequence[str] = ()) -> DataFrame:
    """Clamp, truncate and hash request contexts into the log schema, followed by the ``keep`` columns."""
    zero = F.lit(0).cast("long")
    return context.select(
        F.col("id").cast("long").alias("id"),
        F.greatest(zero, F.col("post_id")).alias("post_id"),
        F.substring(text(F.col("url")), 1, URL_CHARS).alias("url"),
        F.substring(text(F.col("user_agent")), 1, USER_AGENT_CHARS).alias("user_agent"),
        F.substring(text(F.col("bot_name")), 1, BOT_NAME_CHARS).alias("bot_name"),
        ip_hash(F.col("remote_addr"), salt).alias("ip_hash"),
        F.greatest(zero, F.col("bytes_served")).alias("bytes_served"),
        F.coalesce((F.col("cache_hit") != 0).cast("int"), F.lit(0)).alias("cache_hit"),
        to_second(F.col("created_at")).alias("created_at"),
        *keep,
    )


def classify(
    events: DataFrame,
    settings: Settings = Settings(enable_logging=True),
    *,
    salt: str,
    site_root: str = "",
    bots: Sequence[str] | None = None,
    unknown_tokens: Sequence[str] = UNKNOWN_TOKENS,
    serve_override: ColumnHook | None = None,
    allow: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Log rows of raw requests: served ones and, if wanted, bot-like unknown ones.

    ``keep`` names columns that stay behind those of the log, such as the site in a log of many sites.

    Works on batch and streaming frames alike. Both kinds of row come from one pass with a
    conditional, since a request is either served or a candidate for ``unknown``.
    """
    return log_rows(detect_kept(events, settings, bots, unknown_tokens, serve_override, allow), salt, site_root, keep)


def detect_kept(
    events: DataFrame,
    settings: Settings = Settings(enable_logging=True),
    bots: Sequence[str] | None = None,
    unknown_tokens: Sequence[str] = UNKNOWN_TOKENS,
    serve_override: ColumnHook | None = None,
    allow: Column | None = None,
) -> DataFrame:
    """``detect`` for those requests only that become log rows."""
    bots = bot_tokens(settings) if bots is None else list(bots)
    kept = log_gate(events, settings, allow).filter(
        kept_requests(settings, bots, unknown_tokens, serve_override)
    )
    return detect(
        kept, settings, bots=bots, unknown_tokens=unknown_tokens, serve_override=serve_override
    )


def log_rows(seen: DataFrame, salt: str, site_root: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """Log rows of what ``detect_kept`` found."""
    served = F.col("served")
    context = seen.select(
        "id",
        "post_id",
        request_url(F.col("uri"), site_root).alias("url"),
        "user_agent",
        F.when(served, resolve_bot_name(F.col("is_md"), F.col("bot_token")))
        .otherwise(F.lit(UNKNOWN_BOT))
        .alias("bot_name"),
        "remote_addr",
        F.when(served, F.col("payload_bytes")).otherwise(F.lit(0)).alias("bytes_served"),
        F.when(served, F.col("cache_hit")).otherwise(F.lit(0)).alias("cache_hit"),
        "created_at",
        *keep,
    )
    return log_normalise(context, salt, keep).select(*LOG_COLUMNS, *keep)


def servable_requests(
    events: DataFrame, servable: DataFrame, settings: Settings = Settings(), **hooks
) -> DataFrame:
    """Serve-worthy requests that hit one servable post.

    Only the distinct ids of the posts travel. Spark broadcasts them when their measured size
    is below its threshold; above it, AQE splits the partitions of posts that draw most hits.
    """
    seen = detect(events, settings, **hooks).filter("served AND post_id > 0")
    ids = servable.select(F.col("id").alias("post_id"))
    return seen.join(ids, "post_id", "left_semi")


def with_markdown_bytes(events: DataFrame, store: DataFrame) -> DataFrame:
    """Set ``payload_bytes`` to the UTF-8 size of the stored Markdown of each post."""
    sizes = store.select("post_id", byte_length(F.col("markdown")).cast("long").alias("_bytes"))
    return (
        events.join(sizes, "post_id", "left")
        .withColumn("payload_bytes", F.coalesce("_bytes", "payload_bytes"))
        .select(events.columns)
    )
