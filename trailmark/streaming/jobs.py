"""The jobs as streams. They use the same column functions and operators as the batch jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmark.config import Settings
from trailmark.functions.clock import AsOf, day_bucket, epoch_second
from trailmark.operators.markdown import stored
from trailmark.operators.requests import classify
from trailmark.operators.traffic import named_bot_rows
from trailmark.plans.corpus import markdown_documents
from trailmark.session import short_methods
from trailmark.sources.tables import merge_daily_hits, write_log_batch, write_store


def stream_classify(
    events: DataFrame,
    log_path: str,
    checkpoint: str,
    settings: Settings = Settings(enable_logging=True),
    *,
    salt: str,
    logged: Callable[[DataFrame, int], None] | None = None,
    **hooks,
) -> StreamingQuery:
    """Append classified requests to the log; ``logged`` is called after each micro-batch.

    The log's partitions carry the query's id, which lives in the checkpoint: a replay replaces its
    own batch, and another checkpoint never replaces this one's.
    """
    rows = classify(events, settings, salt=salt, **hooks)

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        # A listener may read the rows as well; classification still runs once.
        kept = batch.persist() if logged is not None else batch
        try:
            write_log_batch(kept, batch_id, log_path, stream)
            if logged is not None:
                logged(kept, batch_id)
        finally:
            if logged is not None:
                kept.unpersist()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with short_methods(events.sparkSession):
        return writer.start()


def daily_hits(log: DataFrame, lateness: str | None = None) -> DataFrame:
    """Day counts per bot over a stream of log rows.

    State is one counter per bot and day, and counts combine before the shuffle, so nothing has to
    be dropped to bound it. With ``lateness``, days that far behind are closed and their rows ignored.
    """
    if lateness is None:
        day = day_bucket(F.col("created_at")).alias("dt")
        return named_bot_rows(log).groupBy(day, "bot_name").agg(F.count(F.lit(1)).alias("hits"))
    # Watermarks need an instant: the UTC one, so that days do not shift with the session zone.
    instant = F.timestamp_seconds(epoch_second(F.col("created_at")))
    stamped = named_bot_rows(log).withColumn("seen_at", instant).withWatermark("seen_at", lateness)
    counts = stamped.groupBy(F.window("seen_at", "1 day"), "bot_name").agg(F.count(F.lit(1)).alias("hits"))
    day = F.floor(F.unix_seconds("window.start") / 86_400).cast("int")
    return counts.select(F.date_from_unix_date(day).alias("dt"), "bot_name", "hits")


def stream_daily_hits(log: DataFrame, path: str, checkpoint: str, lateness: str | None = None) -> StreamingQuery:
    """Keep a rollup table by day current: each changed count replaces the last one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # A few rows per open day, used three times by the merge.
        changed = batch.persist()
        merge_daily_hits(changed, path)
        changed.unpersist()

    counts = daily_hits(log, lateness).writeStream.outputMode("update").foreachBatch(write)
    writer = counts.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with short_methods(log.sparkSession):
        return writer.start()


def stream_markdown_refresh(
    saves: DataFrame,
    posts: Callable[[], DataFrame],
    authors: DataFrame,
    store_path: str,
    checkpoint: str,
    settings: Settings = Settings(),
    as_of: AsOf = None,
    buckets: int = 512,
    **build,
) -> StreamingQuery:
    """Re-convert the posts named by save events and merge them into the Markdown table.

    ``posts`` is called per micro-batch to read the current content. Repeated saves of a post in
    a micro-batch convert it once, and a replay writes the same rows again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select(F.col("post_id").alias("id")).distinct()
        rows = posts().join(changed, "id", "left_semi")
        built = markdown_documents(rows, authors, settings=settings, **build)
        write_store(batch.sparkSession, stored(built, as_of, settings.cache_ttl), store_path, buckets)

    return (
        saves.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
