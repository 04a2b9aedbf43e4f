"""The Markdown table: what is live, what is stale, and merging in new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.clock import AsOf, moment


def live_rows(store: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Rows whose time has not run out; a row is live through its expiry second."""
    return store.filter(F.col("expires_at") >= moment(as_of))


def markdown_stale(posts: DataFrame, store: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Posts whose Markdown is missing, expired or older than the post.

    Which ones is settled on ids and times; contents are then read for the stale ids, which Spark
    broadcasts when they measure small, as they do between two refreshes.
    """
    live = live_rows(store, as_of).select(F.col("post_id").alias("id"), "built_at")
    heads = posts.select("id", "post_modified")
    fresh = (heads["id"] == live["id"]) & (live["built_at"] >= heads["post_modified"])
    stale = heads.join(live, fresh, "left_anti").select("id").distinct()
    return posts.join(stale, "id", "left_semi")


def markdown_store_upsert(store: DataFrame, new_rows: DataFrame) -> DataFrame:
    """The store with ``new_rows`` in place of the old rows of the same posts.

    One outer join reads each side once: new rows are freshly converted and costly to repeat.
    """
    new = new_rows.select([F.col(c).alias(f"_new_{c}") for c in store.columns])
    both = store.join(new, F.col("post_id") == F.col("_new_post_id"), "full_outer")
    replaced = F.col("_new_post_id").isNotNull()
    return both.select(
        [F.when(replaced, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in store.columns]
    )


def last_saves(post_saves: DataFrame) -> DataFrame:
    """Latest save per post, so that an often-saved post joins as one row."""
    return post_saves.groupBy("post_id").agg(F.max("saved_at").alias("saved_at"))


def markdown_store_invalidate(store: DataFrame, post_saves: DataFrame) -> DataFrame:
    """The store without rows of posts saved after those rows were built.

    Only saves invalidate: a changed setting shows once rows run out. Index documents are
    rebuilt as jobs and hold no cached copy that would have to go.
    """
    saves = last_saves(post_saves)
    newer = (store["post_id"] == saves["post_id"]) & (saves["saved_at"] > store["built_at"])
    return store.join(saves, newer, "left_anti")
