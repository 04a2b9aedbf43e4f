"""Corpus jobs: posts to Markdown documents, refreshed in part, and the bundles over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.config import BUNDLE_MAX_BYTES, Settings
from trailmark.functions.clock import AsOf
from trailmark.operators import publish
from trailmark.operators.markdown import assemble, html_to_markdown, stored
from trailmark.operators.posts import with_author, with_image, with_terms
from trailmark.operators.requests import ColumnHook
from trailmark.operators.store import live_rows, markdown_stale, markdown_store_upsert


def markdown_documents(
    posts: DataFrame,
    authors: DataFrame,
    post_terms: DataFrame | None = None,
    images: DataFrame | None = None,
    settings: Settings = Settings(),
    *,
    render: ColumnHook | None = None,
    drop_raw_text: bool = False,
    **document,
) -> DataFrame:
    """``post_id, markdown, error`` of posts.

    Only the lookups the chosen header needs enter the plan. Conversion comes first, so the
    heavy HTML column is gone before any join moves rows.
    """
    converted = html_to_markdown(posts, render=render, drop_raw_text=drop_raw_text).drop("post_content")
    rows = with_author(converted, authors)
    if settings.include_frontmatter:
        rows = with_terms(rows, post_terms)
    if settings.include_schema:
        rows = with_image(rows, images) if images is not None else rows.withColumn("image", F.lit(None).cast("string"))
    return assemble(rows, settings, **document)


def markdown_refresh(
    posts: DataFrame,
    store: DataFrame,
    authors: DataFrame,
    post_terms: DataFrame | None = None,
    images: DataFrame | None = None,
    settings: Settings = Settings(),
    as_of: AsOf = None,
    **options,
) -> DataFrame:
    """The store after rebuilding only the stale posts."""
    stale = markdown_stale(posts, store, as_of)
    built = markdown_documents(stale, authors, post_terms, images, settings, **options)
    return markdown_store_upsert(store, stored(built, as_of, settings.cache_ttl))


def bundle_rows(listed: DataFrame, store: DataFrame, authors: DataFrame, as_of: AsOf = None, **build) -> DataFrame:
    """``site, id, post_date, markdown`` of listed posts with content.

    Live stored Markdown no older than its post is used as it is; ``built`` marks the posts without it,
    the only ones that hand their HTML to the conversion. Of the store, only listed posts' rows travel.
    """
    wanted = listed.select(F.col("id").alias("post_id"), "post_modified")
    live = live_rows(store, as_of).join(wanted, "post_id").filter("built_at >= post_modified")
    live = live.select(F.col("post_id").alias("id"), F.col("markdown").alias("stored"))
    rows = listed.join(live, "id", "left")
    needed = rows.withColumn("post_content", F.when(F.col("stored").isNull(), F.col("post_content")))
    built = markdown_documents(needed, authors, keep=("site", "post_date", "stored"), **build)
    return built.select(
        "site", F.col("post_id").alias("id"), "post_date", F.coalesce("stored", "markdown").alias("markdown"),
        F.col("stored").isNull().alias("built"),
    )


def built_for_store(rows: DataFrame, as_of: AsOf = None, settings: Settings = Settings()) -> DataFrame:
    """Store rows of what ``bundle_rows`` had to convert; pass them to ``write_store`` after the bundles.

    Write ``rows`` to a table first if both are used, so that conversion runs once.
    """
    fresh = rows.filter("built").select(F.col("id").alias("post_id"), "markdown")
    return stored(fresh, as_of, settings.cache_ttl)


def full_bundles(
    sites: DataFrame,
    listed: DataFrame,
    store: DataFrame,
    authors: DataFrame,
    as_of: AsOf = None,
    max_bytes: int = BUNDLE_MAX_BYTES,
    **build,
) -> DataFrame:
    return publish.llms_full(sites, bundle_rows(listed, store, authors, as_of, **build), max_bytes)
