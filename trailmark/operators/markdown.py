"""HTML to Markdown as a map-only job, and the documents built from it."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.config import EDITOR_COMMENT, PREVIEW_CHARS, Settings
from trailmark.functions import html_fold
from trailmark.functions.clock import AsOf, iso_datetime, moment
from trailmark.functions.headers import article_block, article_struct, quote_header, yaml_header
from trailmark.functions.text import byte_length, filled, text, trim
from trailmark.operators.requests import ColumnHook
from trailmark.session import bound_batches

# Ship the helper with the task so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(html_fold)

_RESULT = "markdown string, error string"
PAGES = 200  # that are Python strings at once


def _folder(drop_raw_text: bool):
    fold = html_fold.fold

    # Arrow arrays, a few pages at a time: as pandas series a batch would be there twice more as Python strings.
    @F.arrow_udf(_RESULT)
    def convert(html: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, max(len(html), 1), PAGES):  # an empty batch gives an empty array
            done, errors = [], []
            for source in html.slice(start, PAGES).to_pylist():
                try:
                    done.append(fold(source, drop_raw_text) if source else "")
                    errors.append(None)
                except Exception as failure:
                    done.append(None)
                    errors.append(f"{type(failure).__name__}: {failure}")
            columns = [pa.array(done, pa.string()), pa.array(errors, pa.string())]
            parts.append(pa.StructArray.from_arrays(columns, names=["markdown", "error"]))
        return pa.concat_arrays(parts)

    return convert


def squeeze(markdown: Column) -> Column:
    """Runs of three or more newlines become two; outer blanks go."""
    return trim(F.regexp_replace(markdown, "\n{3,}", "\n\n"))


def html_to_markdown(
    df: DataFrame,
    html_col: str = "post_content",
    out_col: str = "markdown",
    error_col: str = "error",
    *,
    drop_raw_text: bool = False,
    render: ColumnHook | None = None,
    spread: int | None = None,
) -> DataFrame:
    """Add the Markdown of ``html_col`` and, per failed row, an error instead of a failed job.

    Only the HTML column crosses to Python, in Arrow batches of 1000 rows and 8 MB at most (the setting stays in the
    session), and no row moves between tasks.
    Input splits already balance tasks by bytes; ``spread`` redistributes rows first for inputs
    that come in few splits. ``render`` transforms the HTML column before conversion.
    """
    bound_batches(df.sparkSession)
    html = F.col(html_col)
    html = text(render(html) if render else html)
    # Editor block comments go before parsing, so text around them stays one run.
    prepared = F.regexp_replace(html, EDITOR_COMMENT, "")
    blank = trim(html) == ""
    if spread:
        df = df.repartition(spread)
    folded = _folder(drop_raw_text)(F.when(blank, F.lit("")).otherwise(prepared))
    with_result = df.withColumn("_folded", folded)
    return with_result.select(
        *[F.col(c) for c in df.columns if c not in (out_col, error_col)],
        squeeze(F.col("_folded.markdown")).alias(out_col),
        F.col("_folded.error").alias(error_col),
    )


def document_header(settings: Settings, offset_minutes: int = 0) -> Column:
    """Header column over posts with ``author`` and, for front matter, term arrays."""
    date = iso_datetime(F.col("post_date"), offset_minutes)
    common = F.col("post_title"), F.col("permalink"), F.col("author"), date
    if settings.include_frontmatter:
        return yaml_header(*common, F.col("categories"), F.col("tags"), filled(F.col("post_excerpt")))
    return quote_header(*common)


def article_of_post(site_name: Column, site_url: Column, offset_minutes: int = 0) -> Column:
    return article_struct(
        F.col("post_title"),
        F.col("permalink"),
        iso_datetime(F.col("post_date"), offset_minutes),
        iso_datetime(F.col("post_modified"), offset_minutes),
        F.col("author"),
        site_name,
        site_url,
        F.col("image"),
    )


def markdown_preview(documents: DataFrame) -> DataFrame:
    """First characters of the Markdown of published posts, '' for others."""
    preview = F.when(
        F.col("post_status") == "publish", F.substring(text(F.col("markdown")), 1, PREVIEW_CHARS)
    ).otherwise(F.lit(""))
    return documents.select("post_id", preview.alias("preview"))


def savings_report(documents: DataFrame, key: str = "site") -> DataFrame:
    """Bytes of HTML against bytes of Markdown per ``key``, with token estimates.

    An addition: the published size claims in measurable form. A token is taken as four bytes.
    """
    html, md = byte_length(F.col("post_content")), byte_length(F.col("markdown"))
    rated = documents.withColumn("_ratio", F.round(F.try_divide(html, md), 6))
    # One row per key and distinct ratio: the median is exact for any number of posts.
    counted = rated.groupBy(key, "_ratio").agg(
        F.count(F.lit(1)).alias("posts"),
        F.count("_ratio").alias("_rated"),
        F.sum(html.cast("long")).alias("html_bytes"),
        F.sum(md.cast("long")).alias("markdown_bytes"),
    )
    upto = Window.partitionBy(key).orderBy(F.col("_ratio").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_upto", F.sum("_rated").over(upto))
    placed = placed.withColumn("_all", F.sum("_rated").over(Window.partitionBy(key)))
    sums = placed.groupBy(key).agg(
        F.sum("posts").alias("posts"),
        F.sum("html_bytes").alias("html_bytes"),
        F.sum("markdown_bytes").alias("markdown_bytes"),
        F.min(F.when(2 * F.col("_upto") >= F.col("_all"), F.col("_ratio"))).alias("median_ratio"),
    )
    return sums.select(
        "*",
        F.floor(F.col("html_bytes") / 4).alias("html_tokens"),
        F.floor(F.col("markdown_bytes") / 4).alias("markdown_tokens"),
        F.round(F.try_divide(F.col("html_bytes"), F.col("markdown_bytes")), 6).alias("ratio"),
    )


def assemble(
    posts: DataFrame,
    settings: Settings = Settings(),
    *,
    site_name: Column | None = None,
    site_url: Column | None = None,
    offset_minutes: int = 0,
    markdown_output: ColumnHook | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``post_id, markdown`` of converted posts: header, body, optional metadata block, hook."""
    parts = [document_header(settings, offset_minutes), F.col("markdown")]
    if settings.include_schema:
        article = article_of_post(
            F.lit("") if site_name is None else site_name,
            F.lit("") if site_url is None else site_url,
            offset_minutes,
        )
        parts += [F.lit("\n\n"), article_block(article)]
    whole = F.concat(*parts)
    if markdown_output is not None:
        whole = markdown_output(whole)
    return posts.select(F.col("id").alias("post_id"), whole.alias("markdown"), "error", *keep)


def stored(documents: DataFrame, built_at: AsOf, ttl: int) -> DataFrame:
    """Store rows of freshly built documents; rows that failed to convert are left out."""
    built = moment(built_at)
    # No time to live means for good.
    expires = built + F.make_dt_interval(secs=F.lit(int(ttl))) if ttl else moment("9999-12-31 23:59:59")
    return documents.filter(F.col("markdown").isNotNull()).select(
        "post_id",
        "markdown",
        built.alias("built_at"),
        expires.alias("expires_at"),
    )
