"""Index documents, full-text bundles, sitemaps and robots lines, one per site.

A document holds at most the list limit of a site's newest posts, so ordering and joining its
lines happens on few rows per site; sites spread over the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.config import BUNDLE_MAX_BYTES, MARKDOWN_VALUE, ROBOTS_COMMENT, SITEMAP_PATH, Settings
from trailmark.functions.clock import iso_datetime
from trailmark.functions.text import (
    add_query_param,
    byte_length,
    clean_url,
    filled,
    text,
    trim_words,
    xml_escape,
    xml_escape_url,
)
from trailmark.operators.posts import newest_first


def ordered_concat(lines: DataFrame, line: str, *keys: str) -> DataFrame:
    """``keys..., body``: each site's lines newest first, joined without separator.

    Rows carry ``post_date`` and ``id``; the callers have limited them per site.
    """
    item = F.struct("post_date", "id", F.col(line).alias("line"))
    newest = F.sort_array(F.collect_list(item), asc=False)
    body = F.array_join(F.transform(newest, lambda x: x["line"]), "")
    return lines.groupBy(*keys).agg(body.alias("body"))


def document(sites: DataFrame, bodies: DataFrame, header: Column, footer: Column | None = None) -> DataFrame:
    """``site, document`` for every site, including those with nothing listed."""
    parts = [header, text(F.col("body"))] + ([footer] if footer is not None else [])
    return sites.join(bodies, "site", "left").select("site", F.concat(*parts).alias("document"))


def index_lines(listed: DataFrame, words: int = 20) -> DataFrame:
    """One index line per listed post: title, link and summary."""
    excerpt = filled(F.col("post_excerpt"))
    source = F.when(excerpt != "", excerpt).otherwise(F.col("post_content"))
    line = F.concat(
        F.lit("- ["), text(F.col("post_title")),
        F.lit("]("), text(F.col("permalink")),
        F.lit("): "), trim_words(text(source), words), F.lit("\n"),
    )
    return listed.select("site", "id", "post_date", line.alias("line"))


def llms_index(sites: DataFrame, listed: DataFrame) -> DataFrame:
    header = F.concat(
        F.lit("# "), F.col("name"), F.lit("\n\n> "), F.col("description"), F.lit("\n\n## Posts\n\n")
    )
    return document(sites, ordered_concat(index_lines(listed), "line", "site"), header)


def bundle_header(name: Column) -> Column:
    return F.concat(F.lit("# "), name, F.lit(" — full content\n\n"))


def bundle_sections(sites: DataFrame, rows: DataFrame) -> DataFrame:
    """Sections of ``rows(site, id, post_date, markdown)`` with their sizes and that of the header."""
    section = F.concat(F.col("markdown"), F.lit("\n\n---\n\n"))
    headers = sites.select("site", byte_length(bundle_header(F.col("name"))).alias("header_bytes"))
    return (
        rows.filter(F.col("markdown").isNotNull())
        .join(headers, "site")
        .select("site", "id", "post_date", "header_bytes", section.alias("section"))
        .withColumn("section_bytes", byte_length(F.col("section")).cast("long"))
    )


def llms_full_cap(sections: DataFrame, max_bytes: int = BUNDLE_MAX_BYTES) -> DataFrame:
    """The leading sections of each site whose running size fits the cap with the header.

    Sizes are never negative, so the running size only grows and the filter keeps a prefix.
    """
    in_order = Window.partitionBy("site").orderBy(*newest_first())
    running = F.sum("section_bytes").over(
        in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sized = sections.withColumn("running_bytes", running + F.col("header_bytes"))
    return sized.filter(F.col("running_bytes") <= max_bytes)


def llms_full(sites: DataFrame, rows: DataFrame, max_bytes: int = BUNDLE_MAX_BYTES) -> DataFrame:
    kept = llms_full_cap(bundle_sections(sites, rows), max_bytes)
    return document(sites, ordered_concat(kept, "section", "site"), bundle_header(F.col("name")))


def sitemap_entries(listed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Location with the Markdown parameter and UTC change time of listed posts."""
    loc = add_query_param(F.col("permalink"), settings.query_param_name, MARKDOWN_VALUE)
    return listed.select(
        "site", "id", "post_date", loc.alias("loc"), text(iso_datetime(F.col("post_modified"))).alias("lastmod")
    )


def sitemap_xml(sites: DataFrame, entries: DataFrame) -> DataFrame:
    """A urlset per site; blank change times leave their element out."""
    lastmod = F.when(
        F.col("lastmod") != "",
        F.concat(F.lit("\t\t<lastmod>"), xml_escape(F.col("lastmod")), F.lit("</lastmod>\n")),
    ).otherwise(F.lit(""))
    url = F.concat(
        F.lit("\t<url>\n\t\t<loc>"), xml_escape_url(F.col("loc")), F.lit("</loc>\n"), lastmod, F.lit("\t</url>\n")
    )
    header = F.lit(
        '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    )
    bodies = ordered_concat(entries.withColumn("url", url), "url", "site")
    return document(sites, bodies, header, F.lit("</urlset>\n"))


def robots_lines(
    sites: DataFrame, settings: Settings = Settings(), output: Column | None = None, comment: str = ROBOTS_COMMENT
) -> DataFrame:
    """Each site's robots text, with the sitemap advertised on public sites."""
    output = F.lit("") if output is None else output
    root = F.concat(F.lit("https://"), F.col("site"), F.lit(f"/{SITEMAP_PATH}"))
    advertised = F.concat(output, F.lit(f"\n# {comment}\nSitemap: "), clean_url(root), F.lit("\n"))
    shown = F.col("is_public") & F.lit(settings.sitemap_enabled)
    return sites.select("site", F.when(shown, advertised).otherwise(output).alias("robots"))
