"""The engine's input tables derived from the sample tables (events, pages, supplier, ...).

Each view is a narrow projection of a sample table, so jobs on it read as they would on a real
log or corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.config import (
    GENESIS_NOINDEX_KEY,
    RANK_MATH_ROBOTS_KEY,
    YOAST_NOINDEX_KEY,
    Settings,
)
from trailmark.functions.clock import moment, to_second
from trailmark.functions.text import url_host
from trailmark.operators.requests import classify

# Rows lie before and after the bounds of 1, 7 and 30 days before it.
AS_OF = "2024-01-31 06:30:15"
SALT = "fixture-salt"
LOGGING = Settings(enable_logging=True)
PUBLIC_TYPES = ("post", "page", "attachment")

USER_AGENTS = (
    "Mozilla/5.0 (compatible; GPTBot/1.2)",
    "mozilla/5.0 claudebot/1.0",
    "PerplexityBot/1.0",
    "CCBot/2.0",
    "Mozilla/5.0 Applebot-Extended",
    "Googlebot/2.1",
    "SomeCrawler/3.1",
    "Mozilla/5.0 (Windows NT 10.0) Chrome/124.0",
    "",
    "curl/8.4.0",
    "ChatGPT-User GPTBot",
    "fetch-ai/0.1",
)
QUERIES = ("?format=md", "?format=M.D", "?utm=x&format=html&format=md", "?format=html")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_access_events(events: DataFrame) -> DataFrame:
    """Raw requests of an ``events`` frame, batch or streaming."""
    agent = F.get(F.array(*map(F.lit, USER_AGENTS)), ((F.col("event_id") * 5 + F.col("user_id")) % 12).cast("int"))
    query = F.coalesce(F.get(F.array(*map(F.lit, QUERIES)), (F.col("event_id") % 9).cast("int")), F.lit(""))
    post = F.when(F.expr("event_id % 11 = 0"), 0).otherwise(F.expr("(event_id * 7 + user_id) % 300 + 1"))
    return events.select(
        (F.col("event_id") + 1).alias("id"),
        to_second(F.col("ts")).alias("created_at"),
        post.cast("long").alias("post_id"),
        F.concat(F.lit("/p/"), post.cast("string"), query).alias("uri"),
        query.alias("query_string"),
        agent.alias("user_agent"),
        F.expr(
            "CASE WHEN event_id % 17 = 0 THEN '' ELSE "
            "concat('10.0.', CAST(user_id % 256 AS STRING), '.', CAST(event_id % 4 AS STRING)) END"
        ).alias("remote_addr"),
        F.expr("CAST(floor(value * 100) AS BIGINT)").alias("payload_bytes"),
        F.expr("CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END").alias("cache_hit"),
    )


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_access_events(table(spark, sf_dir, "events"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(access_events(spark, sf_dir), LOGGING, salt=SALT)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def post_date() -> Column:
    return moment("2024-01-01 00:00:00") + F.make_dt_interval(mins=F.col("page_id").cast("int") * 37)


def post_modified() -> Column:
    return post_date() + F.make_dt_interval(hours=(F.col("page_id") % 5).cast("int"))


def posts(spark: SparkSession, sf_dir: str, whole_page: bool = False) -> DataFrame:
    """Posts of the sample pages; the content is the article, or the page as it is."""
    article = F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)
    return pages(spark, sf_dir).select(
        (F.col("page_id") + 1).alias("id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("post_title"),
        F.col("url").alias("permalink"),
        (F.col("html") if whole_page else article).alias("post_content"),
        F.expr(
            "CASE WHEN page_id % 3 = 0 THEN concat('Excerpt for page ', CAST(page_id AS STRING)) ELSE '' END"
        ).alias("post_excerpt"),
        F.expr("CASE page_id % 10 WHEN 0 THEN 'draft' WHEN 1 THEN 'private' ELSE 'publish' END").alias("post_status"),
        F.expr("CASE WHEN page_id % 13 = 0 THEN 'secret' ELSE '' END").alias("post_password"),
        F.expr(
            "CASE WHEN page_id % 29 = 0 THEN 'attachment' WHEN page_id % 4 = 3 THEN 'page' ELSE 'post' END"
        ).alias("post_type"),
        F.expr("page_id % 10").alias("post_author"),
        post_date().alias("post_date"),
        post_modified().alias("post_modified"),
        url_host(F.col("url")).alias("site"),
    )


def post_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    robots = "CASE WHEN page_id % 19 = 0 THEN 'noindex,nofollow' WHEN page_id % 7 = 0 THEN 'index' END"
    values = F.create_map(
        F.lit(YOAST_NOINDEX_KEY), F.expr("CASE WHEN page_id % 17 = 0 THEN '1' END"),
        F.lit(RANK_MATH_ROBOTS_KEY), F.expr(robots),
        F.lit(GENESIS_NOINDEX_KEY), F.expr("CASE WHEN page_id % 23 = 0 THEN '1' END"),
    )
    rows = pages(spark, sf_dir).select((F.col("page_id") + 1).alias("post_id"), F.explode(values).alias("key", "value"))
    return rows.filter(F.col("value").isNotNull())


def post_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and tag names; nation and part lookups have fixed, small key ranges."""
    ids = pages(spark, sf_dir).select("page_id", (F.col("page_id") + 1).alias("post_id"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    keys = F.array_distinct(F.array(F.expr("page_id % 25"), F.expr("(page_id * 3) % 25")))
    categories = (
        ids.select("post_id", F.explode(keys).alias("k"))
        .join(nations, "k")
        .select("post_id", F.lit("category").alias("taxonomy"), F.col("n_name").alias("name"))
    )
    brands = table(spark, sf_dir, "part").filter("p_partkey < 20").select(F.col("p_partkey").alias("k"), "p_brand")
    tags = (
        ids.select("post_id", F.expr("page_id % 20").alias("k"))
        .join(brands, "k")
        .select("post_id", F.lit("post_tag").alias("taxonomy"), F.col("p_brand").alias("name"))
    )
    return categories.unionByName(tags)


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("display_name")
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Featured images of the posts with an .html address."""
    url = F.concat(F.lit("https://img.example.org/"), F.col("page_id").cast("string"), F.lit(".png"))
    return pages(spark, sf_dir).filter(F.col("url").contains(".html")).select(
        (F.col("page_id") + 1).alias("post_id"), url.alias("image")
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per host with its settings."""
    hosts = pages(spark, sf_dir).select(url_host(F.col("url")).alias("site")).distinct()
    return hosts.select(
        "site",
        F.col("site").alias("name"),
        F.concat(F.lit("Pages of "), F.col("site")).alias("description"),
        F.expr("length(site) % 4 <> 0").alias("is_public"),
    )


def site_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved settings per host: token list text, enabled types and retention days."""
    return sites(spark, sf_dir).select(
        "site",
        F.expr(
            "CASE length(site) % 3 WHEN 0 THEN '' WHEN 1 THEN concat('  ', site, 'Bot \n\n CCBot\n') ELSE ' \n ' END"
        ).alias("bot_list"),
        F.expr("CASE length(site) % 2 WHEN 0 THEN 'page,attachment,news' ELSE '' END").alias("enabled_types"),
        F.expr("(length(site) % 5) * 10 - 13").cast("int").alias("retention_days"),
    )


def post_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).select(F.col("id").alias("post_id"), F.col("post_modified").alias("saved_at"))


def markdown_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part-filled store: posts without a query in their address, built soon after their date."""
    built = post_date() + F.make_dt_interval(hours=F.lit(2))
    life = F.make_dt_interval(days=(F.col("page_id") % 40).cast("int"))
    return (
        pages(spark, sf_dir)
        .filter(~F.col("url").contains("?"))
        .select(
            (F.col("page_id") + 1).alias("post_id"),
            F.concat(F.lit("# stored "), F.col("page_id").cast("string")).alias("markdown"),
            built.alias("built_at"),
            (built + life).alias("expires_at"),
        )
    )
