"""One query per operator, over the sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark import bindings as b
from trailmark.config import SITEMAP_MAX_POSTS, LOG_WINDOWS, Settings
from trailmark.functions import clock, detect, headers, text
from trailmark.operators import botlist, cachehits, markdown, publish, requests, store, traffic
from trailmark.operators import posts as postops
from trailmark.plans import corpus, report
from trailmark.plans.request_log import request_log
from trailmark.session import shared_folder
from trailmark.sources import tables
from trailmark.sources.schemas import EXPORT_COLUMNS
from trailmark.streaming import hit_labels, hit_state, jobs

AS_OF = b.AS_OF
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FRONT = Settings(include_frontmatter=True)
SCHEMA = Settings(include_schema=True)
SMALL_CAP = 20_000
TTL = 6 * 3600


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def listed(s, d, n=100):
    types = postops.listed_types(b.PUBLIC_TYPES)
    return postops.listed_posts(b.posts(s, d), types, n, postops.noindex_posts(b.post_meta(s, d)))


def listed_with_content(s, d):
    return postops.with_content(listed(s, d), b.posts(s, d))


def servable(s, d):
    typed = postops.type_filter(b.posts(s, d), postops.allowed_types(b.PUBLIC_TYPES))
    return postops.servable_posts(typed, postops.noindex_posts(b.post_meta(s, d)))


def detected(s, d, settings=b.LOGGING):
    return requests.detect(b.access_events(s, d), settings)


# --- sources ---------------------------------------------------------------------------------
@query
def scan_request_log(s, d):
    path = shared_folder(s)
    tables.append_log(b.request_log(s, d), path)
    return tables.read_log(s, path).drop("dt")


@query
def scan_access_events(s, d):
    return b.access_events(s, d)


@query
def scan_posts(s, d):
    rows = postops.latest_posts(b.posts(s, d), postops.listed_types(b.PUBLIC_TYPES), 100)
    return rows.select("id", "post_title", "post_status", "post_type", "post_date")


@query
def scan_post_by_id(s, d):
    recent = traffic.window_filter(b.request_log(s, d), AS_OF, 7)
    wanted = traffic.post_rows(recent).select("post_id").distinct()
    return postops.posts_by_id(b.posts(s, d), wanted).select("id", "post_title", "permalink")


@query
def scan_post_meta(s, d):
    flags = postops.meta_flags(b.post_meta(s, d))
    return flags.withColumn("meta_rankmath_robots", F.array_join("meta_rankmath_robots", "|"))


@query
def scan_post_terms(s, d):
    rows = postops.terms_by_post(b.post_terms(s, d))
    return rows.select("post_id", *[F.array_join(c, "|").alias(c) for c in ("categories", "tags")])


@query
def scan_bot_list(s, d):
    return botlist.effective_tokens(b.site_settings(s, d).select("site", "bot_list"))


# --- sinks -----------------------------------------------------------------------------------
@query
def append_request_log(s, d):
    path = shared_folder(s)
    log = b.request_log(s, d)
    tables.append_log(log.filter(F.col("bot_name") == "manual"), path)
    tables.append_log(log.filter(F.col("bot_name") != "manual"), path)
    return tables.read_log(s, path)


@query
def retention_prune(s, d):
    path = shared_folder(s)
    # One load and two micro-batches, which are in time order as a stream's are.
    log, early = b.request_log(s, d), F.lit("2024-01-24 03:00:00").cast("timestamp_ntz")
    tables.append_log(log.filter("id % 3 = 0"), path)
    tables.write_log_batch(log.filter((F.col("id") % 3 > 0) & (F.col("created_at") < early)), 0, path, "s")
    tables.write_log_batch(log.filter((F.col("id") % 3 > 0) & (F.col("created_at") >= early)), 1, path, "s")
    tables.prune_log(s, path, AS_OF, 7)
    return tables.read_log(s, path).drop("dt")


@query
def retention_kept(s, d):
    return traffic.retention_prune(b.request_log(s, d), AS_OF, 7)


@query
def retention_expired(s, d):
    return traffic.retention_expired(b.request_log(s, d), AS_OF, 7)


@query
def purge_log(s, d):
    path = shared_folder(s)
    tables.append_log(b.request_log(s, d), path)
    tables.purge_log(s, path)
    return s.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_left"))


@query
def export_csv(s, d):
    path = shared_folder(s)
    tables.export_csv(b.request_log(s, d), path, AS_OF, 7)
    schema = (
        "created_at timestamp_ntz, post_id long, url string, user_agent string, bot_name string, "
        "bytes_served long, cache_hit int"
    )
    rows = s.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return rows.fillna("", subset=["url", "user_agent", "bot_name"])


@query
def write_text_documents(s, d):
    path = shared_folder(s)
    tables.write_text_documents(llms_index(s, d), path)
    return tables.read_text_documents(s, path)


@query
def chart_json(s, d):
    return traffic.chart_json(traffic.daily_bot_chart(b.request_log(s, d), AS_OF, 30, 5))


@query
def markdown_store_upsert(s, d):
    path = shared_folder(s)
    tables.write_store(s, b.markdown_store(s, d), path, 8)
    fresh = b.posts(s, d).select(
        F.col("id").alias("post_id"), F.concat(F.lit("# new "), "post_title").alias("markdown"), F.lit(None).alias("error")
    )
    tables.write_store(s, markdown.stored(fresh, AS_OF, TTL), path, 8)
    return tables.read_store(s, path)


@query
def markdown_store_invalidate(s, d):
    return store.markdown_store_invalidate(b.markdown_store(s, d), b.post_saves(s, d))


# --- predicates ------------------------------------------------------------------------------
@query
def window_filter(s, d):
    return traffic.window_filter(b.request_log(s, d), AS_OF, 7).select("id", "created_at", "bot_name")


@query
def named_bot_rows(s, d):
    return traffic.named_bot_rows(b.request_log(s, d)).select("id", "bot_name")


@query
def post_rows(s, d):
    return traffic.post_rows(b.request_log(s, d)).select("id", "post_id")


@query
def unknown_rows(s, d):
    return traffic.unknown_rows(b.request_log(s, d)).select("id", "user_agent")


@query
def detect_markdown_request(s, d):
    events = b.access_events(s, d)
    is_md = detect.query_param_md(F.col("query_string"))
    is_bot = detect.is_bot_ua(F.col("user_agent"))
    modes = [detect.should_serve(is_md, is_bot, m).alias(f"serve_{m}") for m in ("ua", "query_param", "both")]
    return events.select("id", *modes)


@query
def query_param_md(s, d):
    return b.access_events(s, d).select(
        "id", detect.query_param_md(F.col("query_string")).alias("is_md"),
        text.query_param(F.col("query_string"), "format").alias("format"),
    )


@query
def is_bot_ua(s, d):
    return b.access_events(s, d).select("id", detect.is_bot_ua(F.col("user_agent")).alias("is_bot"))


@query
def unknown_ua_match(s, d):
    return b.access_events(s, d).select("id", detect.unknown_ua_match(F.col("user_agent")).alias("unknown_token"))


@query
def unknown_ua_gate(s, d):
    rows = detected(s, d).filter(requests.unknown_ua_gate(b.LOGGING))
    return rows.select("id", "user_agent", "unknown_token")


@query
def log_gate(s, d):
    rows = requests.log_gate(detected(s, d), b.LOGGING, F.col("remote_addr") != "")
    return rows.filter("served").select("id", "remote_addr")


@query
def servable_posts(s, d):
    return servable(s, d).select("id", "post_type")


@query
def noindex_posts(s, d):
    return postops.noindex_posts(b.post_meta(s, d))


@query
def type_filter(s, d):
    types = postops.allowed_types(b.PUBLIC_TYPES, ["page", "attachment"])
    return postops.type_filter(b.posts(s, d), types).select("id", "post_type")


@query
def servable_requests(s, d):
    rows = requests.servable_requests(b.access_events(s, d), servable(s, d), b.LOGGING)
    return rows.select("id", "post_id", "created_at")


@query
def served_request_log(s, d):
    documents = corpus.markdown_documents(b.posts(s, d), b.authors(s, d))
    settings = Settings(enable_logging=True, cache_ttl=TTL)
    return request_log(b.access_events(s, d), servable(s, d), b.post_saves(s, d), documents, settings, salt=b.SALT)


@query
def endpoint_route(s, d):
    paths = F.array(*[F.lit(p) for p in ("/llms.txt", "/llms-full.txt?x=1", "/botfood-sitemap.xml/", "/en/llms.txt")])
    asked = F.get(paths, F.pmod(F.col("page_id"), F.lit(5)).cast("int"))
    uri = F.coalesce(asked, F.col("url"))
    return b.pages(s, d).select("page_id", detect.endpoint_route(uri).alias("route"))


@query
def export_projection(s, d):
    return b.request_log(s, d).select(EXPORT_COLUMNS)


@query
def markdown_preview(s, d):
    docs = corpus.markdown_documents(b.posts(s, d), b.authors(s, d), keep=("post_status",))
    return markdown.markdown_preview(docs)


# --- joins -----------------------------------------------------------------------------------
@query
def top_posts_titled(s, d):
    return traffic.top_posts_titled(b.request_log(s, d), b.posts(s, d), AS_OF, 30, 50)


@query
def bot_first_match(s, d):
    tokens = botlist.effective_tokens(b.site_settings(s, d).select("bot_list"))
    bots = tokens.groupBy("token").agg(F.min("pos").alias("pos"))
    return botlist.bot_first_match(b.access_events(s, d), bots)


@query
def bot_first_match_by_site(s, d):
    """Each site's own list against every sample agent."""
    bots = botlist.effective_tokens(b.site_settings(s, d).select("site", "bot_list"))
    agents = b.sites(s, d).select("site", F.explode(F.array(*map(F.lit, b.USER_AGENTS))).alias("user_agent"))
    return botlist.bot_first_match(agents, bots, ("site",))


@query
def unknown_not_bot(s, d):
    ua = F.col("user_agent")
    rows = b.access_events(s, d).filter(detect.first_token(ua, detect.UNKNOWN_TOKENS).isNotNull() & ~detect.is_bot_ua(ua))
    return rows.select("id", "user_agent")


@query
def series_fill(s, d):
    daily = traffic.daily_bot_hits(b.request_log(s, d), AS_OF, 7)
    return traffic.series_fill(traffic.bot_calendars(daily), AS_OF, 7)


@query
def top_bot_semi(s, d):
    daily = traffic.daily_bot_hits(b.request_log(s, d), AS_OF, 30)
    return traffic.top_bot_calendars(daily, 3).select("bot_name", F.explode("by_day").alias("dt", "hits"))


@query
def post_author_join(s, d):
    return postops.with_author(b.posts(s, d), b.authors(s, d)).select("id", "author")


@query
def post_terms_join(s, d):
    rows = postops.with_terms(b.posts(s, d).select("id"), b.post_terms(s, d))
    return rows.select("id", *[F.array_join(c, ", ").alias(c) for c in ("categories", "tags")])


@query
def post_image_join(s, d):
    return postops.with_image(b.posts(s, d).select("id"), b.images(s, d))


@query
def markdown_stale(s, d):
    return store.markdown_stale(b.posts(s, d), b.markdown_store(s, d), AS_OF).select("id")


# --- aggregates ------------------------------------------------------------------------------
@query
def total_requests(s, d):
    return traffic.total_requests(b.request_log(s, d), AS_OF, 30)


@query
def request_totals(s, d):
    return traffic.request_totals(b.request_log(s, d), AS_OF)


@query
def cache_hit_rate(s, d):
    return traffic.cache_hit_rate(b.request_log(s, d), AS_OF, 7)


@query
def top_bots(s, d):
    return traffic.top_bots(b.request_log(s, d), AS_OF, 30, 5)


@query
def top_bots_by_site(s, d):
    """A log of three sites."""
    site = F.concat(F.lit("site"), F.pmod("id", F.lit(3)).cast("string"))
    log = requests.classify(b.access_events(s, d).withColumn("site", site), b.LOGGING, salt=b.SALT, keep=("site",))
    return traffic.top_bots_by(log, "site", AS_OF, 30, 2)


@query
def top_bots_collated(s, d):
    return traffic.top_bots(b.request_log(s, d), AS_OF, 30, 5, traffic.LOOSE_COLLATION)


@query
def top_posts(s, d):
    return traffic.top_posts(b.request_log(s, d), AS_OF, 30, 5)


@query
def top_posts_known(s, d):
    return traffic.top_posts(b.request_log(s, d), AS_OF, 30, 20, b.posts(s, d))


@query
def unknown_uas(s, d):
    return traffic.unknown_uas(b.request_log(s, d), AS_OF, 30, 50)


@query
def daily_bot_hits(s, d):
    return traffic.daily_bot_hits(b.request_log(s, d), AS_OF, 30)


@query
def bot_totals(s, d):
    return traffic.bot_totals(traffic.daily_bot_hits(b.request_log(s, d), AS_OF, 30))


@query
def daily_bot_series(s, d):
    return traffic.daily_bot_series(b.request_log(s, d), AS_OF, 30, 5)


@query
def traffic_summary(s, d):
    row = report.traffic_summary(b.request_log(s, d), b.posts(s, d), AS_OF)
    return row.select(
        "total", "hit_rate_label", F.to_json("top_bots").alias("top_bots"), F.to_json("top_posts").alias("top_posts")
    )


@query
def analytics_report(s, d):
    return report.report_rows(report.analytics_report(b.request_log(s, d), b.posts(s, d), AS_OF))


@query
def collect_terms(s, d):
    rows = postops.collect_terms(b.post_terms(s, d))
    return rows.select("post_id", "taxonomy", F.array_join("names", "|").alias("names"))


@query
def ordered_concat(s, d):
    lines = listed(s, d).withColumn("line", F.concat(F.col("id").cast("string"), F.lit(";")))
    return publish.ordered_concat(lines, "line", "site")


# --- windows, top-k, sets --------------------------------------------------------------------
@query
def llms_full_cap(s, d):
    rows = publish.llms_full_cap(sections(s, d), SMALL_CAP)
    return rows.select("site", "id", "section_bytes", "running_bytes")


@query
def per_site_limit(s, d):
    return postops.per_site_limit(b.posts(s, d), 3).select("site", "id")


@query
def first_match_rank(s, d):
    token = detect.first_token(F.col("user_agent"), detect.BOT_TOKENS)
    return b.access_events(s, d).select("id", token.alias("token")).filter(F.col("token").isNotNull())


@query
def topk_hits(s, d):
    counted = traffic.count_and_last_seen(traffic.post_rows(b.request_log(s, d)), "post_id")
    return traffic.top_by_hits(counted, "post_id", 10).select("post_id", "hits")


@query
def topk_recent(s, d):
    return traffic.unknown_uas(b.request_log(s, d), AS_OF, 365, 2)


@query
def sort_export(s, d):
    return traffic.export_rows(b.request_log(s, d), AS_OF, 30)


@query
def sort_days(s, d):
    return traffic.sort_days(traffic.daily_bot_hits(b.request_log(s, d), AS_OF, 7))


@query
def topn_bots_series(s, d):
    daily = traffic.daily_bot_hits(b.request_log(s, d), AS_OF, 30)
    return traffic.top_bot_calendars(daily, 3).select("bot_name", "total")


@query
def latest_posts(s, d):
    return postops.latest_posts(b.posts(s, d), postops.listed_types(b.PUBLIC_TYPES), 20).select("id", "post_date")


@query
def types_intersect(s, d):
    allowed = postops.allowed_types_of(F.col("enabled_types"), b.PUBLIC_TYPES)
    return b.site_settings(s, d).select("site", F.array_join(allowed, ",").alias("types"))


@query
def bot_list_add(s, d):
    settings = b.site_settings(s, d).select("site", "bot_list")
    agents = F.when(F.col("is_public"), F.concat("site", F.lit("Bot"))).otherwise(F.lit("Googlebot/2.1"))
    return botlist.bot_list_add(settings, b.sites(s, d).select("site", agents.alias("user_agent")))


@query
def bot_list_extend(s, d):
    settings = b.site_settings(s, d).select("site", "bot_list")
    found = b.sites(s, d).select("site", F.lit("Googlebot/2.1").alias("user_agent"))
    return botlist.bot_list_add(settings, found, extend_defaults=True)


@query
def types_except(s, d):
    return postops.occurring_types(b.posts(s, d))


# --- HTML to Markdown ------------------------------------------------------------------------
def html_to_markdown_frame(s, d, whole_page=False, **options):
    return markdown.html_to_markdown(b.posts(s, d, whole_page), **options)


@query
def html_to_markdown(s, d):
    return html_to_markdown_frame(s, d).select("id", "markdown", "error")


@query
def html_to_markdown_page(s, d):
    """Whole pages, scripts and styles left out."""
    return html_to_markdown_frame(s, d, True, drop_raw_text=True).select("id", "markdown", "error")


# --- scalars ---------------------------------------------------------------------------------
@query
def log_normalise(s, d):
    context = b.access_events(s, d).select(
        "id",
        (F.col("post_id") - 5).alias("post_id"),
        F.repeat(F.concat(F.lit("/é/"), F.col("query_string")), 20).alias("url"),
        F.repeat(F.col("user_agent"), 20).alias("user_agent"),
        F.repeat(F.lit("ñame "), 30).alias("bot_name"),
        "remote_addr",
        (F.col("payload_bytes") - 1000).alias("bytes_served"),
        (F.col("cache_hit") * 7).alias("cache_hit"),
        "created_at",
    )
    return requests.log_normalise(context, b.SALT)


@query
def ip_hash(s, d):
    return b.access_events(s, d).select("id", detect.ip_hash(F.col("remote_addr"), b.SALT).alias("ip_hash"))


@query
def resolve_bot_name(s, d):
    rows = detected(s, d)
    return rows.select("id", detect.resolve_bot_name(F.col("is_md"), F.col("bot_token")).alias("bot_name"))


@query
def request_url(s, d):
    uri = F.concat(F.col("uri"), F.lit(" a<b>é"))
    return b.access_events(s, d).select("id", requests.request_url(uri, "https://example.org/").alias("url"))


@query
def byte_length(s, d):
    return b.posts(s, d).select("id", text.byte_length(F.col("post_content")).cast("long").alias("bytes"))


@query
def day_bucket(s, d):
    at = F.col("created_at")
    return b.request_log(s, d).select("id", clock.day_bucket(at).alias("dt"), clock.days_ago(at, 7).alias("week_before"))


@query
def date_axis(s, d):
    """The axis of the week that ends with the newest log row."""
    last = b.request_log(s, d).agg(F.max("created_at").alias("last"))
    return last.select(F.explode(clock.date_axis(F.col("last"), 7)).alias("dt")).select(
        F.date_format("dt", "yyyy-MM-dd").alias("label")
    )


@query
def hit_rate_label(s, d):
    by_day = b.request_log(s, d).groupBy(clock.day_bucket(F.col("created_at")).alias("dt"))
    return by_day.agg(traffic.hit_rate_label(traffic.hit_rate()).alias("label"))


@query
def iso_datetime(s, d):
    return b.posts(s, d).select(
        "id",
        clock.iso_datetime(F.col("post_modified")).alias("utc"),
        clock.iso_datetime(F.col("post_modified"), 120).alias("local"),
    )


def headed(s, d):
    rows = postops.with_author(b.posts(s, d), b.authors(s, d))
    return postops.with_image(postops.with_terms(rows, b.post_terms(s, d)), b.images(s, d))


@query
def yaml_header(s, d):
    quoted = headed(s, d).withColumn("post_title", F.concat(F.lit('A "'), "post_title", F.lit('"')))
    return quoted.select("id", markdown.document_header(FRONT).alias("header"))


@query
def quote_header(s, d):
    return headed(s, d).select("id", markdown.document_header(Settings()).alias("header"))


@query
def article_json(s, d):
    article = markdown.article_of_post(F.col("site"), F.concat(F.lit("https://"), "site", F.lit("/")))
    return headed(s, d).select("id", headers.article_json(article).alias("article"))


@query
def article_block(s, d):
    article = markdown.article_of_post(F.col("site"), F.concat(F.lit("https://"), "site", F.lit("/")))
    return headed(s, d).select("id", headers.article_block(article).alias("block"))


@query
def trim_words(s, d):
    return b.posts(s, d).select("id", text.trim_words(F.col("post_content")).alias("summary"))


@query
def add_query_param(s, d):
    return b.pages(s, d).select("page_id", text.add_query_param(F.col("url"), "format", "md").alias("url"))


@query
def xml_escape(s, d):
    return b.pages(s, d).select(
        "page_id", text.xml_escape(F.col("html")).alias("html"), text.xml_escape_url(F.col("url")).alias("url")
    )


@query
def url_path(s, d):
    return b.pages(s, d).select("page_id", text.url_path(F.col("url")).alias("path"))


@query
def parse_token_list(s, d):
    return b.site_settings(s, d).select(
        "site", F.array_join(text.parse_token_list(F.col("bot_list")), "|").alias("tokens")
    )


@query
def sanitize_key(s, d):
    return b.pages(s, d).select("page_id", text.sanitize_key(F.col("url")).alias("key"))


@query
def whitelist_value(s, d):
    return b.site_settings(s, d).select(
        "site", text.whitelist_value(F.col("retention_days"), LOG_WINDOWS, 30).alias("retention_days")
    )


# --- content ---------------------------------------------------------------------------------
@query
def markdown_documents(s, d):
    docs = corpus.markdown_documents(b.posts(s, d), b.authors(s, d), b.post_terms(s, d), settings=FRONT)
    return docs.select("post_id", "markdown")


@query
def markdown_documents_schema(s, d):
    docs = corpus.markdown_documents(
        b.posts(s, d), b.authors(s, d), images=b.images(s, d), settings=SCHEMA,
        site_name=F.col("site"), site_url=F.concat(F.lit("https://"), "site", F.lit("/")),
    )
    return docs.select("post_id", "markdown")


@query
def markdown_refresh(s, d):
    return corpus.markdown_refresh(b.posts(s, d), b.markdown_store(s, d), b.authors(s, d), as_of=AS_OF)


@query
def listed_posts(s, d):
    return listed(s, d, 10).select("site", "id")


@query
def llms_index(s, d):
    return publish.llms_index(b.sites(s, d), listed_with_content(s, d))


def sections(s, d):
    rows = corpus.bundle_rows(listed_with_content(s, d), b.markdown_store(s, d), b.authors(s, d), AS_OF)
    return publish.bundle_sections(b.sites(s, d), rows)


@query
def llms_full(s, d):
    return corpus.full_bundles(b.sites(s, d), listed_with_content(s, d), b.markdown_store(s, d), b.authors(s, d), AS_OF)


@query
def sitemap_entries(s, d):
    return publish.sitemap_entries(listed(s, d, SITEMAP_MAX_POSTS)).drop("post_date")


@query
def sitemap_xml(s, d):
    return publish.sitemap_xml(b.sites(s, d), publish.sitemap_entries(listed(s, d, SITEMAP_MAX_POSTS)))


@query
def robots_lines(s, d):
    return publish.robots_lines(b.sites(s, d))


@query
def savings_report(s, d):
    return markdown.savings_report(html_to_markdown_frame(s, d))


# --- streams ---------------------------------------------------------------------------------
def sample_stream(s, d, name, **options):
    """A stream of a table that is one file or a folder of files."""
    # A stream's plain path must be a folder; a pattern may name either.
    return s.readStream.schema(b.table(s, d, name).schema).options(**options).parquet(f"{d}/{name}.parque[t]")


def event_stream(s, d):
    return b.as_access_events(sample_stream(s, d, "events"))


def stream_files(s):
    """Files a trigger takes in: each is read by one task, so one file would leave all other cores idle."""
    return s.sparkContext.defaultParallelism


def scattered_event_stream(s, d, out):
    """The events in four triggers, each of which jumps back in time, as every file holds all times."""
    events, files = b.table(s, d, "events"), stream_files(s)
    events.repartition(4 * files, "event_id").write.parquet(f"{out}/events")
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{out}/events")
    return b.as_access_events(stream)


@query
def stream_classify(s, d):
    out = shared_folder(s)
    # Two queries with checkpoints of their own fill one log.
    events = scattered_event_stream(s, d, out)
    for k in (0, 1):
        half = events.filter(F.col("id") % 2 == k)
        jobs.stream_classify(half, f"{out}/log", f"{out}/state{k}", b.LOGGING, salt=b.SALT).awaitTermination()
    return tables.read_log(s, f"{out}/log").drop("dt")


@query
def stream_daily_hits(s, d):
    out = shared_folder(s)
    log = requests.classify(scattered_event_stream(s, d, out), b.LOGGING, salt=b.SALT)
    jobs.stream_daily_hits(log, f"{out}/daily", f"{out}/state").awaitTermination()
    return tables.read_daily_hits(s, f"{out}/daily")


def served_requests(events):
    rows = requests.detect(events, b.LOGGING).filter("served AND post_id > 0")
    return rows.select("id", "post_id", "created_at")


@query
def cache_hit_labels(s, d):
    labelled = cachehits.cache_hit_labels(served_requests(b.access_events(s, d)), b.post_saves(s, d), TTL)
    return labelled.select("id", "post_id", "cache_hit")


def parts_in_time_order(s, rows, at, key, parts=4):
    """``rows`` in parts that follow one another in time, each in files for all cores."""
    second = clock.epoch_second(at).cast("double")
    borders = rows.select(second.alias("at")).approxQuantile("at", [i / parts for i in range(1, parts)], 0.01)
    edges = [float("-inf"), *borders, float("inf")]
    return [rows.filter((second >= low) & (second < high)).repartition(stream_files(s), key) for low, high in zip(edges, edges[1:])]


@query
def stream_cache_hit(s, d):
    out = shared_folder(s)
    events, saves = b.table(s, d, "events"), b.post_saves(s, d)
    # Both sources are cut at times of their own, so neither source's rows come complete. Each part is there as a whole
    # before the stream goes on from its checkpoint: a trigger that ended inside a part would take later files for late.
    asked = parts_in_time_order(s, events, clock.to_second(F.col("ts")), "event_id")
    saved = parts_in_time_order(s, saves, F.col("saved_at"), "post_id")
    for some_events, some_saves in zip(asked, saved):
        some_events.write.mode("append").parquet(f"{out}/events")
        some_saves.write.mode("append").parquet(f"{out}/saves")
        requests_so_far = served_requests(b.as_access_events(s.readStream.schema(events.schema).parquet(f"{out}/events")))
        saves_so_far = s.readStream.schema(saves.schema).parquet(f"{out}/saves")
        rows = hit_state.request_and_save_events(requests_so_far, saves_so_far)
        hit_labels.stream_hit_labels(rows, f"{out}/labels", f"{out}/state", TTL).awaitTermination()
    hit_labels.finish_hit_labels(s, f"{out}/labels", f"{out}/state", TTL)
    return hit_labels.read_hit_labels(s, f"{out}/labels").select("id", "post_id", "cache_hit")


@query
def stream_cache_hit_state(s, d):
    """The form with one number per post in the state store; without a limit, one trigger holds all rows."""
    out = shared_folder(s)
    pages = sample_stream(s, d, "pages")
    saves = pages.select((F.col("page_id") + 1).alias("post_id"), b.post_modified().alias("saved_at"))
    events = hit_state.request_and_save_events(served_requests(event_stream(s, d)), saves)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(provider)
    s.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = hit_state.stream_cache_hit(events, TTL).writeStream.format("parquet")
        writer.option("path", f"{out}/labels").option("checkpointLocation", f"{out}/state").trigger(
            availableNow=True
        ).start().awaitTermination()
    finally:
        s.conf.set(provider, before)
    return s.read.parquet(f"{out}/labels").select("id", "post_id", "cache_hit")


@query
def stream_markdown_refresh(s, d):
    out = shared_folder(s)
    tables.write_store(s, b.markdown_store(s, d), f"{out}/store", 8)
    pages = sample_stream(s, d, "pages", maxBytesPerTrigger=tables.STREAM_LIMIT)
    saves = pages.select((F.col("page_id") + 1).alias("post_id"))
    jobs.stream_markdown_refresh(
        saves, lambda: b.posts(s, d), b.authors(s, d), f"{out}/store", f"{out}/state", as_of=AS_OF, buckets=8
    ).awaitTermination()
    return tables.read_store(s, f"{out}/store")
