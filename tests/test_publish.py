"""Eligibility, headers and published documents."""

import json
import xml.etree.ElementTree as ET
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from trailmark import bindings as b
from trailmark.config import Settings
from trailmark.functions import headers
from trailmark.operators import botlist, markdown, posts, publish
from trailmark.plans import corpus

SF = "/root/testdata/sf0.01"


def post(id, site="s", status="publish", password="", kind="post", day=None):
    return (id, f"T{id}", f"https://{site}/{id}", "<p>x</p>", "", status, password, kind, 0, f"2024-01-{day or id:02d} 00:00:00", site)


def frame(spark, *rows):
    schema = (
        "id long, post_title string, permalink string, post_content string, post_excerpt string, post_status string, "
        "post_password string, post_type string, post_author long, post_date string, site string"
    )
    made = spark.createDataFrame(rows, schema).withColumn("post_date", F.col("post_date").cast("timestamp_ntz"))
    return made.withColumn("post_modified", F.col("post_date"))


def test_limit_comes_before_eligibility(spark):
    rows = frame(spark, post(1), post(2, password="p"), post(3, status="draft"), post(4, kind="attachment"), post(5))
    listed = posts.listed_posts(rows, ["post", "page"], 2)
    # newest two published are 5 and 2, and 2 has a password
    assert [r.id for r in listed.collect()] == [5]
    single = posts.listed_posts(rows, ["post", "page"], 3, site=None)
    assert sorted(r.id for r in single.collect()) == [1, 5]


@pytest.mark.parametrize("threshold", ["1000", "2"])
def test_site_limit_beyond_the_group_limit_threshold(spark, threshold):
    rows = frame(spark, *[post(i, site="hot", day=i % 28 + 1) for i in range(1, 60)], post(70, site="cold", day=1))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    try:
        kept = [(r.site, r.id) for r in posts.per_site_limit(rows, 10).collect()]
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    order = sorted(range(1, 60), key=lambda i: (-(i % 28 + 1), -i))
    assert sorted(kept) == sorted([("hot", i) for i in order[:10]] + [("cold", 70)])


def test_small_site_limit_is_applied_before_the_shuffle(spark):
    plan = posts.per_site_limit(b.posts(spark, SF), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_noindex_marks(spark):
    rows = [("1", ["index"], ""), ("", ["nofollow", "noindex"], ""), ("", ["noindex,x"], ""), ("0", None, "1"), (None, None, None)]
    marks = spark.createDataFrame(rows, "a string, r array<string>, c string")
    columns = F.col("a"), F.col("r"), F.col("c")
    assert [r.x for r in marks.select(posts.noindex(*columns).alias("x")).collect()] == [True, True, False, True, False]
    off = posts.noindex(*columns, flag_a_used=False, robots_used=False)
    assert [r.x for r in marks.select(off.alias("x")).collect()] == [False, False, False, True, False]


def test_types():
    public = ["post", "page", "attachment"]
    assert posts.allowed_types(public) == ["post", "page"]
    assert posts.allowed_types(public, ["page", "attachment", "x"]) == ["page"]
    assert posts.allowed_types(public, ["page"], lambda t: [*t, "book"]) == ["page", "book"]
    assert posts.listed_types(public) == ["post", "page"]


def test_no_types_left_filters_nothing(spark):
    rows = frame(spark, post(1), post(2, kind="attachment"))
    assert posts.type_filter(rows, posts.allowed_types(["post", "attachment"], ["gone"])).count() == 2
    assert posts.type_filter(rows, ["post"]).count() == 1


def test_settings_are_merged_and_checked():
    saved = Settings.from_saved({"detection_mode": "odd", "cache_ttl": 5, "log_retention_days": 8, "x": 1, "query_param_name": ""})
    good = saved.validated()
    assert (good.detection_mode, good.cache_ttl, good.log_retention_days, good.query_param_name) == ("both", 86400, 30, "format")
    assert Settings.from_saved(None) == Settings()
    typed = Settings(query_param_name="For Mat!", cache_ttl=-3600, log_retention_days=-90).validated()
    assert (typed.query_param_name, typed.cache_ttl, typed.log_retention_days) == ("format", 3600, 90)


def test_bundle_cap_is_a_prefix(spark):
    rows = [("s", i, f"2024-01-{30 - i:02d}", size, 10) for i, size in enumerate((50, 100, 10, 5), 1)]
    sized = spark.createDataFrame(rows, "site string, id long, post_date string, section_bytes long, header_bytes long")
    keep = lambda cap: sorted(r.id for r in publish.llms_full_cap(sized, cap).collect())
    assert keep(59) == [] and keep(60) == [1] and keep(159) == [1] and keep(160) == [1, 2] and keep(175) == [1, 2, 3, 4]


def test_bundles_fill_the_cap(spark):
    cap = 20_000
    every = b.posts(spark, SF)
    listed = posts.with_content(posts.listed_posts(every, ["post", "page"], 100), every)
    rows = corpus.bundle_rows(listed, b.markdown_store(spark, SF), b.authors(spark, SF), b.AS_OF)
    sections = publish.bundle_sections(b.sites(spark, SF), rows).cache()
    docs = publish.llms_full(b.sites(spark, SF), rows, cap)
    size = {r.site: len(r.document.encode()) for r in docs.collect()}
    kept = {(r.site, r.id) for r in publish.llms_full_cap(sections, cap).collect()}
    for site, rows in _by_site(sections):
        left = [r for r in rows if (site, r.id) not in kept]
        assert size[site] <= cap
        assert not left or size[site] + left[0].section_bytes > cap
    sections.unpersist()


def _by_site(sections):
    groups = {}
    for r in sections.orderBy(F.desc("post_date"), F.desc("id")).collect():
        groups.setdefault(r.site, []).append(r)
    return groups.items()


def test_sitemap_is_xml(spark):
    listed = frame(spark, post(1), post(2)).withColumn("permalink", F.lit("https://s/a?x=1&y='2'#z"))
    entries = publish.sitemap_entries(listed)
    blank = entries.withColumn("lastmod", F.when(F.col("id") == 1, "").otherwise(F.col("lastmod")))
    sites = spark.createDataFrame([("s",), ("empty",)], "site string")
    docs = {r.site: r.document for r in publish.sitemap_xml(sites, blank).collect()}
    root = ET.fromstring(docs["s"].encode())
    space = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
    assert [u.find(f"{space}loc").text for u in root] == ["https://s/a?x=1&y='2'&format=md#z"] * 2
    assert [u.find(f"{space}lastmod") is None for u in root] == [False, True]
    assert root[0].find(f"{space}lastmod").text == "2024-01-02T00:00:00+00:00"
    assert len(ET.fromstring(docs["empty"].encode())) == 0


def test_robots(spark):
    sites = spark.createDataFrame([("a.org", True), ("b.org", False)], "site string, is_public boolean")
    out = F.lit("User-agent: *\n")
    text = {r.site: r.robots for r in publish.robots_lines(sites, output=out, comment="Markdown here").collect()}
    assert text == {
        "a.org": "User-agent: *\n\n# Markdown here\nSitemap: https://a.org/botfood-sitemap.xml\n",
        "b.org": "User-agent: *\n",
    }
    off = publish.robots_lines(sites, Settings(sitemap_enabled=False)).collect()
    assert {r.robots for r in off} == {""}


def test_article_block_is_json(spark):
    rows = spark.createDataFrame([('A "b"/ü\n', "u", None), ("t", "u", "i.png")], "t string, u string, i string")
    article = headers.article_struct(*[F.col(c) for c in "tuuuuuu"], F.col("i"))
    blocks = [r.x for r in rows.select(headers.article_block(article).alias("x")).collect()]
    bodies = [x.removeprefix("```json\n").removesuffix("\n```\n") for x in blocks]
    for body, has_image in zip(bodies, (False, True)):
        data = json.loads(body)
        assert ("image" in data) is has_image
        assert list(data)[:8] == ["@context", "@type", "headline", "url", "datePublished", "dateModified", "author", "publisher"]
        assert body == json.dumps(data, indent=4, ensure_ascii=False)
    compact = [r.x for r in rows.select(headers.article_json(article).alias("x")).collect()]
    assert json.loads(compact[0]) == json.loads(bodies[0])


def test_token_lists_as_data(spark):
    saved = spark.createDataFrame([(1, " A\n\nB "), (2, " \n"), (3, None)], "k int, bot_list string")
    tokens = botlist.effective_tokens(saved).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    got = {r.k: [x.token for x in r.t] for r in tokens.collect()}
    assert got[1] == ["A", "B"] and got[2][0] == "GPTBot" and len(got[3]) == 14
    found = spark.createDataFrame([(1, "B"), (2, " New<i> ")], "k int, user_agent string")
    grown = {r.k: r.bot_list for r in botlist.bot_list_add(saved, found).collect()}
    assert grown == {1: "A\nB", 2: "New", 3: ""}
    kept = {r.k: r.bot_list for r in botlist.bot_list_add(saved, found, extend_defaults=True).collect()}
    assert kept[2].split("\n")[0] == "GPTBot" and kept[2].endswith("\nNew")


def test_substring_join_equals_containment(spark):
    agents = ["xxABCyy", "abc", "ab", "", "zab cz", "ABCABC", "É-ab"]
    tokens = [(0, "bc"), (1, "AB"), (2, "abc"), (3, "é")]
    matched = botlist.bot_first_match(
        spark.createDataFrame([(a,) for a in agents * 2], "user_agent string"),
        spark.createDataFrame(tokens, "pos int, token string"),
    )
    want = {a: next((t for _, t in tokens if t.lower() in a.lower() and t.isascii()), None) for a in agents if a}
    assert {r.user_agent: r.token for r in matched.collect()} == {a: t for a, t in want.items() if t}


def test_refresh_rebuilds_only_stale_posts(spark):
    store = b.markdown_store(spark, SF)
    refreshed = corpus.markdown_refresh(b.posts(spark, SF), store, b.authors(spark, SF), as_of=b.AS_OF)
    again = corpus.markdown_refresh(b.posts(spark, SF), refreshed, b.authors(spark, SF), as_of="2024-01-31 07:00:00")
    assert again.filter("built_at = timestamp_ntz'2024-01-31 07:00:00'").count() == 0
    assert again.count() == b.posts(spark, SF).count()


def test_refresh_converts_once(spark):
    refreshed = corpus.markdown_refresh(b.posts(spark, SF), b.markdown_store(spark, SF), b.authors(spark, SF), as_of=b.AS_OF)
    assert refreshed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_hooks_shape_documents(spark):
    docs = corpus.markdown_documents(
        frame(spark, post(1)),
        spark.createDataFrame([(0, "Ann")], "author_id long, display_name string"),
        render=lambda html: F.concat(html, F.lit("<b>more</b>")),
        markdown_output=lambda md: F.concat(md, F.lit("!")),
    )
    assert docs.first().markdown == (
        "# T1\n\n> Source: https://s/1  \n> Author: Ann  \n> Date: 2024-01-01T00:00:00+00:00\n\nx\n\n**more**!"
    )


def test_median_ratio_is_exact_beyond_any_sketch(spark):
    from trailmark.operators.markdown import savings_report

    rows = spark.range(30_001).selectExpr("'s' site", "repeat('x', cast(100 + id % 7001 as int)) post_content", "repeat('y', 100) markdown")
    ratios = sorted(round((100 + i % 7001) / 100, 6) for i in range(30_001))
    assert savings_report(rows).first().median_ratio == ratios[15_000]


def test_stored_markdown_older_than_its_post_is_built_again(spark):
    listed = posts.with_content(
        posts.listed_posts(b.posts(spark, SF), posts.listed_types(b.PUBLIC_TYPES), 5), b.posts(spark, SF)
    )
    one = listed.orderBy("id").first()
    store = spark.createDataFrame(
        [(one.id, "stored", one.post_modified - timedelta(seconds=1))], "post_id long, markdown string, at timestamp_ntz"
    ).select("post_id", "markdown", F.col("at").alias("built_at"), F.lit("2030-01-01 00:00:00").cast("timestamp_ntz").alias("expires_at"))
    rows = corpus.bundle_rows(listed, store, b.authors(spark, SF), b.AS_OF)
    assert all(r.built and r.markdown != "stored" for r in rows.collect())
    fresh = store.withColumn("built_at", F.col("built_at") + F.expr("interval 1 second"))
    rows = corpus.bundle_rows(listed, fresh, b.authors(spark, SF), b.AS_OF)
    assert {r.id for r in rows.collect() if not r.built} == {one.id}
    assert corpus.built_for_store(rows, b.AS_OF).count() == listed.count() - 1


def test_conversion_bounds_the_arrow_batches_of_any_session(spark):
    keys = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "10000")
    try:
        rows = markdown.html_to_markdown(spark.range(3000).selectExpr("id", "concat('<p>', id, '</p>') AS post_content"))
        assert [spark.conf.get(k) for k in keys] == ["1000", str(8 << 20)]
        assert rows.filter("markdown = CAST(id AS STRING)").count() == 3000
    finally:
        for k, value in zip(keys, before):
            spark.conf.set(k, value)
