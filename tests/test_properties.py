"""Relations that hold on any data."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.local import compare, duck
from checks.oracle import oracle_sql
from checks.queries import QUERIES
from trailmark import bindings as b
from trailmark.functions.html_fold import fold
from trailmark.operators import requests, traffic

SF = "/root/testdata/sf0.01"
PIECES = [
    "<p>", "</p>", "<b>", "</b>", "<ul>", "<ol>", "<li>", "</li>", "</ul>", "<table>", "<tr>", "<td>", "<th>", "</table>",
    "<pre>", "</pre>", "<code>", "</code>", "<a href='u\">", "</a>", "<script>", "</script>", "<!-- x", "-->", "<", ">",
    "&amp;", "&#0;", "&#xD800;", "&#99999999;", "text", "  ", "\n", "|", "`", "<br/>", "</div>", "<div>", "<h2>", "</",
]


@given(st.lists(st.sampled_from(PIECES), max_size=25))
@settings(max_examples=400, deadline=None)
def test_any_tag_soup_converts(pieces):
    assert isinstance(fold("".join(pieces)), str)
    assert isinstance(fold("".join(pieces), drop_raw_text=True), str)


@given(st.text(alphabet="ab \n\t", max_size=30))
def test_plain_text_keeps_its_words(text):
    assert fold(text).split() == text.split()


def test_deep_nesting_converts():
    assert fold("<div>" * 5000 + "x") == "x"


def test_bot_and_unknown_rows_are_disjoint(spark):
    seen = requests.detect(b.access_events(spark, SF), b.LOGGING)
    assert seen.filter("bot_token IS NOT NULL AND unknown_token <> ''").count() == 0
    log = b.request_log(spark, SF)
    assert log.filter("bot_name = 'unknown' AND (cache_hit <> 0 OR bytes_served <> 0)").count() == 0


def test_kept_filter_agrees_with_the_names(spark):
    seen = requests.detect(b.access_events(spark, SF), b.LOGGING)
    kept = seen.filter(F.col("served") | requests.unknown_ua_gate(b.LOGGING))
    assert kept.count() == b.request_log(spark, SF).count() == 8333


def test_series_never_exceeds_daily_counts(spark):
    log = b.request_log(spark, SF)
    for days in (1, 7, 30):
        dense = traffic.daily_bot_series(log, b.AS_OF, days, 5).agg(F.sum("hits")).first()[0] or 0
        sparse = traffic.daily_bot_hits(log, b.AS_OF, days).agg(F.sum("hits")).first()[0]
        assert dense <= sparse


def test_classifying_again_gives_the_same_rows(spark):
    log = b.request_log(spark, SF)
    assert log.exceptAll(b.request_log(spark, SF)).count() == 0
    assert log.select("id").distinct().count() == log.count()


@pytest.mark.parametrize("name", ["daily_bot_hits", "iso_datetime", "stream_daily_hits", "cache_hit_labels", "retention_prune"])
def test_results_do_not_depend_on_the_session_zone(spark, name):
    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        ok, _, _, note = compare(spark, duck(sf), name, QUERIES[name], oracle_sql()[name], sf)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert ok, note
