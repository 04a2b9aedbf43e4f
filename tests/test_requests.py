"""Request decisions at their edges."""

import hashlib

import pytest
from pyspark.sql import functions as F

from trailmark.config import BOT_TOKENS, Settings
from trailmark.functions import detect, text
from trailmark.operators import requests
from trailmark.sources.schemas import ACCESS_EVENTS, LOG_COLUMNS

LOGGING = Settings(enable_logging=True)


def one(spark, column, **values):
    names = list(values)
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("query", "value", "is_md"),
    [
        ("", "", False),
        (None, "", False),
        ("?format=md", "md", True),
        ("format=MD", "MD", True),
        ("?format=M.D", "M.D", True),
        ("?format=%6Dd", "md", True),
        ("?format=m%zzd", "m%zzd", False),
        ("?format=+md", " md", True),
        ("?format=html&format=md", "md", True),
        ("?format=md&format=html", "html", False),
        ("?format=md&format", "", False),
        ("?format=md&format[]=x", "", False),
        ("?Format=md", "", False),
        ("?xformat=md", "", False),
        ("?a=format=md", "", False),
        ("?format=md#frag", "md", True),
        ("?a b=1&format=md", "md", True),
        ("?format=mKd", "mKd", True),
        ("?format=mdK", "mdK", True),
    ],
)
def test_query_param(spark, query, value, is_md):
    assert one(spark, text.query_param(F.col("q"), "format"), q=query) == value
    assert one(spark, detect.query_param_md(F.col("q")), q=query) is is_md


def test_param_name_is_configurable(spark):
    assert one(spark, detect.query_param_md(F.col("q"), "a.b"), q="?a.b=md") is True
    assert one(spark, detect.query_param_md(F.col("q"), "a.b"), q="?axb=md") is False


@pytest.mark.parametrize(
    ("agent", "token", "unknown"),
    [
        ("", None, ""),
        (None, None, ""),
        ("ChatGPT-User GPTBot", "GPTBot", ""),
        ("x GOOGLE-EXTENDED y", "Google-Extended", ""),
        ("Googlebot/2.1", None, "bot"),
        ("my spider crawler", None, "crawler"),
        ("Mozilla/5.0 Chrome/124.0", None, ""),
        ("cooKie", None, ""),
        ("Bytespider bot", "Bytespider", ""),
    ],
)
def test_tokens(spark, agent, token, unknown):
    assert one(spark, detect.first_token(F.col("a"), BOT_TOKENS), a=agent) == token
    assert one(spark, detect.is_bot_ua(F.col("a")), a=agent) is (token is not None)
    assert one(spark, detect.unknown_ua_match(F.col("a")), a=agent) == unknown


def test_kelvin_sign_is_no_k(spark):
    assert one(spark, detect.first_token(F.col("a"), ["kit"]), a="Kit") is None
    assert one(spark, detect.is_bot_ua(F.col("a"), ["kit"]), a="Kit") is False


def test_token_characters_are_plain_text(spark):
    for token in ("a.b", "c++", "x/y", "ai/", "(z)", "É"):
        assert one(spark, detect.is_bot_ua(F.col("a"), [token]), a=f"1{token}2") is True
        assert one(spark, detect.first_token(F.col("a"), [token]), a=f"1{token}2") == token
    assert one(spark, detect.is_bot_ua(F.col("a"), ["a.b"]), a="axb") is False
    assert one(spark, detect.first_token(F.col("a"), ["É"]), a="é") is None


def test_long_lists_match_alike(spark):
    many = [f"agent{i:03d}" for i in range(200)]
    assert one(spark, detect.first_token(F.col("a"), many), a="x AGENT150 agent007") == "agent007"
    assert one(spark, detect.is_bot_ua(F.col("a"), many), a="Agent199") is True


def test_saved_list_replaces_builtin():
    assert detect.bot_tokens(Settings(bot_list=" \n ")) == list(BOT_TOKENS)
    assert detect.bot_tokens(Settings(bot_list=" A \r\n\nB")) == ["A", "B"]


def request(id=1, query="", agent="", address="1.2.3.4", uri="/x", size=10, hit=1, post=1):
    return (id, "2024-01-01 10:00:00.75", post, uri + query, query, agent, address, size, hit)


def events(spark, *rows):
    schema = ", ".join(
        f"{f.name} {'string' if f.name == 'created_at' else f.dataType.simpleString()}" for f in ACCESS_EVENTS
    )
    return spark.createDataFrame(rows, schema).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


BOT, PLAIN, ODD = "GPTBot/1", "Chrome", "Feedfetcher"


def names(spark, settings, **hooks):
    frame = events(
        spark, request(1, "?format=md", PLAIN), request(2, "", BOT), request(3, "", ODD), request(4, "", PLAIN),
        request(5, "?format=md", BOT), request(6, "?format=md", ODD),
    )
    return {r.id: r.bot_name for r in requests.classify(frame, settings, salt="s", **hooks).collect()}


def test_modes(spark):
    mode = lambda m: Settings(enable_logging=True, detection_mode=m)
    assert names(spark, mode("both")) == {1: "manual", 2: "GPTBot", 3: "unknown", 5: "manual", 6: "manual"}
    # The name is "manual" even where only agents are looked at.
    assert names(spark, mode("ua")) == {2: "GPTBot", 3: "unknown", 5: "manual", 6: "unknown"}
    assert names(spark, mode("query_param")) == {1: "manual", 3: "unknown", 5: "manual", 6: "manual"}


def test_logging_switches(spark):
    assert names(spark, Settings()) == {}
    quiet = Settings(enable_logging=True, log_unknown_uas=False)
    assert names(spark, quiet) == {1: "manual", 2: "GPTBot", 5: "manual", 6: "manual"}


def test_hooks(spark):
    every = names(spark, LOGGING, serve_override=lambda served: served | (F.col("id") == 4))
    assert every[4] == "" and every[3] == "unknown"
    none = names(spark, LOGGING, serve_override=lambda served: F.lit(False))
    assert none == {3: "unknown", 6: "unknown"}
    assert names(spark, LOGGING, allow=F.col("id") == 2) == {2: "GPTBot"}
    assert names(spark, LOGGING, bots=["chrome"]) == {1: "manual", 2: "unknown", 3: "unknown", 4: "chrome", 5: "manual", 6: "manual"}
    assert 3 not in names(spark, LOGGING, unknown_tokens=["zzz"])


def test_log_row(spark):
    frame = events(spark, request(7, "?format=md", "é" * 600, " 1.2.3.4 ", "/ü" * 200, -5, 9, -3))
    row = requests.classify(frame, LOGGING, salt="pepper", site_root="https://s.org/").first()
    assert list(row.asDict()) == LOG_COLUMNS
    assert row.post_id == 0 and row.bytes_served == 0 and row.cache_hit == 1
    assert row.url == ("https://s.org" + "/ü" * 200)[:255]
    assert row.user_agent == "é" * 500
    assert row.ip_hash == hashlib.sha256(b"1.2.3.4pepper").hexdigest()
    assert str(row.created_at) == "2024-01-01 10:00:00"
    hidden = requests.classify(events(spark, request(8, "?format=md", address="")), LOGGING, salt="s").first()
    assert hidden.ip_hash == ""


def test_bytes_come_from_the_store(spark):
    store = spark.createDataFrame([(1, "aé")], "post_id long, markdown string")
    rows = requests.with_markdown_bytes(events(spark, request(1, post=1), request(2, post=9)), store)
    assert {r.id: r.payload_bytes for r in rows.collect()} == {1: 3, 2: 10}


def test_routes(spark):
    def route(uri, **off):
        return one(spark, detect.endpoint_route(F.col("u"), Settings(**off)), u=uri)

    assert route("/llms.txt") == route("llms.txt/?a=1") == "index"
    assert route("/llms-full.txt#x") == "bundle"
    assert route("https://s.org/botfood-sitemap.xml") == "sitemap"
    assert route("/llms%20.txt") == "index"
    assert route("/en/llms.txt") == route("/") == "other"
    assert route("/llms.txt", llmstxt_enabled=False) == "other"
    assert route("/botfood-sitemap.xml", sitemap_enabled=False) == "other"


@pytest.mark.parametrize(
    ("url", "result"),
    [
        ("https://a.b/c", "https://a.b/c?format=md"),
        ("https://a.b/c?x=1#top", "https://a.b/c?x=1&format=md#top"),
        ("https://a.b/c?format=html&x=1", "https://a.b/c?format=md&x=1"),
        ("https://a.b/c?format=a&x=1&format=b", "https://a.b/c?format=md&x=1"),
        ("https://a.b/c?", "https://a.b/c?format=md"),
        ("https://a.b/c?format&y=?z", "https://a.b/c?format=md&y=?z"),
    ],
)
def test_add_query_param(spark, url, result):
    assert one(spark, text.add_query_param(F.col("u"), "format", "md"), u=url) == result


def test_text_columns(spark):
    assert one(spark, text.sanitize_text(F.col("h")), h=" a<b>\n\tc%20d  e ") == "a cd e"
    assert [one(spark, text.filled(F.col("h")), h=v) for v in ("0", "", None, "00")] == ["", "", "", "00"]
    assert one(spark, text.trim_words(F.col("h"), 3), h=" <p>a <b>b</b></p><style>x y</style> c\n d") == "a b c&hellip;"
    assert one(spark, text.trim_words(F.col("h"), 4), h="a b  c d ") == "a b c d"
    assert one(spark, text.trim_words(F.col("h")), h=" ") == ""
    assert one(spark, text.xml_escape(F.col("h")), h="<a href=\"x\">'&amp;") == "&lt;a href=&quot;x&quot;&gt;&#039;&amp;amp;"
    assert one(spark, text.xml_escape_url(F.col("h")), h="http://a/?x=1&amp;y='2'&z= <") == "http://a/?x=1&#038;y=&#039;2&#039;&#038;z=%20"
    assert one(spark, text.json_quote(F.col("h")), h='a"b/ü\n') == '"a\\"b/ü\\n"'
