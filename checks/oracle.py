"""Reference SQL for the queries, written for DuckDB over the same sample tables."""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the package shows.
BOT_TOKENS = [
    "GPTBot", "ChatGPT-User", "OAI-SearchBot", "ClaudeBot", "Claude-User", "anthropic-ai", "PerplexityBot",
    "Perplexity-User", "CCBot", "Google-Extended", "Applebot-Extended", "Bytespider", "Meta-ExternalAgent", "cohere-ai",
]
UNKNOWN_TOKENS = ["bot", "crawler", "spider", "gpt", "claude", "anthropic", "fetch", "ai/"]
USER_AGENTS = [
    "Mozilla/5.0 (compatible; GPTBot/1.2)", "mozilla/5.0 claudebot/1.0", "PerplexityBot/1.0", "CCBot/2.0",
    "Mozilla/5.0 Applebot-Extended", "Googlebot/2.1", "SomeCrawler/3.1", "Mozilla/5.0 (Windows NT 10.0) Chrome/124.0",
    "", "curl/8.4.0", "ChatGPT-User GPTBot", "fetch-ai/0.1",
]
QUERY_STRINGS = ["?format=md", "?format=M.D", "?utm=x&format=html&format=md", "?format=html"]

NOW = "TIMESTAMP '2024-01-31 06:30:15'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(col: str) -> str:
    return f"translate({col}, '{UPPER}', '{LOWER}')"


def first_of(col: str, tokens) -> str:
    whens = " ".join(f"WHEN contains({fold(col)}, {q(t.lower())}) THEN {q(t)}" for t in tokens)
    return f"(CASE {whens} END)"


VIEWS: dict[str, str] = {}

VIEWS["ae"] = f"""
SELECT *, '/p/' || post_id || query_string AS uri FROM (
  SELECT event_id + 1 AS id, date_trunc('second', ts) AS created_at,
    CAST(CASE WHEN event_id % 11 = 0 THEN 0 ELSE (event_id * 7 + user_id) % 300 + 1 END AS BIGINT) AS post_id,
    CASE event_id % 9 {" ".join(f"WHEN {i} THEN {q(s)}" for i, s in enumerate(QUERY_STRINGS))} ELSE '' END AS query_string,
    CASE (event_id * 5 + user_id) % 12 {" ".join(f"WHEN {i} THEN {q(s)}" for i, s in enumerate(USER_AGENTS))} END AS user_agent,
    CASE WHEN event_id % 17 = 0 THEN '' ELSE '10.0.' || (user_id % 256) || '.' || (event_id % 4) END AS remote_addr,
    CAST(floor(value * 100) AS BIGINT) AS payload_bytes,
    CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS cache_hit
  FROM events)"""

VIEWS["seen"] = f"""
SELECT *, coalesce(regexp_replace(lower(fmt), '[^a-z0-9_-]', '', 'g') = 'md', false) AS is_md,
  CASE WHEN bot IS NULL AND user_agent <> '' THEN coalesce(heur, '') ELSE '' END AS unknown_token
FROM (SELECT *, {first_of("user_agent", BOT_TOKENS)} AS bot, {first_of("user_agent", UNKNOWN_TOKENS)} AS heur,
  CASE WHEN length(params) > 0 THEN url_decode(substr(params[-1], 8)) ELSE '' END AS fmt
  FROM (SELECT *, list_filter(string_split(ltrim(query_string, '?'), '&'), lambda p: starts_with(p, 'format=')) AS params FROM ae))"""

VIEWS["log"] = """
SELECT id, post_id, left(uri, 255) AS url, left(user_agent, 500) AS user_agent,
  CASE WHEN is_md THEN 'manual' WHEN bot IS NOT NULL THEN bot ELSE 'unknown' END AS bot_name,
  CASE WHEN remote_addr = '' THEN '' ELSE sha256(remote_addr || 'fixture-salt') END AS ip_hash,
  CASE WHEN is_md OR bot IS NOT NULL THEN greatest(0, payload_bytes) ELSE 0 END AS bytes_served,
  CASE WHEN is_md OR bot IS NOT NULL THEN cache_hit ELSE 0 END AS cache_hit,
  created_at
FROM seen WHERE is_md OR bot IS NOT NULL OR unknown_token <> ''"""

VIEWS["posts"] = """
SELECT page_id + 1 AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS post_title, url AS permalink,
  html AS page_html, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS post_content,
  CASE WHEN page_id % 3 = 0 THEN 'Excerpt for page ' || page_id ELSE '' END AS post_excerpt,
  CASE page_id % 10 WHEN 0 THEN 'draft' WHEN 1 THEN 'private' ELSE 'publish' END AS post_status,
  CASE WHEN page_id % 13 = 0 THEN 'secret' ELSE '' END AS post_password,
  CASE WHEN page_id % 29 = 0 THEN 'attachment' WHEN page_id % 4 = 3 THEN 'page' ELSE 'post' END AS post_type,
  page_id % 10 AS post_author,
  TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL 37 MINUTE AS post_date,
  TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL 37 MINUTE + (page_id % 5) * INTERVAL 1 HOUR AS post_modified,
  CASE WHEN page_id % 17 = 0 THEN '1' ELSE '' END AS yoast,
  CASE WHEN page_id % 19 = 0 THEN 'noindex,nofollow' WHEN page_id % 7 = 0 THEN 'index' ELSE '' END AS robots,
  CASE WHEN page_id % 23 = 0 THEN '1' ELSE '' END AS genesis,
  CASE WHEN contains(url, '.html') THEN 'https://img.example.org/' || page_id || '.png' END AS image,
  page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS site
FROM pages"""

VIEWS["hidden"] = (
    "SELECT id FROM posts WHERE yoast = '1' OR genesis = '1' OR list_contains(string_split(robots, ','), 'noindex')"
)
VIEWS["servable"] = """
SELECT * FROM posts WHERE post_status = 'publish' AND post_password = '' AND id NOT IN (SELECT id FROM hidden)"""


def listed(n: int) -> str:
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY post_date DESC, id DESC) AS rn FROM posts
  WHERE post_status = 'publish' AND post_type <> 'attachment')
WHERE rn <= {n} AND post_password = '' AND id NOT IN (SELECT id FROM hidden)"""


VIEWS["listed"] = listed(100)
VIEWS["mapped"] = listed(1000)

VIEWS["terms"] = """
SELECT DISTINCT page_id + 1 AS post_id, 'category' AS taxonomy, n_name AS name
FROM pages JOIN nation ON n_nationkey = page_id % 25 OR n_nationkey = (page_id * 3) % 25
UNION ALL
SELECT page_id + 1, 'post_tag', p_brand FROM pages JOIN part ON p_partkey = page_id % 20"""
VIEWS["post_names"] = """
SELECT post_id, list_sort(list(name) FILTER (taxonomy = 'category')) AS cats,
  list_sort(list(name) FILTER (taxonomy = 'post_tag')) AS tags FROM terms GROUP BY post_id"""
VIEWS["authored"] = """
SELECT p.*, coalesce(s_name, '') AS author, cats, tags FROM posts p
LEFT JOIN supplier ON s_suppkey = post_author LEFT JOIN post_names ON post_id = id"""
VIEWS["sites"] = """
SELECT site, site AS name, 'Pages of ' || site AS description, length(site) % 4 <> 0 AS is_public
FROM (SELECT DISTINCT site FROM posts)"""
VIEWS["site_settings"] = r"""
SELECT site, CASE length(site) % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' || site || 'Bot ' || chr(10) || chr(10) || ' CCBot' || chr(10)
  ELSE ' ' || chr(10) || ' ' END AS bot_list,
  CASE length(site) % 2 WHEN 0 THEN 'page,attachment,news' ELSE '' END AS enabled_types,
  CAST((length(site) % 5) * 10 - 13 AS INTEGER) AS retention_days FROM sites"""
VIEWS["saved_lines"] = """
SELECT site, list_filter(list_transform(string_split(bot_list, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM site_settings"""
BUILTIN = "[" + ", ".join(q(t) for t in BOT_TOKENS) + "]"
VIEWS["tokens"] = f"""
SELECT site, unnest(range(length(l))) AS pos, unnest(l) AS token
FROM (SELECT site, CASE WHEN length(lines) = 0 THEN {BUILTIN} ELSE lines END AS l FROM saved_lines)"""
VIEWS["store"] = """
SELECT id AS post_id, '# stored ' || page_id AS markdown, post_date + INTERVAL 2 HOUR AS built_at,
  post_date + INTERVAL 2 HOUR + (page_id % 40) * INTERVAL 1 DAY AS expires_at
FROM posts WHERE NOT contains(permalink, '?')"""
VIEWS["stale"] = f"""
SELECT p.* FROM posts p LEFT JOIN store s ON s.post_id = p.id
WHERE s.post_id IS NULL OR expires_at < {NOW} OR built_at < post_modified"""


def decode(col: str) -> str:
    """The entities that occur in the sample pages with their semicolon."""
    for name, char in (("&quot;", "chr(34)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")):
        col = f"replace({col}, '{name}', {char})"
    return col


def trim(col: str) -> str:
    return rf"regexp_replace({col}, '^[ \t\n\r\x0b\x00]+|[ \t\n\r\x0b\x00]+$', '', 'g')"


def squash(col: str) -> str:
    return rf"regexp_replace(replace({col}, chr(160), ' '), '[ \t\n\r\f\x0b]+', ' ', 'g')"


def block(kind: str, col: str) -> str:
    return trim(squash(decode(col)))


# Sample articles are one heading, then paragraphs; some open with a never-closed bold run that
# ends at a line break. Each piece that starts with <p> is a paragraph.
ARTICLE_BODY = rf"""
'# ' || {block("h", "regexp_extract(c, '(?s)<h1>(.*?)</h1>', 1)")} || chr(10) || chr(10) ||
  {squash(decode("regexp_extract(c, '(?s)</h1>([^<]*)', 1)"))} ||
  list_aggregate(list_transform(string_split(c, '<p>')[2:], lambda p:
    (CASE WHEN starts_with(p, '<b>')
      THEN '**' || {block("p", "regexp_extract(p, '(?s)^<b>([^<]*)', 1)")} || '**'
      ELSE {block("p", "regexp_extract(p, '(?s)^([^<]*)', 1)")} END) || chr(10) || chr(10) ||
    {squash(decode("regexp_extract(p, '(?s)</p>([^<]*)', 1)"))}), 'string_agg', '')"""

VIEWS["md"] = f"SELECT id, {trim(ARTICLE_BODY)} AS markdown FROM (SELECT id, post_content AS c FROM posts)"

# Around the article a page has a title, a list of links, a remark and a footer.
LINKS = rf"""
list_aggregate(list_transform(regexp_extract_all(h, '<li><a href="[^"]*">[^<]*</a></li>'), lambda x:
  '- [' || {squash(decode("regexp_extract(x, '>([^<]*)</a>', 1)"))} || '](' || {decode("regexp_extract(x, 'href=\"([^\"]*)', 1)")} || ')' || chr(10)), 'string_agg', '')"""
PAGE_MD = rf"""
{squash(decode("regexp_extract(h, '<title>([^<]*)', 1)"))} || chr(10) || {LINKS} || chr(10) ||
{squash(decode("regexp_extract(h, '<div class=.ad.>([^<]*)', 1)"))} || chr(10) || chr(10) || {ARTICLE_BODY} ||
{squash(decode("regexp_extract(h, '<footer>([^<]*)', 1)"))}"""
PAGE_TRIMMED = trim(f"regexp_replace({PAGE_MD}, chr(10) || '{{3,}}', chr(10) || chr(10), 'g')")
VIEWS["page_md"] = f"SELECT id, {PAGE_TRIMMED} AS markdown FROM (SELECT id, post_content AS c, page_html AS h FROM posts)"


def iso(col: str) -> str:
    return f"(strftime({col}, '%Y-%m-%dT%H:%M:%S') || '+00:00')"


NL = "chr(10)"
QUOTE_HEADER = (
    f"'# ' || post_title || {NL} || {NL} || '> Source: ' || permalink || '  ' || {NL} || '> Author: ' || author || '  '"
    f" || {NL} || '> Date: ' || {iso('post_date')} || {NL} || {NL}"
)


def yaml(title: str) -> str:
    def esc(col):
        return f"replace({col}, chr(34), chr(92) || chr(34))"

    return (
        f"'---' || {NL} || 'title: \"' || {esc(title)} || '\"' || {NL} || 'url: ' || permalink || {NL} || 'author: ' || author || {NL}"
        f" || 'date: ' || {iso('post_date')} || {NL} || 'categories: [' || array_to_string(cats, ', ') || ']' || {NL}"
        f" || 'tags: [' || array_to_string(tags, ', ') || ']' || {NL}"
        f" || CASE WHEN post_excerpt <> '' THEN 'excerpt: \"' || {esc('post_excerpt')} || '\"' || {NL} ELSE '' END"
        f" || '---' || {NL} || {NL} || '# ' || {title} || {NL} || {NL}"
    )


def js(col: str) -> str:
    return f"CAST(to_json({col}) AS VARCHAR)"


def article_members(indent: bool) -> str:
    sep, gap = (f"',' || {NL}", "' '") if indent else ("','", "''")
    pad = [("repeat(' ', %d)" % n) if indent else "''" for n in (4, 8)]
    nl = NL if indent else "''"

    def member(p, key, value):
        return f"{p} || '\"{key}\":' || {gap} || {value}"

    def obj(key, *members):
        inner = f" || {sep} || ".join(members)
        return f"{pad[0]} || '\"{key}\":' || {gap} || '{{' || {nl} || {inner} || {nl} || {pad[0]} || '}}'"

    flat = [
        member(pad[0], "@context", "'\"https://schema.org\"'"), member(pad[0], "@type", "'\"Article\"'"),
        member(pad[0], "headline", js("post_title")), member(pad[0], "url", js("permalink")),
        member(pad[0], "datePublished", js(iso("post_date"))), member(pad[0], "dateModified", js(iso("post_modified"))),
        obj("author", member(pad[1], "@type", "'\"Person\"'"), member(pad[1], "name", js("author"))),
        obj(
            "publisher", member(pad[1], "@type", "'\"Organization\"'"), member(pad[1], "name", js("site")),
            member(pad[1], "url", js("'https://' || site || '/'")),
        ),
    ]
    image = f"CASE WHEN image IS NULL THEN '' ELSE {sep} || {member(pad[0], 'image', js('image'))} END"
    return f" || {sep} || ".join(flat) + " || " + image


ARTICLE_JSON = f"'{{' || {article_members(False)} || '}}'"
ARTICLE_BLOCK = f"'```json' || {NL} || '{{' || {NL} || {article_members(True)} || {NL} || '}}' || {NL} || '```' || {NL}"

VIEWS["docs"] = f"SELECT id, {QUOTE_HEADER} || markdown AS markdown FROM authored JOIN md USING (id)"
VIEWS["bundled"] = f"""
SELECT l.site, l.id, l.post_date, octet_length(encode('# ' || l.site || ' — full content' || {NL} || {NL})) AS header_bytes,
  coalesce(s.markdown, d.markdown) || {NL} || {NL} || '---' || {NL} || {NL} AS section
FROM listed l JOIN docs d ON d.id = l.id LEFT JOIN store s ON s.post_id = l.id AND s.expires_at >= {NOW} AND s.built_at >= l.post_modified"""
VIEWS["sized"] = """
SELECT *, octet_length(encode(section)) AS section_bytes, CAST(header_bytes + sum(octet_length(encode(section))) OVER (
  PARTITION BY site ORDER BY post_date DESC, id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_bytes FROM bundled"""


def words(col: str) -> str:
    bare = rf"trim(regexp_replace({col}, '(?s)<!--.*?-->|<[a-zA-Z/!?][^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))"
    return rf"list_filter(regexp_split_to_array({bare}, '[\n\r\t ]+'), lambda w: w <> '')"


def summary(col: str) -> str:
    return f"array_to_string(({words(col)})[1:20], ' ') || CASE WHEN length({words(col)}) > 20 THEN '&hellip;' ELSE '' END"


# Page addresses of the samples carry no "format" parameter of their own.
MD_URL = r"""regexp_extract(permalink, '^([^?#]*)', 1) || '?' ||
  CASE WHEN contains(split_part(permalink, '#', 1), '?') AND split_part(split_part(permalink, '#', 1), '?', 2) <> ''
    THEN split_part(split_part(permalink, '#', 1), '?', 2) || '&' ELSE '' END || 'format=md' || regexp_extract(permalink, '(#.*)$', 1)"""


def xml(col: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        col = f"replace({col}, {q(raw)}, {q(safe)})"
    return col


def xml_url(col: str) -> str:
    kept = rf"regexp_replace(replace({col}, ' ', '%20'), '[^a-zA-Z0-9\-~+_.?#=!&;,/:%@$|*''()\[\]\x{{80}}-\x{{10FFFF}}]', '', 'g')"
    return f"replace(replace(replace({kept}, '&amp;', '&'), '&', '&#038;'), '''', '&#039;')"


VIEWS["entries"] = f"SELECT site, id, post_date, {MD_URL} AS loc, {iso('post_modified')} AS lastmod FROM mapped"


def recent(days: int, where: str = "true") -> str:
    return f"FROM log WHERE created_at >= {NOW} - INTERVAL {days} DAY AND {where}"


def counted(key: str, days: int, where: str = "true") -> str:
    return f"SELECT {key}, count(*) AS hits, max(created_at) AS last_seen {recent(days, where)} GROUP BY {key}"


def top(key: str, days: int, limit: int, where: str) -> str:
    return f"{counted(key, days, where)} ORDER BY hits DESC, {key} LIMIT {limit}"


def titled(days: int, limit: int) -> str:
    return f"""SELECT t.post_id, coalesce(post_title, '') AS post_title, hits, last_seen
FROM ({top("post_id", days, limit, "post_id > 0")}) t LEFT JOIN posts ON id = t.post_id"""


def daily(days: int) -> str:
    return f"SELECT CAST(created_at AS DATE) AS dt, bot_name, count(*) AS hits {recent(days, "bot_name <> ''")} GROUP BY ALL"


def axis(days: int) -> str:
    return f"SELECT CAST(unnest(generate_series(DATE '2024-01-31' - {days - 1}, DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS dt"


def ranked(days: int, n: int | None) -> str:
    limit = "" if n is None else f"LIMIT {n}"
    return f"SELECT bot_name, CAST(sum(hits) AS BIGINT) AS total FROM ({daily(days)}) GROUP BY bot_name ORDER BY total DESC, bot_name {limit}"


def series(days: int, n: int | None) -> str:
    return f"""SELECT a.dt, r.bot_name, coalesce(hits, 0) AS hits FROM ({axis(days)}) a, ({ranked(days, n)}) r
LEFT JOIN ({daily(days)}) d ON d.dt = a.dt AND d.bot_name = r.bot_name"""


RATE = "CAST(sum(cache_hit) AS DOUBLE) / nullif(count(*), 0)"
LABEL = f"coalesce(CAST(CAST(round({RATE} * 100) AS INTEGER) AS VARCHAR) || '%', '—')"
ROUTES = (
    "CASE page_id % 5 WHEN 0 THEN 'index' WHEN 1 THEN 'bundle' WHEN 2 THEN 'sitemap' ELSE 'other' END"
)

INDEX_DOC = f"""
SELECT s.site, '# ' || name || {NL} || {NL} || '> ' || description || {NL} || {NL} || '## Posts' || {NL} || {NL} ||
  coalesce(body, '') AS document
FROM sites s LEFT JOIN (SELECT site, string_agg('- [' || post_title || '](' || permalink || '): ' ||
  {summary("CASE WHEN post_excerpt <> '' THEN post_excerpt ELSE post_content END")} || {NL}, '' ORDER BY post_date DESC, id DESC) AS body
  FROM listed GROUP BY site) b ON b.site = s.site"""

TTL = 6 * 3600
LABELS = f"""
, req AS (SELECT id, post_id, created_at FROM seen WHERE (is_md OR bot IS NOT NULL) AND post_id > 0),
seg AS (SELECT r.*, s.post_modified IS NOT NULL AND s.post_modified <= r.created_at AS after_save
  FROM req r LEFT JOIN posts s ON s.id = r.post_id),
inst AS (SELECT post_id, after_save, created_at AS t, min(id) AS id FROM seg GROUP BY ALL),
chain AS (SELECT post_id, after_save, min(t) AS t FROM inst GROUP BY ALL
  UNION ALL SELECT i.post_id, i.after_save, i.t FROM chain c
  JOIN LATERAL (SELECT post_id, after_save, min(t) AS t FROM inst WHERE inst.post_id = c.post_id
    AND inst.after_save = c.after_save AND inst.t > c.t + INTERVAL {TTL} SECOND GROUP BY ALL) i ON true)
SELECT req.id, req.post_id, CASE WHEN m.id IS NULL THEN 1 ELSE 0 END AS cache_hit FROM req LEFT JOIN (
  SELECT inst.id FROM inst JOIN chain USING (post_id, after_save, t)) m ON m.id = req.id"""

SERVED_LABELS = LABELS.replace(
    "AND post_id > 0)", "AND post_id > 0 AND post_id IN (SELECT id FROM servable WHERE post_type <> 'attachment'))"
)
SERVED_LOG = f"""{SERVED_LABELS.rsplit("SELECT req.id", 1)[0]}
SELECT l.id, l.post_id, url, user_agent, bot_name, ip_hash,
  CASE WHEN r.id IS NULL THEN 0 ELSE coalesce(octet_length(encode(d.markdown)), l.bytes_served) END AS bytes_served,
  CASE WHEN r.id IS NULL THEN 0 WHEN m.id IS NULL THEN 1 ELSE 0 END AS cache_hit, l.created_at
FROM log l LEFT JOIN req r ON r.id = l.id LEFT JOIN docs d ON d.id = l.post_id
LEFT JOIN (SELECT inst.id FROM inst JOIN chain USING (post_id, after_save, t)) m ON m.id = l.id
WHERE r.id IS NOT NULL OR bot_name = 'unknown'"""

ENDED = f"{NOW} + INTERVAL 1 DAY"
REFRESHED = f"""SELECT post_id, markdown, built_at, expires_at FROM store WHERE post_id NOT IN (SELECT id FROM stale)
UNION ALL SELECT id, d.markdown, {NOW}, {ENDED} FROM docs d WHERE id IN (SELECT id FROM stale)"""

LOG_ALL = "SELECT * FROM log"
KEPT = f"SELECT * {recent(7)}"
SEVEN = "created_at, post_id, url, user_agent, bot_name, bytes_served, cache_hit"

BODIES: dict[str, str] = {
    "scan_request_log": LOG_ALL,
    "scan_access_events": "SELECT * FROM ae",
    "scan_posts": "SELECT id, post_title, post_status, post_type, post_date FROM posts WHERE post_status = 'publish' "
    "AND post_type IN ('post', 'page') ORDER BY post_date DESC, id DESC LIMIT 100",
    "scan_post_by_id": f"SELECT id, post_title, permalink FROM posts WHERE id IN (SELECT post_id {recent(7)})",
    "scan_post_meta": "SELECT id AS post_id, yoast AS meta_yoast_noindex, replace(robots, ',', '|') AS meta_rankmath_robots, "
    "genesis AS meta_genesis_noindex FROM posts WHERE yoast <> '' OR robots <> '' OR genesis <> ''",
    "scan_post_terms": "SELECT post_id, array_to_string(cats, '|') AS categories, array_to_string(tags, '|') AS tags FROM post_names",
    "scan_bot_list": "SELECT site, CAST(pos AS INTEGER) AS pos, token FROM tokens",
    "append_request_log": "SELECT *, CAST(created_at AS DATE) AS dt FROM log",
    "retention_prune": KEPT,
    "retention_kept": KEPT,
    "retention_expired": f"SELECT CAST(created_at AS DATE) AS dt, count(*) AS expired FROM log WHERE created_at < {NOW} - INTERVAL 7 DAY GROUP BY 1",
    "purge_log": "SELECT count(*) AS rows_left FROM log WHERE false",
    "export_csv": f"SELECT {SEVEN} {recent(7)}",
    "write_text_documents": INDEX_DOC,
    "chart_json": f"""
SELECT '{{"labels":[' || (SELECT string_agg('"' || strftime(dt, '%Y-%m-%d') || '"', ',' ORDER BY dt) FROM ({axis(30)})) ||
  '],"datasets":[' || string_agg('{{"label":"' || bot_name || '","data":[' || data || ']}}', ',' ORDER BY total DESC, bot_name) || ']}}' AS chart
FROM (SELECT s.bot_name, total, string_agg(CAST(hits AS VARCHAR), ',' ORDER BY dt) AS data FROM ({series(30, 5)}) s
  JOIN ({ranked(30, 5)}) r ON r.bot_name = s.bot_name GROUP BY ALL)""",
    "markdown_store_upsert": f"SELECT id AS post_id, '# new ' || post_title AS markdown, {NOW} AS built_at, {NOW} + INTERVAL {TTL} SECOND AS expires_at FROM posts",
    "markdown_store_invalidate": "SELECT store.* FROM store JOIN posts ON id = post_id WHERE post_modified <= built_at",
    "window_filter": f"SELECT id, created_at, bot_name {recent(7)}",
    "named_bot_rows": "SELECT id, bot_name FROM log WHERE bot_name <> ''",
    "post_rows": "SELECT id, post_id FROM log WHERE post_id > 0",
    "unknown_rows": "SELECT id, user_agent FROM log WHERE bot_name = 'unknown'",
    "detect_markdown_request": "SELECT id, bot IS NOT NULL AS serve_ua, is_md AS serve_query_param, is_md OR bot IS NOT NULL AS serve_both FROM seen",
    "query_param_md": "SELECT id, is_md, fmt AS format FROM seen",
    "is_bot_ua": "SELECT id, bot IS NOT NULL AS is_bot FROM seen",
    "unknown_ua_match": "SELECT id, unknown_token FROM seen",
    "unknown_ua_gate": "SELECT id, user_agent, unknown_token FROM seen WHERE NOT (is_md OR bot IS NOT NULL) AND unknown_token <> ''",
    "log_gate": "SELECT id, remote_addr FROM seen WHERE (is_md OR bot IS NOT NULL) AND remote_addr <> ''",
    "servable_posts": "SELECT id, post_type FROM servable WHERE post_type IN ('post', 'page')",
    "noindex_posts": "SELECT id AS post_id FROM hidden",
    "type_filter": "SELECT id, post_type FROM posts WHERE post_type = 'page'",
    "servable_requests": "SELECT id, post_id, created_at FROM seen WHERE (is_md OR bot IS NOT NULL) AND post_id > 0 AND post_id IN "
    "(SELECT id FROM servable WHERE post_type <> 'attachment')",
    "served_request_log": SERVED_LOG,
    "endpoint_route": f"SELECT page_id, {ROUTES} AS route FROM pages",
    "export_projection": f"SELECT {SEVEN} FROM log",
    "markdown_preview": "SELECT id AS post_id, CASE WHEN post_status = 'publish' THEN left(d.markdown, 500) ELSE '' END AS preview FROM posts JOIN docs d USING (id)",
    "top_posts_titled": titled(30, 50),
    "bot_first_match": f"""
SELECT user_agent, arg_min(token, pos) AS token FROM (SELECT DISTINCT user_agent FROM ae WHERE user_agent <> '')
JOIN (SELECT token, min(pos) AS pos FROM tokens GROUP BY token) ON contains({fold("user_agent")}, {fold("token")}) GROUP BY user_agent""",
    "bot_first_match_by_site": f"""
SELECT a.site, user_agent, arg_min(token, pos) AS token
FROM (SELECT site, unnest([{", ".join(q(u) for u in USER_AGENTS)}]) AS user_agent FROM sites) a
JOIN tokens t ON t.site = a.site AND contains({fold("user_agent")}, {fold("token")}) WHERE user_agent <> '' GROUP BY a.site, user_agent""",
    "unknown_not_bot": "SELECT id, user_agent FROM seen WHERE heur IS NOT NULL AND bot IS NULL",
    "series_fill": series(7, None),
    "top_bot_semi": f"SELECT bot_name, dt, hits FROM ({daily(30)}) WHERE bot_name IN (SELECT bot_name FROM ({ranked(30, 3)}))",
    "post_author_join": "SELECT id, author FROM authored",
    "post_terms_join": "SELECT id, array_to_string(cats, ', ') AS categories, array_to_string(tags, ', ') AS tags FROM authored",
    "post_image_join": "SELECT id, image FROM posts",
    "markdown_stale": "SELECT id FROM stale",
    "total_requests": f"SELECT count(*) AS total {recent(30)}",
    "request_totals": f"""
SELECT count(*) FILTER (created_at >= {NOW} - INTERVAL 1 DAY) AS requests_1d,
  count(*) FILTER (created_at >= {NOW} - INTERVAL 7 DAY) AS requests_7d,
  count(*) FILTER (created_at >= {NOW} - INTERVAL 30 DAY) AS requests_30d FROM log""",
    "cache_hit_rate": f"SELECT {RATE} AS hit_rate {recent(7)}",
    "top_bots": top("bot_name", 30, 5, "bot_name <> ''"),
    "top_bots_by_site": f"""
SELECT site, bot_name, hits, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY hits DESC, bot_name) AS rn FROM (
  SELECT 'site' || (id % 3) AS site, bot_name, count(*) AS hits, max(created_at) AS last_seen {recent(30, "bot_name <> ''")} GROUP BY 1, 2)) WHERE rn <= 2""",
    "top_bots_collated": top("bot_name", 30, 5, "bot_name <> ''"),
    "top_posts": top("post_id", 30, 5, "post_id > 0"),
    "top_posts_known": top("post_id", 30, 20, "post_id > 0 AND post_id IN (SELECT id FROM posts)"),
    "unknown_uas": f"{counted('user_agent', 30, "bot_name = 'unknown'")} ORDER BY last_seen DESC, user_agent LIMIT 50",
    "daily_bot_hits": daily(30),
    "bot_totals": f"SELECT bot_name, total AS hits FROM ({ranked(30, None)})",
    "daily_bot_series": series(30, 5),
    "traffic_summary": f"""
SELECT (SELECT count(*) {recent(7)}) AS total, (SELECT {LABEL} {recent(7)}) AS hit_rate_label,
  (SELECT '[' || string_agg('{{"bot_name":"' || bot_name || '","hits":' || hits || '}}', ',' ORDER BY hits DESC, bot_name) || ']'
    FROM ({top("bot_name", 7, 5, "bot_name <> ''")})) AS top_bots,
  (SELECT '[' || string_agg('{{"post_id":' || post_id || ',"post_title":' || {js("post_title")} || ',"hits":' || hits || '}}', ',' ORDER BY hits DESC, post_id) || ']'
    FROM ({titled(7, 5)})) AS top_posts""",
    "analytics_report": f"""
SELECT 'totals' AS part, 'requests_' || n || 'd' AS item, (SELECT count(*) FROM log WHERE created_at >= {NOW} - n * INTERVAL 1 DAY) AS hits,
  CAST(NULL AS TIMESTAMP) AS last_seen FROM (VALUES (1), (7), (30)) t(n)
UNION ALL SELECT 'series', strftime(dt, '%Y-%m-%d') || ' ' || bot_name, hits, NULL FROM ({series(30, 5)})
UNION ALL SELECT 'bots', bot_name, hits, last_seen FROM ({top("bot_name", 30, 50, "bot_name <> ''")})
UNION ALL SELECT 'posts', post_id || ' ' || post_title, hits, last_seen FROM ({titled(30, 50)})
UNION ALL SELECT 'unknown', user_agent, hits, last_seen FROM ({counted('user_agent', 30, "bot_name = 'unknown'")} ORDER BY last_seen DESC, user_agent LIMIT 50)""",
    "collect_terms": "SELECT post_id, taxonomy, array_to_string(list_sort(list(name)), '|') AS names FROM terms GROUP BY post_id, taxonomy",
    "ordered_concat": "SELECT site, string_agg(id || ';', '' ORDER BY post_date DESC, id DESC) AS body FROM listed GROUP BY site",
    "llms_full_cap": "SELECT site, id, section_bytes, running_bytes FROM sized WHERE running_bytes <= 20000",
    "per_site_limit": "SELECT site, id FROM posts QUALIFY row_number() OVER (PARTITION BY site ORDER BY post_date DESC, id DESC) <= 3",
    "first_match_rank": "SELECT id, bot AS token FROM seen WHERE bot IS NOT NULL",
    "topk_hits": "SELECT post_id, count(*) AS hits FROM log WHERE post_id > 0 GROUP BY post_id ORDER BY hits DESC, post_id LIMIT 10",
    "topk_recent": f"{counted('user_agent', 365, "bot_name = 'unknown'")} ORDER BY last_seen DESC, user_agent LIMIT 2",
    "sort_export": f"SELECT {SEVEN} {recent(30)} ORDER BY created_at DESC, id DESC",
    "sort_days": f"{daily(7)} ORDER BY dt, bot_name",
    "topn_bots_series": ranked(30, 3),
    "latest_posts": "SELECT id, post_date FROM posts WHERE post_status = 'publish' AND post_type <> 'attachment' ORDER BY post_date DESC, id DESC LIMIT 20",
    "types_intersect": "SELECT site, CASE WHEN enabled_types <> '' THEN 'page' ELSE 'page,post' END AS types FROM site_settings",
    "bot_list_add": """
SELECT site, array_to_string(CASE WHEN list_contains(lines, ua) THEN lines ELSE list_append(lines, ua) END, chr(10)) AS bot_list
FROM saved_lines JOIN (SELECT site, CASE WHEN is_public THEN site || 'Bot' ELSE 'Googlebot/2.1' END AS ua FROM sites) USING (site)""",
    "bot_list_extend": f"""
SELECT site, array_to_string(list_append(CASE WHEN length(lines) = 0 THEN {BUILTIN} ELSE lines END, 'Googlebot/2.1'), chr(10)) AS bot_list FROM saved_lines""",
    "types_except": "SELECT DISTINCT post_type FROM posts EXCEPT SELECT 'attachment'",
    "html_to_markdown": "SELECT id, markdown, CAST(NULL AS VARCHAR) AS error FROM md",
    "html_to_markdown_page": "SELECT id, markdown, CAST(NULL AS VARCHAR) AS error FROM page_md",
    "log_normalise": """
SELECT id, greatest(0, post_id - 5) AS post_id, left(repeat('/é/' || query_string, 20), 255) AS url,
  left(repeat(user_agent, 20), 500) AS user_agent, left(repeat('ñame ', 30), 100) AS bot_name,
  CASE WHEN remote_addr = '' THEN '' ELSE sha256(remote_addr || 'fixture-salt') END AS ip_hash,
  greatest(0, payload_bytes - 1000) AS bytes_served, cache_hit, created_at FROM ae""",
    "ip_hash": "SELECT id, CASE WHEN remote_addr = '' THEN '' ELSE sha256(remote_addr || 'fixture-salt') END AS ip_hash FROM ae",
    "resolve_bot_name": "SELECT id, CASE WHEN is_md THEN 'manual' ELSE coalesce(bot, '') END AS bot_name FROM seen",
    "request_url": "SELECT id, 'https://example.org' || uri || '%20abé' AS url FROM ae",
    "byte_length": "SELECT id, octet_length(encode(post_content)) AS bytes FROM posts",
    "day_bucket": "SELECT id, CAST(created_at AS DATE) AS dt, created_at - INTERVAL 7 DAY AS week_before FROM log",
    "date_axis": "SELECT strftime((SELECT CAST(max(created_at) AS DATE) FROM log) - i, '%Y-%m-%d') AS label FROM (SELECT CAST(unnest(range(7)) AS INTEGER) AS i)",
    "hit_rate_label": f"SELECT CAST(created_at AS DATE) AS dt, {LABEL} AS label FROM log GROUP BY 1",
    "iso_datetime": f"SELECT id, {iso('post_modified')} AS utc, strftime(post_modified + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+02:00' AS local FROM posts",
    "yaml_header": f"SELECT id, {yaml('t')} AS header FROM (SELECT *, 'A \"' || post_title || '\"' AS t FROM authored)",
    "quote_header": f"SELECT id, {QUOTE_HEADER} AS header FROM authored",
    "article_json": f"SELECT id, {ARTICLE_JSON} AS article FROM authored",
    "article_block": f"SELECT id, {ARTICLE_BLOCK} AS block FROM authored",
    "trim_words": f"SELECT id, {summary('post_content')} AS summary FROM posts",
    "add_query_param": f"SELECT page_id, {MD_URL} AS url FROM posts",
    "xml_escape": f"SELECT page_id, {xml('html')} AS html, {xml_url('url')} AS url FROM pages",
    "url_path": "SELECT page_id, trim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS path FROM pages",
    "parse_token_list": "SELECT site, array_to_string(lines, '|') AS tokens FROM saved_lines",
    "sanitize_key": "SELECT page_id, regexp_replace(lower(url), '[^a-z0-9_-]', '', 'g') AS key FROM pages",
    "whitelist_value": "SELECT site, CASE WHEN retention_days IN (7, 30, 90, 365) THEN retention_days ELSE 30 END AS retention_days FROM site_settings",
    "markdown_documents": f"SELECT id AS post_id, {yaml('post_title')} || markdown AS markdown FROM authored JOIN md USING (id)",
    "markdown_documents_schema": f"SELECT id AS post_id, {QUOTE_HEADER} || markdown || {NL} || {NL} || {ARTICLE_BLOCK} AS markdown FROM authored JOIN md USING (id)",
    "markdown_refresh": REFRESHED,
    "listed_posts": f"SELECT site, id FROM ({listed(10)})",
    "llms_index": INDEX_DOC,
    "llms_full": f"""
SELECT s.site, '# ' || name || ' — full content' || {NL} || {NL} || coalesce(body, '') AS document FROM sites s LEFT JOIN (
  SELECT site, string_agg(section, '' ORDER BY post_date DESC, id DESC) AS body FROM sized WHERE running_bytes <= 512000 GROUP BY site) b ON b.site = s.site""",
    "sitemap_entries": "SELECT site, id, loc, lastmod FROM entries",
    "sitemap_xml": f"""
SELECT s.site, '<?xml version="1.0" encoding="UTF-8"?>' || {NL} || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || {NL} ||
  coalesce(body, '') || '</urlset>' || {NL} AS document FROM sites s LEFT JOIN (
  SELECT site, string_agg(chr(9) || '<url>' || {NL} || chr(9) || chr(9) || '<loc>' || {xml_url('loc')} || '</loc>' || {NL} ||
    chr(9) || chr(9) || '<lastmod>' || lastmod || '</lastmod>' || {NL} || chr(9) || '</url>' || {NL}, '' ORDER BY post_date DESC, id DESC) AS body
  FROM entries GROUP BY site) b ON b.site = s.site""",
    "robots_lines": f"""
SELECT site, CASE WHEN is_public THEN {NL} || '# Markdown versions of content for AI crawlers' || {NL} ||
  'Sitemap: https://' || site || '/botfood-sitemap.xml' || {NL} ELSE '' END AS robots FROM sites""",
    "savings_report": """
SELECT site, count(*) AS posts, CAST(sum(h) AS BIGINT) AS html_bytes, CAST(sum(m) AS BIGINT) AS markdown_bytes,
  CAST(sum(h) // 4 AS BIGINT) AS html_tokens, CAST(sum(m) // 4 AS BIGINT) AS markdown_tokens, round(quantile_disc(CAST(h AS DOUBLE) / m, 0.5), 6) AS median_ratio, round(CAST(sum(h) AS DOUBLE) / sum(m), 6) AS ratio
FROM (SELECT site, octet_length(encode(post_content)) AS h, octet_length(encode(markdown)) AS m FROM posts JOIN md USING (id)) GROUP BY site""",
    "stream_classify": LOG_ALL,
    "stream_daily_hits": "SELECT CAST(created_at AS DATE) AS dt, bot_name, count(*) AS hits FROM log GROUP BY ALL",
    "cache_hit_labels": LABELS,
    "stream_cache_hit": LABELS,
    "stream_cache_hit_state": LABELS,
    "stream_markdown_refresh": f"SELECT id AS post_id, markdown, {NOW} AS built_at, {ENDED} AS expires_at FROM docs",
}


def _needed(body: str) -> list[str]:
    """The views a query uses, in definition order."""
    import re

    used: set[str] = set()

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", sql):
                used.add(name)
                visit(VIEWS[name])

    visit(body)
    return [name for name in VIEWS if name in used]


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, body in BODIES.items():
        views = ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v].strip()})" for v in _needed(body))
        out[name] = f"WITH RECURSIVE {views} {body.strip()}" if views else body.strip()
    return out
