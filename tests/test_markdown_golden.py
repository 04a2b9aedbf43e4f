"""Hand-written conversions, at least one per rule, run through the job itself."""

import pytest

from trailmark.operators.markdown import html_to_markdown

CASES = {
    "blank": (" \n\t ", ""),
    "editor_comment_joins_text": ("a <!-- wp:paragraph -->b<!-- /wp:paragraph -->", "a b"),
    "other_comment_is_dropped": ("a<!-- note -->b", "ab"),
    "comment_splits_space_runs": ("a <!-- x --> b", "a  b"),
    "editor_comment_with_hyphen_still_dropped": ('<!-- wp:image {"a-b":1} --><p>x</p>', "x"),
    "newline_runs": ("<p>a</p><hr><p>b</p>", "a\n\n---\n\nb"),
    "newline_runs_in_code": ("<pre>a\n\n\n\nb</pre>", "```\na\n\nb\n```"),
    "nbsp_and_spaces": ("a&nbsp; b\n\tc", "a b c"),
    "blank_between_blocks": ("<p>a</p>\n<p>b</p>", "a\n\n b"),
    "no_escaping": ("1 * 2 _x_ #", "1 * 2 _x_ #"),
    "unicode_space_kept": ("a b", "a b"),
    "headings": ("<h1>One</h1><h3> T\nwo </h3>", "# One\n\n### T wo"),
    "heading_one_line": ("<h2>a<br>b</h2>", "## a b"),
    "heading_after_text": ("x<h6>y</h6>z", "x\n\n###### y\n\nz"),
    "paragraph": ("<p> a </p><p>b</p>c", "a\n\nb\n\nc"),
    "strong": ("x<strong> a </strong>y", "x **a** y"),
    "b_blank": ("x<b> </b>y", "x y"),
    "em": ("<em>a</em><i>b </i>c", "*a**b* c"),
    "nested_emphasis": ("<b><i>a</i></b>", "***a***"),
    "code_span": ("<code>a  b</code>", "`a  b`"),
    "code_with_backtick": ("<code>a`b</code>", "`` a`b ``"),
    "code_entities": ("<code>&lt;b&gt;</code>", "`<b>`"),
    "pre_language": ('<pre><code class="hl language-php">  x\n y</code></pre>', "```php\nx\n y\n```"),
    "pre_first_code_decides": ('<pre><code>a</code><code class="language-js">b</code></pre>', "```\nab\n```"),
    "pre_not_prefix_class": ('<pre><code class="xlanguage-js">b</code></pre>', "```\nb\n```"),
    "link": ('<a href="/x?a=1&amp;b=2">t</a>', "[t](/x?a=1&b=2)"),
    "link_without_href": ("<a>t</a><a href=''>u</a>", "tu"),
    "link_keeps_inner": ('<a href="u"><b>t</b></a>', "[**t**](u)"),
    "image": ('<img alt="A" src="s.png"><img>', "![A](s.png)![]()"),
    "br": ("a<br>b<br/>c", "a  \nb  \nc"),
    "hr": ("a<hr>b", "a\n\n---\n\nb"),
    "ordered_list_has_no_numbers": ("<ol><li>a</li><li>b</li></ol>", "- a\n- b"),
    "only_items_count": ("<ul>x<p>y</p><li>a</li></ul>", "- a"),
    "nested_list": ("<ul><li>a<ul><li>b<ol><li>c</li></ol></li></ul></li></ul>", "- a\n  - b\n    - c"),
    "nested_list_moves_behind_text": ("<ul><li>a<ul><li>b</li></ul>c</li></ul>", "- ac\n  - b"),
    "item_continuation": ("<ul><li><p>a</p><p>b</p></li></ul>", "- a\n  b"),
    "nested_item_continuation": ("<ul><li>x<ul><li>a<br>b</li></ul></li></ul>", "- x\n  - a  \n    b"),
    "list_inside_wrapper": ("<ul><li>a<div><ul><li>b</li></ul></div></li></ul>", "- a  - b"),
    "item_outside_list": ("<div><li>a</li></div>", "a"),
    "list_follows_text": ("x<ul><li>a</li></ul>y", "x\n- a\n\ny"),
    "blockquote": ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n> \n> b"),
    "table_with_head": (
        "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>",
        "| a | b |\n| --- | --- |\n| 1 | 2 |",
    ),
    "table_without_head": ("<table><tr><td>1</td></tr><tr><td>2</td></tr></table>", "| 1 |\n| --- |\n| 2 |"),
    "table_late_head": (
        "<table><tr><td>1</td></tr><tr><th>h</th></tr><tr><td>2</td></tr></table>",
        "| 1 |\n| h |\n| --- |\n| 2 |",
    ),
    "table_pads_short_rows": (
        "<table><tr><td>1</td></tr><tr><td>2</td><td>3</td></tr></table>",
        "| 1 |  |\n| --- | --- |\n| 2 | 3 |",
    ),
    "table_ignores_caption_and_empty_rows": (
        "<table><caption>c</caption><tr></tr><tr><td>1</td></tr></table>",
        "| 1 |\n| --- |",
    ),
    "table_empty": ("a<table><tr></tr></table>b", "ab"),
    "table_cell": ("<table><tr><td>a|b<br>c</td></tr></table>", "| a\\|b c |\n| --- |"),
    "nested_table_flattens": (
        "<table><tr><td>x<table><tr><td>y</td></tr></table></td></tr></table>",
        "| x \\| y \\| \\| --- \\| |\n| --- |",
    ),
    "colspan_ignored": ('<table><tr><td colspan="2">a</td></tr></table>', "| a |\n| --- |"),
    "other_tags_pass": ("<section><span>a</span><u>b</u></section>", "ab"),
    "script_text_leaks": ("<p>a</p><script>let x = '</p>';</script>", "a\n\nlet x = '</p>';"),
    "entities": ("&lt;&eacute;&#65;&#x42;&apos;&unknown;&copy", "<éAB'&unknown;&copy"),
    "open_bold_ends_at_paragraph": ("<p><b>a<br><p>b</p>", "**a**\n\nb"),
    "open_items": ("<ul><li>a<li>b</ul>", "- a\n- b"),
    "open_cells": ("<table><tr><td>1<td>2<tr><td>3</table>", "| 1 | 2 |\n| --- | --- |\n| 3 |  |"),
    "stray_end_tag": ("a </b>b</p> c", "a b c"),
    "stray_less_than": ("1 < 2", "1 < 2"),
    "end_tag_closes_inner": ("<div><i>a</div>b", "*a*b"),
    "end_tag_stops_at_higher_rank": ("<b><table><tr><td>a</b>c</td></tr></table></b>", "**| ac |\n| --- |**"),
    "page_shell_is_transparent": ("<html><head></head><body><p>a</p></body></html>", "a"),
    "self_closed": ("<div/>a<b/>c", "ac"),
}


@pytest.fixture(scope="module")
def converted(spark):
    rows = [(name, html) for name, (html, _) in CASES.items()]
    frame = spark.createDataFrame(rows, "name string, post_content string")
    return {r.name: r for r in html_to_markdown(frame).collect()}


@pytest.mark.parametrize("name", CASES)
def test_golden(converted, name):
    assert converted[name].error is None
    assert converted[name].markdown == CASES[name][1]


def test_raw_text_can_be_dropped(spark):
    frame = spark.createDataFrame([("<style>p{}</style>a<script>x</script>b",)], "post_content string")
    assert html_to_markdown(frame, drop_raw_text=True).first().markdown == "ab"


def test_nulls_and_failures_stay_rows(spark, monkeypatch):
    from trailmark.functions import html_fold

    def broken(html, drop):
        raise ValueError("bad page")

    frame = spark.createDataFrame([(1, None), (2, "x")], "id int, post_content string").coalesce(1)
    assert [r.markdown for r in html_to_markdown(frame).orderBy("id").collect()] == ["", "x"]
    monkeypatch.setattr(html_fold, "fold", broken)
    rows = html_to_markdown(frame).orderBy("id").collect()
    assert rows[1].markdown is None and rows[1].error == "ValueError: bad page"


def test_no_three_newlines_on_pages(spark):
    from trailmark import bindings as b

    docs = html_to_markdown(b.posts(spark, "/root/testdata/sf0.01", whole_page=True))
    assert docs.filter("markdown LIKE '%\n\n\n%' OR error IS NOT NULL OR markdown = ''").count() == 0


def test_pages_are_converted_a_few_at_a_time_from_arrow(spark):
    import pyarrow as pa

    from trailmark.operators.markdown import PAGES, _folder

    convert = _folder(False).func
    found = convert(pa.array(["<p>a</p>"] * (2 * PAGES + 1)))
    assert isinstance(found, pa.StructArray) and len(found) == 2 * PAGES + 1
    assert {x["markdown"].strip() for x in found.to_pylist()} == {"a"} and len(convert(pa.array([], pa.string()))) == 0
