"""String, URL and list columns used across the jobs; all run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.config import SUMMARY_ELLIPSIS, SUMMARY_WORDS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
# Characters a web URL may keep; anything else in ASCII is dropped.
_URL_KEPT = r"a-zA-Z0-9\-~+_.?#=!&;,/:%@$|*'()\[\]"
# ASCII blank, tab, newline, return, NUL and vertical tab: what "trim" means here.
BLANKS = " \t\n\r\0\x0b"


def text(col: Column) -> Column:
    """A string that is empty rather than null."""
    return F.coalesce(col, F.lit(""))


def filled(col: Column) -> Column:
    """``col`` unless it counts as empty: null, '' and, as in form values, '0' become ''."""
    return F.when(text(col) != "0", text(col)).otherwise(F.lit(""))


def sanitize_text(col: Column) -> Column:
    """One line of plain text: no tags, no percent-encoded bytes, single blanks, trimmed."""
    bare = F.regexp_replace(text(col), r"(?s)<[a-zA-Z/!?][^>]*>", "")
    bare = F.regexp_replace(bare, "(?i)%[a-f0-9]{2}", "")
    return trim(F.regexp_replace(bare, "[\r\n\t ]+", " "))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once: a one-element array gives the value a name.

    Without it Catalyst writes the value's expression out at every use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def ascii_fold(col: Column) -> Column:
    """Lower-case A-Z only: other scripts must not fold into ASCII letters."""
    return F.translate(col, _UPPER, _LOWER)


def ascii_match_fold(col: Column) -> Column:
    """Lower-cased text for finding ASCII needles: much cheaper than ``ascii_fold``.

    The two characters whose lower case is an ASCII letter are put out of the way first.
    """
    for stray in ("\u212a", "\u0130"):
        col = F.replace(col, F.lit(stray), F.lit("\ufffd"))
    return F.lower(col)


def fold_token(token: str) -> str:
    return token.translate(str.maketrans(_UPPER, _LOWER))


def byte_length(col: Column) -> Column:
    return F.octet_length(col)


def sanitize_key(col: Column) -> Column:
    return F.regexp_replace(ascii_fold(col), "[^a-z0-9_-]", "")


def query_string(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[^?#]*\?([^#]*)", 1)


def query_param(query: Column, name: str) -> Column:
    """Decoded value of the last parameter called ``name``; '' if there is none.

    Works on the raw text because ``parse_url`` rejects real-world URLs and keeps the first
    of duplicate parameters. A list parameter (``name[]=``) has no scalar value and reads ''.
    """
    # The greedy start makes the first match found the last parameter of that name.
    last = rf"^\??(?:[^#]*&)?{re.escape(name)}(?:=([^&#]*)|\[[^&#]*)?(?:[&#].*)?$"
    value = F.when(query.contains(name), F.regexp_extract(query, last, 1)).otherwise(F.lit(""))
    # A lone percent sign stands for itself.
    escaped = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    return text(F.when(value.rlike("[%+]"), F.try_url_decode(escaped)).otherwise(value))


def url_path(uri: Column) -> Column:
    """Path of a URI or absolute URL without its outer slashes."""
    path = F.regexp_extract(uri, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.btrim(path, F.lit("/"))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://([^/?#]+)", 1)


def clean_url(url: Column) -> Column:
    """Encode blanks and drop ASCII characters that cannot stand in a URL."""
    encoded = F.replace(F.ltrim(url), F.lit(" "), F.lit("%20"))
    return F.regexp_replace(encoded, rf"[\x00-\x7F&&[^{_URL_KEPT}]]", "")


def add_query_param(url: Column, name: str, value: str) -> Column:
    """Set ``name=value`` in a URL: in place if present, else appended; fragment kept."""
    pair = f"{name}={value}"
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    base = F.regexp_extract(url, "^([^?#]*)", 1)
    parts = F.filter(F.split(query_string(url), "&"), lambda p: p != "")
    own = F.transform(
        parts, lambda p: F.when(F.substring_index(p, "=", 1) == name, F.lit(pair)).otherwise(p)
    )
    full = F.when(F.array_contains(own, pair), own).otherwise(F.array_append(own, F.lit(pair)))
    first = F.array_position(full, pair)
    # Repeats of the parameter collapse into its first place.
    once = F.filter(full, lambda p, i: (p != pair) | (i == first - 1))
    return F.concat(base, F.lit("?"), F.array_join(once, "&"), fragment)


def xml_escape(col: Column) -> Column:
    """Escape text for XML content and attributes, ampersand first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def xml_escape_url(url: Column) -> Column:
    """A cleaned URL for XML; ampersand and apostrophe as numeric references."""
    plain = F.replace(clean_url(url), F.lit("&amp;"), F.lit("&"))
    numeric = F.replace(plain, F.lit("&"), F.lit("&#038;"))
    return F.replace(numeric, F.lit("'"), F.lit("&#039;"))


def strip_tags(html: Column) -> Column:
    """Text of an HTML string: scripts and styles go with their content."""
    no_raw = F.regexp_replace(html, r"(?is)<(script|style)[^>]*?>.*?</\1>", "")
    return trim(F.regexp_replace(no_raw, r"(?s)<!--.*?-->|<[a-zA-Z/!?][^>]*>", ""))


def trim_words(
    source: Column, words: int = SUMMARY_WORDS, ellipsis: str = SUMMARY_ELLIPSIS
) -> Column:
    """The first ``words`` words of tag-stripped text, marked when something was cut."""
    bare = F.btrim(strip_tags(source), F.lit(" \t\n\r"))
    split = F.filter(F.split(bare, "[\n\r\t ]+", words + 1), lambda w: w != "")
    kept = F.array_join(F.slice(split, 1, words), " ")
    return F.when(F.size(split) > words, F.concat(kept, F.lit(ellipsis))).otherwise(kept)


def json_quote(col: Column) -> Column:
    """A string as a JSON literal; slashes and non-ASCII letters stay as they are."""
    wrapped = F.to_json(F.struct(text(col).alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def parse_token_list(saved: Column) -> Column:
    """Non-blank trimmed lines of a saved list, in order."""
    lines = F.transform(F.split(text(saved), "\n"), trim)
    return F.filter(lines, lambda line: line != "")


def whitelist_value(col: Column, allowed: Sequence, default) -> Column:
    return F.when(col.isin(list(allowed)), col).otherwise(F.lit(default))
