"""Per-request decisions: is it a crawler, did it ask for Markdown, what is it called."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.config import (
    BOT_TOKENS,
    BUNDLE_PATH,
    INDEX_PATH,
    MANUAL_BOT,
    MARKDOWN_VALUE,
    SITEMAP_PATH,
    UNKNOWN_TOKENS,
    Settings,
)
from trailmark.functions.text import (
    ascii_fold,
    ascii_match_fold,
    bind,
    fold_token,
    query_param,
    sanitize_key,
    sanitize_text,
    text,
    trim,
    url_path,
)

# Longest list spelled out as one generated-code branch per token.
_CHAIN = 64


def bot_tokens(settings: Settings) -> list[str]:
    """The effective ordered token list: saved lines, or the built-in ones if none."""
    lines = [line.strip(" \t\n\r\0\x0b") for line in settings.bot_list.split("\n")]
    return [line for line in lines if line] or list(BOT_TOKENS)


def contains_any(user_agent: Column, tokens: Sequence[str]) -> Column:
    """True if a non-empty agent contains any token, ignoring ASCII case only.

    One compiled pattern over the text; its case-insensitive mode folds ASCII letters alone.
    Tokens that contain another token add nothing to it.
    """
    folded = {fold_token(t) for t in tokens}
    needed = sorted(t for t in folded if not any(o != t and o in t for o in folded))
    if not needed:
        return F.lit(False)
    agent = text(user_agent)
    pattern = "|".join(re.sub(r"([^\w/ -])", r"\\\1", t, flags=re.ASCII) for t in needed)
    return (agent != "") & agent.rlike(f"(?i)(?:{pattern})")


def match_fold(user_agent: Column, *token_lists: Sequence[str]) -> Column:
    """The agent folded for ``first_in`` with these tokens."""
    ascii_only = all(t.isascii() for tokens in token_lists for t in tokens)
    agent = text(user_agent)
    return ascii_match_fold(agent) if ascii_only else ascii_fold(agent)


def first_in(folded: Column, tokens: Sequence[str]) -> Column:
    """First token in list order contained in an already folded, non-empty text; else null."""
    if not tokens:
        return F.lit(None).cast("string")
    if len(tokens) <= _CHAIN:
        hit = F.coalesce(*[F.when(folded.contains(fold_token(t)), F.lit(t)) for t in tokens])
    else:
        names = F.array(*[F.lit(t) for t in tokens])
        needles = F.array(*[F.lit(fold_token(t)) for t in tokens])
        hit = F.get(F.filter(names, lambda _, i: folded.contains(F.get(needles, i))), F.lit(0))
    return F.when(folded != "", hit)


def first_token(user_agent: Column, tokens: Sequence[str]) -> Column:
    """First token in list order that the user agent contains, ignoring ASCII case; else null."""
    return bind(match_fold(user_agent, tokens), lambda folded: first_in(folded, tokens))


def is_bot_ua(user_agent: Column, tokens: Sequence[str] = BOT_TOKENS) -> Column:
    return contains_any(user_agent, tokens)


def is_unknown_ua(
    user_agent: Column,
    tokens: Sequence[str] = BOT_TOKENS,
    unknown_tokens: Sequence[str] = UNKNOWN_TOKENS,
) -> Column:
    """Looks like a bot but is on no list."""
    return contains_any(user_agent, unknown_tokens) & ~contains_any(user_agent, tokens)


def unknown_ua_match(
    user_agent: Column,
    tokens: Sequence[str] = BOT_TOKENS,
    unknown_tokens: Sequence[str] = UNKNOWN_TOKENS,
) -> Column:
    """Heuristic token of a bot-like agent that is on no list; '' otherwise."""
    return F.when(is_bot_ua(user_agent, tokens), F.lit("")).otherwise(
        text(first_token(user_agent, unknown_tokens))
    )


def query_param_md(query: Column, name: str = "format") -> Column:
    return F.coalesce(sanitize_key(query_param(query, name)) == MARKDOWN_VALUE, F.lit(False))


def should_serve(is_md: Column, is_bot: Column, mode: str = "both") -> Column:
    """The mode is known when the plan is built, so only the tests it needs enter the plan."""
    chosen = {"ua": is_bot, "query_param": is_md}.get(mode, is_md | is_bot)
    return F.coalesce(chosen, F.lit(False))


def resolve_bot_name(is_md: Column, token: Column) -> Column:
    """``manual`` when Markdown was asked for, in every mode; else the token; else ''."""
    return F.when(is_md, F.lit(MANUAL_BOT)).otherwise(text(token))


def ip_hash(address: Column, salt: str) -> Column:
    address = trim(text(address))
    return F.when(address == "", F.lit("")).otherwise(
        F.sha2(F.concat(address, F.lit(salt)), 256)
    )


def endpoint_route(uri: Column, settings: Settings = Settings()) -> Column:
    """Which published document a URI asks for: index, bundle, sitemap or other."""
    path = url_path(sanitize_text(uri))
    route = F.when(F.lit(settings.llmstxt_enabled) & (path == INDEX_PATH), F.lit("index"))
    route = route.when(F.lit(settings.llmstxt_enabled) & (path == BUNDLE_PATH), F.lit("bundle"))
    route = route.when(F.lit(settings.sitemap_enabled) & (path == SITEMAP_PATH), F.lit("sitemap"))
    return route.otherwise(F.lit("other"))
