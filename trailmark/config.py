"""Settings and the fixed values every job shares."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

# ---------------------------------------------------------------------------
# Fixed values. They have to stay as they are for results to agree.
# ---------------------------------------------------------------------------
BOT_TOKENS = (
    "GPTBot",
    "ChatGPT-User",
    "OAI-SearchBot",
    "ClaudeBot",
    "Claude-User",
    "anthropic-ai",
    "PerplexityBot",
    "Perplexity-User",
    "CCBot",
    "Google-Extended",
    "Applebot-Extended",
    "Bytespider",
    "Meta-ExternalAgent",
    "cohere-ai",
)
UNKNOWN_TOKENS = ("bot", "crawler", "spider", "gpt", "claude", "anthropic", "fetch", "ai/")

DETECTION_MODES = ("both", "query_param", "ua")
CACHE_TTLS = (3600, 6 * 3600, 86400, 7 * 86400)
LOG_WINDOWS = (7, 30, 90, 365)
MARKDOWN_VALUE = "md"
MANUAL_BOT = "manual"
UNKNOWN_BOT = "unknown"

URL_CHARS = 255
USER_AGENT_CHARS = 500
BOT_NAME_CHARS = 100
PREVIEW_CHARS = 500
SUMMARY_WORDS = 20
SUMMARY_ELLIPSIS = "&hellip;"
BUNDLE_MAX_BYTES = 500 * 1024
SITEMAP_MAX_POSTS = 1000

INDEX_PATH = "llms.txt"
BUNDLE_PATH = "llms-full.txt"
SITEMAP_PATH = "botfood-sitemap.xml"

YOAST_NOINDEX_KEY = "_yoast_wpseo_meta-robots-noindex"
RANK_MATH_ROBOTS_KEY = "rank_math_robots"
GENESIS_NOINDEX_KEY = "_genesis_noindex"
UNLISTED_TYPE = "attachment"

# Block comments the editor leaves in content (Java pattern, ASCII blanks).
EDITOR_COMMENT = r"<!--[ \t\n\r\f\x0b]*/?wp:[^-]*?-->"
# ---------------------------------------------------------------------------

# The advertised line is free text for crawlers' operators; name your own product in it.
ROBOTS_COMMENT = "Markdown versions of content for AI crawlers"


def whitelisted(value: Any, allowed: Iterable[Any], default: Any) -> Any:
    """``value`` if it is one of ``allowed``, else ``default``."""
    return value if value in tuple(allowed) else default


def supported_types(public: Iterable[str]) -> list[str]:
    """Public content types that can be published: all but attachments."""
    return [t for t in public if t != UNLISTED_TYPE]


def enabled_types(supported: Iterable[str], enabled: Iterable[str]) -> list[str]:
    """Supported types narrowed to the enabled ones; an empty list enables all."""
    chosen = set(enabled)
    return [t for t in supported if t in chosen] if chosen else list(supported)


@dataclass(frozen=True)
class Settings:
    """The options of all jobs with their defaults; keys match the saved form."""

    detection_mode: str = "both"
    query_param_name: str = "format"
    bot_list: str = ""
    cache_ttl: int = 86400
    enabled_post_types: tuple[str, ...] = ()
    llmstxt_enabled: bool = True
    llmstxt_max_posts: int = 100
    sitemap_enabled: bool = True
    include_frontmatter: bool = False
    include_schema: bool = False
    enable_logging: bool = False
    log_retention_days: int = 30
    log_unknown_uas: bool = True

    @classmethod
    def from_saved(cls, saved: Mapping[str, Any] | None) -> Settings:
        """Saved values laid over the defaults; keys this class lacks are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (saved or {}).items() if k in known and v is not None})

    def validated(self, public_types: Iterable[str] = ("post", "page")) -> Settings:
        """The settings as the settings form would store them."""
        kept = set(supported_types(public_types))
        name = re.sub("[^a-z0-9_-]", "", self.query_param_name.lower())
        return replace(
            self,
            detection_mode=whitelisted(self.detection_mode, DETECTION_MODES, "both"),
            query_param_name=name or "format",
            cache_ttl=whitelisted(abs(self.cache_ttl), CACHE_TTLS, 86400),
            enabled_post_types=tuple(t for t in self.enabled_post_types if t in kept),
            log_retention_days=whitelisted(abs(self.log_retention_days), LOG_WINDOWS, 30),
        )
