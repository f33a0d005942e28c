"""Constants that shape results, and the job configuration."""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

EXTRACTOR_VERSION = "1"
THIN_TEXT = 400
MAX_LINKS, MAX_OUTBOUND, MAX_BODY_BYTES = 200, 25, 2_000_000
MAX_TEXT_CHARS, TIMEOUT_MS, MAX_PAGES = 12_000, 20_000, 5
MAX_CRAWL_DELAY_MS, ROBOTS_MAX_CHARS, MAX_REDIRECTS = 30_000, 512_000, 4
SITEMAP_MAX_URLS, SITEMAP_CHILDREN = 200, 5
DIFF_BLOCKS, DIFF_BLOCK_CHARS = 2000, 400
RUNG_TTL_MS = 1_800_000
ROBOTS_TTL_MS, ROBOTS_RETRY_MS = 21_600_000, 300_000
LATENCY_WEIGHT = 0.3
RENDER_MAX_ACTIONS, RENDER_MAX_MS = 10, 20_000
RECIPE_MIN_ITEMS, RECIPE_MAX_FAILURES = 2, 2
SNIPPET_CHARS = 300
USER_AGENT = "pagewright/0.1"
VENDOR_RUNGS = ("firecrawl", "apify")
SEARCH_PROVIDERS = ("serper", "tavily")


@dataclass(frozen=True)
class CrawlConfig:
    user_agent: str = USER_AGENT
    vendor_keys: Mapping[str, str] = field(default_factory=dict)
    vendor_order: tuple[str, ...] = VENDOR_RUNGS
    search_order: tuple[str, ...] = SEARCH_PROVIDERS
    local_render: bool = False
    auto_robots: bool = False
    max_text_chars: int = MAX_TEXT_CHARS
    timeout_ms: int = TIMEOUT_MS
    max_pages: int = MAX_PAGES
    max_body_bytes: int = MAX_BODY_BYTES
    max_links: int = MAX_LINKS
    max_outbound: int = MAX_OUTBOUND
    include_html: bool = False

    def vendor_rungs(self) -> list[str]:
        """Paid rungs that have a key, in the configured order."""
        return [r for r in self.vendor_order if r in VENDOR_RUNGS and self.vendor_keys.get(r)]

    def search_providers(self) -> list[str]:
        return [p for p in self.search_order if p in SEARCH_PROVIDERS and self.vendor_keys.get(p)]

    def has_contact(self) -> bool:
        """Whether site operators can tell from the user agent whom to ask."""
        return bool(re.search(r"https?://|\+[\w.-]+@|\(\+", self.user_agent))


_warned: set[str] = set()


def from_env(env: Mapping[str, str], **overrides: object) -> CrawlConfig:
    """Configuration from variables ``PAGEWRIGHT_*`` and the services' own key names; too short keys don't count."""

    def pick(*names: str) -> str | None:
        return next((v.strip() for n in names if len((v := env.get(n, "")).strip()) > 6), None)

    def listed(name: str) -> tuple[str, ...]:
        return tuple(x.strip() for x in env.get(name, "").split(",") if x.strip())

    keys = {s: pick(f"PAGEWRIGHT_{s.upper()}_KEY", f"{s.upper()}_API_{'TOKEN' if s == 'apify' else 'KEY'}") for s in (*VENDOR_RUNGS, *SEARCH_PROVIDERS)}
    made = {
        "user_agent": env.get("PAGEWRIGHT_USER_AGENT") or USER_AGENT, "vendor_keys": {k: v for k, v in keys.items() if v},
        "vendor_order": listed("PAGEWRIGHT_VENDOR_ORDER") or VENDOR_RUNGS, "search_order": listed("PAGEWRIGHT_SEARCH_ORDER") or SEARCH_PROVIDERS,
        "local_render": env.get("PAGEWRIGHT_LOCAL_RENDER") == "1", "auto_robots": env.get("PAGEWRIGHT_AUTO_ROBOTS") == "1",
    }
    config = CrawlConfig(**{**made, **overrides})
    if not config.has_contact() and config.user_agent not in _warned:
        _warned.add(config.user_agent)
        logging.getLogger("pagewright").warning("user agent %r names no contact", config.user_agent)
    return config
