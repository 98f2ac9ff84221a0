"""Settings of the engine; every value can be set by an environment variable of the same upper-case name
with the prefix ``LOOMDEX_``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    max_indexed_urls: int = 5_000_000
    max_queue_size: int = 50_000
    max_render_queue: int = 5_000
    max_depth: int = 5
    max_links_per_page: int = 50
    min_content_words: int = 50
    domain_delay_ms: int = 200
    global_rps: int = 10
    domain_concurrency: int = 2
    reindex_after_hours: int = 24
    reindex_batch_size: int = 10_000
    sitemap_max_urls_per_domain: int = 5_000
    sitemap_max_concurrent: int = 3
    sitemap_max_depth: int = 3
    sitemap_max_pending: int = 100
    robots_cache_ttl_ms: int = 3_600_000
    max_retries: int = 3
    retry_delays: str = "300000,600000,1200000"
    search_cache_ttl_s: int = 30

    @property
    def retry_delays_ms(self) -> list[int]:
        return [int(x) for x in self.retry_delays.split(",")]


def non_negative(raw: str | None, default: int) -> int:
    """A non-negative integer, or the default for anything else."""
    try:
        n = int(str(raw).strip())
    except ValueError:
        return default
    return n if n >= 0 else default


def non_empty(raw: str | None, default: str) -> str:
    """A trimmed non-empty string, or the default."""
    return raw.strip() if raw and raw.strip() else default


def load(env: dict[str, str] | None = None) -> Config:
    env = os.environ if env is None else env
    values = {}
    for f in fields(Config):
        raw = env.get(f"LOOMDEX_{f.name.upper()}")
        if raw is not None:
            values[f.name] = non_negative(raw, f.default) if isinstance(f.default, int) else non_empty(raw, f.default)
    return Config(**values)


CONFIG = load()
