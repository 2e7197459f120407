"""Settings of a crawl and of extraction, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from loomstone.functions.urls import check_patterns

#: Field -> (least, most).
RANGES = {
    "max_pages": (1, 10_000), "max_depth": (0, 20), "crawl_concurrency": (1, 64), "retry_attempts": (1, 10), "retry_delay": (0.0, 60.0),
    "max_retry_delay": (0.0, 600.0), "chunk_tokens": (20, 8000), "output_chars": (0, 2_000_000), "max_chunks": (1, 1000), "search_limit": (1, 20),
    "irrelevant_streak": (1, 100), "llm_max_pages": (0, 1000),
}


@dataclass(frozen=True)
class CrawlSettings:
    """Bounds of a run; a value out of range raises ValueError that names the field."""

    max_pages: int = 100
    max_depth: int = 3
    crawl_concurrency: int = 8
    retry_attempts: int = 3
    retry_delay: float = 0.5
    max_retry_delay: float = 8.0
    retry_on: tuple[str, ...] = ("timeout", "network_error", "rate_limited")
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    same_domain: bool = True
    only_main_content: bool = True
    chunk_tokens: int = 400
    output_chars: int = 64_000
    max_chunks: int = 40
    search_limit: int = 10
    irrelevant_streak: int = 3
    llm_max_pages: int = 20
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(f.default, bool) and not isinstance(value, bool):
                raise ValueError(f"{f.name} must be true or false")
            if f.name in RANGES:
                low, high = RANGES[f.name]
                if isinstance(value, bool) or not isinstance(value, int | float) or not low <= value <= high:
                    raise ValueError(f"{f.name} must lie between {low} and {high}")
                if isinstance(low, int) and not isinstance(value, int):
                    raise ValueError(f"{f.name} must be a whole number")
        check_patterns(list(self.include))
        check_patterns(list(self.exclude))
