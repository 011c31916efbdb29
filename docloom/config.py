"""Settings and vocabularies. Vocabularies are data, so another corpus binds its own."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

# Aliases, display names and function words of the default corpus.
SCHEME_ALIASES = {
    "large cap": "large_cap", "largecap": "large_cap", "bluechip": "large_cap", "blue chip": "large_cap",
    "flexi cap": "flexi_cap", "flexicap": "flexi_cap",
    "elss": "elss", "tax saver": "elss", "80c": "elss", "80 c": "elss",
    "mid cap": "midcap", "midcap": "midcap", "mid cap fund": "midcap",
}
PLAN_ALIASES = {"direct": "direct", "direct plan": "direct", "regular": "regular", "regular plan": "regular"}
SCHEME_TITLES = {
    "large_cap": "Large Cap Fund", "flexi_cap": "Flexi Cap Fund", "elss": "ELSS Tax Saver Fund",
    "midcap": "Midcap Fund", "amc_wide": "Mutual Fund",
}
PLAN_TITLES = {"direct": "Direct plan", "regular": "Regular plan", "n_a": ""}
#: What a client shows of a scheme: category, icon and tagline.
SCHEME_CARDS = {
    "large_cap": ("Large Cap", "trending_up", "Shares of the largest companies, in two plans."),
    "flexi_cap": ("Flexi Cap", "donut_large", "Shares of companies of any size."),
    "elss": ("ELSS Tax Saver", "savings", "Tax saving with a lock-in of three years."),
    "midcap": ("Mid Cap", "speed", "Shares of companies of middle size."),
    "amc_wide": ("AMC Factsheets", "account_balance", "Factsheets, holdings and downloads of all schemes."),
}
#: Questions to begin with, about a scheme's title; ``amc_wide`` has its own.
STARTERS = ("What is the exit load of the {title}?", "What is the expense ratio of the {title}?", "What is the benchmark of the {title}?", "What is the minimum investment in the {title}?")
STARTERS_OF_ALL = ("What is the date of the latest factsheet?", "Where are the portfolio holdings?", "Where can a statement be downloaded?")
DOC_TYPES = ("scheme_page", "sid", "kim", "factsheet", "efactsheet", "downloads", "homepage", "third_party")
STOPWORDS = (
    "a an the is are was were be been being of on in for to at by with and or as that this these those it its from "
    "what which who whom whose how many much does do did can could will would shall should may might i me my we our "
    "you your he she they them there here about into over under more most less least than then so such not no nor "
    "only own same too very just also"
).split()


@dataclass(frozen=True)
class Vocabulary:
    """What the engine knows of a corpus's subject matter."""

    scheme_aliases: dict[str, str] = field(default_factory=lambda: dict(SCHEME_ALIASES))
    plan_aliases: dict[str, str] = field(default_factory=lambda: dict(PLAN_ALIASES))
    scheme_titles: dict[str, str] = field(default_factory=lambda: dict(SCHEME_TITLES))
    plan_titles: dict[str, str] = field(default_factory=lambda: dict(PLAN_TITLES))
    scheme_cards: dict[str, tuple[str, str, str]] = field(default_factory=lambda: dict(SCHEME_CARDS))
    doc_types: tuple[str, ...] = DOC_TYPES
    stopwords: tuple[str, ...] = tuple(STOPWORDS)
    brand: str = "the fund house"

    def starters(self, scheme: str) -> list[str]:
        """Questions to begin with about a scheme."""
        if scheme == "amc_wide":
            return list(STARTERS_OF_ALL)
        return [s.format(title=self.scheme_titles[scheme]) for s in STARTERS]


@dataclass(frozen=True)
class Settings:
    """Tunables; ``from_env`` overrides each from ``DOCLOOM_<NAME>``."""

    embed_dim: int = 384
    embed_batch_size: int = 32
    max_chunk_chars: int = 900
    min_chunk_chars: int = 120
    chunk_overlap: int = 150
    min_extracted_chars: int = 2000
    top_k: int = 12
    similarity_threshold: float = 0.53
    citation_score_floor: float = 0.45
    lexical_rerank_weight: float = 0.15
    max_context_chars: int = 12000
    max_sentences: int = 3
    max_answer_chars: int = 420
    http_timeout_s: float = 30.0
    http_retries: int = 3
    http_backoff_s: float = 1.0
    http_delay_s: float = 1.5
    memory_max_messages: int = 10
    max_sessions: int = 64
    session_ttl_s: int = 1800

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Settings":
        """Defaults with the environment's overrides; a value of the wrong kind raises ValueError."""
        env = dict(os.environ) if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(f"DOCLOOM_{f.name.upper()}")
            if raw is not None:
                given[f.name] = type(f.default)(raw)
        return replace(cls(), **given)


SETTINGS = Settings()
VOCABULARY = Vocabulary()
