"""Settings of a corpus, with the defaults that apply to missing keys."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    categories: tuple[str, ...] = ("cs.AI", "cs.LG", "cs.CL", "cs.CV", "cs.NE", "stat.ML")
    history_start: str = "2017-01-01"
    abstract_window_months: int | None = None
    docs_per_chunk: int = 512
    prefix_length: int = 2
    recent_size: int = 200
    docs_per_zone: int = 4096
    block: int = 512

    @classmethod
    def read(cls, text: str) -> "Config":
        """From JSON with camel-case keys; keys that are absent or null keep their defaults."""
        # The file's keys.
        names = {"categories": "categories", "historyStart": "history_start", "abstractWindowMonths": "abstract_window_months", "docsPerChunk": "docs_per_chunk", "tokenShardPrefixLength": "prefix_length", "recentFeedSize": "recent_size"}
        got = {names[k]: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items() if k in names and v is not None}
        return cls(**{f.name: got[f.name] for f in fields(cls) if f.name in got})
