"""Typed settings. Every field can be overridden by an environment variable of the same upper-case name."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    crawler_max_pages: int = 600
    crawler_max_depth: int = 6
    pdf_max_kb: int = 5000
    bp_threshold: int = 12
    crawl_min_words: int = 25
    crawl_min_alpha: float = 0.45
    chunk_size: int = 512
    chunk_overlap: int = 64
    min_chunk_words: int = 30
    semantic_buffer: int = 1
    semantic_percentile: float = 0.95
    semantic_min_words: int = 100
    embed_dim: int = 384
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    bm25_top_k: int = 20
    bm25_boost: float = 2.5
    retrieval_top_k: int = 20
    rrf_k: int = 60
    dense_weight: float = 0.6
    bm25_weight: float = 0.4
    graph_weight: float = 1.2
    fused_boost: float = 1.5
    graph_hops: int = 2
    rerank_top_k: int = 5
    guardrail_mode: str = "rules"
    guardrail_threshold: float = 0.75
    memory_max_turns: int = 8
    memory_summary_every: int = 6
    legacy_chunk_chars: int = 1200
    legacy_chunk_overlap: int = 120
    legacy_min_chars: int = 100

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> "Settings":
        env = dict(os.environ if env is None else env)
        casts = {"int": int, "float": float, "str": str, "bool": lambda v: v.lower() in ("1", "true", "yes")}
        values = {f.name: casts[f.type](env[f.name.upper()]) for f in fields(Settings) if f.name.upper() in env}
        return Settings(**values)


DEFAULTS = Settings()
