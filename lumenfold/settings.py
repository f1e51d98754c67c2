"""Engine settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_tokens: int = 512
    chunk_overlap: int = 50
    scanned_page_chars: int = 50
    ocr_min_confidence: float = 60.0
    top_k: int = 8
    candidate_pool: int = 20
    hub_degree_limit: int = 50
    graph_fact_limit: int = 100
    rrf_k: int = 60
    mention_boost: float = 0.01
    context_tokens: int = 3000
    min_evidence: float = 0.05
    similar_threshold: float = 0.90
    similar_limit: int = 3
    seed_chunks: int = 10
    seed_entities: int = 5
    post_chars: int = 2000
    preview_chars: int = 300
    post_context_tokens: int = 1800
    post_facts: int = 12
    embedding_dim: int = 384
