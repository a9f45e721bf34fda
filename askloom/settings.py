"""Parameters of every job, with the default values users rely on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # retrieval
    top_k: int = 10
    multi_query_count: int = 3
    expand_queries: bool = True
    dense_multiplier: int = 6
    dense_cap: int = 60
    lexical_multiplier: int = 4
    lexical_cap: int = 80
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    min_relevant: int = 2
    rerank_candidates: int = 40
    max_per_source: int = 2
    max_parents: int = 3
    confidence_threshold: float = 0.45
    max_context_tokens: int = 3000
    # chunking
    parent_size: int = 1800
    parent_overlap: int = 180
    child_size: int = 500
    child_overlap: int = 50
    flat_size: int = 600
    flat_overlap: int = 100
    article_chunk_size: int = 400
    # articles
    news_relevance: float = 0.35
    news_dedup: float = 0.85
    news_max_age_days: int = 30
    news_relaxed_days: int = 365
    # evaluation
    eval_top_k: int = 5
    eval_sample_rate: int = 10
    eval_context_docs: int = 4
    eval_context_chars: int = 1800
    eval_answer_chars: int = 3000
    # vectors
    vector_dim: int = 64
    # Questions that meet a block of documents in one task (operators/dense.py).
    query_block_rows: int = 4_000

    def dense_candidates(self, k: int) -> int:
        return max(k, min(max(k * self.dense_multiplier, k), self.dense_cap))

    def lexical_candidates(self, k: int) -> int:
        return max(k, min(max(k * self.lexical_multiplier, k), self.lexical_cap))

    @property
    def variant_limit(self) -> int:
        return max(self.multi_query_count + 2, 3)


DEFAULTS = Settings()
