"""All constants of the engine in one place; every operator takes its limits from here by default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # chunking: estimated tokens a word, target and least size of a chunk, overlap
    tokens_per_word: float = 1.35
    chunk_target: int = 300
    chunk_least: int = 20
    chunk_overlap: int = 64
    # fallback and oversize windows, in estimated tokens
    fallback_tokens: int = 6000
    oversize_tokens: int = 7500
    oversize_window: int = 7500
    window_overlap: int = 200
    # retrieval
    rrf_k: int = 60
    graph_weight: float = 0.25
    graph_anchors: int = 3
    top_k: int = 5
    showcase_k: int = 3
    retrieve_k: int = 15
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    fact_least: float = 0.45
    # tables
    numeric_share: float = 0.7
    preview_rows: int = 25
    summary_rows: int = 3
    sheet_rows: int = 1000
    # text extraction
    block_limit: int = 60
    preview_chars: int = 600
    html_least_chars: int = 15
    block_chars: int = 1000
    plain_chars: int = 2000
    ocr_least_chars: int = 30
    context_chars: int = 80_000
    # prices for a million tokens, in dollars: input, output, cache write, cache read, embedding
    price_input: float = 0.80
    price_output: float = 4.00
    price_cache_write: float = 1.00
    price_cache_read: float = 0.08
    price_embedding: float = 0.13


DEFAULT = Config()
