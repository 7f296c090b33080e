"""Verification checks of a stage as one column of structs, and the rate of those that pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check(name: str, passed: Column, detail: Column | None = None, severity: str = "warn") -> Column:
    """A check's severity is `info` when it passes."""
    ok = F.coalesce(passed, F.lit(False))
    return F.struct(F.lit(name).alias("name"), ok.alias("passed"), F.when(ok, "info").otherwise(severity).alias("severity"), F.coalesce(detail.cast("string") if detail is not None else F.lit(""), F.lit("")).alias("detail"))


def checks(*made: Column) -> Column:
    return F.array(*made)


def pass_rate(column: Column) -> Column:
    """Share of checks that pass, 0 without any."""
    return F.coalesce(F.try_divide(F.size(F.filter(column, lambda c: c["passed"])).cast("double"), F.size(column)), F.lit(0.0))


#: Checks by stage: name -> (severity if it fails, condition in SQL over the stage's metrics).
CATALOGUE = {
    "intake": {"file_exists": ("error", "true"), "size_nonzero": ("error", "size_bytes > 0"), "extension_present": ("warn", "extension <> ''"), "sha256_computed": ("warn", "length(sha256) = 64")},
    "format": {"mime_resolved": ("warn", "mime <> 'application/octet-stream'"), "encoding_detected": ("warn", "encoding NOT IN ('binary', 'unknown')"), "not_scanned_pdf": ("warn", "sub_structure <> 'scanned-pdf'"), "sub_structure_classified": ("warn", "sub_structure <> 'unknown'")},
    "parse": {"word_count_positive": ("warn", "word_count > 0"), "content_extracted": ("warn", "blocks + tables > 0"), "parser_matched_mime": ("warn", "true")},
    "intel": {"doc_type_classified": ("warn", "doc_type <> 'other'"), "domain_detected": ("warn", "domain <> 'general'"), "summary_generated": ("warn", "summary <> ''"), "entities_extracted": ("warn", "entities > 0")},
    "chunk": {"chunks_created": ("error", "chunks > 0"), "avg_tokens_in_range": ("warn", "avg_tokens BETWEEN 30 AND 600"), "no_empty_chunks": ("warn", "min_tokens >= 20"), "coverage": ("warn", "coverage >= 90")},
    "multimodal": {"tables_processed": ("warn", "enriched >= tables"), "images_processed": ("warn", "captions + ocr = images"), "llm_responded": ("warn", "responded")},
    "embed": {"chunks_embedded": ("error", "embedded = chunks"), "vector_dim_correct": ("warn", "true"), "bm25_built": ("warn", "terms > 0"), "real_embeddings": ("warn", "NOT mock")},
    "metadata": {"metadata_attached": ("error", "with_metadata = chunks"), "required_fields_present": ("warn", "missing = 0"), "filterable_fields": ("warn", "filterable >= 5")},
    "graph": {"graph_built": ("error", "nodes > 0"), "entities_found": ("warn", "entities > 0"), "entity_types": ("warn", "types > 0")},
    "store": {"vectors_upserted": ("error", "vectors > 0"), "store_connected": ("warn", "connected"), "sql_tables": ("info", "true")},
    "rag": {"showcase_built": ("warn", "questions = 10"), "sql_store": ("warn", "tables > 0"), "hybrid_retrieval": ("warn", "hybrid")},
    "answer": {"answers_generated": ("error", "answers = questions"), "llm_available": ("warn", "available"), "token_budget": ("warn", "tokens < 50000")},
    "unified_parse": {"parse_completed": ("error", "completed"), "docling_used": ("warn", "unified"), "content_classified": ("warn", "classified")},
}


def stage_checks(stage: str) -> Column:
    """The catalogue's checks of a stage over a row of its metrics; a condition on a null metric fails."""
    return checks(*[check(name, F.expr(condition), severity=severity) for name, (severity, condition) in CATALOGUE[stage].items()])
