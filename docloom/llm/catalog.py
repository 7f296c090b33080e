"""The queries of the operators of this subpackage, and of the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from docloom.llm import alignment, caps, jpeg, language, licenses, maxscore, mixing, ngram_join, pieces, quality, sharding, token_counts, warc


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run, "op1_vector_dedup": caps.op1_vector_dedup, "op2_ngram_join": ngram_join.op2_ngram_join, "op3_token_counts": token_counts.op3_token_counts, "op4_language": language.op4_language, "op5_licenses": licenses.op5_licenses, "op6_sharding": sharding.op6_sharding, "op7_mixing": mixing.op7_mixing, "op8_pieces": pieces.op8_pieces, "op9_jpeg": jpeg.op9_jpeg, "op10_quality": quality.op10_quality, "op11_alignment": alignment.op11_alignment, "op12_warc": warc.op12_warc, "op13_maxscore": maxscore.op13_maxscore}


def oracle_sql() -> dict:
    return {"op2_ngram_join": ngram_join.OP2_SQL, "op6_sharding": sharding.OP6_SQL, "op7_mixing": mixing.OP7_SQL, "op12_warc": warc.OP12_SQL, "op13_maxscore": maxscore.OP13_SQL}
