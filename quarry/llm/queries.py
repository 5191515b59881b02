"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import ball_kmeans, chat_format, itq_dedup, language_id, lexical_search, minhash_dedup, mixing, packing, secret_scan, token_counts, toxicity, vector_search, warc_zstd

QUERIES = {
    "op1_length_buckets": packing.op1_length_buckets,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_itq_dedup": itq_dedup.op3_itq_dedup,
    "op4_warc_zstd": warc_zstd.op4_warc_zstd,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_vector_search": vector_search.op8_vector_search,
    "op9_minhash_dedup": minhash_dedup.op9_minhash_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_ball_kmeans": ball_kmeans.op12_ball_kmeans,
    "op13_language_id": language_id.op13_language_id,
}

ORACLES: dict[str, str] = {
    "op4_warc_zstd": warc_zstd.OP4_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op8_vector_search": vector_search.OP8_SQL,
    "op9_minhash_dedup": minhash_dedup.OP9_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
    "op12_ball_kmeans": ball_kmeans.OP12_SQL,
}
