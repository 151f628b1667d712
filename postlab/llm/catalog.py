"""Registered queries of the operators in this subpackage, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from postlab.llm import alignment, chat, decontaminate, jaccard, langid, licenses, mixing, ngram_lm, packing, quality, spelling, vectors, warc
from postlab.llm.common import table

QUERIES = {
    "op1_license_scan": lambda s, d: licenses.scan(table(s, d, "documents")).drop("matches"),
    "op2_quality_rules": lambda s, d: quality.quality(table(s, d, "documents")),
    "op3_language_id": lambda s, d: langid.identify(table(s, d, "documents")),
    "op4_best_fit_packing": lambda s, d: packing.pack(table(s, d, "documents")),
    "op5_vector_near_dup": lambda s, d: vectors.near_duplicates(table(s, d, "embeddings")),
    "op6_chat_format": lambda s, d: chat.digests(table(s, d, "conversations")),
    "op7_ngram_lm": lambda s, d: ngram_lm.score(table(s, d, "documents")),
    "op8_warc": lambda s, d: warc.round_trip(table(s, d, "pages")),
    "op9_jaccard_join": lambda s, d: jaccard.near_duplicates(table(s, d, "documents")).drop("text_print"),
    "op10_mix": lambda s, d: mixing.mix(table(s, d, "documents")),
    "op11_decontaminate": lambda s, d: decontaminate.report(table(s, d, "documents"), table(s, d, "benchmark")).drop("items"),
    "op12_spelling_variants": lambda s, d: spelling.variants(table(s, d, "documents")),
    "op13_token_alignment": lambda s, d: alignment.align(table(s, d, "documents")),
}

ORACLES = {
    "op2_quality_rules": quality.quality_sql(),
    "op6_chat_format": chat.DIGESTS_SQL,
    "op8_warc": warc.ROUND_TRIP_SQL,
    "op10_mix": mixing.MIX_SQL,
    "op11_decontaminate": decontaminate.REPORT_SQL,
}
