"""The queries of this subpackage by name, and their oracles in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirgate.llm import attention_lm, decontam, fingerprints, hard_negatives, jaccard, langid, lexical, licenses, line_dedup, mixing, rollups, simhash, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_lm_scores": attention_lm.query,
    "op8_line_dedup": line_dedup.query,
    "op1_fingerprints": fingerprints.query,
    "op6_token_rollups": rollups.query,
    "op7_warc_salvage": warc.query,
    "op2_language_id": langid.query,
    "op9_license_scan": licenses.query,
    "op3_decontaminate": decontam.query,
    "op4_simhash": simhash.query,
    "op10_source_mix": mixing.query,
    "op11_jaccard_join": jaccard.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_lexical_search": lexical.query,
    "token_rollups_words": rollups.words_query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": decontam.ORACLE_SQL,
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op7_warc_salvage": warc.ORACLE_SQL,
    "op11_jaccard_join": jaccard.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_lexical_search": lexical.ORACLE_SQL,
    "token_rollups_words": rollups.WORDS_SQL,
}
