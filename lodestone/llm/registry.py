"""The opN_ queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from lodestone.llm import codes, decontaminate, flac, langid, lines, mixing, neardup, phrases, secrets, spans, tokens, toxicity, warc

QUERIES = {
    "op1_warc_dictionary": warc.query,
    "op2_source_mix": mixing.query,
    "op3_line_dedup": lines.query,
    "op4_minhash_neardup": neardup.query,
    "op5_flac_media": flac.query,
    "op6_language_id": langid.query,
    "op7_toxicity": toxicity.query,
    "op8_sentence_spans": spans.query,
    "op9_decontaminate": decontaminate.query,
    "op10_token_parquet": tokens.query,
    "op11_secret_scan": secrets.query,
    "op12_vector_codes": codes.query,
    "op13_phrase_mining": phrases.query,
}
SQL = {
    "op3_line_dedup": lines.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_secret_scan": secrets.SQL,
    "op12_vector_codes": codes.SQL,
    "op13_phrase_mining": phrases.SQL,
}
