"""Queries of this subpackage and their SQL."""

from tallywright.llm import html_text, interpolated_lm, itq_dedup, langid, latent_decontam, mixing, parity_join, quotes, secrets, warc

QUERIES = {
    "op1_latent_decontam": latent_decontam.op1_latent_decontam,
    "op2_html_text": html_text.op2_html_text,
    "op3_interpolated_lm": interpolated_lm.op3_interpolated_lm,
    "op4_language_id": langid.op4_language_id,
    "op5_quote_linking": quotes.op5_quote_linking,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_parity_join": parity_join.op7_parity_join,
    "op8_embedding_dedup": itq_dedup.op8_embedding_dedup,
    "op9_source_mix": mixing.op9_source_mix,
    "op10_warc_archive": warc.op10_warc_archive,
}
ORACLES = {"op5_quote_linking": quotes.SQL, "op9_source_mix": mixing.SQL, "op10_warc_archive": warc.SQL}
