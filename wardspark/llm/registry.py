"""The queries of this subpackage and their SQL, where SQL can express them."""

from wardspark.llm import decontam, exact_dedup, html_text, katz, mixing, quality, simhash, token_codes, toxicity, warc

QUERIES = {
    "op1_katz": katz.op1_katz,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_html_text": html_text.op3_html_text,
    "op4_token_codes": token_codes.op4_token_codes,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_decontam": decontam.op6_decontam,
    "op7_warc": warc.op7_warc,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality": quality.op9_quality,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {"op1_katz": katz.SQL, "op5_exact_dedup": exact_dedup.SQL, "op7_warc": warc.SQL, "op8_simhash": simhash.SQL, "op10_mixing": mixing.SQL}
