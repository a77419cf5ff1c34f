"""The corpus queries and, where SQL can express them, their DuckDB texts."""

from . import decontaminate, exact_dedup, language_id, license_scan, line_dedup, mixing, simhash, token_count, toxicity, url_filter

QUERIES = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_simhash": simhash.op2_simhash,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_language_id": language_id.op9_language_id,
    "op10_token_counts": token_count.op10_token_counts,
}

ORACLES = {
    "op1_url_filters": url_filter.OP1_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_license_scan": license_scan.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
}
