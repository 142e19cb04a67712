"""Queries of this subpackage, by name."""

from . import centroids, chat, decontaminate, lines, lm, packing, quality, repair, simhash, sketches, substrings, toxicity, urls

QUERIES = {
    "op1_lm_score": lm.op1_lm_score,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_chat": chat.op3_chat,
    "op4_simhash": simhash.op4_simhash,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_suffix_dedup": substrings.op8_suffix_dedup,
    "op9_urls": urls.op9_urls,
    "op10_fingerprints": sketches.op10_fingerprints,
    "op11_centroids": centroids.op11_centroids,
    "op12_repair": repair.op12_repair,
    "op13_quality": quality.op13_quality,
}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": lines.OP2_SQL, "op7_decontaminate": decontaminate.OP7_SQL, "op8_suffix_dedup": substrings.OP8_SQL, "op11_centroids": centroids.OP11_SQL, "op12_repair": repair.OP12_SQL}
