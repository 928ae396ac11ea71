"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, clusters, decontaminate, html_extract, jaccard_join, lattice_lm, license_scan, mixing, secrets_scan, token_count, toxicity, url_templates, vector_codes

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_nearest": ann.op3_nearest,
    "op4_lm_scores": lattice_lm.op4_lm_scores,
    "op5_mix": mixing.op5_mix,
    "op6_secret_scan": secrets_scan.op6_secret_scan,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_token_counts": token_count.op10_token_counts,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_clusters": clusters.op12_clusters,
    "op13_url_filter": url_templates.op13_url_filter,
}
ORACLE_SQL = {"op5_mix": mixing.SQL, "op11_vector_codes": vector_codes.SQL, "op12_clusters": clusters.SQL}
