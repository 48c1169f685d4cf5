"""The queries of this subpackage, one for each operator, and their SQL."""

from . import band, decontamination, html, language, lm_scoring, mixing, near_dedup, phrases, pii, rotated, secrets, tokens, topk

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_near_dedup": near_dedup.query,
    "op3_mixing": mixing.query,
    "op4_secrets": secrets.query,
    "op5_tokens": tokens.query,
    "op6_pii": pii.query,
    "op7_lm_scoring": lm_scoring.query,
    "op8_language": language.query,
    "op9_topk": topk.query,
    "op10_html": html.query,
    "op11_phrases": phrases.query,
    "op12_rotated_codes": rotated.query,
    "op13_band_join": band.query,
}
ORACLES = {"op1_decontamination": decontamination.ORACLE, "op3_mixing": mixing.ORACLE, "op9_topk": topk.ORACLE, "op11_phrases": phrases.ORACLE, "op13_band_join": band.ORACLE}
