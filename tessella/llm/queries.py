"""The queries of this subpackage and their SQL."""

from importlib import import_module

MODULES = {
    "op1_sentencepiece": "sentencepiece_codec",
    "op2_mix_sources": "mixing",
    "op3_media_sequences": "media",
    "op4_phrase_automata": "phrase_dedup",
    "op5_token_rollup": "rollup",
    "op6_quality_rules": "quality",
    "op7_toxicity": "toxicity",
    "op8_suffix_dedup": "suffix_dedup",
    "op9_lm_scores": "logbilinear",
    "op10_order_minhash": "order_minhash",
}
QUERIES, ORACLES = {}, {}
for _name, _module in MODULES.items():
    _m = import_module(f"tessella.llm.{_module}")
    QUERIES[_name] = _m.query
    if getattr(_m, "SQL", None):
        ORACLES[_name] = _m.SQL
