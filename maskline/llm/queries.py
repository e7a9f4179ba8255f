"""The registered queries of this subpackage."""

from __future__ import annotations

from . import byte_model, decontamination, html_text, importance, language_id, license_scan, manifest, mixing, ngram_join, quality_rules, spelling, token_files, warc

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_token_files": token_files.op2_token_files,
    "op3_html_text": html_text.op3_html_text,
    "op4_mixing": mixing.op4_mixing,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_byte_model": byte_model.op6_byte_model,
    "op7_importance": importance.op7_importance,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_language_id": language_id.op10_language_id,
    "op11_manifest": manifest.op11_manifest,
    "op12_spelling": spelling.op12_spelling,
    "op13_warc": warc.op13_warc,
}

ORACLES: dict[str, str] = {"op1_ngram_join": ngram_join.OP1_SQL, "op5_license_scan": license_scan.OP5_SQL, "op9_quality_rules": quality_rules.OP9_SQL, "op11_manifest": manifest.OP11_SQL, "op12_spelling": spelling.OP12_SQL, "op13_warc": warc.OP13_SQL}
