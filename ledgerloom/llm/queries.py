"""The corpus queries, one for each operator, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from ledgerloom.llm import decontaminate, fingerprint, hmm, htmltext, language, licenses, lines, near, packing, repeats, resample, search, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_licenses": licenses.op4_licenses,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_language": language.op6_language,
    "op7_repeats": repeats.op7_repeats,
    "op8_near": near.op8_near,
    "op9_hmm": hmm.op9_hmm,
    "op10_packing": packing.op10_packing,
    "op11_search": search.op11_search,
    "op12_resample": resample.op12_resample,
    "op13_html_text": htmltext.op13_html_text,
}
ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op5_line_dedup": lines.OP5_SQL,
    "op7_repeats": repeats.OP7_SQL,
    "op8_near": near.OP8_SQL,
    "op11_search": search.OP11_SQL,
    "op12_resample": resample.OP12_SQL,
    "op13_html_text": htmltext.OP13_SQL,
}
