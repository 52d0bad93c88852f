"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontam, langid, licenses, linededup, lm, neardup, pieces, quality, urlfilter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_lm_score": lm.op2_lm_score,
    "op3_language_id": langid.op3_language_id,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_licenses": licenses.op6_licenses,
    "op7_quality": quality.op7_quality,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_line_dedup": linededup.op10_line_dedup,
}

ORACLES = {
    "op1_warc": warc.SQL,
    "op6_licenses": licenses.SQL,
    "op8_near_duplicates": neardup.SQL,
    "op9_url_filter": urlfilter.SQL,
    "op10_line_dedup": linededup.SQL,
}
