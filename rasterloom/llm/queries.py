"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from rasterloom.llm import chat, decontaminate, fim, hyperminhash, licenses, linededup, nndescent, pii, quality, repeats, spelling, urlfilter, wfst

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_near_duplicates": hyperminhash.op2_near_duplicates,
    "op3_nearest_neighbours": nndescent.op3_nearest_neighbours,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_repeated_substrings": repeats.op5_repeated_substrings,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_personal_data": pii.op8_personal_data,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_sentencepiece": wfst.op10_sentencepiece,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_url_filter": urlfilter.op12_url_filter,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {
    "op1_license_scan": licenses.oracle(),
    "op2_near_duplicates": hyperminhash.ORACLE,
    "op4_decontamination": decontaminate.ORACLE,
    "op6_chat_formatting": chat.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
