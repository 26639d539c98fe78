"""The queries of this folder, each over whole tables with production parameters, and SQL for those that it can say."""

from __future__ import annotations

from yore.llm import bases, brown, decontaminate, langid, licenses, mixing, packing, periodic, pii, quality, simhash, suffix, urls, whitening

QUERIES = {
    "op1_repeats": suffix.op1_repeats,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_urls": urls.op3_urls,
    "op4_simhash": simhash.op4_simhash,
    "op5_brown": brown.op5_brown,
    "op6_licenses": licenses.op6_licenses,
    "op7_pii": pii.op7_pii,
    "op8_quality": quality.op8_quality,
    "op9_language": langid.op9_language,
    "op10_pack": packing.op10_pack,
    "op11_runs": periodic.op11_runs,
    "op12_whiten": whitening.op12_whiten,
    "op13_mix": mixing.op13_mix,
}

QUERIES |= bases.QUERIES

ORACLES = {"op2_decontaminate": decontaminate.SQL, "op13_mix": mixing.SQL, **bases.ORACLES}
