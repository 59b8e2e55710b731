"""Registry of the training-data queries."""

from __future__ import annotations

from inkloom.llm import bitext, cleaning, languages, mainbody, mojibake, oracle, packing, repeats, residue, tokens, truncation


def queries() -> dict:
    return {
        "p1_found": residue.p1_found,
        "p1_kept": cleaning.p1_kept,
        "p2_found": repeats.p2_found,
        "p2_cleaned": cleaning.p2_cleaned,
        "p3_found": mojibake.p3_found,
        "p3_restored": mojibake.p3_restored,
        "p4_found": truncation.p4_found,
        "p4_sites": truncation.p4_sites,
        "p5_found": bitext.p5_found,
        "p6_found": mainbody.p6_found,
        "p6_story": cleaning.p6_story,
        "p7_ids": tokens.p7_ids,
        "p8_pack": packing.p8_pack,
        "p8_fill": packing.p8_fill,
        "p9_found": languages.p9_found,
        "p9_languages": languages.p9_languages,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
