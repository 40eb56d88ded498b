"""The subpackage's queries, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from weftline.llm import mix, personal, spans, split, survivors, tokenize, variants

QUERIES = {
    "p1_found": survivors.p1_found,
    "p1_survivors": survivors.p1_survivors,
    "p2_found": variants.p2_found,
    "p2_variants": variants.p2_variants,
    "p4_found": split.p4_found,
    "p4_pieces": split.p4_pieces,
    "p4_cover": split.p4_cover,
    "p5_found": personal.p5_found,
    "p5_redacted": personal.p5_redacted,
    "p6_ids": tokenize.p6_ids,
    "p7_mix": mix.p7_mix,
    "p7_shares": mix.p7_shares,
    "p8_found": spans.p8_found,
    "p8_shared": spans.p8_shared,
}

SQL = {
    "p4_found": "SELECT record_id FROM records WHERE strlen(content) > 1200",
    "p4_cover": "SELECT record_id, true AS whole, true AS small, true AS paged FROM records WHERE strlen(content) > 1200",
}
