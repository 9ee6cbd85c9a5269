"""The queries of this package and their SQL, for __spark_entry__."""

from __future__ import annotations

from plenaria.llm import lookalikes, mixing, name_variants, near_duplicates, quota_sample, reading_level, reference_match, stable_sample, tokens, transcripts

QUERIES = {
    "p1_found": transcripts.p1_found,
    "p1_turns": transcripts.p1_turns,
    "p1_speech_turns": transcripts.p1_speech_turns,
    "p2_found": name_variants.p2_found,
    "p2_entities": name_variants.p2_entities,
    "p3_found": reference_match.p3_found,
    "p3_matches": reference_match.p3_matches,
    "p4_found": lookalikes.p4_found,
    "p4_forms": lookalikes.p4_forms,
    "p4_classes": lookalikes.p4_classes,
    "p5_found": near_duplicates.p5_found,
    "p5_groups": near_duplicates.p5_groups,
    "p6_sample": stable_sample.p6_sample,
    "p7_found": quota_sample.p7_found,
    "p7_report": quota_sample.p7_report,
    "p7_targets": quota_sample.p7_targets,
    "p7_sample": quota_sample.p7_sample,
    "p8_ids": tokens.p8_ids,
    "p9_found": mixing.p9_found,
    "p9_mix": mixing.p9_mix,
    "p9_shares": mixing.p9_shares,
    "p10_found": reading_level.p10_found,
    "p10_profile": reading_level.p10_profile,
}
SQL = stable_sample.SQL | quota_sample.SQL | lookalikes.SQL
