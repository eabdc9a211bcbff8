"""The corpus operators' queries and their SQL, for the entry module."""

from __future__ import annotations

from heliograph.llm.bpe import op6_bpe_round_trip
from heliograph.llm.decontam import op9_decontamination
from heliograph.llm.langid import op2_language_id
from heliograph.llm.licenses import OP4_SQL, op4_license_scan
from heliograph.llm.matroska import op7_media_columns
from heliograph.llm.neardup import op3_near_duplicates
from heliograph.llm.quality import op5_quality
from heliograph.llm.repeats import op8_repeated_passages
from heliograph.llm.toxicity import op1_toxicity
from heliograph.llm.urls import op10_url_filter

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_near_duplicates, op4_license_scan, op5_quality, op6_bpe_round_trip, op7_media_columns, op8_repeated_passages, op9_decontamination, op10_url_filter)}
#: The others: trained models, hashes of encoded forms, and components that are too slow in SQL; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_license_scan": OP4_SQL}
