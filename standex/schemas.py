"""Explicit schemas: nothing is inferred when data is read. All fields are nullable."""

from __future__ import annotations

#: doc_idx is null where a file does not number its chunks.
CHUNK = (
    "doc_idx long, id string, title string, text string, category string, keywords array<string>, part_number int, standard_year int, "
    "is_summary_chunk boolean, chunk_index int"
)
ENRICHED = CHUNK + (
    ", related_standards array<string>, technical_properties struct<physical:array<string>, chemical:array<string>, testing:array<string>, "
    "manufacturing:array<string>, quality:array<string>>, application_domains array<string>, composition_terms array<string>, "
    "is_test_method boolean, superseded_by string, importance_weight double"
)
QUERY = "id string, query string, expected_standards array<string>"
RESULT = QUERY + ", retrieved_standards array<string>, latency_seconds double"
LINE = "src_id string, page_no int, line_no int, line string"
