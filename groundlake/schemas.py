"""Declared schemas, as DDL, of every table the engine reads or writes."""

from __future__ import annotations

PAPERS = "paper_id string, title string, authors array<string>, abstract string, published string, updated string, primary_category string, categories array<string>, pdf_url string, comment string, journal_ref string, doi string"
CHUNKS = "chunk_id string, paper_id string, title string, year string, primary_category string, chunk_idx int, n_chunks int, text string"
INDEX = CHUNKS + ", embedding array<float>"
GOLD = "qid string, question string, type string, gold_answer string, expected_citations array<string>, key_claims array<string>, notes string"
HUMAN = "correctness int, faithfulness int, refusal_ok int, notes string"
AUTO = (
    "cited_ids array<string>, n_cited int, valid_citations array<string>, invalid_citations array<string>, n_invalid int, grounding_violation boolean, uncited boolean, marked_outside_corpus boolean, "
    "expected_ids array<string>, cites_expected array<string>, expected_citation_recall double, retrieval_recall double, retrieval_hit boolean"
)
RUN = (
    "qid string, question string, type string, backend string, condition string, model string, k int, retrieved_ids array<string>, expected_citations array<string>, "
    f"human struct<{HUMAN}>, answer string, latency_s double, error string, attempts int, grounded boolean, auto struct<{AUTO}>"
)
CATALOGUE = (
    "recid string, arxiv_eprints array<struct<value: string, categories: array<string>>>, titles array<struct<title: string>>, authors array<struct<full_name: string>>, "
    "publication_info array<struct<year: string, journal_title: string>>, dois array<struct<value: string>>, report_numbers array<struct<value: string>>, "
    "documents array<struct<url: string, filename: string, key: string>>"
)
REJECTS = "paper_id string, title string, year string, doi string, tried_url string, file string, reason string"
API_RECORD = "entry_id string, title string, authors array<string>, summary string, published string, updated string, primary_category string, categories array<string>, pdf_url string, comment string, journal_ref string, doi string"
