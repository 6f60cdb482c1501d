"""Schemas and closed vocabularies."""

from __future__ import annotations

CHUNKS = (
    "tenant_id string, chapter string, source_uri string, section_path string, content string, content_hash string,"
    " metadata map<string,string>, embedding array<float>, embed_model string, is_active boolean, created_at timestamp"
)
RESULTS = "query_id long, rank int, chunk_id string, content string, score double, source_uri string, section_path string, metadata map<string,string>, retriever string"
NODES = "tenant_id string, canonical_name string, name string, entity_type string, confidence double, surface_forms array<string>, chapter string, created_at timestamp"
EDGES = "tenant_id string, src string, dst string, rel_type string, source_uri string, confidence double, evidence string, chunk_id string, chapter string, created_at timestamp"
GOLDEN = (
    "case_id string, id string, question string, query string, expected_answer string, segment string, is_answerable boolean, relevant_chunk_ids array<string>,"
    " relevant_keywords array<string>, relevance_grades map<string,int>, history array<struct<role:string,content:string>>"
)

# The closed vocabularies of the graph.
NODE_LABELS = ["Person", "Organization", "Product", "Technology", "Location", "Project", "Concept", "Event"]
RELATIONSHIP_TYPES = [
    "WORKS_AT", "FOUNDED", "ACQUIRED", "PARTNERS_WITH", "SUPPLIES", "COMPETES_WITH", "LOCATED_IN", "USES", "PART_OF", "MENTIONS", "REPORTS_TO",
    "SUBCONTRACTS_ON", "SUPERSEDES",
]
STOP_ENTITIES = [
    "data", "system", "systems", "user", "users", "customer", "customers", "company", "companies", "team", "teams", "product", "products", "service",
    "services", "process", "information", "technology",
]
