"""Fixed schemas of the tables that this library reads and writes; nothing is inferred."""

from __future__ import annotations

DOCUMENTS = """document_id string, status string, file_name string, source_path string, company_sigla string, file_hash string, page_count int,
    extraction_time_seconds double, tables_detected int, figures_detected int, headers_removed int, footers_removed int, ocr_used boolean,
    pdf_type string, markdown string, raw variant, errors array<string>, warnings array<string>, extracted_at timestamp"""
EXTRACTED = "document_id string, status string, markdown string, page_count int, tables_detected int, figures_detected int, ocr_used boolean, errors array<string>, warnings array<string>"
CHUNKS = "policy_id string, chunk_index int, chunk_type string, content string, metadata map<string,string>, chunk_id string, parent_id string, embedding array<float>"
POLICIES = "policy_id string, file_name string, file_hash string, company_sigla string, file_size_bytes bigint, markdown_size_bytes bigint, page_count int, created_at timestamp"
FACTS = "policy_id string, facts struct<numero_poliza:string,asegurado:string,vigencia:string,prima:string,coberturas:array<struct<nombre:string,limite:string,franquicia:string,detalle:string>>,condiciones:array<string>>"
JOBS = "event_id bigint, job_id string, policy_id string, status string, error string, ts timestamp"
METRICS = "event_id bigint, ts timestamp, kind string, status string, pages int, tables int, seconds double"
