"""Schemas of the index tables, as DDL."""

TABLES = {
    "files": "path string, hash string, size_bytes long, language string, role string, summary string, updated_at string",
    "chunks": "chunk_id string, path string, symbol_id string, line_start int, line_end int, text string, summary string, token_estimate int, hash string, chunk_type string",
    "symbols": "symbol_id string, path string, name string, kind string, signature string, line_start int, line_end int, summary string, hash string, token_estimate int",
    "relations": "source_ref string, target_ref string, relation_type string, weight double",
    "subsystems": "name string, summary string, representative_paths array<string>, file_count long, symbol_count long",
    "memories": "memory_id long, title string, summary string, evidence_refs array<string>, evidence_hash string, created_at string, last_validated_at string",
    "query_cache": "query_key string, query_text string, response_json string, created_at string",
    "index_meta": "key string, value string",
    "embeddings": "ref string, vector array<float>, model string, content_hash string, created_at string",
    "contents": "path string, text string",
    "imports": "path string, source_ref string, target_ref string, relation_type string, weight double",
    "mentions": "path string, source_ref string, target_ref string, relation_type string, weight double",
    "postings": "term string, ref string, of string, tf long, length int, path string",
    "lengths": "ref string, of string, length int, path string",
    "validations": "memory_id long, validated_at string",
}
