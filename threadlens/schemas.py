"""Spark schemas of the engine's tables, as DDL."""

SESSIONS = """id string, project_path string, cwd string, git_branch string, derived_branches array<string>, started_at timestamp,
ended_at timestamp, last_active_at timestamp, message_count int, turn_count int, first_user_text string, last_user_text string,
status string, status_source string, status_set_at timestamp, provider string, cost_usd double, source_path string, account string,
summary_title string, summary_short string, summary_long string, summary_model string, summary_at timestamp, summary_turn_count int"""
CHUNKS = "id long, session_id string, start_seq int, end_seq int, start_ts timestamp, end_ts timestamp, text string, approx_tokens int"
CHUNK_VECTORS = "chunk_id long, embedding array<float>, model_id string, dim int, embedded_at timestamp, session_id string"
FILES = "path string, size long, mtime_unix long, last_offset long, last_seq int, session_id string"
SESSION_USAGE = """session_id string, model string, turns int, input_tokens long, output_tokens long, cache_read_tokens long,
cache_write_tokens long, cost_usd double, updated_at timestamp"""
#: A block holds a term's postings within one range of chunks; no posting of it has more occurrences or a shorter chunk.
BLOCKS = "term string, block long, n int, max_f int, min_len int, postings array<struct<chunk_id:long,len:int,positions:array<int>>>"
LENGTHS = "chunk_id long, len int"
CLASSIFICATIONS = "session_id string, recipe_id string, ts timestamp, status string, evidence string, model string, raw_json string"

TABLES = {
    "sessions": SESSIONS, "chunks": CHUNKS, "chunk_vectors": CHUNK_VECTORS, "files": FILES, "session_usage": SESSION_USAGE, "classifications": CLASSIFICATIONS,
}
KEYS = {
    "sessions": ["id"], "chunks": ["id"], "chunk_vectors": ["chunk_id"], "files": ["path"], "session_usage": ["session_id", "model"], "classifications": ["session_id", "recipe_id"],
}
#: What a row's bucket follows from: its session, so that a session's rows of all tables lie together; a file's path.
BUCKET_KEYS = {"sessions": "id", "chunks": "session_id", "chunk_vectors": "session_id", "files": "path", "session_usage": "session_id", "classifications": "session_id"}
#: The two tables of a segment of postings.
SEGMENTS = {"blocks": BLOCKS, "lengths": LENGTHS}

#: The two transcript providers. Format A is one file per session under a project folder, format B dated rollouts.
PROVIDER_A, PROVIDER_B = "claude-code", "codex"
