"""Schemas of the raw tables, the views and the tables that pipelines write. Fixed values."""

USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
MESSAGE = f"struct<role:string,content:string,model:string,stop_reason:string,usage:{USAGE}>"
#: One line of a transcript. Content is read as text, which keeps JSON byte for byte.
RAW_EVENT = f"uuid string, parentUuid string, sessionId string, type string, timestamp timestamp, isSidechain boolean, isCompactSummary boolean, cwd string, gitBranch string, message {MESSAGE}"
RAW_SUBAGENT = f"uuid string, parentUuid string, sessionId string, type string, timestamp timestamp, isSidechain boolean, message {MESSAGE}"
RAW_META = "agentType string, description string"
ENVELOPE = "uuid string, type string, sessionId string, timestamp string, message string"

VIEWS = {
    "sessions": "session_id string, cwd string, git_branch string, started_at timestamp_ntz, ended_at timestamp_ntz, assistant_messages bigint, record_count bigint, transcript_path string",
    "messages": "uuid string, parent_uuid string, session_id string, ts timestamp_ntz, type string, is_sidechain boolean, is_compact_summary boolean, role string, model string, stop_reason string, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_write bigint, content_json string, source_file string",
    "content_blocks": "session_id string, message_uuid string, ts timestamp_ntz, role string, message_type string, is_compact_summary boolean, pos int, block_type string, text string, tool_use_id_field string, tool_name string, tool_input string, tool_use_id string, tool_result_content string, thinking string",
    "messages_text": "uuid string, session_id string, ts timestamp_ntz, role string, is_compact_summary boolean, text_content string",
    "turn_window": "session_id string, prev_uuid string, prev_role string, prev_ts timestamp_ntz, curr_uuid string, curr_role string, curr_ts timestamp_ntz, gap_ms bigint, window_idx bigint",
    "tool_calls": "message_uuid string, session_id string, ts timestamp_ntz, tool_name string, tool_use_id string, tool_input string",
    "tool_results": "message_uuid string, session_id string, ts timestamp_ntz, tool_use_id string, content string",
    "todo_events": "session_id string, written_at timestamp_ntz, message_uuid string, subject string, status string, active_form string, snapshot_ix bigint",
    "todo_state_current": "session_id string, subject string, status string, active_form string, written_at timestamp_ntz",
    "subagent_spawns": "session_id string, spawned_at timestamp_ntz, message_uuid string, tool_use_id string, spawn_tool string, subagent_type string, description string, prompt string, run_in_background string",
    "task_creations": "session_id string, created_at timestamp_ntz, message_uuid string, tool_use_id string, create_tool string, subject string, description string, active_form string, metadata string",
    "task_updates": "session_id string, updated_at timestamp_ntz, message_uuid string, tool_use_id string, update_tool string, task_id string, status string, add_blocked_by string, owner string",
    "tasks_state_current": "session_id string, task_id string, subject string, active_form string, status string, created_at timestamp_ntz, last_updated_at timestamp_ntz",
    "skill_invocations": "session_id string, ts timestamp_ntz, message_uuid string, source string, skill_id string, args string, tool_use_id string, context_uuid string",
    "subagent_sessions": "parent_session_id string, agent_hex string, agent_type string, description string, started_at timestamp_ntz, ended_at timestamp_ntz, message_count bigint, transcript_path string",
    "subagent_messages": "uuid string, parent_uuid string, session_id string, parent_session_id string, agent_hex string, ts timestamp_ntz, type string, role string, model string, input_tokens bigint, output_tokens bigint, content_json string, source_file string",
}

TABLES = {
    "ingest_stamps": "uuid string, session_id string, approx_tokens int, simhash64 bigint, token_budget_bucket string, canonical_uuid string, first_seen_ts timestamp, stamped_at timestamp",
    "message_embeddings": "uuid string, model string, dim int, embedding array<float>, embedded_at timestamp",
    "message_clusters": "uuid string, cluster_id int, x float, y float, is_noise boolean",
    "cluster_terms": "cluster_id int, term string, weight float, rank int",
    "session_communities": "session_id string, community_id int, size int, is_medoid boolean, coherence float, gamma_used float",
    "community_profile": "gamma double, n_communities int, quality double, plateau_length int",
    "session_classifications": "session_id string, autonomy_tier string, work_category string, success string, goal string, confidence float, classified_at timestamp",
    "message_trajectory": "session_id string, prev_uuid string, curr_uuid string, prev_sentiment string, curr_sentiment string, delta double, is_transition boolean, transition_kind string, confidence float, classified_at timestamp",
    "session_conflicts": "session_id string, turn_a_uuid string, turn_b_uuid string, conflict_kind string, severity string, agent_position string, user_position string, confidence double, detected_at timestamp",
    "user_friction": "uuid string, session_id string, ts timestamp, text_snippet string, label string, rationale string, source string, confidence float, classified_at timestamp",
    "skills_catalog": "skill_id string, name string, plugin string, plugin_version string, source_kind string, description string, argument_hint string, source_path string, synced_at timestamp",
    "session_checkpoint": "session_id string, pipeline string, last_ts_processed timestamp, last_mtime_processed timestamp, completed_at timestamp",
    "retry_queue": "pipeline string, unit_id string, error string, attempts int, next_attempt_at timestamp, created_at timestamp, completed_at timestamp",
}
