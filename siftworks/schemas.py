"""Schemas of the tables."""

ITEM = "source string, url string, title string, text string, fetched_at string, author_name string, author_handle string, is_thread boolean, thread_contents string, expanded_urls array<string>, has_video boolean, video_url string"
CARD = "card_id string, name string, desc string, list_id string, list_name string, url string, checklist_items array<string>, last_activity string"
COST = "node_name string, input_tokens long, output_tokens long, latency_ms double, cost_usd double, error string, provider string"
#: The columns of each table of the store, and its key; a table without one is only appended to.
STORE = {
    "seen_items": ("url string, seen_at string", "url"),
    "recent_item_embeddings": ("item_id string, url string, embedding_vector array<double>, fetched_at string, scored_at string, is_roundup boolean", "url"),
    "topic_vectors": ("tag string, embedding_vector array<double>, updated_at string", "tag"),
    "prefilter_drops": ("item_id string, filter_type string, similarity_score double, compared_against_item_id string, compared_against_tag string, run_id string", None),
    "embedding_failures": ("module string, run_id string, item_count long, error string, occurred_at string", None),
    "scored_items_log": (ITEM + ", keep boolean, reasoning string, tags array<string>, run_id string, logged_at string", None),
    "dropped_tags": ("run_id string, item_id string, tag string", None),
    "classification_log": ("item_id string, decision string, proposal_type string, run_id string", None),
    "approval_log": ("item_id string, outcome string, run_id string", None),
    "feedback_events": ("event_id string, item_id string, feedback_text string, replied_at string, run_id string, tags array<string>, title string, content_summary string, sentiment string", None),
    "nudge_events": ("event_id string, week_of string, item_id string, replied_at string, tags array<string>, delta double, at long", None),
    "same_day_adjustments": ("week_of string, tag string, cumulative_adjustment double, item_ids_contributing array<string>", "week_of, tag"),
    "node_summary": ("run_id string, node_name string, items_in long, items_out long, dropped long, cost_usd double, duration_seconds double, error_summary string", "run_id, node_name"),
    "run_history": ("run_id string, path string, status string, started_at string, finished_at string, total_cost_usd double, items_in long, items_out long, duration_seconds double, error_summary string", "run_id"),
    "plan_history": ("run_id string, cards array<struct<card_id:string,list_name:string>>, generated_at string", "run_id"),
    "carry_forward_log": ("url string, carried_in_run_id string, carried_at string", "url"),
    "item_map": ("message_id string, run_id string, item_number int, url string, title string, text string, tags array<string>, reasoning string, section string", "message_id, item_number"),
    "pending_resume": ("message_id string, thread_id string, proposal_id string, run_id string, url string, title string, text string, reasoning string, tags array<string>, proposal_type string, matched_card_id string", "message_id"),
    "outbox": ("effect_id string, run_id string, node string, target string, kind string, payload string, after string, follow string, seq long, status string, tries int, result string, error string, created_at string, changed_at string", "effect_id"),
    "model_answers": ("model string, digest string, answers string, run_id string, answered_at string", "digest"),
    "adhoc_queue": ("key string, text string, queued_at string", "key"),
    "polling_state": ("name string, value long", "name"),
    "profile": ("name string, content string, updated_at string", "name"),
    "documents_out": ("name string, run_id string, text string, generated_at string", "name"),
    "event_log": ("ts string, agent string, event_type string, summary string", None),
    "costs": (COST + ", run_id string", None),
}
