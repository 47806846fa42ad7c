"""Declared schemas of audit tables."""

CALL = (
    "subject_id int, toi int, th int, true_label string, condition string, name_group string, city string, run_idx int, provider string, model string, latency_s double, ok boolean, "
    "prompt string, system string, rubric_used boolean, response struct<risk_label: string, proposed_asset_mix: struct<growth_pct: int, income_pct: int>, "
    "assumptions_made: map<string, array<string>>, justification_short: string, error: string>"
)
#: Column names of the two result tables in use: operators take names, these give them.
CORE = {"correct": "acc", "pred": "pred_label", "true": "true_label", "group": "name_group", "place": "city", "seconds": "latency_s", "time": None}
ALT = {"correct": "risk_band_correct", "pred": "risk_label", "true": "true_risk_band", "group": "gender", "place": "location", "seconds": "response_time_seconds", "time": "timestamp"}
CACHE_ENTRY = (
    "key string, prompt_hash string, prompt_text string, model string, timestamp timestamp, access_count bigint, last_accessed timestamp, response_time double, token_count bigint, cost double, "
    "file_path string, file_size bigint, confidence_score double, validation_passed boolean"
)
STUDY = "study string, n bigint, effect double, se double, models array<string>, groups array<string>"
VERSION_LOG = "version_id string, timestamp timestamp, payload string"
CHECKPOINT = "total_calls bigint, completed_calls bigint, failed_calls bigint, start_time double, last_checkpoint double"
