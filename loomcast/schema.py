"""Schemas of the tables that everything else is a query over."""

TOKENS = "struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint, cached_input_tokens: bigint>"
ERROR = "struct<is_retryable: boolean, is_rate_limit: boolean, is_timeout: boolean, error_category: string, suggested_wait: double>"
ATTEMPTS = (
    "item_id string, prompt string, seq bigint, generation int, attempt int, strategy string, model string, temperature double, state string, "
    f"error_type string, error_message string, error {ERROR}, wait_before double, started_at double, duration double, output string, tokens {TOKENS}, partition_id int, context string, "
    "cooldown double, consecutive int, error_detail string"
)
#: ``cooldown`` and ``consecutive``: the pause that a rate limit began (null if it began none) and its number
#: since the last success. ``error_detail``: JSON, see ``functions/details.py``.
#: States of an attempt. The last attempt of an item has one of FINAL.
FINAL = ("success", "failed_final", "exhausted", "recovered", "skipped")
#: Fixed texts.
SKIPPED = "Skipped by middleware"
DRY_RUN_PREFIX = "[DRY-RUN] Mock output for prompt: "
MOCK_PREFIX = "Mock response to: "
