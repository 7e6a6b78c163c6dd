"""The relations: usage messages, prices, and the server's tables."""

from __future__ import annotations

SOURCES = ("opencode", "claude", "codex", "gemini", "cursor", "amp", "droid")
#: Sources that a submission may name.
SUBMITTABLE = ("opencode", "claude", "codex", "gemini", "cursor", "amp")
TOKENS = ("input", "output", "cache_read", "cache_write", "reasoning")

#: One row per message of any tool. ``cost`` is what the source itself states, 0 if it states none.
MESSAGES = (
    "source string, model_id string, provider_id string, session_id string, timestamp_ms bigint, date date, "
    + ", ".join(f"{t} bigint" for t in TOKENS)
    + ", cost double, agent string"
)
COLUMNS = ("source", "model_id", "provider_id", "session_id", "timestamp_ms", "date", *TOKENS, "cost", "agent")
#: Prices per token; null counts as free.
PRICES = "model_key string, price_input double, price_output double, price_cache_read double, price_cache_write double"
PRICE_COLUMNS = ("price_input", "price_output", "price_cache_read", "price_cache_write")
