"""Column functions on stated cases."""

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from meterglass.functions import names, values


def apply(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_agents(spark):
    given = ["OmO", "omo-plan", "Planner-Sisyphus", "explore", "sisyphus", "plan", None]
    assert apply(spark, names.agent_name, given) == ["Sisyphus", "Planner-Sisyphus", "Planner-Sisyphus", "explore", "Sisyphus", "plan", None]


def test_custom_models(spark):
    given = ["custom:Claude-Opus-4.5-Thinking-[Anthropic]-0", "gemini-2.5-pro", "Claude-Sonnet-4-[Anthropic]", None]
    assert apply(spark, names.custom_model, given) == ["claude-opus-4-5-thinking-0", "gemini-2-5-pro", "claude-sonnet-4", None]


@pytest.mark.parametrize(
    "rules, given, expected",
    [
        ("cursor", ["claude-3-sonnet", "gpt-4o", "gemini-pro", "deepseek-coder", "llama-3", "unknown-model"], ["anthropic", "openai", "google", "deepseek", "meta", "cursor"]),
        ("amp", ["grok-4", "x", None], ["xai", "anthropic", "anthropic"]),
        ("review", ["glm-4", "codex", "x"], ["zai", "openai", None]),
        ("display", ["o1-mini", "foo1", "auto"], ["openai", "unknown", "cursor"]),
    ],
)
def test_providers(spark, rules, given, expected):
    assert apply(spark, lambda c: names.provider_of(c, rules), given) == expected


def test_default_models(spark):
    given = ["anthropic", "openai", "google", "xai", "custom"]
    assert apply(spark, names.default_model, given) == ["claude-unknown", "gpt-unknown", "gemini-unknown", "grok-unknown", "custom-unknown"]


def test_short_names(spark):
    given = ["claude-4.5-opus", "claude-3-5-sonnet-20241022", "claude-3-5-sonnet", "o3", "o3-mini", "GPT-4o-mini", "haiku", "x-gpt-4.1"]
    assert apply(spark, names.short_name, given) == ["opus-4-5", "sonnet-4", "sonnet-3-5", "o3", None, "gpt-4o", None, "gpt-4.1"]


def test_labels(spark):
    given = ["claude-opus-4-5-20251101", "claude-sonnet-4-20250514", "gpt-5.1-codex", "gpt-4o-mini", "gemini-2.5-pro", "grok-code", "deepseek-r1", "some_new-model-high", "claude-3-7-sonnet"]
    expected = ["Claude Opus 4.5", "Claude Sonnet 4", "GPT-5.1", "GPT-4o Mini", "Gemini 2.5 Pro", "Grok Code", "DeepSeek R1", "Some New Model High", "Claude 3.7 Sonnet"]
    assert apply(spark, names.model_label, given) == expected
    assert apply(spark, names.source_label, ["amp", "claude", "other"]) == ["Amp", "Claude Code", "Other"]


def test_money(spark):
    given = ["$0.50", "0.50", "$1,234.56", "", "NaN", "nan", "  ", None, "1e3", "free"]
    assert apply(spark, values.money, given) == [0.5, 0.5, 1234.56, 0, 0, 0, 0, 0, 1000, 0]


def test_times(spark):
    given = ["2025-02-05T12:00:00.123Z", "2025-02-05t12:00:00+02:00", "2025-02-05", "12:00", "2025-13-01T00:00:00Z", None]
    assert apply(spark, values.millis_of_rfc3339, given) == [1738756800123, 1738749600000, None, None, None, None]
    given = ["2025-02-05T12:00:00.123Z", "2025-02-05T12:00:00", "2025-02-05", "x", "2025-02-31"]
    assert apply(spark, values.millis_of_csv_date, given) == [1738756800123, 1738756800000, 1738756800000, 0, 0]
    days = apply(spark, values.date_of_millis, [1750075200000, 0, 1733011200000], "bigint")
    assert [str(d) for d in days] == ["2025-06-16", "1970-01-01", "2024-12-01"]


def test_number_labels(spark):
    assert apply(spark, values.compact, [999, 1500, 2_500_000, 3_000_000_000], "bigint") == ["999", "1.5K", "2.5M", "3.0B"]
    assert apply(spark, values.dollars, [12.5, 1500.0], "double") == ["$12.50", "$1.5K"]
    assert apply(spark, values.hour_label, [0, 9, 12, 15], "int") == ["12am", "9am", "12pm", "3pm"]
    assert apply(spark, values.span_label, [0, 9000, 420_000, 7_500_000], "bigint") == ["N/A", "9s", "7m", "2h 5m"]


def test_djb2(spark):
    def expected(text):
        h = 5381
        for c in text:
            h = (h * 33 + ord(c)) & 0xFFFFFFFF
        return format(abs(h - (1 << 32) if h >> 31 else h), "x").rjust(16, "0")

    given = ["a", "submission", '{"sources":["claude"]}', "x" * 300]
    assert apply(spark, values.djb2, given) == [expected(x) for x in given]


def test_display_names_of_known_models_and_of_others(spark):
    given = ["grok-3", "grok-3-mini", "grok-3-high", "claude-instant-1", "gpt-3.5-turbo", "o1", "claude-sonnet-4-20250514", "some_NEW-model"]
    assert apply(spark, names.model_label, given) == ["Grok 3", "Grok 3 Mini", "Grok Code 3 High", "Claude instant 1", "Gpt 3.5 Turbo", "o1", "Claude Sonnet 4", "Some New Model"]


LABELS = {
    "claude-opus-4-5-20251101": "Claude Opus 4.5", "claude_opus_4.5": "Claude Opus 4.5", "claude-opus-45": "Claude Opus 4.5", "claude-4-opus": "Claude 4 Opus", "claude-opus-4": "Claude Opus 4",
    "claude-opus-4-1": "Claude Opus 4", "claude-sonnet-4-5-high": "Claude Sonnet 4.5 High", "Claude-4_Sonnet": "Claude 4 Sonnet", "claude-sonnet-4-thinking": "Claude Sonnet 4",
    "claude-haiku-4-5": "Claude Haiku 4.5", "claude4haiku": "Claude 4 Haiku", "claude-haiku-4": "Claude Haiku 4", "claude-3-7-sonnet": "Claude 3.7 Sonnet", "claude-3.5-sonnet": "Claude 3.5 Sonnet",
    "claude-3-5-haiku": "Claude 3.5 Haiku", "claude-3-opus": "Claude 3 Opus", "claude-3-sonnet": "Claude 3 Sonnet", "claude3haiku": "Claude 3 Haiku", "claude-4.5-opus": "Claude 4.5 Opus",
    "claude--opus-4": "Claude  Opus 4", "claude-": "Claude", "claude-instant-1": "Claude instant 1", "claude-3.opus": "Claude 3.opus", "gpt-5-1": "GPT-5.1", "gpt-5-mini": "GPT-5",
    "gpt-4-o-mini": "GPT-4o Mini", "gpt-4o-2024-08-06": "GPT-4o", "gpt4turbo": "GPT-4 Turbo", "gpt-4.1": "GPT-4", "gpt-3.5-turbo": "Gpt 3.5 Turbo", "o1-mini-x": "o1 Mini", "o1_preview-2": "o1 Preview",
    "o3mini": "o3 Mini", "O1": "o1", "o3-high": "o3 High", "o1-pro": "O1 Pro", "x-o1-mini": "X O1 Mini", "-o1-mini": "O1 Mini", "gemini-3-pro-preview": "Gemini 3 Pro", "gemini_3_flash": "Gemini 3 Flash",
    "gemini-2-5-pro": "Gemini 2.5 Pro", "gemini-25-flash": "Gemini 2.5 Flash", "gemini-2.0-flash-lite": "Gemini 2.0 Flash", "gemini-1.5-pro-002": "Gemini 1.5 Pro", "gemini-1_5_flash": "Gemini 1.5 Flash",
    "gemini-1.0-pro-vision": "Gemini 1.0 Pro Vision", "gemini-2.0-pro-exp": "Gemini 2.0 Pro Exp", "gemini-1-0-flash": "Gemini 1 0 Flash", "grok-3": "Grok 3", "grok-3-mini-low": "Grok Code 3 Mini Low",
    "grok-3-beta": "Grok Code 3", "x-ai/grok-4": "Grok Code", "deepseek-v3.1": "DeepSeek V3", "deepseek_r1": "DeepSeek R1", "deepseek-chat": "DeepSeek", "kimi-k2-20250711-1": "Kimi K2", "kimi-k2-20250711-1:free": "Kimi K2 20250711 1",
    "kimi-k2-12345678": "Kimi K2", "kimi-k2-12345678-20250101": "Kimi K2", "kimi-20250101:x": "Kimi 20250101", "kimi-high-thinking": "Kimi High", "kimi-thinking-high": "Kimi High", "kimi-high:x": "Kimi",
    "kimi-2024": "Kimi 2024", "_a__b-": "A B",
}


def test_display_names_of_every_family_and_tail(spark):
    got = dict(zip(LABELS, apply(spark, names.model_label, list(LABELS))))
    assert got == LABELS


def test_tokens_as_the_review_shows_them(spark):
    given = [999, 1500, 2_500_000, 3_000_000_000]
    assert apply(spark, lambda c: values.compact(c, large=2), given, "bigint") == ["999", "1.5K", "2.50M", "3.00B"]


def test_tokens_up_to_the_largest_mark(spark):
    given = [None, 999, 1500, 999_999_999, 1_000_000_000, 3_000_125_000]
    assert apply(spark, lambda c: values.compact(c, large=2, top="M"), given, "bigint") == [None, "999", "1.5K", "1000.00M", "1000.00M", "3000.13M"]
    assert apply(spark, lambda c: values.compact(c, top="K"), given[1:], "bigint") == ["999", "1.5K", "1000000.0K", "1000000.0K", "3000125.0K"]


def test_digits_are_rounded_by_the_exact_value(spark):
    """7.585 and 0.145 lie below a half as doubles, also when their whole is taken away; 0.125 is one and goes up."""
    given = [None, 7.585, 0.145, 1.005, 0.125, 1.375, -1.125, -0.145, 1234567.875, 1e11 + 0.125, 1e13, *[n / 1000 for n in range(5, 20000, 10)], *[n / 8 for n in range(-99, 99)]]
    exact = lambda x, digits: x if x is None else f"{Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP):f}"
    for digits in (1, 2):
        assert apply(spark, lambda c: values.fixed(c, digits), given, "double") == [exact(x, digits) for x in given]


def test_halves_of_prices_go_up_or_to_the_even_digit(spark):
    given = [None, 0.125, 0.145, 1.375, 1125.0, 1375.0, 256125.0, 256124.99]
    up = [None, "$0.13", "$0.14", "$1.38", "$1.13K", "$1.38K", "$256.13K", "$256.12K"]
    even = [None, "$0.12", "$0.14", "$1.38", "$1.12K", "$1.38K", "$256.12K", "$256.12K"]
    assert apply(spark, lambda c: values.currency(c, kilo=True), given, "double") == up
    assert apply(spark, lambda c: values.currency(c, kilo=True, even=True), given, "double") == even


def test_names_in_tables(spark):
    given = ["claude-sonnet-4-20250514", "claude-opus-4-5-20251101", "claude-opus-4-5-high", "gpt-4o", "x/claude-haiku-4-5-20251001-v1"]
    assert apply(spark, names.table_label, given) == ["sonnet-4", "opus-4-5", "opus-4-5-high", "gpt-4o", "haiku-4-5"]
    assert apply(spark, names.table_labels, [["o3", "claude-sonnet-4-20250514", "o3"], []], "array<string>") == ["- o3\n- sonnet-4", ""]


def test_numbers_and_days_as_texts(spark):
    assert apply(spark, values.thousands, [0, 999, 1234567], "bigint") == ["0", "999", "1,234,567"]
    assert apply(spark, values.currency, [0.0, 1.005, 411.645, 999.999, 2.5], "double") == ["$0.00", "$1.00", "$411.64", "$1000.00", "$2.50"]
    assert apply(spark, lambda c: values.currency(c, kilo=True), [999.0, 1000.0, 12345.678], "double") == ["$999.00", "$1.00K", "$12.35K"]
    day = lambda f: apply(spark, lambda c: f(c.cast("date")), ["2024-01-05"])
    assert day(values.day_label) == ["Jan 5, 2024"] and day(lambda c: values.day_label(c, full=True)) == ["January 5, 2024"] and day(values.weekday_label) == ["Friday"]
    assert day(lambda c: values.days_between(c, F.lit("2023-12-31").cast("date"))) == [5]
