"""Names as columns: providers, models, agents, display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Per rule set, what a lower-cased model name contains for each provider, and the default.
PROVIDERS = {
    "amp": (
        {"anthropic": "claude|opus|sonnet|haiku", "openai": "gpt|o1|o3", "google": "gemini", "xai": "grok"},
        "anthropic",
    ),
    "cursor": (
        {
            "anthropic": "claude|sonnet|opus|haiku",
            "openai": "gpt|o1|o3",
            "google": "gemini",
            "deepseek": "deepseek",
            "meta": "llama|mixtral",
        },
        "cursor",
    ),
    "droid": (
        {
            "anthropic": "claude|anthropic|opus|sonnet|haiku",
            "openai": "gpt|openai|o1|o3",
            "google": "gemini|google",
            "xai": "grok",
        },
        "unknown",
    ),
    "review": (
        {
            "anthropic": "claude|opus|sonnet|haiku",
            "openai": "gpt|o1|o3|codex",
            "google": "gemini",
            "xai": "grok",
            "zai": "glm|pickle",
        },
        None,
    ),
    "display": (
        {
            "anthropic": "claude|sonnet|opus|haiku",
            "openai": "gpt|^o1|^o3|codex|text-embedding|dall-e|whisper|tts",
            "google": "gemini",
            "deepseek": "deepseek",
            "xai": "grok",
            "meta": "llama|mixtral",
            "cursor": "^auto$|cursor",
        },
        "unknown",
    ),
}
#: The models that a short name stands for, in the order in which they are tried.
SHORT_NAMES = (
    (r"opus.*", r"4\.5|4-5", "opus-4-5"),
    (r"opus.*", r"4", "opus-4"),
    (r"sonnet.*", r"4\.5|4-5", "sonnet-4-5"),
    (r"sonnet.*", r"4", "sonnet-4"),
    (r"sonnet.*", r"3\.7|3-7", "sonnet-3-7"),
    (r"sonnet.*", r"3\.5|3-5", "sonnet-3-5"),
    (r"haiku.*", r"4\.5|4-5", "haiku-4-5"),
    (r"^o3$", r"", "o3"),
    (r"^gpt-4o", r"", "gpt-4o"),
    (r"gpt-4\.1", r"", "gpt-4.1"),
    (r"gemini-2\.5-pro", r"", "gemini-2.5-pro"),
    (r"gemini-2\.5-flash", r"", "gemini-2.5-flash"),
)
#: The model that stands for a provider where a record names none.
DEFAULT_MODELS = {"anthropic": "claude", "openai": "gpt", "google": "gemini", "xai": "grok"}
SOURCE_LABELS = {"opencode": "OpenCode", "claude": "Claude Code", "codex": "Codex CLI", "gemini": "Gemini CLI", "cursor": "Cursor IDE", "amp": "Amp", "droid": "Droid"}
PINNED_AGENTS = ("Sisyphus", "Planner-Sisyphus")
#: Display names of models that are known by their whole name.
DISPLAY_NAMES = {
    "claude-sonnet-4-20250514": "Claude Sonnet 4",
    "claude-3-5-sonnet-20241022": "Claude 3.5 Sonnet",
    "claude-3-5-sonnet-20240620": "Claude 3.5 Sonnet",
    "claude-3-opus-20240229": "Claude 3 Opus",
    "claude-3-haiku-20240307": "Claude 3 Haiku",
    "gpt-4o": "GPT-4o",
    "gpt-4o-mini": "GPT-4o Mini",
    "gpt-4-turbo": "GPT-4 Turbo",
    "o1": "o1",
    "o1-mini": "o1 Mini",
    "o1-preview": "o1 Preview",
    "o3-mini": "o3 Mini",
    "gemini-2.5-pro": "Gemini 2.5 Pro",
    "gemini-2.5-flash": "Gemini 2.5 Flash",
    "gemini-2.0-flash": "Gemini 2.0 Flash",
    "gemini-1.5-pro": "Gemini 1.5 Pro",
    "gemini-1.5-flash": "Gemini 1.5 Flash",
    "grok-3": "Grok 3",
    "grok-3-mini": "Grok 3 Mini",
}
#: Fixed values, the first that a name holds counts: forms of a name and what they are shown as. Where a form has
#: a space a name may have a dash or an underscore, where it has a point also a point; "^" and "$" are a name's ends.
FAMILIES = {
    "claude opus 4.5": "Claude Opus 4.5",
    "claude 4 opus": "Claude 4 Opus",
    "claude opus 4": "Claude Opus 4",
    "claude sonnet 4.5": "Claude Sonnet 4.5",
    "claude 4 sonnet": "Claude 4 Sonnet",
    "claude sonnet 4": "Claude Sonnet 4",
    "claude haiku 4.5": "Claude Haiku 4.5",
    "claude 4 haiku": "Claude 4 Haiku",
    "claude haiku 4": "Claude Haiku 4",
    "claude 3.7 sonnet": "Claude 3.7 Sonnet",
    "claude 3.5 sonnet": "Claude 3.5 Sonnet",
    "claude 3.5 haiku": "Claude 3.5 Haiku",
    "claude 3 opus": "Claude 3 Opus",
    "claude 3 sonnet": "Claude 3 Sonnet",
    "claude 3 haiku": "Claude 3 Haiku",
    "gpt 5.1": "GPT-5.1",
    "gpt 5": "GPT-5",
    "gpt 4 o mini": "GPT-4o Mini",
    "gpt 4 o": "GPT-4o",
    "gpt 4 turbo": "GPT-4 Turbo",
    "gpt 4": "GPT-4",
    "^o1 mini": "o1 Mini",
    "^o1 preview": "o1 Preview",
    "^o3 mini": "o3 Mini",
    "^o1$": "o1",
    "^o3$": "o3",
    "gemini 3 pro": "Gemini 3 Pro",
    "gemini 3 flash": "Gemini 3 Flash",
    "gemini 2.5 pro": "Gemini 2.5 Pro",
    "gemini 2.5 flash": "Gemini 2.5 Flash",
    "gemini 2.0 flash": "Gemini 2.0 Flash",
    "gemini 1.5 pro": "Gemini 1.5 Pro",
    "gemini 1.5 flash": "Gemini 1.5 Flash",
    "grok 3 mini": "Grok Code 3 Mini",
    "grok 3": "Grok Code 3",
    "grok": "Grok Code",
    "deepseek v3": "DeepSeek V3",
    "deepseek r1": "DeepSeek R1",
    "deepseek": "DeepSeek",
}
#: What may follow a model's own name, from left to right: how it thinks, with what effort, a tag, dates.
TAIL = r"(?i)([-_]thinking)?([-_](high|medium|low))?(:[-\w]+)?(-\d{8})?(-20\d{6,8}(-\d+)?)?$"
EFFORT = r"(?i)[-_](high|medium|low)$"
#: Vendors whose name takes the next part of a model's name with it, which stays in lower case.
GLUED = r"(?i)^(claude|gemini)[-_]"


def form_pattern(form: str) -> str:
    """The regular expression of a form of FAMILIES."""
    return "(?i)" + form.replace(".", "[-_.]?").replace(" ", "[-_]?")


def first_of(rules: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    value = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for condition, result in reversed(rules):
        value = F.when(condition, result).otherwise(value)
    return value


def provider_of(model: Column, rules: str) -> Column:
    """The provider of a model name by one of the PROVIDERS rule sets; a null name has the default."""
    table, default = PROVIDERS[rules]
    lower = F.lower(F.coalesce(model, F.lit("")))
    return first_of([(lower.rlike(pattern), provider) for provider, pattern in table.items()], default)


def short_name(model: Column) -> Column:
    """The standard name behind a tool's own model name, or null. A 4 anywhere counts as version 4."""
    lower = F.lower(model)
    tests = []
    for family, version, name in SHORT_NAMES:
        holds = lower.rlike(family.removesuffix(".*"))
        tests.append((holds & lower.rlike(version) if version else holds, name))
    return first_of(tests)


def custom_model(model: Column) -> Column:
    """``custom:Claude-Opus-4.5-[Anthropic]-0`` as ``claude-opus-4-5-0``."""
    bare = F.regexp_replace(F.regexp_replace(model, "^custom:", ""), r"\[[^\]]*\]?", "")
    lower = F.lower(F.regexp_replace(bare, "-+$", ""))
    return F.regexp_replace(F.replace(lower, F.lit("."), F.lit("-")), "-+", "-")


def default_model(provider: Column) -> Column:
    known = first_of([(F.lower(provider) == p, m) for p, m in DEFAULT_MODELS.items()], provider)
    return F.concat(known, F.lit("-unknown"))


def agent_name(agent: Column) -> Column:
    """One name for the spellings of an agent; names that hold ``plan`` are only the planner's."""
    lower = F.lower(agent)
    return first_of(
        [
            (lower.contains("plan") & lower.rlike("omo|sisyphus"), "Planner-Sisyphus"),
            (lower.contains("plan"), agent),
            (lower.isin("omo", "sisyphus"), "Sisyphus"),
        ],
        agent,
    )


def source_label(source: Column) -> Column:
    other = F.concat(F.upper(F.substring(source, 1, 1)), F.substring(source, F.lit(2), F.length(source)))
    return first_of([(source == k, v) for k, v in SOURCE_LABELS.items()], other)


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def model_label(model: Column) -> Column:
    """A display name: a known name's, else that of the first form it holds, else its parts, each with a capital.

    The tail does not count, but an effort at the very end is shown.
    """
    bare = F.regexp_replace(model, TAIL, "")
    effort = F.regexp_extract(model, EFFORT, 1)
    shown = F.when(effort == "", "").otherwise(F.concat(F.lit(" "), _capital(effort)))
    vendor = F.regexp_extract(bare, GLUED, 1)
    rest = F.when(vendor == "", bare).otherwise(F.substring(bare, F.length(vendor) + 2, F.length(bare)))
    first = F.when(vendor == "", F.lit("")).otherwise(F.regexp_extract(rest, "^[^-_]*", 0))
    glued = F.when(vendor != "", F.concat(_capital(vendor), F.lit(" "), F.lower(first)))
    others = F.filter(F.split(F.substring(rest, F.length(first) + 1, F.length(rest)), "[-_]"), lambda w: w != "")
    parts = F.array_compact(F.concat(F.array(glued), F.transform(others, _capital)))
    families = [(bare.rlike(form_pattern(form)), F.lit(label)) for form, label in FAMILIES.items()]
    known = [(model == name, F.lit(label)) for name, label in DISPLAY_NAMES.items()]
    return first_of(known, F.concat(first_of(families, F.trim(F.array_join(parts, " "))), shown))


def table_label(model: Column) -> Column:
    """A claude model's name in tables, ``sonnet-4`` of ``claude-sonnet-4-20250514``; other names as they are."""
    dated = F.regexp_extract(model, r"claude-([A-Za-z0-9_]+)-([0-9-]+)-[0-9]{8}", 0)
    bare = F.when(dated != "", F.regexp_replace(dated, "^claude-|-[0-9]{8}$", ""))
    other = F.regexp_extract(model, r"claude-([A-Za-z0-9_]+-.+)", 1)
    return F.coalesce(bare, F.nullif(other, F.lit("")), model)


def table_labels(models: Column) -> Column:
    """A list of models as lines, each name once and in order."""
    labels = F.array_sort(F.array_distinct(F.transform(models, table_label)))
    return F.array_join(F.transform(labels, lambda m: F.concat(F.lit("- "), m)), "\n")
