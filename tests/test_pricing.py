"""The resolver against a plain restatement of its tiers, over names chosen to collide."""

import itertools
import unicodedata

from meterglass.operators.pricing import HELD, HOLDS, PREFIXES, resolve_models


def short(model):
    """The cases that the names below touch."""
    m = model.lower()
    for family in ("opus", "sonnet"):
        if family in m:
            if "4.5" in m or "4-5" in m:
                return f"{family}-4-5"
            if "4" in m:
                return f"{family}-4"
            if family == "sonnet":
                for v in ("3.7", "3.5"):
                    if v in m or v.replace(".", "-") in m:
                        return f"sonnet-{v.replace('.', '-')}"
    if m == "o3" or m.startswith("gpt-4o"):
        return m[:6]
    return None


def inside(hay, needle):
    at = hay.find(needle)
    if at < 0:
        return False
    edge = hay[max(0, at - 1) : at] + hay[at + len(needle) : at + len(needle) + 1]
    return not any(unicodedata.category(c)[0] in "LN" for c in edge)


def expected(model, keys):
    forms = [f for f in (model, short(model)) if f is not None]
    for form in forms:
        for prefix in PREFIXES:
            if prefix + form in keys:
                return 5 * forms.index(form) + PREFIXES.index(prefix), prefix + form
    for tier in (HOLDS, HELD):
        for key in sorted(keys, key=str.encode):
            for form in forms:
                a, b = (key.lower(), form.lower()) if tier == HOLDS else (form.lower(), key.lower())
                if inside(a, b):
                    return tier, key
    return None


def test_resolver_against_restatement(spark):
    keys = ["gpt-4o", "openai/gpt-4o", "o3", "azure/o3-mini", "claude-sonnet-4", "anthropic/claude-sonnet-4-5", "Sonnet-3-7", "google/gemini-2.5-pro", "glm", "a_b", "é-model"]
    models = ["gpt-4o", "GPT-4o-mini", "o3", "foo3", "claude-4-sonnet", "Sonnet 4.5", "claude-3.7-sonnet", "gemini-2.5-pro", "my-glm-x", "glmx", "a_b", "b", "é", "-", "mini", "opus", "o3-mini-high"]
    models = models + [f"{a}/{b}" for a, b in itertools.product(("azure", "x"), ("o3", "glm"))]
    got = resolve_models(
        spark.createDataFrame([(m,) for m in models + models[:3]] + [(None,)], "model_id string"),
        spark.createDataFrame([(k,) for k in keys], "model_key string"),
    )
    found = {r["model_id"]: (r["tier"], r["model_key"]) for r in got.collect()}
    assert found == {m: e for m in models if (e := expected(m, keys))}
