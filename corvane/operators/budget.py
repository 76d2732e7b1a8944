"""Task intent, adaptive budgets and presets, as columns over a table of tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of each intent, in order of precedence.
INTENTS = {
    "bug_fix": ["fix", "bug", "error", "crash", "fail", "failing", "regression", "incident", "broken"],
    "feature_add": ["add", "implement", "support", "introduce", "extend", "new", "feature"],
    "refactor": ["refactor", "cleanup", "simplify", "rename", "restructure", "optimize"],
    "documentation": ["doc", "docs", "readme", "comment", "explain", "guide"],
    "test_focus": ["test", "tests", "coverage", "assert", "pytest"],
}
# Factors of each intent for max_chars, top_n_files, snippet_radius, max_snippets.
FACTORS = {
    "bug_fix": [0.88, 0.9, 0.88, 0.92],
    "feature_add": [1.1, 1.12, 1.0, 1.05],
    "refactor": [1.24, 1.2, 1.22, 1.18],
    "documentation": [0.72, 0.76, 0.72, 0.8],
    "test_focus": [0.92, 0.95, 0.9, 1.0],
    "general": [1.0, 1.0, 1.0, 1.0],
}
# The base budget.
BASE = {"max_chars": 24000, "top_n_files": 12, "snippet_radius": 40, "max_snippets": 60}
# Named budgets (max_chars, top_n_files, snippet_radius, max_snippets) and other names for them.
PRESETS = {"tiny": [6000, 6, 20, 16], "small": [12000, 8, 24, 30], "medium": [24000, 12, 30, 60], "large": [36000, 16, 40, 90], "xlarge": [50000, 20, 50, 120]}
PRESET_NAMES = {"s": "small", "sm": "small", "m": "medium", "med": "medium", "balanced": "medium", "l": "large", "lg": "large", "xl": "xlarge", "default": "small"}
# Marks of quick and of complex tasks.
QUICK = ["explain", "summary", "summarize", "quick", "small", "typo", "doc", "readme"]
COMPLEX = ["architecture", "migration", "investigate", "root cause", "refactor", "performance", "security", "concurrency", "state machine", "deep"]


def votes(text: Column, keywords: list[str]) -> Column:
    low = F.lower(text)
    return sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def intent(text: Column) -> Column:
    """The intent with most keywords in the text; the first of equals; general without any."""
    scores = F.array(*[F.struct(votes(text, ks).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, ks) in enumerate(INTENTS.items())])
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["k"]).otherwise("general")


def complexity(n_tokens: Column, n_changed: Column, spread: Column) -> Column:
    return F.least(F.lit(1.0), 0.45 * F.least(F.lit(1.0), n_tokens / 24) + 0.4 * F.least(F.lit(1.0), n_changed / 12) + 0.15 * F.least(F.lit(1.0), spread))


def budget(name: Column, cx: Column, low: float = 0.65, high: float = 1.45) -> dict[str, Column]:
    """Effective budget by intent name and complexity."""
    out = {}
    for i, (key, base) in enumerate(BASE.items()):
        factor = F.create_map(*[F.lit(x) for k, v in FACTORS.items() for x in (k, v[i])])[name]
        scaled = F.least(F.greatest(factor * (0.75 + 0.55 * cx), F.lit(low)), F.lit(high))
        out[key] = F.greatest(F.lit(1), F.bround(base * scaled).cast("long"))
    return out


def auto_preset(text: Column, n_tokens: Column, n_changed: Column, n_hints: Column) -> Column:
    low = F.lower(F.trim(text))
    any_of = lambda marks: votes(low, marks) > 0
    score = F.least(F.lit(6), F.floor(n_tokens / 4)) + F.least(F.lit(5), F.floor(n_changed / 2)) + (n_hints >= 3).cast("int") + 2 * any_of(COMPLEX).cast("int") - any_of(QUICK).cast("int")
    size = F.char_length(F.trim(text))
    return F.when((n_changed <= 1) & (n_tokens <= 8) & (size <= 120) & (score <= 2), "tiny").when((n_changed >= 8) | (n_tokens >= 20) | (size >= 260) | (score >= 8), "medium").otherwise("small")


def override(said: Column) -> Column:
    """A budget that a text asks for, null where it doesn't say: a preset or another name of one, a JSON object, or ``key=value`` pairs.

    A structure of the keys of ``BASE``. Null and blank ask for nothing; what is none of these fails the query.
    """
    token = F.lower(F.trim(said))
    names = F.create_map(*[F.lit(x) for kv in PRESET_NAMES.items() for x in kv])
    name = F.coalesce(names[token], token)
    json = F.try_parse_json(token)
    pairs = F.filter(F.transform(F.split(F.replace(token, F.lit(";"), F.lit(",")), ","), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("=")))
    value = lambda key: F.trim(F.get(F.split(F.element_at(F.filter(pairs, lambda x: F.trim(F.substring_index(x, "=", 1)) == key), -1), "="), F.lit(1))).cast("int")
    empty = F.coalesce(token, F.lit("")) == ""
    is_json, is_pairs = F.startswith(token, F.lit("{")) & F.endswith(token, F.lit("}")) & json.isNotNull(), F.contains(token, F.lit("=")) & (F.size(F.filter(pairs, lambda x: x != "")) > 0)
    known = empty | name.isin(list(PRESETS)) | is_json | is_pairs
    fields = []
    for i, key in enumerate(BASE):
        preset = F.create_map(*[F.lit(x) for k, v in PRESETS.items() for x in (k, v[i])])[name]
        read = F.when(name.isin(list(PRESETS)), preset).when(is_json, F.try_variant_get(json, f"$.{key}", "int")).when(is_pairs, F.when(F.exists(pairs, lambda x: F.trim(F.substring_index(x, "=", 1)) == key), value(key)))
        fields.append(F.when(known, read).otherwise(F.raise_error(F.concat(F.lit("unsupported budget preset: "), said)).cast("int")).alias(key))
    return F.struct(*fields)


def with_override(effective: dict[str, Column], asked: Column) -> dict[str, Column]:
    """An effective budget in which what was asked for wins, at least 1 each."""
    return {k: F.when(asked[k].isNotNull(), F.greatest(F.lit(1), asked[k]).cast("long")).otherwise(v) for k, v in effective.items()}
