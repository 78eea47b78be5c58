"""Explanations of violations: the fixed ones, and what is read from a model's answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("explanation", "suggested_correction", "risk_summary")
# The texts without violations, without a model, and where an answer leaves a part out.
NO_VIOLATIONS = ("No legal metrology violations detected.", "No correction required.", "Low risk. Product is compliant.")
NO_MODEL = (
    "LLM explanation is disabled because GROQ_API_KEY is not configured.",
    "Set GROQ_API_KEY to enable AI-generated corrections; meanwhile, fix missing mandatory declarations.",
    "Potential compliance risk exists due to reported rule violations.",
)
FALLBACK = (
    "Compliance issues detected. Please review mandatory declarations.",
    "Review output and update missing/invalid fields.",
    "Moderate to high risk based on listed violations.",
)


def explained(violations: Column) -> Column:
    """The three parts for an array of violations where no model is asked."""
    none = F.coalesce(F.size(violations), F.lit(0)) <= 0
    return F.struct(*[F.when(none, a).otherwise(b).alias(n) for n, a, b in zip(PARTS, NO_VIOLATIONS, NO_MODEL, strict=True)])


def answer_json(text: Column) -> Column:
    """The JSON object in an answer as a variant: the text without code fences, else from its first { to its last }."""
    plain = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    for fence in (r"(?i)\A```json\s*", r"\A```\s*", r"\s*```\z"):
        plain = F.regexp_replace(plain, fence, "")
    inner = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(plain), F.try_parse_json(inner))


def section(value: Column, fallback: str) -> Column:
    """A part of an answer as text: lists a line each, objects as `key: value` lines, blanks replaced."""
    text = F.when(F.schema_of_variant(value) == "STRING", F.trim(F.try_variant_get(value, "$", "string")))
    items = F.filter(F.transform(F.try_variant_get(value, "$", "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,string>")), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))))
    kind = F.schema_of_variant(value)
    shown = (
        F.when(F.startswith(kind, F.lit("ARRAY")), F.array_join(items, "\n"))
        .when(F.startswith(kind, F.lit("OBJECT")), F.array_join(pairs, "\n"))
        .when(kind == "STRING", text)
        .otherwise(F.try_variant_get(value, "$", "string"))
    )
    return F.when(F.coalesce(shown, F.lit("")) != "", shown).otherwise(F.lit(fallback))


def answered(text: Column) -> Column:
    """The three parts of a model's answer; an answer without JSON is the explanation as it is."""
    found = answer_json(text)
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "```json|```", ""))
    plain = F.when(F.coalesce(text, F.lit("")) == "", "No model explanation returned.").otherwise(plain)
    free = (plain, F.lit(FALLBACK[1]), F.lit(FALLBACK[2]))
    part = lambda n, f: section(F.try_variant_get(found, f"$.{n}", "variant"), f)
    return F.struct(*[F.when(found.isNotNull(), part(n, f)).otherwise(x).alias(n) for n, f, x in zip(PARTS, FALLBACK, free, strict=True)])
