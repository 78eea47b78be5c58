"""Scores, risk levels, violations and recommendations. Three risk scales exist and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(x: Column) -> Column:
    """Null or empty text."""
    return x.isNull() | (x.cast("string") == "")


# --- service scale ---------------------------------------------------------------------------------


def rule_score(results: Column, fields: list[Column]) -> Column:
    """Share of rules passed in percent; without rules, the share of fields that are there."""
    passed = F.size(F.filter(results, lambda r: r["passed"]))
    there = sum((~missing(f)).cast("int") for f in fields)
    return F.when(F.size(results) > 0, passed / F.size(results) * 100).otherwise(there / F.lit(float(len(fields))) * 100)


def service_risk(score: Column, critical: Column) -> Column:
    return (
        F.when(critical > 0, "critical").when(score >= 90, "compliant").when(score >= 70, "low").when(score >= 50, "medium").when(score >= 30, "high").otherwise("critical")
    )


def failed(results: Column) -> Column:
    return F.filter(results, lambda r: r["status"] == "failed")


def critical_count(results: Column) -> Column:
    return F.size(F.filter(failed(results), lambda r: r["severity"] == "critical"))


def violations(results: Column) -> Column:
    """One entry per message of each failed rule; a warning lowers the score but is no violation."""
    each = F.transform(
        failed(results),
        lambda r: F.transform(r["messages"], lambda m: F.struct(r["rule_id"].alias("rule_id"), r["rule_name"].alias("rule_name"), r["severity"].alias("severity"), m.alias("message"))),
    )
    return F.flatten(each)


# What to advise when a field is missing, in order.
ADVICE = (
    ("fssai", "CRITICAL: Add FSSAI license number (14 digits) prominently on product packaging"),
    ("mrp", "CRITICAL: Display Maximum Retail Price (MRP) with 'Rs.' or '₹' symbol"),
    ("expiry_date", "HIGH: Add expiry date or 'Best Before' date in DD/MM/YYYY format"),
    ("manufacturing_date", "MEDIUM: Include manufacturing date (Mfg Date or MFD)"),
    ("net_weight", "HIGH: Display net weight/quantity with appropriate unit (g, kg, ml, L)"),
    ("country", "MEDIUM: Add 'Country of Origin' or 'Made in' information"),
)


def recommendations(found: Column, fields: dict[str, Column]) -> Column:
    """Advice for missing fields, then a fix for each of the first three violations."""
    advice = F.array_compact(F.array(*[F.when(missing(fields[f]), F.lit(text)) for f, text in ADVICE]))
    return F.concat(advice, F.transform(F.slice(found, 1, 3), lambda v: F.concat(F.lit("FIX: "), v["message"])))


# --- legacy scale ------------------------------------------------------------------------------------


def legacy_risk(score: Column) -> Column:
    return F.when(score >= 85, "Compliant").when(score >= 60, "Moderate Risk").otherwise("High Risk")


def penalty_score(penalties: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - F.aggregate(penalties, F.lit(0), lambda a, x: a + x))


# The four rules of the simple dialect: code, field, penalty, message.
SIMPLE_RULES = (
    ("LM-PC-001", "mrp", 20, "MRP declaration is mandatory on pre-packaged commodities."),
    ("LM-PC-002", "quantity", 20, "Net quantity declaration is required."),
    ("LM-PC-003", "manufacturer", 20, "Manufacturer/packer/importer details are required."),
    ("LM-PC-004", "country_of_origin", 10, "Country of origin must be clearly declared for imported goods."),
)


def simple_violations(fields: dict[str, Column]) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.when(missing(fields[f]), F.struct(F.lit(code).alias("code"), F.lit(f).alias("field"), F.lit(message).alias("message"), F.lit(p).alias("penalty")))
                for code, f, p, message in SIMPLE_RULES
            ]
        )
    )


# --- deductions -----------------------------------------------------------------------------------------

# Points off per violation category, and the cap once there is one of category A.
POINTS = {"A": 25, "B": 20, "C": 10, "D": 5}
CAP_WITH_A = 60
# Least score, level, penalty risk, action.
LEVELS = (
    (90, "Fully Compliant", "None", "No action required"),
    (70, "Minor Risk", "Low", "Address minor issues within 30 days"),
    (50, "Moderate Legal Risk", "Moderate - Possible fine Rs. 2000-5000", "Mandatory correction required within 15 days"),
    (0, "High Penalty Risk", "High - Possible fine Rs. 5000+ or imprisonment", "Immediate removal from sale, product detention required"),
)
# Checks on product flags: code, category is the letter in it, field, whether the flag being set or missing is the fault.
FLAG_CHECKS = (
    ("LM-SCORE-A002", "price_exceeds_mrp", True),
    ("LM-SCORE-A001", "misleading_quantity_words", True),
    ("LM-SCORE-B001", "mrp_inclusive_of_taxes", False),
    ("LM-SCORE-B002", "net_quantity", False),
    ("LM-SCORE-B003", "manufacturer_name", False),
    ("LM-SCORE-B004", "date_of_manufacture", False),
    ("LM-SCORE-B005", "consumer_care", False),
    ("LM-SCORE-B006", "country_of_origin", False),
    ("LM-SCORE-C001", "valid_si_units", False),
    ("LM-SCORE-C002", "incorrect_font_size", True),
    ("LM-SCORE-C003", "declaration_on_pdp", False),
    ("LM-SCORE-C004", "improper_mrp_format", True),
    ("LM-SCORE-D001", "spacing_alignment_issues", True),
    ("LM-SCORE-D002", "formatting_inconsistencies", True),
)


def letter(category: Column) -> Column:
    """A to D; anything else counts as D."""
    up = F.upper(F.coalesce(category, F.lit("D")))
    return F.when(up.isin(*POINTS), up).otherwise("D")


def deduction_score(categories: Column) -> Column:
    """Score for an array of violation categories."""
    points = F.create_map(*[F.lit(v) for kv in POINTS.items() for v in kv])
    total = F.aggregate(F.transform(categories, lambda c: points[letter(c)]), F.lit(0), lambda a, x: a + x)
    score = F.greatest(F.lit(0), F.lit(100) - total)
    return F.when(F.exists(categories, lambda c: letter(c) == "A"), F.least(score, F.lit(CAP_WITH_A))).otherwise(score)


def deduction_level(score: Column, what: int = 1) -> Column:
    """1 the level, 2 the penalty risk, 3 the action."""
    out = F.when(score >= LEVELS[0][0], LEVELS[0][what])
    for row in LEVELS[1:-1]:
        out = out.when(score >= row[0], row[what])
    return out.otherwise(LEVELS[-1][what])


def set_(x: Column) -> Column:
    """Whether a flag or text counts as true."""
    return x.isNotNull() & ~x.cast("string").isin("", "false", "0", "0.0")


def flag_violations(flags: dict[str, Column]) -> Column:
    """Codes of the checks a product fails, category A first."""
    tests = []
    for code, name, fault in FLAG_CHECKS:
        bad = set_(flags[name]) if fault else ~set_(flags[name])
        if code == "LM-SCORE-B006":
            bad = bad & set_(flags["is_imported"])
        tests.append(F.when(bad, F.lit(code)))
    return F.array_compact(F.array(*tests))


def code_categories(codes: Column) -> Column:
    return F.transform(codes, lambda c: F.substring(c, 10, 1))


# --- OCR --------------------------------------------------------------------------------------------------


def ocr_level(mean: Column) -> Column:
    return F.when(mean >= 0.85, "HIGH_CONFIDENCE").when(mean >= 0.70, "MEDIUM_CONFIDENCE").when(mean >= 0.50, "LOW_CONFIDENCE").otherwise("VERY_LOW_CONFIDENCE")
