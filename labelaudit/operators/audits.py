"""The text audit: normalise, extract, run the rules, score; and the audits table it makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelaudit.functions import extract as E
from labelaudit.functions import text as X
from labelaudit.operators import rules as R
from labelaudit.operators import scoring as S

FIELDS = ("fssai", "mrp", "expiry_date", "manufacturing_date", "net_weight", "batch", "country")


def rule_fields(text: Column, lenient: bool = False) -> dict[str, Column]:
    """The seven fields the rules read; nothing else is extracted for them."""
    dates = E.dates(text, lenient)
    return {
        "fssai": E.fssai_value(text),
        "mrp": E.price_value(text),
        "expiry_date": dates["expiry_date"]["parsed"],
        "manufacturing_date": dates["manufacturing_date"]["parsed"],
        "net_weight": E.weight_value(text),
        "batch": E.batch(text),
        "country": E.country(text),
    }


def with_fields(listings: DataFrame, compose: bool = False, lenient: bool = False) -> DataFrame:
    """The listings with the rule fields; `compose` for text that is not plain ASCII."""
    text = listings.withColumn("norm", X.normalise(F.col("label_text"), compose))
    return extracted(text, **rule_fields(F.col("norm"), lenient)).drop("norm")


def extracted(frame: DataFrame, **columns: Column) -> DataFrame:
    """Add columns of many patterns, of which those that nobody asks for are left out. The optimiser merges no projection
    whose dear columns are used more than once. Fused with others, so many patterns make one method that is too long for
    Java to compile; beside a higher-order function, which is never fused, each makes methods of its own."""
    (name, first), *others = columns.items()
    apart = F.coalesce(first, X.let(F.col(frame.columns[0]), lambda _: F.lit(None)))
    return frame.select("*", apart.alias(name), *[c.alias(n) for n, c in others])


def once(frame: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once however often they are used: the optimiser merges no
    projections across a generator, here of one row."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return frame.select("*", F.inline(F.array(made)))


def audit(fields: DataFrame, as_of: str, rules: tuple[R.Rule, ...] = R.DEFAULT_RULES) -> DataFrame:
    """One audit per listing: counts, score to one decimal, risk from the full score, violations, advice."""
    now = F.lit(as_of).cast("timestamp_ntz")
    results = R.execute_all(rules, F.col("category"), now)
    run = once(fields, results=results)
    r = F.col("results")
    count = lambda s: F.size(F.filter(r, lambda x: x["status"] == s))
    score = S.rule_score(r, [F.col(f) for f in FIELDS])
    found = S.violations(r)
    return run.select(
        "audit_id",
        "seller_id",
        "product_name",
        "category",
        F.size(r).alias("total_rules"),
        count("passed").alias("passed"),
        count("failed").alias("failed"),
        count("warning").alias("warnings"),
        F.round(score, 1).alias("compliance_score"),
        S.service_risk(score, S.critical_count(r)).alias("risk_level"),
        "created_at",
        found.alias("violations"),
        S.recommendations(found, {f: F.col(f) for f in FIELDS}).alias("recommendations"),
    )
