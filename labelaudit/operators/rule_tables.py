"""Rules as data: a table of rules judges rows whose fields are named by paths in that table.

A row travels as one VARIANT. Each condition has its path, its operator and its value as JSON, and a rule's
conditions are tested one by one in place, so that judging is one join of rows with the rules of their
category and moves no row twice. What a path finds keeps its type: numbers equal numbers, texts equal texts.

A condition passes as the compiled form in `rules` does; what raises an error there (a text that is no number, a
pattern that is no regular expression, an unknown operator) does not pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelaudit.operators import rules as R
from labelaudit.operators.joins import keyed_join

#: A rule as a file or table holds it; values are JSON.
SCHEMA = (
    "id string, name string, category string, severity string, status string, applicable_to array<string>, "
    "conditions array<struct<field: string, operator: string, value: string, value_field: string>>, messages array<string>"
)
_NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "BOOLEAN")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from files of JSON lines. A condition's value may be any JSON; it is kept as text."""
    conditions = "array<struct<field: string, operator: string, value: variant, value_field: string>>"
    schema = SCHEMA.replace("array<struct<field: string, operator: string, value: string, value_field: string>>", conditions)
    raw = spark.read.schema(schema).json(path)
    as_text = F.transform(
        "conditions",
        lambda c: F.struct(c["field"].alias("field"), c["operator"].alias("operator"), F.to_json(c["value"]).alias("value"), c["value_field"].alias("value_field")),
    )
    return raw.withColumn("conditions", as_text)


def variant_path(dotted: Column) -> Column:
    """`a.b.0` as the path $["a"]["b"][0]; null and empty names have no path, nor have those with a double quote."""
    steps = F.transform(F.split(dotted, r"\."), lambda k: F.when(k.rlike(r"\A\d{1,9}\z"), F.concat(F.lit("["), k, F.lit("]"))).otherwise(F.concat(F.lit('["'), k, F.lit('"]'))))
    return F.when((dotted != "") & ~F.contains(dotted, F.lit('"')), F.concat(F.lit("$"), F.array_join(steps, "")))


def at(doc: Column, path: Column) -> Column:
    """What a document has at a path, as VARIANT; null where it has nothing."""
    return F.try_variant_get(doc, path, "variant")


def kind(v: Column) -> Column:
    """null, number (true and false are 1 and 0), text or other."""
    name = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (name == "VOID"), "null")
        .when(name.isin(*_NUMBERS) | F.startswith(name, F.lit("DECIMAL")), "number")
        .when(name == "STRING", "text")
        .otherwise("other")
    )


def typed(v: Column, k: Column) -> Column:
    """kind, text, number and items of a VARIANT of this kind: a number is also a text's if it is one, and what is no
    list has itself as its only item."""
    plain = F.try_variant_get(v, F.lit("$"), "string")
    number = F.when(k == "number", F.try_variant_get(v, F.lit("$"), "double")).when(k == "text", R._double(plain))
    items = F.when(k == "other", F.try_variant_get(v, F.lit("$"), "array<variant>"))
    return F.struct(
        k.alias("kind"),
        F.when(k == "other", F.to_json(v)).otherwise(plain).alias("text"),
        number.alias("number"),
        F.coalesce(items, F.array(v)).alias("items"),
    )


def value(v: Column) -> Column:
    return typed(v, kind(v))


def same(a: Column, b: Column) -> Column:
    """Equal in kind and value; null equals null."""
    equal = F.when(a["kind"] == "null", F.lit(True)).when(a["kind"] == "number", a["number"] == b["number"]).otherwise(a["text"] == b["text"])
    return (a["kind"] == b["kind"]) & F.coalesce(equal, F.lit(False))


def regular(pattern: Column) -> Column:
    """Whether a text is a regular expression for the engine that will run it."""
    return F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def _present(a: Column) -> Column:
    """Neither null, nor an empty text or list."""
    return (a["kind"] != "null") & ~((a["kind"] == "text") & (a["text"] == "")) & ~((a["kind"] == "other") & (a["text"] == "[]"))


def _among(a: Column, e: Column) -> Column:
    return F.exists(F.transform(e["items"], value), lambda x: same(a, x))


def _between(a: Column, e: Column) -> Column:
    item = lambda k: value(F.get(e["items"], F.lit(k)))["number"]
    return (F.size(e["items"]) == 2) & a["number"].between(item(0), item(1))


def _length(test: Callable[[Column, Column], Column]) -> Callable[[Column, Column, Column], Column]:
    return lambda a, e, now: test(F.length(a["text"]), F.floor(e["number"]))


def _contains(a: Column, e: Column) -> Column:
    return F.contains(F.lower(a["text"]), F.lower(e["text"]))


def _truth(e: Column) -> Column:
    return e["number"] != 0


def _days(a: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(R.moment(a["text"])) - F.unix_timestamp(now)) / 86400)


def _matches(a: Column, e: Column) -> Column:
    return F.when(regular(e["text"]), F.regexp_like(a["text"], F.concat(F.lit("(?i)"), e["text"])))


#: The predicates over two of `value`; null counts as not passed.
PREDICATES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "eq": lambda a, e, now: same(a, e),
    "ne": lambda a, e, now: ~same(a, e),
    "gt": lambda a, e, now: a["number"] > e["number"],
    "lt": lambda a, e, now: a["number"] < e["number"],
    "gte": lambda a, e, now: a["number"] >= e["number"],
    "lte": lambda a, e, now: a["number"] <= e["number"],
    "contains": lambda a, e, now: _contains(a, e),
    "not_contains": lambda a, e, now: F.when(a["kind"] == "null", F.lit(True)).otherwise(~_contains(a, e)),
    "regex": lambda a, e, now: _matches(a, e),
    "exists": lambda a, e, now: _present(a) == _truth(e),
    "in": lambda a, e, now: _among(a, e),
    "not_in": lambda a, e, now: ~_among(a, e),
    "between": lambda a, e, now: _between(a, e),
    "length_eq": _length(lambda n, e: n == e),
    "length_gt": _length(lambda n, e: n > e),
    "length_lt": _length(lambda n, e: n < e),
    "is_expired": lambda a, e, now: F.when(a["kind"] == "null", ~_truth(e)).otherwise((R.moment(a["text"]) < now) == _truth(e)),
    "days_until_expiry": lambda a, e, now: _days(a, now) <= e["number"],
}


def passes(operator: Column, a: Column, e: Column, now: Column) -> Column:
    """Whether a condition passes, by the operator that its row names; an unknown one does not."""
    out = F.lit(False)
    for name, test in PREDICATES.items():
        out = F.when(operator == name, F.coalesce(test(a, e, now), F.lit(False))).otherwise(out)
    return out


def compiled(rules: DataFrame) -> DataFrame:
    """A row for each category a rule is for, with the paths and values of its conditions made ready once."""
    conditions = F.transform(
        F.coalesce("conditions", F.array().cast("array<struct<field: string, operator: string, value: string, value_field: string>>")),
        lambda c: F.struct(
            c["field"].alias("field"),
            c["operator"].alias("operator"),
            variant_path(c["field"]).alias("path"),
            F.try_parse_json(c["value"]).alias("value"),
            variant_path(c["value_field"]).alias("value_path"),
        ),
    )
    none = F.array().cast("array<string>")
    made_for = F.array_distinct(F.array_compact(F.concat(F.array("category"), F.coalesce("applicable_to", none))))
    failed = F.when(F.col("severity").isin("critical", "high"), "failed").otherwise("warning")
    each = rules.where(F.col("status") == "active").select("*", F.explode(made_for).alias("__category"))
    return each.select(
        "__category",
        F.struct(
            F.col("id").alias("rule_id"),
            F.col("name").alias("rule_name"),
            "severity",
            F.col("category").alias("rule_category"),
            failed.alias("if_failed"),
            F.coalesce("messages", none).alias("messages"),
            conditions.alias("conditions"),
        ).alias("__rule"),
    )


def judge(rows: DataFrame, rules: DataFrame, key: str, now: Column, category: str = "category", doc: str | None = None) -> DataFrame:
    """key, rule_id, rule_name, status, passed, severity, category, messages, conditions: a row for each row and each
    active rule for its category. `doc` names a VARIANT column; without it a row's own columns are the document.

    A rule without conditions passes. A rule for several categories judges a row once. Null categories meet no
    rule; a category without rules gives no result.
    """
    whole = F.col(doc) if doc else F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    asked = rows.select(F.col(key).alias("__key"), F.col(category).alias("__category"), whole.alias("__doc"))
    met = keyed_join(asked, compiled(rules), "__category")

    # what is found, of what kind it is, its values, the test: one after the other, so that each is worked out once
    named = lambda c: [c[n].alias(n) for n in ("field", "operator")]

    def found(c: Column) -> Column:
        expected = F.when(c["value_path"].isNotNull(), at(F.col("__doc"), c["value_path"])).otherwise(c["value"])
        return F.struct(*named(c), at(F.col("__doc"), c["path"]).alias("actual"), expected.alias("expected"))

    def of_kind(c: Column) -> Column:
        sides = [c[n].alias(n) for n in ("actual", "expected")] + [kind(c[n]).alias(f"{n}_kind") for n in ("actual", "expected")]
        return F.struct(*named(c), *sides)

    def valued(c: Column) -> Column:
        return F.struct(*named(c), *[typed(c[n], c[f"{n}_kind"]).alias(n) for n in ("actual", "expected")])

    def tested(c: Column) -> Column:
        return F.struct(*named(c), passes(c["operator"], c["actual"], c["expected"], now).alias("passed"))

    steps = F.col("__rule.conditions")
    for step in (found, of_kind, valued, tested):
        steps = F.transform(steps, step)
    results = met.withColumn("__results", steps)
    passed = F.forall("__results", lambda r: r["passed"])
    return results.withColumn("__passed", passed).select(
        F.col("__key").alias(key),
        "__rule.rule_id",
        "__rule.rule_name",
        F.when(F.col("__passed"), "passed").otherwise(F.col("__rule.if_failed")).alias("status"),
        F.col("__passed").alias("passed"),
        "__rule.severity",
        F.col("__rule.rule_category").alias("category"),
        F.when(F.col("__passed"), F.array().cast("array<string>")).otherwise(F.col("__rule.messages")).alias("messages"),
        F.col("__results").alias("conditions"),
    )


def rules_as_rows(spark: SparkSession, rules: tuple[R.Rule, ...]) -> DataFrame:
    """Rules written in Python as rows of the table."""
    import json

    rows = [
        (r.id, r.name, r.category, r.severity, r.status, list(r.applicable_to), [(c.field, c.operator, json.dumps(c.value), c.value_field) for c in r.conditions], list(r.messages))
        for r in rules
    ]
    return spark.createDataFrame(rows, SCHEMA)
