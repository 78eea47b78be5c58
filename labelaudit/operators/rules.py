"""Rules: conditions compiled to columns, selection, execution, validation and lifecycle."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelaudit.operators.joins import keyed_join

Operator = Callable[[Column, Any, Column], Column]
NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: Any = None
    value_field: str | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    description: str
    rule_type: str
    category: str
    severity: str
    conditions: tuple[Condition, ...]
    messages: tuple[str, ...]
    tags: tuple[str, ...] = ()
    applicable_to: tuple[str, ...] = ()
    status: str = "active"


# The rules a fresh installation starts with.
DEFAULT_RULES = (
    Rule("rule_000001", "FSSAI Number Required", "All food products must display a valid 14-digit FSSAI license number", "required_field", "food_safety", "critical",
         (Condition("fssai", "exists", True),), ("FSSAI license number is missing",), ("fssai", "mandatory"), ("food", "beverages")),
    Rule("rule_000002", "FSSAI Format Validation", "FSSAI number must be exactly 14 digits", "format_validation", "food_safety", "high",
         (Condition("fssai", "regex", r"^\d{14}$"),), ("FSSAI number format is invalid",), ("fssai", "format"), ("food", "beverages")),
    Rule("rule_000003", "MRP Required", "All products must display Maximum Retail Price", "required_field", "pricing", "critical",
         (Condition("mrp", "exists", True),), ("MRP is missing",), ("mrp", "mandatory"), ("all",)),
    Rule("rule_000004", "Expiry Date Required", "Food products must display expiry or best before date", "required_field", "food_safety", "critical",
         (Condition("expiry_date", "exists", True),), ("Expiry date is missing",), ("expiry", "mandatory"), ("food", "beverages", "medicine")),
    Rule("rule_000005", "Net Weight Required", "Products must display net weight or quantity", "required_field", "packaging", "high",
         (Condition("net_weight", "exists", True),), ("Net weight/quantity is missing",), ("weight", "mandatory"), ("food", "beverages")),
)

# What a rule may say.
RULE_TYPES = ("required_field", "format_validation", "range_check", "expiry_check", "pattern_match", "cross_field", "custom")
SEVERITIES = ("critical", "high", "medium", "low", "info")
STATUSES = ("active", "inactive", "deprecated", "draft")
ACTION_TYPES = ("flag", "warning", "error", "auto_fix", "info")


def _false(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _double(x: Column) -> Column:
    """Numbers as they are, strings only where they are numbers; else null."""
    return F.when(x.cast("string").rlike(NUMERIC), F.trim(x.cast("string")).try_cast("double"))


def _lit(e: Any) -> Column:
    return e if isinstance(e, Column) else F.lit(e)


def _compare(test: Callable[[Column, Column], Column]) -> Operator:
    return lambda a, e, now: _false(test(_double(a), _double(_lit(e))))


def _regex(a: Column, e: Any, now: Column) -> Column:
    if isinstance(e, Column):
        return _false(a.cast("string").rlike(e))
    try:
        re.compile(e)
    except re.error:
        return F.lit(False)
    return _false(F.regexp_like(a.cast("string"), F.lit(f"(?i){e}")))


def _exists(a: Column, e: Any, now: Column) -> Column:
    if not isinstance(e, bool):
        return F.lit(False)
    there = a.isNotNull() & F.coalesce(a.cast("string") != "", F.lit(True))
    return there if e else ~there


def _among(a: Column, e: Any) -> Column:
    values = list(e) if isinstance(e, (list, tuple)) else [e]
    hit = F.lit(False)
    for v in values:
        hit = hit | a.eqNullSafe(_lit(v))
    return hit


def _between(a: Column, e: Any, now: Column) -> Column:
    if not isinstance(e, (list, tuple)) or len(e) != 2:
        return F.lit(False)
    return _false(_double(a).between(float(e[0]), float(e[1])))


def _length(test: Callable[[Column, int], Column]) -> Operator:
    return lambda a, e, now: _false(test(F.length(a.cast("string")), int(e)))


def moment(a: Column) -> Column:
    """A timestamp, or a string as yyyy-mm-dd, d/m/yyyy or d-m-yyyy."""
    s = a.cast("string")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "yyyy-MM-dd HH:mm:ss")])


def _expired(a: Column, e: Any, now: Column) -> Column:
    return F.when(a.isNull(), F.lit(not e)).otherwise(_false((moment(a) < now) == F.lit(bool(e))))


def _days(a: Column, e: Any, now: Column) -> Column:
    return _false(F.floor((F.unix_timestamp(moment(a)) - F.unix_timestamp(now)) / 86400) <= int(e))


#: The rule language; `register_operator` adds to it.
OPERATORS: dict[str, Operator] = {
    "eq": lambda a, e, now: a.eqNullSafe(_lit(e)),
    "ne": lambda a, e, now: ~a.eqNullSafe(_lit(e)),
    "gt": _compare(lambda a, e: a > e),
    "lt": _compare(lambda a, e: a < e),
    "gte": _compare(lambda a, e: a >= e),
    "lte": _compare(lambda a, e: a <= e),
    "contains": lambda a, e, now: _false(F.contains(F.lower(a.cast("string")), F.lower(_lit(e).cast("string")))),
    "not_contains": lambda a, e, now: F.coalesce(~F.contains(F.lower(a.cast("string")), F.lower(_lit(e).cast("string"))), F.lit(True)),
    "regex": _regex,
    "exists": _exists,
    "in": lambda a, e, now: _among(a, e),
    "not_in": lambda a, e, now: ~_among(a, e),
    "between": _between,
    "length_eq": _length(lambda a, n: a == n),
    "length_gt": _length(lambda a, n: a > n),
    "length_lt": _length(lambda a, n: a < n),
    "is_expired": _expired,
    "days_until_expiry": _days,
}
#: Operators the documentation names beside these; extensions.
EXTENSIONS: dict[str, Operator] = {
    "starts_with": lambda a, e, now: _false(F.startswith(a.cast("string"), _lit(e))),
    "ends_with": lambda a, e, now: _false(F.endswith(a.cast("string"), _lit(e))),
    "matches_regex": _regex,
    "not_exists": lambda a, e, now: ~_exists(a, True, now),
    "is_empty": lambda a, e, now: ~_exists(a, True, now),
    "is_not_empty": lambda a, e, now: _exists(a, True, now),
    "is_numeric": lambda a, e, now: _double(a).isNotNull(),
    "is_date": lambda a, e, now: moment(a).isNotNull(),
    "not_between": lambda a, e, now: a.isNotNull() & ~_between(a, e, now),
}


def register_operator(name: str, build: Operator) -> None:
    OPERATORS[name] = build


def path(name: str, columns: Mapping[str, Column] | None = None) -> Column:
    """A dotted path; a number steps into an array, and what is out of range is null."""
    head, *rest = name.split(".")
    out = columns[head] if columns else F.col(head)
    for key in rest:
        out = F.get(out, F.lit(int(key))) if key.isdigit() else out[key]
    return out


def test(c: Condition, now: Column, columns: Mapping[str, Column] | None = None) -> Column:
    """A condition; one with an unknown operator or field never passes, except that a missing field is null."""
    build = OPERATORS.get(c.operator) or EXTENSIONS.get(c.operator)
    if build is None:
        return F.lit(False)
    actual = path(c.field, columns)
    return build(actual, path(c.value_field, columns) if c.value_field else c.value, now)


def execute(rule: Rule, now: Column, columns: Mapping[str, Column] | None = None) -> Column:
    """A rule's result: all conditions, without short cut; no condition means passed."""
    tests = [test(c, now, columns) for c in rule.conditions]
    passed = tests[0] if tests else F.lit(True)
    for t in tests[1:]:
        passed = passed & t
    failed = "failed" if rule.severity in ("critical", "high") else "warning"
    return F.struct(
        F.lit(rule.id).alias("rule_id"),
        F.lit(rule.name).alias("rule_name"),
        F.when(passed, "passed").otherwise(failed).alias("status"),
        passed.alias("passed"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.category).alias("category"),
        F.when(passed, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(m) for m in rule.messages]).cast("array<string>")).alias("messages"),
    )


def applies(rule: Rule, category: Column, wildcard_all: bool = False) -> Column:
    """Active, and made for the category or listing it; `all` is a category like any other unless asked."""
    if rule.status != "active":
        return F.lit(False)
    if wildcard_all and "all" in rule.applicable_to:
        return F.lit(True)
    return _false(category.isin(rule.category, *rule.applicable_to))


def read_rule_packs(spark: SparkSession, path: str) -> DataFrame:
    """category, name, description, code, field, mandatory, required_if_imported, required_if_appliance, penalty, message,
    legal_reference of a JSON file of rule packs by category; without the file, no rows."""
    rule = "struct<code:string,field:string,mandatory:boolean,required_if_imported:boolean,required_if_appliance:boolean,penalty:int,message:string,legal_reference:string>"
    schema = f"categories map<string,struct<name:string,description:string,rules:array<{rule}>>>"
    try:
        packs = spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException:  # no such file
        packs = spark.createDataFrame([], schema)
    each = packs.select(F.explode("categories").alias("category", "pack"))
    return each.select("category", "pack.name", "pack.description", F.explode("pack.rules").alias("rule")).select("category", "name", "description", "rule.*")


def any_applies(rules: tuple[Rule, ...], category: Column, wildcard_all: bool = False) -> Column:
    """Whether some rule applies to a row; where none does, there can be no violation."""
    hit = F.lit(False)
    for r in rules:
        hit = hit | applies(r, category, wildcard_all)
    return hit


def execute_all(rules: tuple[Rule, ...], category: Column, now: Column, columns: Mapping[str, Column] | None = None, wildcard_all: bool = False) -> Column:
    """Results of the rules that apply to a row, as an array; the rules are compiled, not joined."""
    return F.array_compact(F.array(*[F.when(applies(r, category, wildcard_all), execute(r, now, columns)) for r in rules]))


def rules_frame(spark: SparkSession, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    rows = [(i, r.id, r.name, r.description, r.rule_type, r.category, r.severity, list(r.tags), list(r.applicable_to), r.status, list(r.messages)) for i, r in enumerate(rules, 1)]
    return spark.createDataFrame(
        rows,
        "rule_no int, id string, name string, description string, rule_type string, category string, severity string, tags array<string>, applicable_to array<string>, status string, messages array<string>",
    )


def select_rules(rules: DataFrame, rule_id: str | None = None, rule_ids: list[str] | None = None, category: str | None = None, or_all: bool = False) -> DataFrame:
    """By id, by ids in the order given (repeats kept, unknown ones skipped), by category (`or_all`: and those that apply
    to all), or all active. Each row once, whatever ids repeat."""
    if rule_id:
        return rules.where(F.col("id") == rule_id)
    if rule_ids:
        wanted = rules.sparkSession.createDataFrame(list(enumerate(rule_ids)), "position int, id string")
        return rules_by_ids(rules, wanted).orderBy("position").drop("position")
    active = rules.where(F.col("status") == "active")
    if not category:
        return active
    for_all = F.array_contains("applicable_to", "all") if or_all else F.lit(False)
    return active.where((F.col("category") == category) | F.array_contains("applicable_to", category) | for_all)


def rules_by_ids(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rules that a table of ids names, with that table's other columns: repeats kept, unknown ids left out."""
    return keyed_join(wanted, rules, "id")


def filter_rules(rules: DataFrame, category=None, status=None, severity=None, rule_type=None, tag=None, skip: int = 0, limit: int = 50) -> DataFrame:
    for name, value in (("category", category), ("status", status), ("severity", severity), ("rule_type", rule_type)):
        rules = rules.where(F.col(name) == value) if value else rules
    rules = rules.where(F.array_contains("tags", tag)) if tag else rules
    return rules.orderBy(F.desc("rule_no")).offset(skip).limit(min(limit, 100))


def compiles(pattern: Column) -> Column:
    """Whether a text is a regular expression for the engine that will run it; null for null."""
    tried = F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern)
    return F.when(pattern.isNotNull(), tried.isNotNull())


def value_type_ok(operator: Column, value: Column) -> Column:
    """Whether a condition's value, given as JSON, has a type its operator can use; unknown operators take any."""
    is_list, is_text = value.rlike(r"(?s)\A\s*\[.*\]\s*\z"), value.rlike(r'(?s)\A\s*".*"\s*\z')
    bare = F.regexp_replace(F.trim(value), r'\A"|"\z', "")
    plain = value.rlike(r"\A\s*(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false)\s*\z")
    number = plain | (is_text & bare.try_cast("double").isNotNull())
    whole = plain | (is_text & bare.rlike(r"\A\s*[+-]?\d+\s*\z"))
    two = F.size(F.from_json(value, "array<string>")) == 2
    return _false(
        F.when(operator.isin("gt", "lt", "gte", "lte"), number)
        .when(operator.isin("contains", "not_contains", "regex"), is_text)
        .when(operator == "exists", F.trim(value).isin("true", "false"))
        .when(operator.isin("in", "not_in"), is_list)
        .when(operator == "between", is_list & two)
        .when(operator.isin("length_eq", "length_gt", "length_lt"), whole)
        .otherwise(F.lit(True))
    )


#: Fields a rule cannot do without.
REQUIRED = ("name", "description", "rule_type", "category", "conditions", "actions")


def validation_schema() -> dict[str, tuple[str, ...]]:
    """What a rule may say, list by list."""
    return {"rule_types": RULE_TYPES, "severities": SEVERITIES, "statuses": STATUSES, "operators": tuple(OPERATORS), "action_types": ACTION_TYPES, "required_fields": REQUIRED}


def rule_errors(rules: DataFrame) -> DataFrame:
    """id, valid, errors of rule rows with name, description, rule_type, category, severity, status, conditions, actions, tags."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    n = F.length(F.trim("name"))
    checks = [
        F.when(blank(F.col("name")) | (n < 3), "Rule name must be at least 3 characters"),
        F.when(n > 100, "Rule name must be less than 100 characters"),
        F.when(blank(F.col("description")) | (F.length(F.trim("description")) < 10), "Description must be at least 10 characters"),
        F.when(~F.coalesce(F.col("rule_type").isin(*RULE_TYPES), F.lit(False)), "Invalid rule type"),
        F.when(blank(F.col("category")), "Category is required"),
        F.when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "Invalid severity"),
        F.when(F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES), "Invalid status"),
        F.when(F.coalesce(F.size("conditions"), F.lit(0)) <= 0, "At least one condition is required"),
        F.when(F.coalesce(F.size("actions"), F.lit(0)) <= 0, "At least one action is required"),
        F.when(F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.length(t) < 2), "Tags must be at least 2 characters"),
    ]
    known = list(OPERATORS)
    per_condition = F.flatten(
        F.transform(
            "conditions",
            lambda c: F.array_compact(
                F.array(
                    F.when(blank(c["field"]), "Condition field is required"),
                    F.when(~F.coalesce(c["operator"].isin(*known), F.lit(False)), F.concat(F.lit("Unknown operator: "), F.coalesce(c["operator"], F.lit("")))),
                    F.when((c["operator"] == "exists") & ~F.coalesce(c["value"].isin("true", "false"), F.lit(False)), "exists needs true or false"),
                    F.when((c["operator"] == "between") & (F.size(F.split(c["value"], ",")) != 2), "between needs two values"),
                    F.when(c["operator"].isin("in", "not_in") & blank(c["value"]), F.concat(c["operator"], F.lit(" needs a list"))),
                    F.when((c["operator"] == "regex") & ~F.coalesce(compiles(c["value"]), F.lit(True)), F.concat(F.lit("Invalid regex pattern: "), c["value"])),
                )
            ),
        )
    )
    per_action = F.flatten(
        F.transform(
            "actions",
            lambda a: F.array_compact(
                F.array(
                    F.when(~F.coalesce(a["type"].isin(*ACTION_TYPES), F.lit(False)), "Invalid action type"),
                    F.when(blank(a["message"]), "Action message is required"),
                    F.when((a["type"] == "auto_fix") & blank(a["fix_value"]), "auto_fix needs a fix_value"),
                )
            ),
        )
    )
    none = F.array().cast("array<string>")
    errors = F.concat(F.array_compact(F.array(*checks)), F.coalesce(per_condition, none), F.coalesce(per_action, none))
    return rules.select("id", errors.alias("errors")).withColumn("valid", F.size("errors") == 0)


def fold_events(events: DataFrame) -> DataFrame:
    """Rules as of their history: rule_id, seq, event, name, severity -> the current row of each rule.

    create and update carry values and raise the version; activate and deactivate only flip the status; a
    deleted rule is gone until it is created again.
    """
    by = Window.partitionBy("rule_id").orderBy("seq")
    life = F.sum((F.col("event") == "create").cast("int")).over(by)
    lived = events.withColumn("life", life)
    whole = Window.partitionBy("rule_id", "life").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    status = F.when(F.col("event") == "activate", "active").when(F.col("event") == "deactivate", "inactive").when(F.col("event") == "create", "draft")
    state = lived.select(
        "rule_id",
        "seq",
        "event",
        F.last("name", True).over(whole).alias("name"),
        F.last("severity", True).over(whole).alias("severity"),
        F.last(status, True).over(whole).alias("status"),
        F.sum(F.col("event").isin("create", "update").cast("int")).over(whole).alias("version"),
        F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("seq"))).alias("rn"),
    )
    return state.where((F.col("rn") == 1) & (F.col("event") != "delete")).select("rule_id", "name", "severity", "status", F.col("version").cast("long").alias("version"))
