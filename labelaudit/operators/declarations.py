"""Legacy validation: declared fields against a category's rule pack."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelaudit.functions import patterns as P
from labelaudit.functions.extract import capture, number
from labelaudit.functions.needs import may_match
from labelaudit.operators.scoring import missing

# Rule packs: code number, field, when it is required (always, imported, appliance, never), penalty.
PACKS = {
    "food": ("FOOD", (
        ("001", "mrp_inclusive_of_taxes", "always", 25), ("002", "net_quantity", "always", 25), ("003", "manufacturer_or_importer", "always", 20),
        ("004", "date_of_manufacture_or_import", "always", 20), ("005", "expiry_date", "always", 25), ("006", "ingredients_list", "always", 15),
        ("007", "nutritional_info", "always", 10), ("008", "fssai_license", "always", 30), ("009", "consumer_care_information", "always", 10),
        ("010", "country_of_origin", "imported", 15), ("011", "veg_nonveg_symbol", "always", 15), ("012", "common_generic_name", "always", 15),
        ("013", "manufacturer_address", "always", 15), ("014", "importer_address", "imported", 15),
    )),
    "electronics": ("ELEC", (
        ("001", "mrp_inclusive_of_taxes", "always", 20), ("002", "manufacturer_or_importer", "always", 25), ("003", "model_number", "always", 15),
        ("004", "serial_number", "never", 10), ("005", "bis_certification", "always", 30), ("006", "power_rating", "always", 15),
        ("007", "warranty_information", "always", 15), ("008", "consumer_care_information", "always", 10), ("009", "country_of_origin", "always", 15),
        ("010", "date_of_manufacture_or_import", "always", 10), ("011", "energy_rating", "appliance", 10), ("012", "common_generic_name", "always", 15),
        ("013", "manufacturer_address", "always", 15), ("014", "importer_address", "imported", 15),
    )),
    "cosmetics": ("COSM", (
        ("001", "mrp_inclusive_of_taxes", "always", 20), ("002", "net_quantity", "always", 20), ("003", "manufacturer_or_importer", "always", 20),
        ("004", "ingredients_list", "always", 25), ("005", "batch_number", "always", 15), ("006", "date_of_manufacture_or_import", "always", 15),
        ("007", "expiry_date", "always", 20), ("008", "usage_instructions", "always", 10), ("009", "warnings_precautions", "always", 15),
        ("010", "consumer_care_information", "always", 10), ("011", "country_of_origin", "imported", 15), ("012", "cruelty_free_certification", "never", 5),
        ("013", "common_generic_name", "always", 15), ("014", "manufacturer_address", "always", 15), ("015", "importer_address", "imported", 15),
    )),
    "generic": ("GEN", (
        ("001", "mrp_inclusive_of_taxes", "always", 20), ("002", "net_quantity", "always", 20), ("003", "manufacturer_or_importer", "always", 20),
        ("004", "consumer_care_information", "always", 15), ("005", "date_of_manufacture_or_import", "always", 15), ("006", "country_of_origin", "imported", 10),
        ("007", "common_generic_name", "always", 15), ("008", "manufacturer_address", "always", 15), ("009", "importer_address", "imported", 15),
    )),
}
# Penalties of the further checks, which repeat some of the packs'.
FURTHER = {"007": 15, "008": 15, "009": 15, "010": 10, "011": 15, "012": 10, "013": 25}


def imported(text: Column) -> Column:
    return may_match(text, P.IMPORTED) & F.lower(text).rlike(P.IMPORTED)


def appliance(text: Column) -> Column:
    return may_match(text, P.APPLIANCE) & F.lower(text).rlike(P.APPLIANCE)


def price_format_ok(price: Column) -> Column:
    low = F.lower(price)
    return low.rlike("incl|all taxes|taxes included") | F.contains(price, F.lit("₹")) | F.contains(low, F.lit("rs"))


def price_above(text: Column, price: Column) -> Column:
    """Whether the first selling price in the text is above the printed one."""
    printed = capture(F.replace(price, F.lit(","), F.lit("")), r"([0-9]+(?:\.[0-9]+)?)").cast("double")
    asked = number(capture(F.lower(text), r"(?:selling\s*price|sale\s*price|price|offer\s*price|our\s*price)\s*[:\-₹rs\.]*\s*([0-9,]+(?:\.[0-9]+)?)"))
    return F.coalesce(asked > printed, F.lit(False))


def _entry(code: str, field: str, penalty: int) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(penalty).alias("penalty"))


def pack_of(category: Column) -> Column:
    """The pack of a (lower-case) category, generic where it has none."""
    return F.when(category.isin(*PACKS), category).otherwise("generic")


def _needed(text: Column) -> dict[str, Column]:
    return {"always": F.lit(True), "imported": imported(text), "appliance": appliance(text)}


def asked(fields: dict[str, Column], text: Column, category: Column) -> dict[str, Column]:
    """The fields that some pack asks for, null where the category's own does not ask for them."""
    packs: dict[str, dict[str, list[str]]] = {}
    for name, (_, rules) in PACKS.items():
        for _, field, when, _ in rules:
            if when != "never" and field in fields:
                packs.setdefault(field, {}).setdefault(when, []).append(name)
    needed, pack = _needed(text), pack_of(category)
    return {field: F.when(reduce(or_, [pack.isin(*names) & needed[when] for when, names in of.items()]), fields[field]) for field, of in packs.items()}


def pack_violations(fields: dict[str, Column], text: Column, category: Column) -> Column:
    """Violations of the pack of a category. A rule whose field no dialect reads is always broken when it is
    required."""
    known, needs, own = pack_of(category), _needed(text), {}
    for name, (prefix, rules) in PACKS.items():
        tests = []
        for number_, field, when, penalty in rules:
            if when != "never":
                absent = missing(fields[field]) if field in fields else F.lit(True)
                tests.append(F.when(needs[when] & absent, _entry(f"{prefix}-{number_}", field, penalty)))
        own[name] = F.array_compact(F.array(*tests))
    return F.coalesce(*[F.when(known == name, found) for name, found in own.items()])  # only its own pack is looked at


def further_violations(fields: dict[str, Column], text: Column) -> Column:
    price, words = fields["mrp_inclusive_of_taxes"], fields["net_quantity_prohibited_expressions"]
    checks = (
        ("007", "common_generic_name", missing(fields["common_generic_name"])),
        ("008", "manufacturer_address", missing(fields["manufacturer_address"])),
        ("009", "importer_address", imported(text) & missing(fields["importer_address"])),
        ("010", "net_quantity_unit_valid", ~fields["net_quantity_unit_valid"]),
        ("011", "net_quantity_no_approximation", F.coalesce(F.size(words) > 0, F.lit(False))),
        ("012", "mrp_format_valid", F.coalesce(~price_format_ok(price), F.lit(False))),
        ("013", "price_not_exceeding_mrp", price_above(text, price)),
    )
    return F.array_compact(F.array(*[F.when(test, _entry(f"LM-AUD-{n}", field, FURTHER[n])) for n, field, test in checks]))


def pack_frame(spark):
    """The packs as a table: category, code, field, required, penalty."""
    rows = [(c, f"{prefix}-{n}", field, when, penalty) for c, (prefix, rules) in PACKS.items() for n, field, when, penalty in rules]
    return spark.createDataFrame(rows, "category string, code string, field string, required string, penalty int")
