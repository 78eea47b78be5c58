"""Label fields as column expressions, one function per dialect; the dialects differ on purpose.

Everywhere the first pattern that matches *and* validates wins; a value that fails validation leads
to the next pattern, not to the next place the same pattern matches.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelaudit.functions import patterns as P
from labelaudit.functions.needs import holds, let, where_possible
from labelaudit.functions.text import strip


def capture(text: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """The group of the first match, null where there is none or it is empty."""
    found = where_possible(text, pattern, F.regexp_extract(text, f"(?{flags}){pattern}", group))
    return F.try_element_at(F.array_remove(F.array(found), ""), F.lit(1))  # the pattern runs once, as compiled code


def first(text: Column, patterns: Iterable[str], group: int = 1, flags: str = "i") -> Column:
    return F.coalesce(*[capture(text, p, group, flags) for p in patterns])


def number(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit("")).try_cast("double")


def squeeze(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", " ")


def licence_ok(x: Column) -> Column:
    return x.rlike(r"^(0[1-9]|[12][0-9]|3[0-7])[123]\d{11}$")


def unit_name(x: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in P.UNITS.items() for v in kv])[F.lower(x)]


def _price_ok(x: Column) -> Column:
    return (x > 0) & (x < 100000)


def _formatted(price: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(price, 2))


# --- service dialect ------------------------------------------------------------------------------


def fssai(text: Column) -> Column:
    tries = []
    for pattern, confidence in P.SERVICE_FSSAI:
        kinds = F.create_map(*[F.lit(v) for kv in P.LICENCE_TYPES.items() for v in kv])
        parts = lambda m: (m.alias("value"), F.lit(confidence).alias("confidence"), F.substring(m, 1, 2).alias("state_code"), kinds[F.substring(m, 3, 1)].alias("license_type"))  # noqa: E731, B023
        tries.append(let(capture(text, pattern), lambda m: F.when(licence_ok(m), F.struct(*parts(m)))))
    return F.coalesce(*tries)


def price(text: Column) -> Column:
    tries = []
    for pattern, confidence in P.SERVICE_PRICE:
        parts = lambda v: (v.alias("value"), F.lit("INR").alias("currency"), _formatted(v).alias("formatted"), F.lit(confidence).alias("confidence"))  # noqa: E731, B023
        tries.append(let(number(capture(text, pattern)), lambda v: F.when(_price_ok(v), F.struct(*parts(v)))))
    return F.coalesce(*tries)


def weight(text: Column, patterns=P.SERVICE_WEIGHT) -> Column:
    tries = []
    for pattern, confidence in patterns:
        unit = unit_name(capture(text, pattern, 2))
        whole = lambda v, u: F.struct(v.alias("value"), u.alias("unit"), F.concat_ws(" ", v.cast("string"), u).alias("formatted"), F.lit(confidence).alias("confidence"))  # noqa: E731, B023
        tries.append(let(capture(text, pattern, 1).cast("double"), lambda v: F.when(v.isNotNull(), let(unit, lambda u: whole(v, u)))))
    return F.coalesce(*tries)


# The values alone, for those who ask for nothing else.


def fssai_value(text: Column) -> Column:
    return F.coalesce(*[let(capture(text, p), lambda m: F.when(licence_ok(m), m)) for p, _ in P.SERVICE_FSSAI])


def price_value(text: Column) -> Column:
    return F.coalesce(*[let(number(capture(text, p)), lambda v: F.when(_price_ok(v), v)) for p, _ in P.SERVICE_PRICE])


def weight_value(text: Column, patterns=P.SERVICE_WEIGHT) -> Column:
    return F.coalesce(*[capture(text, p, 1).cast("double") for p, _ in patterns])


def full_month_date(line: Column, lenient: bool = False) -> Column:
    """Text and ISO form of the date in a line. Only a full month name and a four-digit year are read;
    `lenient` also reads day/month/year and short month names."""
    pattern = rf"(?:{P.MONTHS})[A-Z]*\s*[,\s]?\d{{2,4}}"
    raw = capture(line, pattern, 0)
    exact = lambda flat: F.when(flat.rlike(rf"^(?:{P.FULL_MONTHS}) \d{{4}}$"), F.try_to_timestamp(F.initcap(flat), F.lit("MMMM yyyy")))
    dated = lambda r, e: F.when(e.isNotNull(), F.struct(r.alias("raw"), F.date_format(e, "yyyy-MM-dd").alias("parsed")))
    found = let(raw, lambda r: let(let(F.upper(squeeze(r)), exact), lambda e: dated(r, e)))
    if not lenient:
        return found
    flat = F.upper(squeeze(raw))
    day = capture(line, P.OCR_DATES[0], 0)
    parsed = F.try_to_timestamp(F.regexp_replace(day, r"[\-.]", "/"), F.lit("d/M/yyyy"))
    short = F.try_to_timestamp(F.initcap(flat), F.lit("MMM yyyy"))
    return F.coalesce(
        F.when(parsed.isNotNull(), F.struct(day.alias("raw"), F.date_format(parsed, "yyyy-MM-dd").alias("parsed"))),
        found,
        F.when(short.isNotNull(), F.struct(raw.alias("raw"), F.date_format(short, "yyyy-MM-dd").alias("parsed"))),
    )


def dates(text: Column, lenient: bool = False) -> Column:
    """First date of each kind, by line; months of shelf life from the last line that gives any."""
    lines = F.split(text, "\n")
    of = lambda words: F.filter(lines, lambda s: let(F.upper(s), lambda up: holds(up, words.split("|"))))
    head = lambda words: F.get(F.filter(F.transform(of(words), lambda s: full_month_date(s, lenient)), lambda d: d.isNotNull()), F.lit(0))
    spans = F.filter(F.transform(of(P.SERVICE_EXPIRES), lambda s: capture(s, P.SERVICE_SPAN)), lambda m: m.isNotNull())
    return F.struct(
        head(P.SERVICE_MADE).alias("manufacturing_date"),
        head(P.SERVICE_EXPIRES).alias("expiry_date"),
        let(spans, lambda x: F.get(x, F.size(x) - 1)).try_cast("int").alias("best_before_months"),
    )


def batch(text: Column) -> Column:
    return let(capture(text, P.SERVICE_BATCH), lambda v: F.when(F.length(v) >= 4, v))


def address(text: Column) -> Column:
    tries = []
    for pattern in P.SERVICE_ADDRESS:
        v = F.trim(squeeze(strip(capture(text, pattern, 1, "is"))))
        v = F.regexp_replace(v, r"\A[.,;]+|[.,;]+\z", "")
        tries.append(F.when(F.length(v) > 20, v))
    return F.coalesce(*tries)


def contact(text: Column) -> Column:
    """Phone (the later pattern wins) and e-mail; null without either."""
    phones = []
    for pattern in reversed(P.SERVICE_PHONE):
        v = F.regexp_replace(capture(text, pattern), r"[\s\-()]", "")
        phones.append(F.when(F.length(v) >= 10, v))
    phone, email = F.coalesce(*phones), capture(text, P.SERVICE_EMAIL)
    return F.when(phone.isNotNull() | email.isNotNull(), F.struct(phone.alias("phone"), email.alias("email")))


def country(text: Column) -> Column:
    return let(F.initcap(squeeze(strip(capture(text, P.SERVICE_COUNTRY)))), lambda v: F.when(F.length(v).between(4, 50), v))


def entities(text: Column, lenient: bool = False, only: Iterable[str] | None = None) -> Column:
    """The eight entities, or `only` some of them."""
    made = {
        "fssai": fssai(text),
        "price": price(text),
        "dates": dates(text, lenient),
        "weight": weight(text),
        "batch": batch(text),
        "address": address(text),
        "contact": contact(text),
        "country": country(text),
    }
    return F.struct(*[made[n].alias(n) for n in (made if only is None else only)])


def completeness(e: Column) -> Column:
    """Share of the eight entities that are there; the dates always count."""
    there = [e[c].isNotNull().cast("int") for c in ("fssai", "price", "weight", "batch", "address", "contact", "country")]
    return F.round((sum(there) + 1) / F.lit(8.0) * 100, 1)


def confidence(e: Column) -> Column:
    """Mean confidence: high 0.9, medium 0.7, other 0.5; dates and contact have none of their own."""
    level = lambda x: F.when(x == "high", 0.9).when(x == "medium", 0.7).otherwise(0.5)
    parts = [
        F.when(e["fssai"].isNotNull(), level(e["fssai"]["confidence"])),
        F.when(e["price"].isNotNull(), level(e["price"]["confidence"])),
        F.when(e["weight"].isNotNull(), level(e["weight"]["confidence"])),
        F.when(e["batch"].isNotNull(), F.lit(0.9)),
        F.when(e["address"].isNotNull(), F.lit(0.7)),
        F.when(e["country"].isNotNull(), F.lit(0.9)),
    ]
    known = F.array_compact(F.array(*parts))
    return F.when(F.size(known) > 0, F.round(F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known), 4)).otherwise(F.lit(0.5))


# --- pattern dialect --------------------------------------------------------------------------------


def label_value(text: Column, name: str) -> Column:
    return first(text, P.LABEL[name][1], 1, "is")


def label_match(text: Column, name: str) -> Column:
    """Of the first pattern that matches: value, the whole match, where it starts and ends (from 0), and which it was."""
    import re

    def found(n: int, p: str) -> Column:
        pattern = f"(?is){p}"
        value = F.regexp_extract(text, pattern, min(1, re.compile(p.replace(r"\z", r"\Z")).groups))

        def parts(at: Column, whole: Column) -> Column:
            return F.struct(value.alias("value"), whole.alias("full_match"), at.alias("start"), (at + F.length(whole)).alias("end"), F.lit(n).alias("pattern_no"), F.lit(p).alias("pattern_used"))

        # its place says whether the pattern matches at all
        return let(where_possible(text, p, F.regexp_instr(text, F.lit(pattern))), lambda i: F.when(i > 0, let(F.regexp_extract(text, pattern, 0), lambda w: parts(i - 1, w))))

    tries = [found(n, p) for n, p in enumerate(P.LABEL[name][1])]
    return F.coalesce(*tries)


def label_values(text: Column) -> list[Column]:
    return [label_value(text, name).alias(name) for name in P.LABEL]


def label_summary(values: dict[str, Column]) -> list[Column]:
    found = sum(v.isNotNull().cast("int") for v in values.values())
    required = [n for n, (needed, _) in P.LABEL.items() if needed]
    there = sum(values[n].isNotNull().cast("int") for n in required)
    return [
        F.lit(len(values)).alias("total_patterns"),
        found.alias("patterns_matched"),
        F.round(found / F.lit(float(len(values))) * 100, 1).alias("match_percentage"),
        F.lit(len(required)).alias("required_total"),
        there.alias("required_found"),
        (F.lit(len(required)) - there).alias("required_missing"),
        (there == len(required)).alias("compliant"),
    ]


def missing_required(values: dict[str, Column]) -> Column:
    names = [F.when(values[n].isNull(), F.lit(n)) for n, (needed, _) in P.LABEL.items() if needed]
    return F.array_compact(F.array(*names))


def custom_patterns(text: Column, patterns: list[str]) -> Column:
    """found and value for each pattern of the caller's; one that does not compile is an error of its own."""
    import re

    none, out = F.lit(None).cast("string"), []
    for i, p in enumerate(patterns):
        try:
            groups = re.compile(p).groups
        except re.error as e:
            out.append(F.struct(F.lit(f"pattern_{i}").alias("name"), F.lit(False).alias("found"), none.alias("value"), F.lit(str(e)).alias("error")))
            continue
        found = text.rlike(f"(?is){p}")
        out.append(F.struct(F.lit(f"pattern_{i}").alias("name"), found.alias("found"), F.when(found, F.regexp_extract(text, f"(?is){p}", min(groups, 1))).alias("value"), none.alias("error")))
    return F.array(*out)


# --- OCR dialect ---------------------------------------------------------------------------------------


def ocr_fssai(text: Column) -> Column:
    tries = []
    for p in P.OCR_FSSAI:
        tries.append(let(capture(text, p), lambda m: F.when(licence_ok(m), F.struct(m.alias("value"), F.lit("high").alias("confidence")))))
    any_run = F.get(F.filter(F.regexp_extract_all(text, F.lit(r"\b(\d{14})\b"), F.lit(1)), licence_ok), F.lit(0))
    return F.coalesce(*tries, let(any_run, lambda m: F.when(m.isNotNull(), F.struct(m.alias("value"), F.lit("medium").alias("confidence")))))


def ocr_mrp(text: Column) -> Column:
    confidence_ = F.when(F.contains(F.upper(text), F.lit("MRP")), "high").otherwise("medium")
    tries = []
    for p in P.OCR_MRP:
        parts = lambda v: F.struct(v.alias("value"), _formatted(v).alias("formatted"), confidence_.alias("confidence"))
        tries.append(let(number(capture(text, p)), lambda v: F.when(_price_ok(v), parts(v))))
    return F.coalesce(*tries)


def ocr_date(line: Column) -> Column:
    """ISO form of the first layout whose text parses: d/m/y (two-digit years 1969-2068), month names, y/m/d."""
    def slashed(flat: Column) -> Column:
        year = F.regexp_extract(flat, r"(\d+)$", 1)
        full = let(
            year,
            lambda y: F.when(F.length(y) == 2, F.concat(F.regexp_extract(flat, r"^(.*/)\d+$", 1), F.when(y.cast("int") < 69, "20").otherwise("19"), y)).when(F.length(y) == 4, flat),
        )
        return F.try_to_timestamp(full, F.lit("d/M/yyyy"))

    def parsed(n: int, raw: Column) -> Column:
        if n == 0:
            same = raw.rlike(r"^\d+([/\-.])\d+\1\d+$")  # one separator throughout
            return F.when(same, let(F.regexp_replace(raw, r"[\-.]", "/"), slashed))
        if n == 3:
            return F.try_to_timestamp(F.regexp_replace(raw, "-", "/"), F.lit("yyyy/M/d"))
        # the month's letters say which of both layouts can read it; a try that fails is dear
        day, head = (r"^\d{1,2} ", "d ") if n == 1 else ("^", "")
        read = lambda layout: F.try_to_timestamp(F.initcap(raw), F.lit(head + layout))
        return F.when(raw.rlike(day + r"[A-Za-z]{3} \d"), read("MMM yyyy")).when(raw.rlike(day + r"[A-Za-z]{4,} \d"), read("MMMM yyyy"))

    tries = [let(squeeze(capture(line, p, 0)), lambda raw: F.date_format(parsed(n, raw), "yyyy-MM-dd")) for n, p in enumerate(P.OCR_DATES)]  # noqa: B023
    return F.coalesce(*tries)


def ocr_dates(text: Column) -> Column:
    """The last dated line of each kind; months of shelf life where only the making is dated."""
    lines = F.split(text, "\n")

    def last(words: str) -> Column:
        found = F.filter(F.transform(F.filter(lines, lambda s: where_possible(s, words, s.rlike("(?i)" + words))), ocr_date), lambda d: d.isNotNull())
        return let(found, lambda x: F.get(x, F.size(x) - 1))

    def found(made: Column, expires: Column) -> Column:
        months = F.when(made.isNotNull() & expires.isNull(), capture(text, P.OCR_SHELF_LIFE)).try_cast("int")
        return F.struct(made.alias("manufacturing_date"), expires.alias("expiry_date"), months.alias("shelf_life_months"))

    return let(last(P.OCR_MADE), lambda made: let(last(P.OCR_EXPIRES), lambda expires: found(made, expires)))


def ocr_batch(text: Column) -> Column:
    return F.coalesce(*[let(capture(text, p), lambda v: F.when(F.length(v) >= 4, v)) for p in P.OCR_BATCH])


def ocr_country(text: Column) -> Column:
    tries = [F.initcap(squeeze(strip(capture(text, p)))) for p in P.OCR_COUNTRY]
    return F.coalesce(*[let(v, lambda x: F.when(F.length(x) >= 4, x)) for v in tries])


def ocr_care(text: Column) -> Column:
    tries = []
    for p in P.OCR_CARE:
        v = F.regexp_replace(capture(text, p), r"[\s\-]", "")
        shown = (
            F.when(F.length(v) == 10, F.concat_ws("-", F.substring(v, 1, 5), F.substring(v, 6, 5)))
            .when(F.length(v) == 11, F.concat_ws("-", F.substring(v, 1, 4), F.substring(v, 5, 3), F.substring(v, 8, 4)))
            .otherwise(v)
        )
        tries.append(F.when(F.length(v) >= 10, F.struct(v.alias("value"), shown.alias("formatted"))))
    return F.coalesce(*tries)


def ocr_allergens(text: Column) -> Column:
    tries = []
    for p in P.OCR_ALLERGENS:
        items = F.filter(F.transform(F.split(strip(capture(text, p)), "[,;&]"), lambda x: F.lower(strip(x))), lambda x: x != "")
        tries.append(F.when(F.size(items) > 0, items))
    return F.coalesce(*tries)


def ocr_fields(text: Column, only: Iterable[str] | None = None) -> Column:
    """The eight fields, or `only` some of them."""
    made = {
        "fssai": ocr_fssai(text),
        "mrp": ocr_mrp(text),
        "dates": ocr_dates(text),
        "net_weight": weight(text, [(p, "high") for p in P.OCR_WEIGHT]),
        "batch_number": ocr_batch(text),
        "country_of_origin": ocr_country(text),
        "customer_care": ocr_care(text),
        "allergens": ocr_allergens(text),
    }
    return F.struct(*[made[n].alias(n) for n in (made if only is None else only)])


def ocr_found(f: Column) -> Column:
    """How many of the nine fields are there; the two dates count one each."""
    plain = ("fssai", "mrp", "net_weight", "batch_number", "country_of_origin", "customer_care", "allergens")
    dated = ("manufacturing_date", "expiry_date")
    return sum(f[c].isNotNull().cast("int") for c in plain) + sum(f["dates"][c].isNotNull().cast("int") for c in dated)


# --- declaration dialect -------------------------------------------------------------------------------


def declared(text: Column, patterns: Iterable[str]) -> Column:
    tries = [F.trim(capture(text, p), F.lit(" .,-")) for p in patterns]
    return F.coalesce(*[F.when(t != "", t) for t in tries])


def prohibited(raw: Column) -> Column:
    words = F.array(*[F.lit(w) for w in P.PROHIBITED])
    found = F.filter(words, lambda w: F.contains(F.lower(raw), w))
    return F.when(raw.isNotNull() & (F.size(found) > 0), found)


def unit_valid(quantity: Column, attached: bool = False) -> Column:
    """Whether a quantity names an SI unit as a word of its own; `attached` also takes 500g."""
    pattern = P.SI_UNITS.replace(r"\b(", r"(?:\b|\d)(", 1) if attached else P.SI_UNITS
    return F.coalesce(quantity.rlike("(?i)" + pattern), F.lit(False))


def universal(text: Column) -> dict[str, Column]:
    fields = {name: declared(text, p) for name, p in P.UNIVERSAL.items()}
    fields["country_of_origin"] = F.initcap(fields["country_of_origin"])
    fields["net_quantity_prohibited_expressions"] = prohibited(declared(text, (P.NET_QUANTITY_RAW,)))
    fields["net_quantity_unit_valid"] = unit_valid(fields["net_quantity"])
    return fields


PACK_FIELDS = {"food": P.FOOD, "electronics": P.ELECTRONICS, "cosmetics": P.COSMETICS}


def declarations(text: Column, category: Column) -> dict[str, Column]:
    """Universal fields, then those of the category; without a known one, the first pack that finds a field."""
    fields = universal(text)
    for name in dict.fromkeys(n for pack in PACK_FIELDS.values() for n in pack):
        found = {c: declared(text, pack[name]) for c, pack in PACK_FIELDS.items() if name in pack}
        known = F.lower(F.coalesce(category, F.lit("")))
        value = F.when(known.isin(*PACK_FIELDS), F.coalesce(*[F.when(known == c, v) for c, v in found.items()]))
        fields[name] = value.otherwise(F.coalesce(*found.values()))
    return fields


def simple_fields(text: Column) -> dict[str, Column]:
    """Four fields: price as `INR n`, quantity in grams or ml, maker, country."""
    value = capture(text, P.SIMPLE["quantity"], 1).cast("double")
    unit = F.lower(capture(text, P.SIMPLE["quantity"], 2))
    base = F.when(unit.isin("kg", "l", "litre", "litres"), value * 1000).otherwise(value)
    shown = F.when(base == F.floor(base), F.floor(base).cast("string")).otherwise(base.cast("string"))
    kind = F.when(unit.isin("kg", "g", "gram", "grams"), "grams").otherwise("ml")
    return {
        "mrp": F.concat(F.lit("INR "), F.replace(capture(text, P.SIMPLE["mrp"]), F.lit(","), F.lit(""))),
        "quantity": F.when(value.isNotNull(), F.concat_ws(" ", shown, kind)),
        "manufacturer": F.trim(capture(text, P.SIMPLE["manufacturer"])),
        "country_of_origin": F.initcap(F.trim(capture(text, P.SIMPLE["country_of_origin"]))),
    }


def detect_category(text: Column) -> Column:
    """The category with most keywords in the text, the first listed on ties, else generic."""
    low = F.lower(text)
    counts = {c: sum(F.contains(low, F.lit(k)).cast("int") for k in words) for c, words in P.CATEGORY_KEYWORDS.items()}
    best = F.greatest(*counts.values())
    out = F.when(best == 0, F.lit("generic"))
    for c, n in counts.items():
        out = out.when(n == best, F.lit(c))
    return out


# --- region dialect ---------------------------------------------------------------------------------------


def alternatives(text: Column, pattern: str) -> Column:
    """The first group of the first match that took part."""
    import re

    return F.coalesce(*[capture(text, pattern, g) for g in range(1, re.compile(pattern).groups + 1)])


def region_fields(text: Column, category: Column) -> dict[str, Column]:
    """Twelve fields of a picture's text; without keyed dates the first two bare ones, or the only one, are
    taken (for food as the expiry). Licences are read for food or unknown, certificates for electronics or unknown."""
    got = {n: alternatives(text, p) for n, p in P.REGION.items()}
    bare = F.regexp_extract_all(text, F.lit("(?i)" + P.REGION_DATES), F.lit(0))
    none = got["manufacture_date"].isNull() & got["expiry_date"].isNull()
    food, only = F.coalesce(category == "food", F.lit(False)), F.size(bare) == 1
    made = F.when(none & ~(only & food), F.get(bare, F.lit(0)))
    expires = F.when(none & only & food, F.get(bare, F.lit(0))).when(none, F.get(bare, F.lit(1)))
    got["manufacture_date"], got["expiry_date"] = F.coalesce(got["manufacture_date"], made), F.coalesce(got["expiry_date"], expires)
    got["mrp"] = F.concat(F.lit("₹"), F.replace(got["mrp"], F.lit(","), F.lit("")))
    for n in ("country_of_origin", "manufacturer", "importer", "consumer_care"):
        got[n] = strip(got[n])
    got["fssai_license"] = F.when(category.isNull() | (category == "food"), got["fssai_license"])
    bis = F.coalesce(got["bis_certification"], capture(text, P.REGION["bis_certification"], 0))
    got["bis_certification"] = F.when(category.isNull() | (category == "electronics"), bis)
    return got
