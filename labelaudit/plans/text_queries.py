"""Text functions and the extraction dialects over listings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.functions import duck as D
from labelaudit.functions import extract as E
from labelaudit.functions import patterns as P
from labelaudit.functions import text as X
from labelaudit.operators import declarations as L
from labelaudit.operators import scoring as S
from labelaudit.operators.audits import extracted, once
from labelaudit.plans.registry import query
from labelaudit.plans.views import LISTINGS
from labelaudit.sources.tables import listings, table

T = F.col


def docs(spark, d):
    return table(spark, d, "documents")


# --- text functions on documents: name -> (column, SQL) -------------------------------------------------

_TEXT = {
    "tn_numerals": (lambda t: X.numerals(t), "translate(text, '०१२३४५६७८९', '0123456789')"),
    "tn_whitespace": (lambda t: X.whitespace(t), X.sql_whitespace("text")),
    "tn_units": (lambda t: X.units(t), X.sql_units("text")),
    "tn_special": (lambda t: X.special(t), X.sql_special("text")),
    "tn_cleanup": (lambda t: X.cleanup(t), X.sql_cleanup("text")),
    "tn_control": (lambda t: X.control(t), "regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g')"),
    "bo_clean": (lambda t: X.squeeze_lines(t), X.sql_strip("regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{2,}', chr(10), 'g')")),
}
for _name, (_column, _sql) in _TEXT.items():
    query(_name, f"SELECT doc_id, md5({_sql}) AS digest FROM documents")(lambda spark, d, c=_column: docs(spark, d).select("doc_id", F.md5(c(T("text"))).alias("digest")))


@query("nm_counts", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INTEGER AS word_count, length(text)::INTEGER AS char_count FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", X.word_count(T("text")).alias("word_count"), F.length("text").alias("char_count"))


_FORMS = f"WITH n AS MATERIALIZED (SELECT doc_id, {X.sql_nfkc("coalesce(text, '')")} AS t FROM documents)"


@query("tn_normalize", _FORMS + f" SELECT doc_id, md5({X.sql_whole('t')}) AS digest FROM n")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.normalise(T("text"))).alias("digest"))


@query("tn_compare", _FORMS + f" SELECT doc_id, md5({X.sql_comparable('t')}) AS digest FROM n")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.comparable(T("text"))).alias("digest"))


@query(
    "tn_sentences",
    r"""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), '\n+'),
        lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''))::INTEGER AS sentences FROM documents""",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.sentences(T("text"))).alias("sentences"))


@query("tn_tokenize", "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+'))::INTEGER AS words FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.words(T("text"))).alias("words"))


@query(
    "ui_clean_ocr",
    LISTINGS
    + r""" SELECT audit_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(label_text, '\{[^}]*\}', '', 'g'), chr(10)), lambda s: trim(s)),
     lambda s: s <> '' AND NOT regexp_matches(s, '^\w+\s*[:=]')), chr(10))) AS digest FROM listings""",
)
def _(spark, d):
    return listings(spark, d).select("audit_id", F.md5(X.strip_markup(T("label_text"))).alias("digest"))


# --- service dialect -------------------------------------------------------------------------------------


def _on(name: str, sql: str | None, *columns):
    """A query over the label texts; SQL columns are over label_text."""
    query(name, None if sql is None else LISTINGS + f" SELECT audit_id, {sql} FROM listings")(
        lambda spark, d: listings(spark, d).select("audit_id", *[c(T("label_text")) for c in columns])
    )


_on("ee_fssai", f"{D.fssai('label_text')} AS value, substr({D.fssai('label_text')}, 1, 2) AS state_code", lambda t: E.fssai(t)["value"].alias("value"), lambda t: E.fssai(t)["state_code"].alias("state_code"))
_on(
    "ee_price",
    f"{D.price('label_text')} AS value, format('₹{{:,.2f}}', {D.price('label_text')}) AS formatted",
    lambda t: E.price(t)["value"].alias("value"),
    lambda t: E.price(t)["formatted"].alias("formatted"),
)
_W = D.first("label_text", [p for p, _ in P.SERVICE_WEIGHT])
_on("ee_weight", f"{_W}::DOUBLE AS value, lower({D.first('label_text', [p for p, _ in P.SERVICE_WEIGHT], 2)}) AS unit", lambda t: E.weight(t)["value"].alias("value"), lambda t: E.weight(t)["unit"].alias("unit"))
_on(
    "ee_dates",
    f"{D.first_date('label_text', P.SERVICE_MADE)} AS made, {D.first_date('label_text', P.SERVICE_EXPIRES)} AS expires, coalesce({D.months('label_text')}, 0) AS months",
    lambda t: E.dates(t)["manufacturing_date"]["parsed"].alias("made"),
    lambda t: E.dates(t)["expiry_date"]["parsed"].alias("expires"),
    lambda t: F.coalesce(E.dates(t)["best_before_months"], F.lit(0)).alias("months"),
)
_on("ee_batch", f"{D.batch('label_text')} AS batch", lambda t: E.batch(t).alias("batch"))
_on("ee_country", f"{D.country('label_text')} AS country", lambda t: E.country(t).alias("country"))
_A = [f"trim({D.squeeze(D.strip(D.cap('label_text', p, 1, 'is')))})" for p in P.SERVICE_ADDRESS]
_A = [f"regexp_replace({a}, '\\A[.,;]+|[.,;]+\\z', '', 'g')" for a in _A]
_on("ee_address", "coalesce(" + ", ".join(f"CASE WHEN length({a}) > 20 THEN {a} END" for a in _A) + ") AS address", lambda t: E.address(t).alias("address"))


@query("ee_contact", "SELECT doc_id, " + D.cap("text", P.SERVICE_EMAIL) + " AS email, coalesce(" + ", ".join(
    f"CASE WHEN length(regexp_replace({D.cap('text', p)}, '[\\s\\-()]', '', 'g')) >= 10 THEN regexp_replace({D.cap('text', p)}, '[\\s\\-()]', '', 'g') END" for p in reversed(P.SERVICE_PHONE)
) + ") AS phone FROM documents")
def _(spark, d):
    c = E.contact(T("text"))
    return docs(spark, d).select("doc_id", c["email"].alias("email"), c["phone"].alias("phone"))


def _address_sql(x: str) -> str:
    tries = [f"regexp_replace(trim({D.squeeze(D.strip(D.cap(x, p, 1, 'is')))}), '\\A[.,;]+|[.,;]+\\z', '', 'g')" for p in P.SERVICE_ADDRESS]
    return "coalesce(" + ", ".join(f"CASE WHEN length({a}) > 20 THEN {a} END" for a in tries) + ")"


def _contact_sql(x: str) -> str:
    phones = [f"regexp_replace({D.cap(x, p)}, '[\\s\\-()]', '', 'g')" for p in P.SERVICE_PHONE]
    return "(" + " OR ".join([f"coalesce(length({p}) >= 10, false)" for p in phones] + [f"{D.cap(x, P.SERVICE_EMAIL)} IS NOT NULL"]) + ")"


def _confidence_sql(x: str) -> str:
    """Six confidences, null where the entity is missing."""
    parts = {
        "c_fssai": D.graded(x, P.SERVICE_FSSAI, D.ok),
        "c_price": D.graded(x, P.SERVICE_PRICE, lambda m: f"{D.num(m)} > 0 AND {D.num(m)} < 100000"),
        "c_weight": D.graded(x, P.SERVICE_WEIGHT, lambda m: f"{m} IS NOT NULL"),
        "c_batch": f"CASE WHEN {D.batch(x)} IS NOT NULL THEN 0.9 END",
        "c_address": f"CASE WHEN {_address_sql(x)} IS NOT NULL THEN 0.7 END",
        "c_country": f"CASE WHEN {D.country(x)} IS NOT NULL THEN 0.9 END",
    }
    return ", ".join(f"({e})::DOUBLE AS {n}" for n, e in parts.items())


_PARTS = ("c_fssai", "c_price", "c_weight", "c_batch", "c_address", "c_country")
_KNOWN = "(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in _PARTS) + ")"
_MEAN = f"(CASE WHEN {_KNOWN} = 0 THEN 0.5 ELSE round((" + " + ".join(f"coalesce({c}, 0)" for c in _PARTS) + f") / {_KNOWN}, 4) END)::DOUBLE"


@query(
    "nlp_analyze",
    LISTINGS
    + f""", n AS (SELECT audit_id, {X.sql_normalise('label_text')} AS norm FROM listings),
    e AS (SELECT audit_id, norm, {_confidence_sql('norm')}, {_contact_sql('norm')} AS contact, """
    + ", ".join(f"({D.first('norm', ps, 1, 'is')} IS NOT NULL)::INT AS l_{n}" for n, (_, ps) in P.LABEL.items())
    + f""" FROM n), s AS (SELECT *, {' + '.join('l_' + n for n in P.LABEL)} AS patterns_matched, {' + '.join('l_' + n for n, (need, _) in P.LABEL.items() if need)} AS required_found FROM e)
    SELECT audit_id, round(({_KNOWN} + contact::INT + 1) / 8.0 * 100, 1)::DOUBLE AS completeness, {_MEAN} AS confidence,
           len(list_filter(regexp_split_to_array(norm, '\\s+'), lambda w: w <> ''))::INTEGER AS word_count, length(norm)::INTEGER AS char_count,
           13 AS total_patterns, patterns_matched, round(patterns_matched / 13.0 * 100, 1)::DOUBLE AS match_percentage, 7 AS required_total, required_found,
           7 - required_found AS required_missing, required_found = 7 AS compliant FROM s""",
)
def _(spark, d):
    """Entities, label summary, completeness, confidence and counts of each normalised listing."""
    norm = extracted(listings(spark, d).select("audit_id", "label_text"), norm=X.normalise(T("label_text"), compose=False))
    found = extracted(norm, entities=E.entities(T("norm")), labels=F.struct(*E.label_values(T("norm"))))
    values = {n: T("labels")[n] for n in P.LABEL}
    return found.select(
        "audit_id",
        E.completeness(T("entities")).alias("completeness"),
        E.confidence(T("entities")).alias("confidence"),
        X.word_count(T("norm")).alias("word_count"),
        F.length("norm").alias("char_count"),
        *E.label_summary(values),
    )


@query("agg_confidence", LISTINGS + f" SELECT audit_id, {_MEAN} AS confidence FROM (SELECT audit_id, {_confidence_sql('label_text')} FROM listings)")
def _(spark, d):
    found = once(listings(spark, d).select("audit_id", "label_text"), entities=E.entities(T("label_text")))
    return found.select("audit_id", E.confidence(T("entities")).alias("confidence"))


# --- pattern dialect --------------------------------------------------------------------------------------

for _name in P.LABEL:
    _on(f"pm_{_name}", f"{D.first('label_text', P.LABEL[_name][1], 1, 'is')} AS value", lambda t, n=_name: E.label_value(t, n).alias("value"))

_FOUND = {n: f"({D.first('label_text', ps, 1, 'is')} IS NOT NULL)::INT" for n, (_, ps) in P.LABEL.items()}
_NEEDED = [n for n, (needed, _) in P.LABEL.items() if needed]
PM = LISTINGS + ", m AS (SELECT audit_id, " + ", ".join(f"{e} AS {n}" for n, e in _FOUND.items()) + " FROM listings)"


def labelled(spark, d):
    found = once(listings(spark, d).select("audit_id", "label_text"), labels=F.struct(*E.label_values(T("label_text"))))
    return found, {n: T("labels")[n] for n in P.LABEL}


@query(
    "agg_pattern_summary",
    PM
    + f""", s AS (SELECT audit_id, {' + '.join(_FOUND)} AS patterns_matched, {' + '.join(_NEEDED)} AS required_found FROM m)
    SELECT audit_id, 13 AS total_patterns, patterns_matched, round(patterns_matched / 13.0 * 100, 1)::DOUBLE AS match_percentage, 7 AS required_total, required_found,
           7 - required_found AS required_missing, required_found = 7 AS compliant FROM s""",
)
def _(spark, d):
    found, values = labelled(spark, d)
    return found.select("audit_id", *E.label_summary(values))


@query("join_missing_req", PM + " SELECT audit_id, concat_ws(',', " + ", ".join(f"CASE WHEN {n} = 0 THEN '{n}' END" for n in _NEEDED) + ") AS missing FROM m")
def _(spark, d):
    found, values = labelled(spark, d)
    return found.select("audit_id", F.array_join(E.missing_required(values), ",").alias("missing"))


@query(
    "pm_custom",
    LISTINGS + " SELECT audit_id, regexp_matches(label_text, '(?is)Batch No: (B\\d+)') AS found_0, nullif(regexp_extract(label_text, '(?is)Batch No: (B\\d+)', 1), '') AS value_0, regexp_matches(label_text, '(?is)steel') AS found_1 FROM listings",
)
def _(spark, d):
    c = E.custom_patterns(T("label_text"), [r"Batch No: (B\d+)", "steel", "("])
    return listings(spark, d).select("audit_id", c[0]["found"].alias("found_0"), c[0]["value"].alias("value_0"), c[1]["found"].alias("found_1"))


# --- OCR dialect --------------------------------------------------------------------------------------------

_on(
    "fx_fssai",
    f"coalesce({D.valid('label_text', P.OCR_FSSAI, D.ok)}, list_filter(regexp_extract_all(label_text, '\\b([0-9]{{14}})\\b', 1), lambda m: {D.ok('m')})[1]) AS value",
    lambda t: E.ocr_fssai(t)["value"].alias("value"),
)
_on("fx_mrp", f"{D.valid('label_text', P.OCR_MRP, lambda v: f'{v} > 0 AND {v} < 100000', D.num)} AS value", lambda t: E.ocr_mrp(t)["value"].alias("value"))
_OW = D.first("label_text", P.OCR_WEIGHT)
_on("fx_weight", f"{_OW}::DOUBLE AS value", lambda t: E.weight(t, [(p, "high") for p in P.OCR_WEIGHT])["value"].alias("value"))
_B = [D.cap("label_text", p) for p in P.OCR_BATCH]
_on("fx_batch", "coalesce(" + ", ".join(f"CASE WHEN length({b}) >= 4 THEN {b} END" for b in _B) + ") AS batch", lambda t: E.ocr_batch(t).alias("batch"))
_C = [D.title(D.squeeze(D.strip(D.cap("label_text", p)))) for p in P.OCR_COUNTRY]
_on("fx_country", "coalesce(" + ", ".join(f"CASE WHEN length({c}) >= 4 THEN {c} END" for c in _C) + ") AS country", lambda t: E.ocr_country(t).alias("country"))


@query("fx_care", "SELECT doc_id, coalesce(" + ", ".join(
    f"CASE WHEN length(regexp_replace({D.cap('text', p)}, '[\\s\\-]', '', 'g')) >= 10 THEN regexp_replace({D.cap('text', p)}, '[\\s\\-]', '', 'g') END" for p in P.OCR_CARE
) + ") AS phone FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", E.ocr_care(T("text"))["value"].alias("phone"))


def _allergens_sql(x: str) -> str:
    tries = [f"list_filter(list_transform(regexp_split_to_array({D.strip(D.cap(x, p))}, '[,;&]'), lambda a: lower({D.strip('a')})), lambda a: a <> '')" for p in P.OCR_ALLERGENS]
    return "coalesce(" + ", ".join(f"CASE WHEN len({t}) > 0 THEN {t} END" for t in tries) + ")"


def _care_sql(x: str) -> str:
    tries = [f"regexp_replace({D.cap(x, p)}, '[\\s\\-]', '', 'g')" for p in P.OCR_CARE]
    return "coalesce(" + ", ".join(f"CASE WHEN length({v}) >= 10 THEN {v} END" for v in tries) + ")"


@query("fx_allergens", f"SELECT doc_id, array_to_string({_allergens_sql('text')}, '|') AS allergens FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(E.ocr_allergens(T("text")), "|").alias("allergens"))


_MADE, _EXPIRES = D.last_date("label_text", P.OCR_MADE), D.last_date("label_text", P.OCR_EXPIRES)


@query(
    "fx_dates",
    LISTINGS
    + f", f AS (SELECT audit_id, label_text, {_MADE} AS made, {_EXPIRES} AS expires FROM listings)"
    + f" SELECT audit_id, made, expires, CASE WHEN made IS NOT NULL AND expires IS NULL THEN try_cast({D.cap('label_text', P.OCR_SHELF_LIFE)} AS INTEGER) END AS months FROM f",
)
def _(spark, d):
    t = E.ocr_dates(T("label_text"))
    return listings(spark, d).select("audit_id", t["manufacturing_date"].alias("made"), t["expiry_date"].alias("expires"), t["shelf_life_months"].alias("months"))


_NINE = {
    "fssai": f"coalesce({D.valid('label_text', P.OCR_FSSAI, D.ok)}, list_filter(regexp_extract_all(label_text, '\\b([0-9]{{14}})\\b', 1), lambda m: {D.ok('m')})[1])",
    "mrp": D.valid("label_text", P.OCR_MRP, lambda v: f"{v} > 0 AND {v} < 100000", D.num),
    "weight": _OW,
    "batch": "coalesce(" + ", ".join(f"CASE WHEN length({b}) >= 4 THEN {b} END" for b in _B) + ")",
    "country": "coalesce(" + ", ".join(f"CASE WHEN length({c}) >= 4 THEN {c} END" for c in _C) + ")",
    "care": _care_sql("label_text"),
    "allergens": _allergens_sql("label_text"),
    "made": _MADE,
    "expires": _EXPIRES,
}


@query(
    "fx_all",
    LISTINGS
    + f", f AS (SELECT audit_id, {' + '.join(f'(({e}) IS NOT NULL)::INT' for e in _NINE.values())} AS n FROM listings)"
    + " SELECT audit_id, n AS fields_found, 9 - n AS fields_missing, round(n / 9.0 * 100, 1)::DOUBLE AS completeness FROM f",
)
def _(spark, d):
    found = extracted(listings(spark, d).select("audit_id", "label_text"), f=E.ocr_fields(T("label_text")))
    n = E.ocr_found(T("f"))
    return found.select("audit_id", n.alias("fields_found"), (9 - n).alias("fields_missing"), F.round(n / 9.0 * 100, 1).alias("completeness"))


# --- declarations ---------------------------------------------------------------------------------------------

_UNIVERSAL = {n: D.declared("label_text", ps) for n, ps in P.UNIVERSAL.items()}
_UNIVERSAL["country_of_origin"] = D.title(_UNIVERSAL["country_of_origin"])
_on("fi_universal", ", ".join(f"{e} AS {n}" for n, e in _UNIVERSAL.items()), *[lambda t, n=n: E.universal(t)[n].alias(n) for n in _UNIVERSAL])
for _pack, _fields in E.PACK_FIELDS.items():
    _on(f"fi_{_pack}", ", ".join(f"{D.declared('label_text', ps)} AS {n}" for n, ps in _fields.items()), *[lambda t, ps=ps, n=n: E.declared(t, ps).alias(n) for n, ps in _fields.items()])
_QTY = D.declared("label_text", P.UNIVERSAL["net_quantity"])
_on("fi_unit_valid", f"coalesce(regexp_matches({_QTY}, {D.q('(?i)' + P.SI_UNITS)}), false) AS unit_valid", lambda t: E.universal(t)["net_quantity_unit_valid"].alias("unit_valid"))
_on(
    "fi_prohibited",
    "array_to_string(list_filter([" + ", ".join(f"'{w}'" for w in P.PROHIBITED) + f"], lambda w: contains(lower({D.declared('label_text', (P.NET_QUANTITY_RAW,))}), w)), ',') AS words",
    lambda t: F.array_join(F.coalesce(E.universal(t)["net_quantity_prohibited_expressions"], F.array().cast("array<string>")), ",").alias("words"),
)


def _declared_sql() -> dict[str, str]:
    out = dict(_UNIVERSAL)
    for n in dict.fromkeys(n for pack in E.PACK_FIELDS.values() for n in pack):
        found = {c: D.declared("label_text", pack[n]) for c, pack in E.PACK_FIELDS.items() if n in pack}
        of = "CASE category " + " ".join(f"WHEN '{c}' THEN {found.get(c, 'NULL')}" for c in E.PACK_FIELDS)
        out[n] = of + " ELSE coalesce(" + ", ".join(found.values()) + ") END"
    return out


DECLARED = LISTINGS + ", declared AS (SELECT audit_id, category, label_text, " + ", ".join(f"{e} AS {n}" for n, e in _declared_sql().items()) + " FROM listings)"
_IMPORTED, _APPLIANCE = f"regexp_matches(lower(label_text), {D.q(P.IMPORTED)})", f"regexp_matches(lower(label_text), {D.q(P.APPLIANCE)})"


def declared(spark, d):
    """Listings with their declared fields, each computed once."""
    rows = listings(spark, d).select("audit_id", "category", "label_text")
    names = E.declarations(T("label_text"), T("category"))
    return once(rows, **names), {n: T(n) for n in names}


_ALL = list(_declared_sql())


@query("fi_all", DECLARED + f" SELECT audit_id, {', '.join(_ALL)} FROM declared")
def _(spark, d):
    return declared(spark, d)[0].select("audit_id", *_ALL)


def _pack_rows() -> str:
    rows = []
    for name, (prefix, rules) in L.PACKS.items():
        for number, field, when, penalty in rules:
            if when != "never":
                absent = f"{field} IS NULL" if field in _ALL else "true"
                need = {"always": "true", "imported": _IMPORTED, "appliance": _APPLIANCE}[when]
                mine = f"category = '{name}'" if name != "generic" else "category NOT IN ('food', 'electronics', 'cosmetics')"
                rows.append(f"SELECT audit_id, '{prefix}-{number}' AS code, {penalty} AS penalty FROM declared WHERE {mine} AND {need} AND {absent}")
    return " UNION ALL ".join(rows)


@query("vs_pack", DECLARED.replace("declared AS (", "declared AS MATERIALIZED (") + " " + _pack_rows())
def _(spark, d):
    rows = listings(spark, d).select("audit_id", "category", "label_text")
    names = L.asked(E.declarations(T("label_text"), T("category")), T("label_text"), T("category"))
    return extracted(rows, **names).select("audit_id", F.explode(L.pack_violations({n: T(n) for n in names}, T("label_text"), T("category"))).alias("v")).select("audit_id", "v.code", "v.penalty")


_ASKED = D.num(D.cap("lower(label_text)", r"(?:selling\s*price|sale\s*price|price|offer\s*price|our\s*price)\s*[:\-₹rs\.]*\s*([0-9,]+(?:\.[0-9]+)?)"))
_PRINTED = f"try_cast({D.cap('replace(mrp_inclusive_of_taxes, chr(44), chr(32)[2:])', r'([0-9]+(?:\.[0-9]+)?)')} AS DOUBLE)"
_FURTHER = {
    "007": "common_generic_name IS NULL",
    "008": "manufacturer_address IS NULL",
    "009": f"{_IMPORTED} AND importer_address IS NULL",
    "010": f"NOT coalesce(regexp_matches(net_quantity, {D.q('(?i)' + P.SI_UNITS)}), false)",
    "011": "len(list_filter([" + ", ".join(f"'{w}'" for w in P.PROHIBITED) + f"], lambda w: contains(lower({D.declared('label_text', (P.NET_QUANTITY_RAW,))}), w))) > 0",
    "012": "mrp_inclusive_of_taxes IS NOT NULL AND NOT regexp_matches(lower(mrp_inclusive_of_taxes), 'incl|all taxes|taxes included|₹|rs')",
    "013": f"coalesce({_ASKED} > {_PRINTED}, false)",
}


@query(
    "vs_extra",
    DECLARED.replace("declared AS (", "declared AS MATERIALIZED (")
    + " "
    + " UNION ALL ".join(f"SELECT audit_id, 'LM-AUD-{n}' AS code, {L.FURTHER[n]} AS penalty FROM declared WHERE {test}" for n, test in _FURTHER.items()),
)
def _(spark, d):
    rows, fields = declared(spark, d)
    return rows.select("audit_id", F.explode(L.further_violations(fields, T("label_text"))).alias("v")).select("audit_id", "v.code", "v.penalty")


_FURTHER_ROWS = " UNION ALL ".join(f"SELECT audit_id, 'LM-AUD-{n}' AS code, {L.FURTHER[n]} AS penalty FROM declared WHERE {test}" for n, test in _FURTHER.items())


@query(
    "vs_score",
    DECLARED.replace("declared AS (", "declared AS MATERIALIZED (")
    + f""", b AS ({_pack_rows()} UNION ALL {_FURTHER_ROWS}), s AS (SELECT audit_id, count(*)::INTEGER AS violations, sum(penalty) AS penalty FROM b GROUP BY audit_id),
    p AS (SELECT audit_id, coalesce(violations, 0) AS violations, greatest(0, 100 - coalesce(penalty, 0))::INTEGER AS score FROM declared LEFT JOIN s USING (audit_id))
    SELECT audit_id, violations, score, CASE WHEN score >= 85 THEN 'Compliant' WHEN score >= 60 THEN 'Moderate Risk' ELSE 'High Risk' END AS risk FROM p""",
)
def _(spark, d):
    """The legacy path whole: declarations, pack and further checks, score, risk."""
    rows, fields = declared(spark, d)
    found = once(rows, v=F.concat(L.pack_violations(fields, T("label_text"), T("category")), L.further_violations(fields, T("label_text"))))
    score = S.penalty_score(F.transform("v", lambda x: x["penalty"]))
    return found.select("audit_id", F.size("v").alias("violations"), score.alias("score"), S.legacy_risk(score).alias("risk"))


_on("vs_flags", f"{_IMPORTED} AS imported, {_APPLIANCE} AS appliance", lambda t: L.imported(t).alias("imported"), lambda t: L.appliance(t).alias("appliance"))


def _detect_sql(x: str) -> str:
    n = {c: "(" + " + ".join(f"contains(lower({x}), '{w}')::INT" for w in words) + ")" for c, words in P.CATEGORY_KEYWORDS.items()}
    best = f"greatest({', '.join(n.values())})"
    return f"CASE WHEN {best} = 0 THEN 'generic' " + " ".join(f"WHEN {e} = {best} THEN '{c}'" for c, e in n.items()) + " END"


_on("vs_detect", f"{_detect_sql('label_text')} AS detected", lambda t: E.detect_category(t).alias("detected"))


# --- simple dialect ---------------------------------------------------------------------------------------------

_v, _u = D.cap("label_text", P.SIMPLE["quantity"]) + "::DOUBLE", f"lower({D.cap('label_text', P.SIMPLE['quantity'], 2)})"
_b = f"CASE WHEN {_u} IN ('kg', 'l', 'litre', 'litres') THEN {_v} * 1000 ELSE {_v} END"
SIMPLE_SQL = {
    "mrp": f"'INR ' || replace({D.cap('label_text', P.SIMPLE['mrp'])}, ',', '')",
    "quantity": f"CASE WHEN {_v} IS NOT NULL THEN concat_ws(' ', CASE WHEN {_b} = floor({_b}) THEN floor({_b})::BIGINT::VARCHAR ELSE ({_b})::VARCHAR END, CASE WHEN {_u} IN ('kg', 'g', 'gram', 'grams') THEN 'grams' ELSE 'ml' END) END",
    "manufacturer": f"trim({D.cap('label_text', P.SIMPLE['manufacturer'])})",
    "country_of_origin": D.title(f"trim({D.cap('label_text', P.SIMPLE['country_of_origin'])})"),
}
_on("bn_extract", ", ".join(f"{e} AS {n}" for n, e in SIMPLE_SQL.items()), *[lambda t, n=n: E.simple_fields(t)[n].alias(n) for n in SIMPLE_SQL])


@query(
    "bre_evaluate",
    LISTINGS
    + ", s AS (SELECT audit_id, "
    + ", ".join(f"{e} AS {n}" for n, e in SIMPLE_SQL.items())
    + """ FROM listings), p AS (SELECT audit_id, 100 - 20 * (mrp IS NULL)::INT - 20 * (quantity IS NULL)::INT - 20 * (manufacturer IS NULL)::INT - 10 * (country_of_origin IS NULL)::INT AS score FROM s)
    SELECT audit_id, score, CASE WHEN score >= 85 THEN 'Compliant' WHEN score >= 60 THEN 'Moderate Risk' ELSE 'High Risk' END AS risk FROM p""",
)
def _(spark, d):
    rows = once(listings(spark, d).select("audit_id", "label_text"), **E.simple_fields(T("label_text")))
    found = once(rows, v=S.simple_violations({n: T(n) for n in SIMPLE_SQL}))
    score = S.penalty_score(F.transform("v", lambda x: x["penalty"]))
    return found.select("audit_id", score.alias("score"), S.legacy_risk(score).alias("risk"))
