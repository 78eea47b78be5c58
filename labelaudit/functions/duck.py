"""The same extraction in DuckDB SQL, for the oracle. RE2 has no look-ahead: what a pattern looks ahead for is
always at its end, so a plain group there leaves the first match and its groups as they are."""

from __future__ import annotations

from labelaudit.functions import patterns as P


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cap(x: str, pattern: str, group: int = 1, flags: str = "i") -> str:
    return f"nullif(regexp_extract({x}, {q(f'(?{flags})' + pattern.replace('(?=', '(?:'))}, {group}), '')"


def whole(x: str, pattern: str, flags: str = "i") -> str:
    """The whole match, without what is looked ahead for."""
    body, _, end = pattern.partition("(?=")
    return cap(x, f"({body})(?={end}", 1, flags) if end else cap(x, pattern, 0, flags)


def first(x: str, patterns, group: int = 1, flags: str = "i") -> str:
    return "coalesce(" + ", ".join(cap(x, p, group, flags) for p in patterns) + ")"


def ok(m: str) -> str:
    return f"regexp_matches({m}, '^(0[1-9]|[12][0-9]|3[0-7])[123][0-9]{{11}}$')"


def num(m: str) -> str:
    return f"try_cast(replace({m}, ',', '') AS DOUBLE)"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '\\s+', ' ', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A\\s+|\\s+\\z', '', 'g')"


def title(x: str) -> str:
    """Initial capitals of words separated by one space."""
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def valid(x: str, patterns, good, value=lambda m: m) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {good(value(cap(x, p)))} THEN {value(cap(x, p))} END" for p in patterns) + ")"


def fssai(x: str) -> str:
    return valid(x, [p for p, _ in P.SERVICE_FSSAI], ok)


def price(x: str) -> str:
    return valid(x, [p for p, _ in P.SERVICE_PRICE], lambda v: f"{v} > 0 AND {v} < 100000", num)


def month_date(line: str) -> str:
    flat = f"upper({squeeze(cap(line, '(?:' + P.MONTHS + ')[A-Z]*' + chr(92) + 's*[,' + chr(92) + 's]?' + chr(92) + 'd{2,4}', 0))})"
    return f"CASE WHEN regexp_matches({flat}, '^(?:{P.FULL_MONTHS}) [0-9]{{4}}$') THEN strftime(strptime({flat}, '%B %Y'), '%Y-%m-%d') END"


def first_date(x: str, words: str) -> str:
    lines = f"list_filter(string_split({x}, chr(10)), lambda s: regexp_matches(upper(s), '{words}'))"
    return f"list_filter(list_transform({lines}, lambda s: {month_date('s')}), lambda d: d IS NOT NULL)[1]"


def months(x: str) -> str:
    lines = f"list_filter(string_split({x}, chr(10)), lambda s: regexp_matches(upper(s), '{P.SERVICE_EXPIRES}'))"
    return f"try_cast(list_filter(list_transform({lines}, lambda s: {cap('s', P.SERVICE_SPAN)}), lambda m: m IS NOT NULL)[-1] AS INTEGER)"


def ocr_date(line: str) -> str:
    """ISO form of the first of the four layouts that parses."""
    raw = [squeeze(cap(line, p, 0)) for p in P.OCR_DATES]
    flat = f"regexp_replace({raw[0]}, '[-.]', '/', 'g')"
    year = f"regexp_extract({flat}, '([0-9]+)$', 1)"
    full = f"CASE length({year}) WHEN 4 THEN {flat} WHEN 2 THEN regexp_extract({flat}, '^(.*/)[0-9]+$', 1) || CASE WHEN {year}::INT < 69 THEN '20' ELSE '19' END || {year} END"
    same = " OR ".join(f"regexp_matches({raw[0]}, '^[0-9]+{s}[0-9]+{s}[0-9]+$')" for s in ("/", "-", "[.]"))
    tries = [
        f"CASE WHEN {same} THEN try_strptime({full}, '%d/%m/%Y') END",
        f"try_strptime({raw[1]}, ['%d %b %Y', '%d %B %Y'])",
        f"try_strptime({raw[2]}, ['%b %Y', '%B %Y'])",
        f"try_strptime(replace({raw[3]}, '-', '/'), '%Y/%m/%d')",
    ]
    return "coalesce(" + ", ".join(f"strftime({t}, '%Y-%m-%d')" for t in tries) + ")"


def last_date(x: str, words: str) -> str:
    lines = f"list_filter(string_split({x}, chr(10)), lambda s: regexp_matches(s, {q('(?i)' + words)}))"
    return f"list_filter(list_transform({lines}, lambda s: {ocr_date('s')}), lambda d: d IS NOT NULL)[-1]"


def graded(x: str, patterns, good) -> str:
    """0.9, 0.7 or 0.5 for the confidence of the first pattern whose value is good."""
    level = {"high": 0.9, "medium": 0.7}
    return "CASE " + " ".join(f"WHEN {good(cap(x, p))} THEN {level.get(c, 0.5)}" for p, c in patterns) + " END"


def batch(x: str) -> str:
    m = cap(x, P.SERVICE_BATCH)
    return f"CASE WHEN length({m}) >= 4 THEN {m} END"


def country(x: str) -> str:
    v = title(squeeze(strip(cap(x, P.SERVICE_COUNTRY))))
    return f"CASE WHEN length({v}) BETWEEN 4 AND 50 THEN {v} END"


def declared(x: str, patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim({cap(x, p)}, ' .,-'), '')" for p in patterns) + ")"


def entities_cte(source: str = "listings", text: str = "label_text") -> str:
    """One row per listing with the seven fields the rules read."""
    return f"""
entities AS (
  SELECT *, {fssai('norm')} AS fssai, {price('norm')} AS mrp, {first_date('norm', P.SERVICE_EXPIRES)} AS expiry_date,
         {first_date('norm', P.SERVICE_MADE)} AS manufacturing_date,
         try_cast({first('norm', [p for p, _ in P.SERVICE_WEIGHT])} AS DOUBLE) AS net_weight, {batch('norm')} AS batch, {country('norm')} AS country
  FROM (SELECT *, {text} AS norm FROM {source})
)"""
