"""Text normalisation as column expressions; each takes and gives a string column."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from labelaudit.functions.needs import let, may_match

# Unit spellings and what they become, in the order they are applied.
UNIT_SPELLINGS = (
    (r"\bgms?\b", "g"),
    (r"\bgrm?s?\b", "g"),
    (r"\bkgs?\b", "kg"),
    (r"\bkilos?\b", "kg"),
    (r"\bmls?\b", "ml"),
    (r"\bltrs?\b", "L"),
    (r"\blitres?\b", "L"),
    (r"\bliters?\b", "L"),
)
# Languages that are listed.
LANGUAGES = ("english", "hindi", "tamil", "telugu", "kannada", "marathi", "bengali", "gujarati", "punjabi", "malayalam")
# Characters kept beside letters and numbers, and the Indian scripts.
KEPT = r"\s.,;:!?'\"()\[\]{}\-_/\\@#$%&*+=₹°"
SCRIPTS = r"ऀ-ॿঀ-৿਀-੿଀-୿ఀ-౿ഀ-ൿ"


def strip(x: Column) -> Column:
    return F.trim(x, F.lit(" \t\n\x0b\f\r"))


def numerals(x: Column) -> Column:
    return F.translate(x, "०१२३४५६७८९", "0123456789")


def spaces(x: Column) -> Column:
    """Any run of spaces becomes one; single ones are left alone."""
    return F.regexp_replace(x, " {2,}", " ")


def whitespace(x: Column) -> Column:
    """Any run of tabs and line ends becomes one line end, any run of spaces one space."""
    return strip(spaces(F.regexp_replace(x, r"[\t\r\n\f\x0B]+", "\n")))


def control(x: Column) -> Column:
    return F.regexp_replace(x, r"[\p{C}\p{Z}&&[^\n\r\t ]]", "")


def units(x: Column) -> Column:
    def replaced(t: Column) -> Column:
        for pattern, unit in UNIT_SPELLINGS:
            t = F.regexp_replace(t, "(?i)" + pattern, unit)
        return t

    # a text without any of the spellings is left by every step, so one look is enough for it
    some = "(?i)" + "|".join(pattern for pattern, _ in UNIT_SPELLINGS)
    spelt = [pattern for pattern, _ in UNIT_SPELLINGS]
    return let(x, lambda t: F.when(may_match(t, *spelt) & t.rlike(some), replaced(t)).otherwise(t))


def special(x: Column) -> Column:
    return F.regexp_replace(x, rf"[^{KEPT}{SCRIPTS}\p{{L}}\p{{N}}]", " ")


def cleanup(x: Column) -> Column:
    """One space between words, none before punctuation, one between punctuation and a letter."""
    x = F.regexp_replace(spaces(x), r" ([.,;:!?])", "$1")
    x = F.regexp_replace(x, r"([.,;:!?])([A-Za-z])", "$1 $2")
    return strip(F.regexp_replace(x, r"(?m)^[\s&&[^\n]]+|[\s&&[^\n]]+$", ""))


def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(x: Column) -> Column:
    return F.pandas_udf(_composed, StringType())(x)


def normalise(x: Column, compose: bool = True, lowercase: bool = False) -> Column:
    """The whole chain. `compose` runs NFKC, for which Spark has no function; leave it out for ASCII text."""
    x = F.coalesce(x, F.lit(""))
    x = nfkc(x) if compose else x
    x = special(units(control(whitespace(numerals(x)))))
    return cleanup(F.lower(x) if lowercase else x)


def comparable(x: Column, compose: bool = True) -> Column:
    x = F.regexp_replace(normalise(x, compose, lowercase=True), r"(?U)[^\w\s]", "")
    return strip(F.regexp_replace(x, r"\s+", " "))


def sentences(x: Column) -> Column:
    """Pieces after . ! ? and white space, and after line ends, without empty ones."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?U)\b\w+\b"), F.lit(0))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def squeeze_lines(x: Column) -> Column:
    """OCR clean-up: runs of spaces and tabs to a space, of line ends to one."""
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{2,}", "\n"))


def strip_markup(x: Column) -> Column:
    """Display clean-up: drop {...} blocks, blank lines and lines that begin with key: or key=."""
    lines = F.split(F.regexp_replace(x, r"\{[^}]*\}", ""), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike(r"^\w+\s*[:=]")), "\n")


# --- the same in DuckDB, for the oracle -------------------------------------------------------


def _sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"


def sql_strip(x: str) -> str:
    return _sub(x, r"\A\s+|\s+\z", "")


def sql_whitespace(x: str) -> str:
    return sql_strip(f"regexp_replace(regexp_replace({x}, '[\\t\\r\\n\\f\\x0B]+', chr(10), 'g'), ' +', ' ', 'g')")


def sql_units(x: str) -> str:
    for pattern, unit in UNIT_SPELLINGS:
        x = _sub(x, "(?i)" + pattern, unit)
    return x


def sql_special(x: str) -> str:
    return _sub(x, rf"[^{KEPT}{SCRIPTS}\p{{L}}\p{{N}}]", " ")


def sql_cleanup(x: str) -> str:
    x = _sub(_sub(x, " +", " "), r" ([.,;:!?])", r"\1")
    x = _sub(x, r"([.,;:!?])([A-Za-z])", r"\1 \2")
    return sql_strip(_sub(x, r"(?m)^[ \t\r\f]+|[ \t\r\f]+$", ""))


def sql_normalise(x: str) -> str:
    """For text without composed forms, control characters and foreign numerals."""
    return sql_cleanup(sql_special(sql_units(sql_whitespace(f"coalesce({x}, '')"))))


def _compatible() -> dict[str, str]:
    """The characters that compatibility decomposition alone replaces, by Python's tables."""
    forms = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xA0, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return {c: k for c, k in forms if k != c and unicodedata.normalize("NFC", c) == c}


def sql_nfkc(x: str) -> str:
    """NFC of the text with those characters replaced, which is NFKC; looked up only in texts that hold one."""
    table = _compatible()
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    held = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in table) + "]"
    keys, values = (", ".join(map(quoted, part)) for part in (table.keys(), table.values()))
    mapped = f"array_to_string(list_transform(string_split({x}, ''), lambda c: coalesce(map([{keys}], [{values}])[c], c)), '')"
    return f"nfc_normalize(CASE WHEN regexp_matches({x}, {quoted(held)}) THEN {mapped} ELSE {x} END)"


def sql_whole(x: str, lowercase: bool = False) -> str:
    """The whole chain."""
    x = f"translate({x}, '०१२३४५६७८९', '0123456789')"
    x = rf"regexp_replace({sql_whitespace(x)}, '([\n\r\t ])|[\p{{C}}\p{{Z}}]', '\1', 'g')"
    x = sql_special(sql_units(x))
    return sql_cleanup(f"lower({x})" if lowercase else x)


def sql_comparable(x: str) -> str:
    return sql_strip(_sub(_sub(sql_whole(x, True), r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s]", ""), r"\s+", " "))
