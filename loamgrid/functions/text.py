"""Column expressions for text, digits and numbers in mixed Khmer and Latin tables.

Java's ``\\d``, ``\\s`` and ``\\w`` are ASCII unless ``(?U)`` is set; every
pattern here that must see other scripts sets it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digits of the Khmer script in order.
KHMER_DIGITS = "០១២៣៤៥៦៧៨៩"
#: Blocks that cannot occur in these documents (Sinhala, Thai, Lao, Myanmar, Arabic, CJK, Kana).
FOREIGN = r"[\x{0D80}-\x{0DFF}\x{0E00}-\x{0E7F}\x{0E80}-\x{0EFF}\x{1000}-\x{109F}\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]"
#: Khmer bases, marks other than the subscript sign, and the subscript sign.
BASE = r"\x{1780}-\x{17B3}"
MARKS = r"\x{17B4}-\x{17D1}\x{17D3}\x{17DD}"
COENG = r"\x{17D2}"
#: Fixed value: characters removed from training labels besides what normalisation removes.
INVISIBLE = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}]"


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def collapse_ws(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return trim_ws(F.regexp_replace(c, r"(?U)\s+", " "))


def nfc(c: Column) -> Column:
    """Canonical composition; Spark has no built-in for it. Made on call: workers import this module without a session."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return compose(c)


def normalize(c: Column) -> Column:
    """Canonical composition, then collapsed white space."""
    return collapse_ws(nfc(c))


#: Marks by the place they take after their base: robat, shifters, vowels; a subscript pair comes before, all else after.
_PLACES = ((2, r"\x{17CC}"), (3, r"\x{17C9}\x{17CA}"), (4, r"\x{17B4}-\x{17C5}"))


def reordered(c: Column) -> Column:
    """Marks after a base in canonical order; a subscript sign and its base are one unit, and equal places keep their order."""
    unit = rf"{COENG}[{BASE}]?|[{MARKS}]"
    cluster = rf"[{BASE}](?:{unit}){{1,200}}+"
    place = lambda u: F.when(u.startswith("\u17d2"), 1).otherwise(_chosen([(u.rlike(f"^[{marks}]"), at) for at, marks in _PLACES], 5))
    units = lambda x: F.array_sort(F.transform(F.regexp_extract_all(F.substring(x, F.lit(2), F.length(x)), F.lit(unit), F.lit(0)), lambda u, i: F.struct(place(u).alias("place"), i.alias("i"), u.alias("u"))))
    sorted_cluster = lambda x: F.concat(F.substring(x, 1, 1), F.array_join(F.transform(units(x), lambda u: u["u"]), ""))
    found = F.regexp_extract_all(c, F.lit(cluster), F.lit(0))
    between = F.split(c, cluster, -1)
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("b"), found.alias("x"))
    joined = F.concat(F.array_join(F.transform(pairs, lambda p: F.concat(p["b"], sorted_cluster(p["x"]))), ""), F.element_at(between, -1))
    return F.when(F.size(found) > 0, joined).otherwise(c)


def _chosen(cases: list[tuple[Column, int]], default: int) -> Column:
    out = F.lit(default)
    for when, value in reversed(cases):
        out = F.when(when, value).otherwise(out)
    return out


def clean_khmer(c: Column, reorder: bool = False) -> Column:
    """Composed text without zero-width and soft-hyphen characters, doubled marks or doubled blanks; newlines stay."""
    out = F.regexp_replace(nfc(c), r"[\x{200B}\x{FEFF}\x{00AD}]", "")
    out = reordered(out) if reorder else out
    out = F.regexp_replace(out, rf"([{MARKS}{COENG}])\1+", "$1")
    return trim_ws(F.regexp_replace(out, r"(?U)[^\S\n]+", " "))


def fold_digits(c: Column) -> Column:
    return F.translate(c, KHMER_DIGITS, "0123456789")


def cell_text(lines: Column) -> Column:
    """Text of a cell from its lines: the non-empty ones, space between."""
    return trim_ws(F.array_join(F.filter(F.transform(lines, lambda x: x["text"]), lambda x: x != ""), " "))


def strip_foreign(c: Column) -> Column:
    """Without characters of foreign scripts; text that has none is unchanged to the last blank."""
    bare = F.regexp_replace(c, FOREIGN, "")
    return F.when(F.length(bare) == F.length(c), c).otherwise(F.trim(F.regexp_replace(bare, " {2,}", " ")))


def foreign_count(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, FOREIGN, ""))


def anomaly_score(c: Column) -> Column:
    """Share of foreign characters among those that are not white space; 0 without any."""
    solid = F.length(F.regexp_replace(c, r"(?U)\s", ""))
    return F.when(solid == 0, F.lit(0.0)).otherwise(foreign_count(c) / solid)


def cell_rules(c: Column) -> Column:
    """Repairs of whole cells: misread currency units, and percentages with Khmer digits."""
    # The misread units and the shape of a percentage.
    unit = r"^[អ#វ]/?(គ\.ក|គ្រាប់|ផ្លែ)\z"
    weight = r"^[អ#វ]/?គ[ៈ:]\.?ក\z"
    percent = rf"^[+-]?[0-9{KHMER_DIGITS}]+([.,][0-9{KHMER_DIGITS}]+)?%\z"
    return F.when(c.rlike(unit), F.regexp_replace(c, unit, "៛/$1")).when(c.rlike(weight), F.lit("៛/គ.ក")).when(c.rlike(percent), fold_digits(c)).otherwise(c)


def stage_text(c: Column) -> Column:
    """A cell's or block's text cleaned, without foreign scripts, its units repaired and grid-line noise emptied, in this order."""
    return strip_noise(cell_rules(strip_foreign(clean_khmer(c))))


def strip_noise(c: Column) -> Column:
    """Empty if nothing but rules (a pipe, with dashes, underscores and blanks)."""
    return F.when(c.rlike(r"^[|\-_—– ]*\|[|\-_—– ]*\z"), F.lit("")).otherwise(c)


def malformed_number(c: Column) -> Column:
    """A comma before four digits, or a percentage of two digits or more without a decimal mark."""
    # Both shapes.
    return c.rlike(r"(?U)\d,\d{4}") | c.rlike(r"(?U)^[+-]?\d{2,}%\z")


def capped_confidence(text: Column, confidence: Column) -> Column:
    """At most 0.4 for malformed numbers, missing confidence included; otherwise unchanged."""
    return F.when(malformed_number(text), F.least(F.coalesce(confidence, F.lit(0.4)), F.lit(0.4))).otherwise(confidence)


def parse_number(c: Column) -> Column:
    """struct(value, is_percent); value is null unless the text is a number once white space and commas are gone.

    Parentheses and a leading minus both mean negative, together as well.
    """
    bare = fold_digits(F.regexp_replace(c, r"(?U)\s", ""))
    percent = bare.endswith("%")
    bare = F.when(percent, F.regexp_replace(bare, r"%\z", "")).otherwise(bare)
    bracketed = bare.rlike(r"^\(.*\)\z")
    bare = F.when(bracketed, F.regexp_replace(bare, r"^\(|\)\z", "")).otherwise(bare)
    minus = bare.startswith("-")
    digits = F.regexp_replace(F.regexp_replace(bare, "^-", ""), ",", "")
    value = F.when(digits.rlike(r"^[0-9]+(\.[0-9]+)?\z"), digits.try_cast("double"))
    return F.struct(F.when(bracketed | minus, -value).otherwise(value).alias("value"), percent.alias("is_percent"))


def sequence_illegal(c: Column) -> Column:
    """A subscript sign without a base after it, a mark twice in a row, or a mark that nothing carries."""
    return c.rlike(rf"{COENG}(?![{BASE}])|([{MARKS}{COENG}])\1|(?<![{BASE}{MARKS}{COENG}])[{MARKS}{COENG}]")


def has_khmer_digit(c: Column) -> Column:
    return c.rlike(f"[{KHMER_DIGITS}]")


def digits_mixed(c: Column) -> Column:
    return has_khmer_digit(c) & c.rlike("[0-9]")


def cell_flags(text: Column, confidence: Column, least: float = 0.80) -> Column:
    """Array of what is wrong with a cell; blank cells have none and a missing confidence says nothing."""
    flags = F.array_compact(F.array(F.when(confidence < least, F.lit("low_conf")), F.when(sequence_illegal(text), F.lit("sequence_illegal")), F.when(digits_mixed(text), F.lit("digit_mixed"))))
    return F.when(F.coalesce(trim_ws(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(flags)


def confidence_band(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("none")).when(c < 0.80, F.lit("low")).when(c < 0.95, F.lit("medium")).otherwise(F.lit("high"))


def fold_numeric(c: Column) -> Column:
    """Folded digits and no spaces: split numbers equal whole ones."""
    return F.replace(fold_digits(collapse_ws(c)), F.lit(" "), F.lit(""))


def fold_spaces(c: Column) -> Column:
    """No space just inside brackets; spaces between words stay."""
    return F.regexp_replace(collapse_ws(c), r"(?U)(?<=[(\[])\s+|\s+(?=[)\]])", "")


def is_numeric(c: Column) -> Column:
    """A single number, with a currency sign, accounting brackets or one short unit if any.

    The comma is a decimal mark only beside a unit, a currency sign or Khmer digits.
    """
    core = collapse_ws(c)
    signed = core.rlike(r"^\p{Sc}")
    core = F.when(signed, F.ltrim(F.substring(core, F.lit(2), F.length(core)))).otherwise(core)
    core = F.when(core.rlike(r"^\(.*\)\z"), F.trim(F.substring(core, F.lit(2), F.length(core) - 2))).otherwise(core)
    unit = F.regexp_extract(core, r"^.* (\S+)\z", 1)
    has_unit = (unit != "") & (F.length(unit) <= 12) & ~unit.rlike(r"(?U)\d")
    core = F.when(has_unit, F.trim(F.substring(core, F.lit(1), F.length(core) - F.length(unit)))).otherwise(core)
    number = fold_numeric(core)
    point = number.rlike(r"^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?%?\z")
    comma = number.rlike(r"^[+-]?([0-9]+|[0-9]{1,3}(\.[0-9]{3})+)(,[0-9]+)?%?\z")
    return point | ((signed | has_unit | has_khmer_digit(c)) & comma)


def is_plain_number(c: Column) -> Column:
    return trim_ws(c).rlike(r"(?U)^[+-]?[\d,]*\d([.,]\d+)?%?\z")


def khmer_ratio(c: Column) -> Column:
    """Share of the Khmer block among characters that are not white space."""
    solid = F.regexp_replace(c, r"(?U)\s", "")
    n = F.length(solid)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.regexp_replace(solid, r"[\x{1780}-\x{17FF}]", ""))) / n)


def is_khmer_text(c: Column) -> Column:
    return ~is_numeric(c) & (khmer_ratio(c) >= 0.5)


def order_valid(c: Column) -> Column:
    """No mark at the start of a token and no subscript sign at its end."""
    return ~(c.rlike(r"(?U)(^|\s)[\x{17B6}-\x{17D3}]") | c.rlike(r"(?U)\x{17D2}(\s|\z)"))


def is_trusted(c: Column) -> Column:
    """Cells that can serve as labels: numbers, texts without Khmer, and well-ordered currency units."""
    return is_plain_number(c) | (khmer_ratio(c) == 0) | (c.startswith("៛") & order_valid(c))


def cer(reference: Column, guess: Column) -> Column:
    """Edits by reference length; 0 or 1 for an empty reference. May exceed 1."""
    return F.when(F.length(reference) == 0, F.when(F.length(guess) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, guess) / F.length(reference))


def similarity(a: Column, b: Column) -> Column:
    """1 less edits by the longer length; two empty texts are alike."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / n)


def training_equivalent(a: Column, b: Column) -> Column:
    """Whether two texts differ in nothing that could be learned: equal once cleaned and without invisible joiners."""
    strip = lambda c: F.regexp_replace(clean_khmer(c), INVISIBLE, "")
    return strip(a) == strip(b)


def replace_count(c: Column, find: str) -> Column:
    """Non-overlapping occurrences; none for an empty search."""
    return F.lit(0) if not find else ((F.length(c) - F.length(F.replace(c, F.lit(find), F.lit("")))) / len(find)).cast("int")


def content_id(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 12)


def matches(c: Column, query: str) -> Column:
    """Case-folded substring search over composed text; a blank query matches nothing."""
    return F.lit(False) if not query.strip() else F.contains(F.lower(nfc(c)), F.lit(unicodedata.normalize("NFC", query).lower()))


def three_places(c: Column) -> Column:
    """Three decimals as text, blank if missing."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.format_string("%.3f", c))


def ctc_collapse(symbols: Column, blank: Column) -> Column:
    """Runs of one symbol once, blanks gone."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(symbols, F.lit(1), F.greatest(F.size(symbols) - 1, F.lit(0))))
    kept = F.zip_with(symbols, before, lambda x, p: F.when(~x.eqNullSafe(p) & (x != blank), x))
    return F.array_compact(kept)
