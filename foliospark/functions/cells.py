"""Parsers for the cells of imported lists. Each returns a struct of value(s), confidence and reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words, codes and formats that the cell parsers know.
TRUE_WORDS = ["ja", "j", "x", "1", "true", "wahr", "y", "yes", "vorhanden", "erteilt"]
FALSE_WORDS = ["nein", "n", "0", "false", "falsch", "no", "nicht vorhanden", "kein", "keine"]
COUNTRIES = {
    "DE": ["D", "DE", "DEU", "DEUTSCHLAND", "GERMANY", "BRD"],
    "AT": ["A", "AT", "AUT", "ÖSTERREICH", "OESTERREICH", "AUSTRIA"],
    "CH": ["CH", "CHE", "SCHWEIZ", "SWITZERLAND"],
    "NL": ["NL", "NIEDERLANDE"],
    "FR": ["F", "FR", "FRANKREICH"],
    "BE": ["B", "BE", "BELGIEN"],
    "LU": ["L", "LU", "LUXEMBURG"],
    "PL": ["PL", "POLEN"],
    "IT": ["IT", "ITALIEN"],
    "ES": ["ES", "SPANIEN"],
    "GB": ["GB", "UK", "GROSSBRITANNIEN"],
    "DK": ["DK", "DÄNEMARK"],
    "CZ": ["CZ", "TSCHECHIEN"],
    "TR": ["TR", "TÜRKEI"],
    "US": ["US", "USA"],
}
TOTAL_WORDS = ["summe", "gesamt", "total", "summe:", "gesamt:"]
#: Shape and format of dates, in the order in which they are tried; a year of two digits comes second.
DATE_FORMATS = [
    (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", "d.M.yyyy"),
    (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2}$", "d.M.yy"),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$", "yyyy-M-d H:m:s"),
]
#: Years of two digits from this one on belong to the last century.
CENTURY = 69
MONEY = "decimal(18,2)"


def result(value: Column, confidence: Column | float, reason: Column | str | None = None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(value.alias("value"), as_col(confidence).cast("double").alias("confidence"), as_col(reason).cast("string").alias("reason"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def clean_cell(x: Column) -> Column:
    """null to empty, no-break space to space, runs of white space to one, trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit(" "), F.lit(" ")), r"\s+", " "))


def split_street(x: Column) -> Column:
    """street and house number."""
    c = clean_cell(x)
    shape = r"^(.+?)[ ,]*\s([0-9]+\s?[a-zA-Z]?(?:\s?[-/]\s?[0-9]+\s?[a-zA-Z]?)?)$"
    street, number = F.regexp_extract(c, shape, 1), F.regexp_replace(F.regexp_extract(c, shape, 2), r"\s+", "")
    whole = c.rlike(shape)
    return F.struct(
        F.when(whole, F.btrim(street, F.lit(" ,"))).otherwise(c).alias("street"),
        F.when(whole, number).otherwise("").alias("number"),
        F.when(c == "", 0.0).when(whole, 0.95).otherwise(0.6).alias("confidence"),
    )


def classify_phone(x: Column) -> Column:
    """mobile or phone, and the cleaned text; fewer than six digits are unparseable."""
    c = clean_cell(x)
    compact = F.regexp_replace(c, r"[^0-9+]", "")
    short = F.length(F.regexp_replace(compact, r"[^0-9]", "")) < 6
    kind = F.when(compact.rlike(r"^(?:\+49|0049|0)1[5-7]\d"), "mobile").otherwise("phone")
    return F.struct(
        F.when(~short, kind).alias("kind"),
        F.when(c != "", c).alias("text"),
        F.when(c == "", 0.0).when(short, 0.4).otherwise(0.9).alias("confidence"),
        F.when(c == "", "empty").when(short, "unparseable_phone").alias("reason"),
    )


def normalize_email(x: Column) -> Column:
    """lower case with a check of the shape."""
    c = F.lower(clean_cell(x))
    good = c.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$")
    return result(F.when(c != "", c), F.when(c == "", 0.0).when(good, 0.95).otherwise(0.4), F.when(c == "", "empty").when(~good, "unparseable_email"))


def parse_date(x: Column) -> Column:
    """known formats in order, then month/year (first day) and a single year."""
    c = clean_cell(x)
    two = F.regexp_extract(c, r"^([0-9]{1,2}\.[0-9]{1,2}\.)([0-9]{2})$", 2).try_cast("int")
    whole_year = F.concat(F.regexp_extract(c, r"^([0-9]{1,2}\.[0-9]{1,2}\.)", 1), (two + F.when(two >= CENTURY, 1900).otherwise(2000)).cast("string"))
    read = lambda fmt: F.try_to_date(whole_year, "d.M.yyyy") if fmt == "d.M.yy" else F.try_to_date(c, fmt)
    day = F.coalesce(*(F.when(c.rlike(shape), read(fmt)) for shape, fmt in DATE_FORMATS))
    month = F.when(c.rlike(r"^(0?[1-9]|1[0-2])/[0-9]{4}$"), F.try_to_date(F.concat(F.lit("1/"), c), "d/M/yyyy"))
    year = F.when(c.rlike(r"^[0-9]{4}$"), F.try_to_date(F.concat(c, F.lit("-1-1")), "yyyy-M-d"))
    return result(
        F.coalesce(day, month, year),
        F.when(day.isNotNull(), 0.95).when(month.isNotNull(), 0.6).when(year.isNotNull(), 0.5).otherwise(0.0),
        F.when(day.isNotNull(), F.lit(None)).when(month.isNotNull(), "day_assumed_first").when(year.isNotNull(), "year_only").when(c == "", "empty").otherwise("unparseable_date"),
    )


def amount_value(x: Column) -> Column:
    """The decimal of F14, null if unreadable: a comma parts the cents, points with or without it part thousands, and a
    minus in front or brackets around make it negative."""
    bare = F.replace(F.trim(F.regexp_replace(clean_cell(x), r"(?i)(euro|eur|€)", "")), F.lit(" "), F.lit(""))

    def read(c: Column) -> Column:
        return let(F.btrim(c, F.lit("()-+")), lambda s: let(F.length(s) - F.length(F.replace(s, F.lit("."), F.lit(""))), lambda points: signed(c, s, points)))

    def signed(c: Column, s: Column, points: Column) -> Column:
        without_points = F.replace(s, F.lit("."), F.lit(""))
        thousands = (points > 1) | s.rlike(r"^[^.]*\.[^.]{3}$")
        plain = F.when(s.contains(","), F.replace(F.when(points > 0, without_points).otherwise(s), F.lit(","), F.lit("."))).when(thousands, without_points).otherwise(s)
        digits = F.regexp_extract(plain, r"^([0-9]*\.?[0-9]+|[0-9]+\.)$", 1)
        value = F.bround(F.nullif(digits, F.lit("")).try_cast("decimal(30,10)"), 2).cast(MONEY)
        return F.when(c.startswith("-") | (c.startswith("(") & c.endswith(")")), -value).otherwise(value).cast(MONEY)

    return let(bare, read)


def parse_amount(x: Column) -> Column:
    """German and English amounts; half-even to two places."""
    empty = clean_cell(x) == ""
    return let(amount_value(x), lambda v: result(v, F.when(v.isNotNull(), 0.9).otherwise(0.0), F.when(v.isNotNull(), F.lit(None)).when(empty, "empty").otherwise("unparseable_amount")))


def parse_postal_code(x: Column) -> Column:
    """four digits get a leading zero, five are taken, anything else is cut to ten characters."""
    c = clean_cell(x)
    digits = F.regexp_replace(c, r"[^0-9]", "")
    four, five = (F.length(digits) == 4) & (F.length(c) == 4), F.length(digits) == 5
    return result(F.when(c == "", F.lit(None)).when(four, F.concat(F.lit("0"), digits)).when(five, digits).otherwise(F.substring(c, 1, 10)), F.when(c == "", 0.0).when(four, 0.7).when(five, 0.95).otherwise(0.5), F.when(c == "", "empty").when(four, "leading_zero_added").when(~five, "postal_code_unusual"))


def country_iso2(x: Column) -> Column:
    """F16: dictionary of country names."""
    c = clean_cell(x)
    key = F.replace(F.upper(c), F.lit("."), F.lit(""))
    code = F.try_element_at(F.create_map(*(F.lit(v) for iso, names in COUNTRIES.items() for name in names for v in (name, iso))), key)
    return result(code, F.when(c == "", 0.0).when(code.isNotNull(), 0.95).otherwise(0.3), F.when(c == "", "empty").when(code.isNull(), "country_unknown"))


def parse_fraction(x: Column) -> Column:
    """numerator and base, or a single number."""
    shape = r"^([0-9.,]+)\s*/\s*([0-9.,]+)$"

    def read(c: Column) -> Column:
        texts = F.array(F.regexp_extract(c, shape, 1), F.regexp_extract(c, shape, 2), c)
        return let(F.transform(texts, amount_value), lambda v: chosen(c, v[0], v[1], v[2]))

    def chosen(c: Column, numerator: Column, base: Column, single: Column) -> Column:
        both = numerator.isNotNull() & F.coalesce(base != 0, F.lit(False))
        return F.struct(
            F.when(both, numerator).otherwise(single).alias("numerator"),
            F.when(both, base.cast("long")).alias("base"),
            F.when(both, 0.95).when(single.isNotNull(), 0.7).otherwise(0.0).alias("confidence"),
            F.when(both, F.lit(None)).when(single.isNotNull(), "share_base_missing").when(c == "", "empty").otherwise("unparseable_fraction").alias("reason"),
        )

    return let(clean_cell(x), read)


def parse_bool(x: Column) -> Column:
    """words for yes and no."""
    c = F.lower(clean_cell(x))
    known = c.isin(TRUE_WORDS + FALSE_WORDS)
    return result(F.when(c.isin(TRUE_WORDS), True).when(c.isin(FALSE_WORDS), False), F.when(c == "", 0.0).when(known, 0.9).otherwise(0.3), F.when(c == "", "empty").when(~known, "unparseable_bool"))


def deposit_type(x: Column, synonyms: dict[str, list[str]]) -> Column:
    """the code of the first synonym that the text contains."""
    c = F.lower(clean_cell(x))
    code = F.lit(None).cast("string")
    for name, words in reversed(synonyms.items()):
        for w in words:
            code = F.when(c.contains(w.lower()), name).otherwise(code)
    return result(F.when(c != "", F.coalesce(code, F.lit("unknown"))), F.when(c == "", 0.0).when(code.isNotNull(), 0.85).otherwise(0.4), F.when(c == "", "empty").when(code.isNull(), "deposit_type_unknown"))


def rent_adjustment(x: Column) -> Column:
    """graduated, indexed, none or unknown."""
    c = F.lower(clean_cell(x))
    kind = F.when(c.contains("staffel"), "graduated").when(c.contains("index"), "indexed").when(c.isin(FALSE_WORDS) | c.contains("keine"), "none").otherwise("unknown")
    return result(F.when(c != "", kind), F.when(c == "", 0.0).when(kind == "unknown", 0.4).when(kind == "none", 0.8).otherwise(0.9), F.when(c == "", "empty").when(kind == "unknown", "rent_adjustment_unknown"))


def looks_like_total(cells: Column) -> Column:
    """The first cell that isn't empty is a word for a total."""
    return F.coalesce(F.lower(F.trim(F.try_element_at(F.filter(cells, lambda v: F.trim(v) != ""), F.lit(1)))).isin(TOTAL_WORDS), F.lit(False))


def cell_text(x: Column, kind: str) -> Column:
    """A typed cell as German text."""
    if kind == "boolean":
        return F.when(x, "ja").otherwise("nein")
    if kind == "date":
        return F.date_format(x, "dd.MM.yyyy")
    if kind == "double":
        return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.replace(x.cast("string"), F.lit("."), F.lit(",")))
    return clean_cell(x.cast("string"))
