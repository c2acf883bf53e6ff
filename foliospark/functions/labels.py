"""Labels of units, folder and object numbers, house numbers and derived names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, normalize_text

UNIT = r"^\s*([^0-9]*?)[\s.\-]*([0-9]+)\s*([a-zA-Z]?)\s*(?:[-–]\s*(.+?))?\s*$"
#: Letters that scanning confuses with digits.
OCR_DIGITS = {"o": "0", "l": "1", "i": "1", "s": "5", "b": "8"}


def zfill(x: Column, width: int) -> Column:
    """Zeros in front, never cutting."""
    return F.lpad(x, F.greatest(F.length(x), F.lit(width)), F.lit("0"))


def parse_unit(x: Column, types: dict[str, str] | None = None) -> Column:
    """prefix, number, suffix, rest, key, type and reason of a unit's label."""
    types = types or {"WE": "apartment"}
    clean = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    good = clean.rlike(UNIT)
    part = lambda k: F.regexp_extract(clean, UNIT, k)
    prefix = F.btrim(part(1), F.lit(" .-"))
    key = F.upper(F.regexp_replace(prefix, r"[\s.\-]", ""))
    number = F.regexp_replace(part(2), r"^0+([0-9])", "$1")
    kind = F.when(key == "", "apartment")
    for k, v in types.items():
        kind = kind.when(key == k.upper(), v)
    return F.struct(
        F.when(good, prefix).otherwise("").alias("prefix"),
        F.when(good, number).alias("number"),
        F.when(good, F.lower(part(3))).otherwise("").alias("suffix"),
        F.when(good & (part(4) != ""), part(4)).alias("rest"),
        F.when(good, F.concat(key, number, F.upper(part(3)))).otherwise(F.upper(F.regexp_replace(clean, r"\s+", ""))).alias("key"),
        F.when(good, kind.otherwise("other")).otherwise("other").alias("type"),
    )


def unit_key(x: Column) -> Column:
    """comparison key of a unit's label."""
    return parse_unit(x)["key"]


def same_unit(a: Column, b: Column) -> Column:
    """F45."""
    return unit_key(a) == unit_key(b)


def unit_variants(prefixes: list[str], number: Column) -> Column:
    """spellings by prefix, padding and separator."""
    numbers = F.array_distinct(F.array(number, zfill(number, 2), zfill(number, 3)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, prefixes)), lambda p: F.flatten(F.transform(numbers, lambda n: F.transform(F.array(F.lit(""), F.lit(" "), F.lit("-"), F.lit(". ")), lambda s: F.concat(p, s, n))))))))


def object_number(x: Column, least: int = 2, most: int = 6) -> Column:
    """leading digits that a separator or the end follows, as digits, value and rest."""
    shape = rf"^\s*([0-9]{{{least},{most}}})(?:[ _,.\-](.*))?$"
    digits = F.regexp_extract(x, shape, 1)
    return F.when(x.rlike(shape), F.struct(digits.alias("digits"), digits.cast("long").alias("number"), F.trim(F.ltrim(F.regexp_replace(F.regexp_extract(x, shape, 2), r"^[ _,.\-]+", ""))).alias("rest")))


def normalize_object_number(x: Column, pad: int = 0) -> Column:
    """digits without leading zeros, padded if asked for."""
    digits = F.regexp_replace(F.coalesce(x, F.lit("")), r"[^0-9]", "")
    value = F.when(digits != "", digits).try_cast("long").cast("string")
    return zfill(value, pad) if pad else value


def object_folder_name(pattern: str, **parts: Column) -> Column:
    """a filled pattern without the traces of empty parts."""
    from .text import filled

    name = F.regexp_replace(F.regexp_replace(filled(pattern, parts), r"\s+,", ","), r",\s*$", "")
    return F.btrim(F.regexp_replace(name, r"\s+", " "), F.lit(" ,"))


def folder_norm(x: Column) -> Column:
    """comparison form of a folder's name."""
    from .text import transliterate

    return F.trim(F.regexp_replace(F.lower(transliterate(F.replace(x, F.lit("_"), F.lit(" ")))), r"\s+", " "))


def loose_match(a: Column, b: Column) -> Column:
    """equal without a leading number of one or two digits and without spaces."""
    bare = lambda x: F.replace(F.regexp_replace(folder_norm(x), r"^[0-9]{1,2}[ .\-]*", ""), F.lit(" "), F.lit(""))
    return (bare(a) != "") & (bare(a) == bare(b))


def house_number(x: Column) -> Column:
    """number of four digits at most, suffix and upper end; an end below the start is dropped."""
    t = F.regexp_replace(normalize_text(x), r"\s*([-/])\s*", "$1")
    shape = r"^([0-9]{1,4})\s?([a-z]?)(?:[-/]([0-9]{1,4})\s?[a-z]?)?$"
    num, to = F.regexp_extract(t, shape, 1).try_cast("int"), F.regexp_extract(t, shape, 3).try_cast("int")
    good = t.rlike(shape)
    return F.struct(F.when(good, num).alias("num"), F.when(good, F.regexp_extract(t, shape, 2)).otherwise("").alias("suffix"), F.when(good & (to >= num), to).alias("upto"))


def house_numbers_overlap(a: Column, b: Column) -> Column:
    """Same suffix and ranges that meet."""
    end = lambda h: F.coalesce(h["upto"], h["num"])
    return F.coalesce((a["suffix"] == b["suffix"]) & (a["num"] <= end(b)) & (b["num"] <= end(a)), F.lit(False))


def address_variants(street: Column, number: Column, postal: Column, city: Column) -> Column:
    """search spellings of an address, sorted."""
    from .text import normalize_city, normalize_street

    s, c = normalize_street(street), normalize_city(city)
    return F.array_sort(F.array_distinct(F.array(F.concat_ws(" ", s, number), F.concat_ws(" ", s, number, c), F.concat_ws(" ", s, number, postal, c), F.concat_ws(" ", s, F.replace(number, F.lit(" "), F.lit(""))))))


def repair_ocr_digits(x: Column) -> Column:
    """letters read as digits between digits or in front of one, and o after a digit at the end.

    From left to right, with the repaired characters as context, as the fold over positions keeps them.
    """
    low = F.lower(x)
    n = F.length(low)
    digit = lambda ch: ch.rlike("^[0-9]$")
    table = F.create_map(*(F.lit(v) for p in OCR_DIGITS.items() for v in p))

    def step(done: Column, i: Column) -> Column:
        ch, after, then = low.substr(i, F.lit(1)), low.substr(i + 1, F.lit(1)), low.substr(i + 2, F.lit(1))
        before = F.when(i > 1, digit(F.right(done, F.lit(1)))).otherwise(False)
        follows = digit(after) | (after.isin("-", "/") & digit(then))
        known = F.try_element_at(table, ch)
        fixed = F.when(known.isNotNull() & follows & (before | (i == 1)), known).when((ch == "o") & before & (i == n), "0").otherwise(ch)
        return F.concat(done, fixed)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(""), step)).otherwise(low)


def strip_legal_form(x: Column, tokens: list[str]) -> Column:
    """F32: without legal forms, longest first; the original if nothing is left."""
    import re

    out = x
    for t in sorted(tokens, key=len, reverse=True):
        out = F.regexp_replace(out, rf"(?iU)(^|[\s,;&+]){re.escape(t)}(?=$|[\s,;&+])", "$1")
    out = F.btrim(F.regexp_replace(F.regexp_replace(out, r"(^|\s)[&,;/+]+(\s|$)", " "), r"\s+", " "), F.lit(" ,;&+-"))
    return F.coalesce(F.nullif(out, F.lit("")), F.trim(x))


def unit_token(label: Column, kind: Column, prefixes: dict[str, str], pad: int = 2) -> Column:
    """prefix by type, padded number, suffix."""
    p = parse_unit(label)
    prefix = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in prefixes.items() for v in pair)), kind), F.lit(prefixes.get("other", "VE")))
    bare = F.replace(clean_text(label), F.lit(" "), F.lit(""))
    return F.when(p["number"].isNotNull(), F.concat(prefix, zfill(p["number"], pad), p["suffix"])).otherwise(F.coalesce(F.nullif(bare, F.lit("")), prefix))


def join_names(names: Column, most: int = 2, separator: str = "_", overflow: str = "u_a") -> Column:
    """all names, or the first with a mark."""
    return F.when(F.size(names) <= most, F.array_join(names, separator)).otherwise(F.concat(names[0], F.lit(separator + overflow)))


def fit_length(prefix: Column, names: Column, most: int, **options) -> Column:
    """a bounded folder name that keeps its unit token."""
    base = F.concat_ws("_", F.nullif(prefix, F.lit("")), join_names(names, **options))
    first = F.concat_ws("_", F.nullif(prefix, F.lit("")), F.concat(names[0], F.lit(options.get("separator", "_") + options.get("overflow", "u_a"))))
    room = F.lit(most) - F.length(prefix) - 1
    cut = F.concat_ws("_", F.nullif(prefix, F.lit("")), F.rtrim(F.regexp_replace(names[0].substr(F.lit(1), F.greatest(room, F.lit(3))), r"[ .\-]+$", "")))
    return F.when(F.length(base) <= most, base).when((F.size(names) > 1) & (F.length(first) <= most), first).otherwise(F.substring(cut, 1, most))


def owner_folder_name(label: Column, kind: Column, names: Column, prefixes: dict[str, str], most: int = 80) -> Column:
    """unit token and sorted names as one bounded folder name."""
    from .text import transliterate

    own = F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda n: transliterate(clean_text(n))), lambda n: n != "")))
    return fit_length(unit_token(label, kind, prefixes), own, most)


def natural_key(label: Column) -> Column:
    """First number of a label, then the label."""
    return F.struct(F.coalesce(F.regexp_extract(label, r"([0-9]+)", 1).try_cast("long"), F.lit(1_000_000_000)).alias("n"), label.alias("l"))
