"""Normal forms of names, headings, streets, numbers and search words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import clean_cell

# German letters and the Latin letters with marks that plain letters stand for.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ß": "ss"}
MARKED = "áàâãåéèêëíìîïóòôõúùûñçýÿÁÀÂÃÅÉÈÊËÍÌÎÏÓÒÔÕÚÙÛÑÇÝ"
PLAIN = "aaaaaeeeeiiiioooouuuncyyAAAAAEEEEIIIIOOOOUUUNCY"
SEARCH_PAIRS = [("ae", "ä"), ("oe", "ö"), ("ue", "ü"), ("ss", "ß")]
DASHES = "‐‑‒–—−"
CITY_WORDS = ["am", "an der", r"a\.", r"a\. d\.", r"i\.", "bei"]


def swapped(x: Column, pairs: dict[str, str]) -> Column:
    for a, b in pairs.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def transliterate(x: Column) -> Column:
    """umlauts to two letters with their case, other marks dropped."""
    return F.translate(swapped(x, UMLAUTS), MARKED, PLAIN)


def norm_name(x: Column) -> Column:
    """comparison form of a name."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(transliterate(F.coalesce(x, F.lit("")))), r"[^a-z0-9 ]", " "), r" +", " "))


def norm_header(x: Column) -> Column:
    """comparison form of a heading; here ä becomes a."""
    plain = F.translate(swapped(F.lower(F.coalesce(x, F.lit(""))), {"ß": "ss"}), "äöü" + MARKED, "aou" + PLAIN)
    return F.regexp_replace(plain, r"[^a-z0-9]", "")


def clean_text(x: Column, forbidden: str = r'[\\/:*?"<>|]') -> Column:
    """without characters that file names can't hold, and without dots at the ends."""
    one = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), forbidden, ""), r"\s+", " "))
    return F.trim(F.btrim(one, F.lit(".")))


def normalize_text(x: Column) -> Column:
    """lower case, one kind of dash and of space, letters with marks spelled plainly; punctuation stays."""
    lower = F.translate(F.lower(F.coalesce(x, F.lit(""))), DASHES + "\u00a0\u202féèáà", "-" * len(DASHES) + "  eeaa")
    return F.trim(F.regexp_replace(swapped(lower, {k: v for k, v in UMLAUTS.items() if k.islower()}), r"\s+", " "))


def normalize_street(x: Column) -> Column:
    """search form of a street; any form of the word for street becomes "str", joined to the name in front of it."""
    t = F.regexp_replace(normalize_text(x), r"(?:(?<=[a-z])[ -]*|\b)str(?:asse|\.)?(?![a-z])", "str")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9 ]+", " "), r" +", " "))


def normalize_city(x: Column) -> Column:
    """without words for a place's position."""
    t = F.regexp_replace(normalize_text(x), rf"\b(?:{'|'.join(CITY_WORDS)})\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9/ ]+", " "), r" +", " "))


def normalize_number(x: Column) -> Column:
    """letters and digits only."""
    return F.regexp_replace(normalize_text(x), r"[^a-z0-9]", "")


def search_name(kind: Column, first: Column, last: Column, company: Column) -> Column:
    """upper-case form for searching, at most 240 characters."""
    raw = F.when(kind == "person", F.concat_ws(" ", last, first)).otherwise(F.coalesce(company, F.lit("")))
    return F.substring(F.upper(clean_cell(transliterate(raw))), 1, 240)


def umlaut_variants(x: Column) -> Column:
    """F64: the word and its spellings after one rule, sorted."""
    low = F.lower(x)
    forms = [x]
    for plain, umlaut in SEARCH_PAIRS:
        forms.append(F.when(low.contains(plain), F.replace(low, F.lit(plain), F.lit(umlaut))))
        forms.append(F.when(low.contains(umlaut), F.replace(low, F.lit(umlaut), F.lit(plain))))
    return F.array_sort(F.array_distinct(F.filter(F.array(*forms), lambda v: v.isNotNull())))


def contains_all(tokens: Column, groups: Column) -> Column:
    """every group of spellings has a token of the text."""
    return F.forall(groups, lambda g: F.exists(g, lambda w: F.array_contains(tokens, w)))


def snippet(x: Column, words: list[str], width: int = 70) -> Column:
    """the text around the first hit."""
    hits = F.filter(F.array(*(F.instr(F.lower(x), w) for w in words)), lambda p: p > 0)
    at = F.array_min(hits) - 1
    start, end = F.greatest(F.lit(0), at - width), F.least(F.length(x), at + width)
    middle = F.replace(x.substr(start + 1, end - start), F.lit("\n"), F.lit(" "))
    found = F.concat(F.when(start > 0, "…").otherwise(""), middle, F.when(end < F.length(x), "…").otherwise(""))
    return F.when(F.size(hits) == 0, F.replace(F.substring(x, 1, 2 * width), F.lit("\n"), F.lit(" "))).otherwise(found)


def truncate(x: Column, most: int, marker: str = " [...] ") -> Column:
    """seven tenths of the room for the head, then a mark and the tail; without room for a tail only the first part."""
    head = int(most * 0.7)
    tail = most - head - len(marker)
    if tail <= 0:
        return F.substring(x, 1, most)
    cut = F.concat(F.regexp_replace(F.substring(x, 1, head), r"\s+$", ""), F.lit(marker), F.regexp_replace(F.right(x, F.lit(tail)), r"^\s+", ""))
    return F.when(F.length(x) <= most, x).otherwise(cut)


def compress_blank_lines(x: Column) -> Column:
    """at most one empty line."""
    return F.btrim(F.regexp_replace(x, r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def clean_subject(x: Column) -> Column:
    """without reply and forward marks, however many."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?i)^(\s*(\[[^\]]*\])?\s*(aw|wg|re|fwd|fw|antw|antwort)\s*(\[[0-9]+\])?\s*:\s*)+", ""))


def email_title(subject: Column, suffix: str) -> Column:
    """a title of at most 120 characters from a subject."""
    clean = F.rtrim(F.substring(clean_text(clean_subject(subject)), 1, 120))
    return F.when(clean != "", F.concat(clean, F.lit(suffix)))


def coerce_code(x: Column, allowed: list[str]) -> Column:
    """the value or its leading token, if it is an allowed code."""
    t = F.trim(x)
    lead = F.regexp_extract(t, r"^([A-Za-z0-9_]+)", 1)
    return F.when(t.isin(allowed), t).when(lead.isin(allowed), lead)


def filled(template: str, values: dict[str, Column]) -> Column:
    """a template with its keys replaced; null becomes empty."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def mask_email(x: Column) -> Column:
    """First letters and the last part of the domain."""
    shape = r"^([^@])[^@]*@([^@.])[^@]*\.([^@.]+)$"
    return F.when(x.rlike(shape), F.concat(F.regexp_extract(x, shape, 1), F.lit("***@"), F.regexp_extract(x, shape, 2), F.lit("***."), F.regexp_extract(x, shape, 3)))


def names_match(a: Column, b: Column) -> Column:
    """A common word of four letters or a common start of five."""
    words = lambda x: F.filter(F.split(norm_name(x), " "), lambda w: F.length(w) >= 4)
    starts = lambda x: F.transform(F.filter(words(x), lambda w: F.length(w) >= 5), lambda w: F.substring(w, 1, 5))
    return F.arrays_overlap(words(a), words(b)) | F.arrays_overlap(starts(a), starts(b))


def alnum_ratio(x: Column) -> Column:
    """Letters and digits among the characters that aren't white space; 0 for none."""
    solid = F.regexp_replace(F.coalesce(x, F.lit("")), r"\s", "")
    return F.coalesce(F.length(F.regexp_replace(solid, r"[^\p{L}\p{N}]", "")) / F.nullif(F.length(solid), F.lit(0)), F.lit(0.0))


def looks_like_html(x: Column) -> Column:
    """A document type or html tag in front, or after a prologue within 2,048 characters."""
    t = F.lower(F.ltrim(x))
    return t.startswith("<!doctype html") | t.startswith("<html") | ((t.startswith("<?xml") | t.startswith("<!--")) & (F.instr(F.substring(t, 1, 2048), "<html") > 0))
