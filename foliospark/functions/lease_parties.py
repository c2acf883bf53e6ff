"""Tenants, landlords and the unit of a lease in its text.

Parties stand behind a label at the start of a line, or in front of a designation such as "hereinafter tenant". Such a part is read word by
word: a salutation opens a person, capitalised words fill it, "and" and commas join persons to a group; the last group of a part counts.
A part without salutations is read piece by piece between its separators. Landlords and excluded names are never tenants.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of German leases.
LEGAL_FORMS = ("GmbH", "AG", "UG", "KG", "OHG", "GbR", "e.V.", "e. V.", "eG", "SE", "mbH", "Co.", "Stiftung", "Verein", "Gesellschaft")
COUPLE = ("Eheleute", "Ehepaar", "Familie", "Fam.")
SALUTATIONS = {"Herr": "Herr", "Herrn": "Herr", "Hr.": "Herr", "Frau": "Frau", "Fr.": "Frau", "Firma": "Firma", "Fa.": "Fa", **{c: c.rstrip(".") for c in COUPLE}}
OPENERS = ("Herr", "Herrn", "Frau", "Eheleute", "Ehepaar", "Familie")
TITLES = ("dr", "prof", "dipl", "ing", "mag", "med", "dr.-ing", "prof.dr")
ASIDE = ("wohnhaft", "geb.", "geboren", "vertreten", "Personalausweis", "Ausweis", "Tel")
STOPWORDS = ("und", "sowie", "zwischen", "vertreten", "durch", "wohnhaft", "geboren", "geb", "als", "der", "die", "das", "dem", "den", "mit", "für", "fuer", "von", "vom", "am", "im", "in", "an", "auf")
TENANT_LABELS = ("Mieter", "Mieterin", "Mieter/in", "Mieter/-in", "Mieterinnen", "Mieterpartei", "Name des Mieters", "Name der Mieterin", "Mietpartei")
LANDLORD_LABELS = ("Vermieter", "Vermieterin")
HEREINAFTER = ("nachfolgend", "nachstehend", "im Folgenden", "folgend", "künftig", "kuenftig", "hiernach")
ALSO = ("auch", "kurz", "gemeinsam")
TENANT_NAMES, LANDLORD_NAMES = ("Mieter", "Mieterin", "Mieterinnen", "Mieterpartei", "Mieterseite"), ("Vermieter", "Vermieterin", "Vermieterseite")
# How far in front of a designation its parties stand, how long a labelled line is, how many parties count.
REACH, LINE, MOST = 220, (3, 140), 4
JOINING = ("und", "sowie", "&")
QUOTES = "„“\"”'‚’"
NAME = re.compile(r"[A-ZÄÖÜ][\wäöüßéèáàóòúùçñ'’.-]*")
PARTY = pa.struct([("kind", pa.string()), ("salutation", pa.string()), ("first", pa.string()), ("last", pa.string()), ("company", pa.string()), ("confidence", pa.float64())])
FIELDS = "kind: string, salutation: string, first: string, last: string, company: string, confidence: double"


@cache
def one_of(words: tuple[str, ...], flags: int = re.IGNORECASE, before: str = "", after: str = "") -> re.Pattern:
    found = "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=len, reverse=True))
    return re.compile(f"{before}(?:{found}){after}", flags)


def has_legal_form(text: str) -> bool:
    return bool(one_of(LEGAL_FORMS, before=r"(?<!\w)", after=r"(?!\w)").search(text))


def party(raw: str) -> dict | None:
    """One person or company; None if the words name neither."""
    words = " ".join(raw.split()).strip(" ,;:()-–„“\"'").split(" ")
    if len(" ".join(words)) < 3:
        return None
    greeted = next((v for k, v in SALUTATIONS.items() if k.lower() == words[0].lower() and len(words) > 1), None)
    text = " ".join(words[1:] if greeted else words)
    text = text[: min((m.start() for m in (one_of((",", "("), 0).search(text), one_of(ASIDE, 0).search(text)) if m), default=len(text))].strip()
    out = {"kind": "natural_person", "salutation": greeted, "first": None, "last": None, "company": None, "confidence": 0.6}
    if has_legal_form(text):
        return out | {"kind": "legal_entity", "salutation": None, "company": text[:200]}
    names = [w for w in text.split() if NAME.match(w) and w.lower().strip(".") not in (*STOPWORDS, *TITLES)]
    if not 0 < len(names) <= 5:
        return None
    joint = greeted in ("Eheleute", "Ehepaar", "Familie", "Fam")
    return out | {"first": " ".join(names[:-1]) or None, "last": (names[-1] if joint else names[-1].rstrip("."))[:120], "confidence": 0.55 if joint else 0.6}


def words_of(part: str) -> list[str]:
    """Words and separators of a part."""
    return re.findall(r"[,;]|[^\s,;]+", part)


def run_of_names(words: list[str], at: int, most: int) -> int:
    """Where the names that begin at ``at`` end; a mark at the end of a name closes it."""
    end = at
    while end < len(words) and end - at < most and (name := NAME.match(words[end])):
        end += 1
        if name.end() < len(words[end - 1]):
            break
    return end


def greeted_groups(words: list[str]) -> list[list[dict]]:
    """Persons behind salutations, those that are joined in one group."""
    groups: list[list[dict]] = []
    at, joined = 0, False
    while at < len(words):
        end = run_of_names(words, at + 1, MOST) if words[at] in OPENERS else at
        if end > at + 1:
            found = party(" ".join(NAME.match(w)[0] if k else w for k, w in enumerate(words[at:end])))
            if not (joined and groups):
                groups.append([])
            groups[-1] += [found] if found else []
            last = words[end - 1]
            joined, at = NAME.match(last).end() == len(last), end
            continue
        joined = joined and (words[at] in ",;" or words[at].lower() in JOINING)
        at += 1
    return groups


def couple(words: list[str]) -> list[dict]:
    """"Couple Karl and Ute Beispiel": two persons with the last word as their name."""
    for at, word in enumerate(words):
        left = run_of_names(words, at + 1, 3) if word in ("Eheleute", "Ehepaar", "Familie") else at
        if left > at + 1 and left < len(words) and words[left] == "und":
            right = run_of_names(words, left + 1, 3)
            if right > left + 1:
                one, two = words[at + 1 : left], [NAME.match(w)[0] for w in words[left + 1 : right]]
                firsts = one[:-1] if len(one) > 1 and one[-1] == two[-1] else one
                make = lambda f, last=two[-1]: {"kind": "natural_person", "salutation": "Eheleute", "first": " ".join(f) or None, "last": last, "company": None, "confidence": 0.5}
                return [make(firsts), make(two[:-1])]
    return []


def once(parties: list[dict]) -> list[dict]:
    key = lambda p: (p["company"] or f"{p['first'] or ''} {p['last'] or ''}").strip().casefold()
    return list({key(p): p for p in reversed(parties) if key(p)}.values())[::-1]


def parties_of(part: str) -> list[dict]:
    """All parties of a part of the text."""
    words = words_of(part)
    if pair := couple(words):
        return once(pair)
    if groups := greeted_groups(words):
        return once(groups[-1])
    out: list[dict] = []
    for piece in re.split(r"[,;&]|\bund\b|\bsowie\b", " ".join(part.split())):
        found = None if re.search(r"\d", piece) else party(piece)  # with digits it is an address or a date
        out += [found] if found else []
        if found and found["kind"] == "legal_entity":
            break  # behind a company come its address and who acts for it
    return once(out)


def labelled(text: str, labels: tuple[str, ...]) -> list[str]:
    """What stands behind a label on its line."""
    least, most = LINE
    mark = one_of(labels, re.IGNORECASE | re.MULTILINE, before=r"^[ \t]*", after=rf"[ \t]*[:\-–][ \t]*(?P<who>.{{{least},{most}}})$")
    return [m["who"] for m in mark.finditer(text)]


def designations(text: str, names: tuple[str, ...]) -> Iterator[re.Match]:
    heads, also = one_of(HEREINAFTER).pattern, one_of(ALSO).pattern
    return one_of(names, before=rf"{heads}\s+(?:{also}\s+)?[{QUOTES}]?\s*", after=r"\b").finditer(text)


def designated(text: str, names: tuple[str, ...], behind: tuple[str, ...] = ()) -> list[str]:
    """The parts in front of designations; with ``behind``, what follows the last of those designations."""
    out = []
    for mark in designations(text, names):
        part = text[max(0, mark.start() - REACH) : mark.start()]
        others = list(designations(part, behind)) if behind else []
        if others:
            rest = part[others[-1].end() :].lstrip(" \t\n\r-–,;:)" + QUOTES)
            for lead in (("genannt", "bezeichnet"), ("und", "sowie")):
                if (word := next((w for w in lead if rest.startswith(w)), None)) is not None:
                    rest = rest[len(word) :].lstrip(" \t\n\r-–,;:)" + QUOTES)
            out.append(rest)
        else:
            out.append(re.split(r"\n\s*\n|\bzwischen\b", part, flags=re.IGNORECASE)[-1])
    return out


def name_of(p: dict) -> str:
    return p["last"] or p["company"] or ""


def without(parties: list[dict], names: list[str]) -> list[dict]:
    """The parties that aren't named, nor hold or are held by a named company."""
    taken = {n.casefold() for n in names if n}
    company = lambda p: (p["company"] or "").casefold()
    return [p for p in parties if name_of(p).casefold() not in taken and not any(t in company(p) or company(p) and company(p) in t for t in taken)]


def read_parties(text: str | None, exclude: tuple[str, ...] = ()) -> dict:
    """At most four tenants, and the names of at most four landlords."""
    text = text or ""
    parts = chain(labelled(text, LANDLORD_LABELS), designated(text, LANDLORD_NAMES))
    landlords = [n for part in parts for p in parties_of(part) if (n := name_of(p))]
    tenants = [p for part in labelled(text, TENANT_LABELS) for p in parties_of(part)]
    tenants = tenants or [p for part in designated(text, TENANT_NAMES, LANDLORD_NAMES) for p in parties_of(part)]
    return {"tenants": without(once(tenants), [*exclude, *landlords])[:MOST], "landlords": landlords[:MOST]}


def lease_parties(text: Column, exclude: tuple[str, ...] = ()) -> Column:
    """Struct of tenants and landlords; null and empty texts have none. ``exclude`` names one's own companies."""

    @F.arrow_udf(f"struct<tenants: array<struct<{FIELDS}>>, landlords: array<string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([read_parties(t.as_py(), exclude) for t in batch], pa.struct([("tenants", pa.list_(PARTY)), ("landlords", pa.list_(pa.string()))]))

    return run(text)


# The words for units, floors and sides, their short forms, and the words near which a unit is the leased one.
NUMBERED = {"WE": "WE", "Wohnung": "WE", "Whg": "WE", "Wohneinheit": "WE", "Einheit": "WE", "Gewerbeeinheit": "GE", "GE": "GE", "Stellplatz": "Stellplatz", "Garage": "Garage", "TG": "TG"}
UPPER = ("OG", "Obergeschoss", "Stock", "Etage")
FLOORS = {"Erdgeschoss": "EG", "EG": "EG", "Dachgeschoss": "DG", "DG": "DG", "Souterrain": "Souterrain", "Untergeschoss": "UG", "UG": "UG", "Hochparterre": "Hochparterre"}
SIDES = ("links", "rechts", "mitte")
LEASED = ("Mietsache", "Mietobjekt", "Mietgegenstand", "vermietet", "Wohnung im", "Wohnung in", "folgende Räume", "Lage der Wohnung")
NEAR = 80


def units_of(text: str) -> Iterator[tuple[int, int, str]]:
    """Units that a text names: kind of naming, place and short form."""
    short = {k.lower(): v for k, v in (NUMBERED | FLOORS).items()}
    side = rf"\b(?:\s*(?P<side>{'|'.join(SIDES)}))?"
    numbered = one_of(tuple(NUMBERED), before=r"\b(?P<word>", after=r")\.?\s*(?:Nr\.?\s*)?(?P<no>\d{1,4}[a-zA-Z]?)\b")
    for m in numbered.finditer(text):
        yield 0, m.start(), f"{short[m['word'].lower()]} {m['no'].upper()}"
    for kind, pattern in ((1, one_of(UPPER, before=r"\b(?P<word>\d)\.\s*", after=side)), (2, one_of(tuple(FLOORS), before=r"\b(?P<word>", after=rf"){side}"))):
        for m in pattern.finditer(text):
            floor = short.get(m["word"].lower(), f"{m['word']}. OG")
            yield kind, m.start(), f"{floor} {m['side'].lower()}" if m["side"] else floor


def unit_of(text: str | None) -> str | None:
    """The unit that stands near words for the leased thing; among equals a numbered one, then the first."""
    text, near = text or "", one_of(LEASED)
    scored = ((not near.search(text, max(0, at - NEAR), at), kind, at, name) for kind, at, name in units_of(text))
    return min(scored, default=(None,) * 4)[3]


def unit_hint(text: Column) -> Column:
    """The unit that a lease names, as a short form; null without one."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([unit_of(t.as_py()) for t in batch], pa.string())

    return run(text)
