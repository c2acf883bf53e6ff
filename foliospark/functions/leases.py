"""Terms of a lease in its text: dates, amounts and the deposit.

A date or an amount is read behind its words; a phrase matches with any white space between its words, and an umlaut also as two
letters. Between the words of an amount and its number stand at most ``GAP`` characters and no other number, currency or end of a clause.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import amount_value, let

# The words in front of dates of a lease.
STARTS = (
    "Mietbeginn", "Beginn des Mietverhältnisses", "Mietverhältnis beginnt am", "beginnt am", "Mietzeit beginnt am", "Mietzeit beginnt ab", "Mietzeit am",
    "Mietzeit ab", "Vertragsbeginn", "ab dem", "Übergabe am", "Einzug am",
)
ENDS = ("endet am", "Mietende", "befristet bis", "läuft bis", "bis zum", "Vertragsende", "Auszug am", "gekündigt zum")
# The words in front of amounts, in the order in which amounts are taken, and what may follow directly.
ADVANCE = ("vorauszahlung", "vorschuss")
LABELS = {
    "deposit_amount": (("Kaution", "Mietsicherheit", "Mietkaution", "Sicherheitsleistung"), ()),
    "base_rent": (("Grundmiete", "Kaltmiete", "Nettokaltmiete", "Netto-Kaltmiete", "Nettomiete", "Mietzins", "monatliche Miete", "Miete monatlich", "Miete (kalt)", "Miete kalt"), ()),
    "utilities_prepayment": (("Betriebskosten", "Nebenkosten"), (*ADVANCE, "pauschale")),
    "heating_prepayment": (("Heizkosten", "Heiz- und Warmwasserkosten", "Heizung"), ADVANCE),
    "total_rent": (("Gesamtmiete", "Bruttomiete", "Warmmiete", "Gesamtbetrag", "Miete gesamt", "insgesamt"), ()),
}
CURRENCIES = ("€", "EUR", "Euro")
TIMES = {"drei": 3, "3": 3, "zwei": 2, "2": 2}
RENT_WORDS = ("Mieten", "Monatsmieten", "Kaltmieten", "Nettomieten", "Nettokaltmieten", "Netto-Kaltmieten", "Kalt-Mieten", "Netto-Mieten", "Monats-Mieten", "Kaltmonatsmieten", "Nettokaltmonatsmieten")
#: Characters between a label and its amount, and between a deposit and its number of rents; a deposit above so many rents isn't one.
GAP, RENTS_GAP, MOST_RENTS = 40, 80, 3


def phrase(words: str) -> str:
    """A pattern for a phrase."""
    spelled = re.escape(words).replace(r"\ ", r"\s+")
    for umlaut, two in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        spelled = spelled.replace(umlaut, f"(?:{umlaut}|{two})")
    return spelled


def any_of(phrases: Iterable[str]) -> str:
    """A pattern for one of several phrases, the longest first."""
    return f"(?:{'|'.join(phrase(p) for p in sorted(phrases, key=len, reverse=True))})"


def label(name: str) -> str:
    """A pattern for the words of an amount, which end where the word ends."""
    stems, endings = LABELS[name]
    return any_of(stems) + (f"(?:-?{any_of(endings)})?" if endings else "") + r"(?!\p{Ll})"


#: Whole euros in groups of three, or two to six digits, or any digits with cents.
AMOUNT = rf"(?:(\d{{1,3}}(?:\.\d{{3}})+,\d\d|\d+,\d\d|\d{{2,6}})(?:,--?)?)\s*{any_of(CURRENCIES)}"
DAY = r"(\d{1,2}\.\d{1,2}\.(?:\d{4}|\d{2,3}))"


def lease_day(text: Column, words: tuple[str, ...]) -> Column:
    """The first date behind one of the words, null if it isn't a date of 1950 to 2100; two digits of a year count from 1970 on."""
    found = F.regexp_extract(text, rf"(?iu){any_of(words)}\s*:?\s*(?:dem\s+)?{DAY}", 1)
    short = F.regexp_extract(found, r"\.(\d\d)$", 1)
    full = F.when(short == "", found).otherwise(F.concat(F.substring(found, F.lit(1), F.length(found) - 2), F.when(short < "70", "20").otherwise("19"), short))
    return let(F.try_to_date(full, "d.M.yyyy"), lambda d: F.when(F.year(d).between(1950, 2100), d))


def amounts(text: Column) -> Column:
    """E04 of a lease: the amounts by label. Labels are taken in order, and an amount that one label has taken is no other's."""

    def step(left: Column, names: list[str], taken: dict[str, Column]) -> Column:
        if not names:
            return F.struct(*(v.alias(k) for k, v in taken.items()))
        name, *rest = names
        shape = rf"(?iu)({label(name)}[^\d€\n.;]{{0,{GAP}}}?){AMOUNT}"
        value = amount_value(F.regexp_extract(left, shape, 2))
        # The first mention with its amount; the same words with the same amount elsewhere are the same statement.
        mention, lead = F.regexp_extract(left, shape, 0), F.regexp_extract(left, shape, 1)
        without = F.when(mention != "", F.replace(left, mention, lead)).otherwise(left)
        return let(F.struct(value.alias("v"), without.alias("t")), lambda s: step(s["t"], rest, taken | {name: s["v"]}))

    return step(F.coalesce(text, F.lit("")), list(LABELS), {})


def lease_terms(text: Column) -> Column:
    """E03 without the parties: start and end, the five amounts. A deposit may be given as a number of rents; one above
    three rents is dropped. Null and empty texts give nulls."""
    clean = F.coalesce(text, F.lit(""))
    rents = rf"(?iu){any_of(('Kaution', 'Mietsicherheit'))}[^.\n]{{0,{RENTS_GAP}}}?({'|'.join(TIMES)})\s+{any_of(RENT_WORDS)}"
    times = F.try_element_at(F.create_map(*(F.lit(v) for pair in TIMES.items() for v in pair)), F.lower(F.regexp_extract(clean, rents, 1)))

    def build(a: Column) -> Column:
        given = F.coalesce(a["deposit_amount"], (a["base_rent"] * times).cast("decimal(18,2)"))
        deposit = F.when(~F.coalesce(given > a["base_rent"] * MOST_RENTS, F.lit(False)), given)
        return F.struct(
            lease_day(clean, STARTS).alias("start_date"),
            lease_day(clean, ENDS).alias("end_date"),
            *((deposit if name == "deposit_amount" else a[name]).alias(name) for name in LABELS),
        )

    return let(amounts(clean), build)
