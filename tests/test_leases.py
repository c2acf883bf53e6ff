"""Terms of leases."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foliospark.functions import lease_parties, leases

TEXTS = [
    ("Mietbeginn: 01.04.2024, befristet bis dem 31.3.26. Kaltmiete 650,00 EUR, Nebenkostenvorauszahlung: 120,- €; Kaution 1.950,00 EUR.", "2024-04-01", "2026-03-31", ["1950.00", "650.00", "120.00", None, None]),
    ("Die Betriebskosten trägt der Mieter. Die Kaution beträgt 1.950,00 EUR", None, None, ["1950.00", None, None, None, None]),
    ("Nettokaltmiete 500,00 Euro. Die Mietsicherheit sind drei Kaltmieten. Gesamtmiete 700,50 €", None, None, ["1500.00", "500.00", None, None, "700.50"]),
    ("Kaltmiete 400,00 EUR, Kaution 9.999,00 EUR", None, None, [None, "400.00", None, None, None]),
    ("Heizkostenvorschuss 80 EUR insgesamt 80 EUR", None, None, [None, None, None, "80.00", "80.00"]),
    ("Mietzins 12,00 EUR ab dem 31.2.2024", None, None, [None, "12.00", None, None, None]),
    ("Kaltmieten 12,00 EUR", None, None, [None] * 5),
    ("", None, None, [None] * 5),
    (None, None, None, [None] * 5),
]


def test_lease_terms(spark):
    df = spark.createDataFrame([(k, t[0]) for k, t in enumerate(TEXTS)], "k int, t string")
    got = [r["y"] for r in df.select("k", leases.lease_terms(F.col("t")).alias("y")).orderBy("k").collect()]
    for (text, start, end, amounts), r in zip(TEXTS, got, strict=True):
        assert (r["start_date"] and str(r["start_date"]), r["end_date"] and str(r["end_date"])) == (start, end), text
        assert [r[n] for n in leases.LABELS] == [a and Decimal(a) for a in amounts], text


@pytest.mark.parametrize("words", ["Mietbeginn", "Vertragsbeginn"])
def test_first_date_counts(spark, words):
    df = spark.createDataFrame([(f"{words} 1.2.2023 und {words} 3.4.2024",)], "t string")
    assert str(df.select(leases.lease_day(F.col("t"), leases.STARTS).alias("d")).first()["d"]) == "2023-02-01"


CONTRACT = """Mietvertrag

zwischen
Verwaltung Übersee GmbH, Hafenallee 13, 40001 Rheinau am See, vertreten durch Tim Übersee
- nachfolgend Vermieter genannt -

und
Herrn Karl Lang und Frau Ute Lang, wohnhaft Alte Gasse 1, 40002 Neuau
- nachfolgend Mieter genannt -

Vermietet wird die Wohnung Nr. 3 im 2. OG links des Hauses.
"""
PARTIES = [
    (CONTRACT, [("Karl", "Lang"), ("Ute", "Lang")], ["Verwaltung Übersee GmbH"]),
    ("Vermieter: Otto Eigner\nMieter: Lang Handels GmbH", [(None, "Lang Handels GmbH")], ["Eigner"]),
    ("Mieter: Eheleute Karl und Ute Lang", [("Karl", "Lang"), ("Ute", "Lang")], []),
    ("Mieter: Ehepaar Karl Lang und Ute Lang", [("Karl", "Lang"), ("Ute", "Lang")], []),
    ("zwischen Frau Vera Haus - nachfolgend Vermieterin genannt - und Herrn Tom Neu - nachfolgend Mieter genannt -", [("Tom", "Neu")], ["Haus"]),
    ("Herrn Alt Eins, Berg. Herrn Tom Neu, Frau Ida Neu & Herrn Bo Weg (im Folgenden auch „Mieterpartei“)", [("Tom", "Neu"), ("Ida", "Neu"), ("Bo", "Weg")], []),
    ("Mieter: Anna Alt, Bernd Neu, Gasse 5, Carl Hof, Dora Au, Emil Ost", [("Anna", "Alt"), ("Bernd", "Neu"), ("Carl", "Hof"), ("Dora", "Au")], []),
    ("Mieter: Anna Alt und Anna Alt", [("Anna", "Alt")], []),
    ("Mieter: Verwaltung Beispiel GmbH", [], []),
    ("Der Mieter zahlt.", [], []),
    ("", [], []),
    (None, [], []),
]


def test_lease_parties(spark):
    df = spark.createDataFrame([(k, t[0]) for k, t in enumerate(PARTIES)], "k int, t string")
    got = [r["y"] for r in df.select("k", lease_parties.lease_parties(F.col("t"), ("Verwaltung Beispiel GmbH",)).alias("y")).orderBy("k").collect()]
    for (text, tenants, landlords), r in zip(PARTIES, got, strict=True):
        assert [(p["first"], p["company"] or p["last"]) for p in r["tenants"]] == tenants, text
        assert r["landlords"] == landlords, text


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Herrn Dr. Hans Peter Lang, geb. 01.01.1970", ("natural_person", "Herr", "Hans Peter", "Lang", None)),
        ("Firma Lang Bau AG", ("legal_entity", None, None, None, "Lang Bau AG")),
        ("Familie Lang", ("natural_person", "Familie", None, "Lang", None)),
        ("und", None),
        ("a b c", None),
        ("Ein Zwei Drei Vier Fünf Sechs", None),
    ],
)
def test_party(raw, want):
    got = lease_parties.party(raw)
    assert (got and (got["kind"], got["salutation"], got["first"], got["last"], got["company"])) == want


@pytest.mark.parametrize(
    ("text", "unit"),
    [
        (CONTRACT, "WE 3"),
        ("Es wird die Wohnung im 1. Obergeschoss rechts vermietet", "1. OG rechts"),
        ("Mietsache: Dachgeschoss links, Gasse 5", "DG links"),
        ("Garage 7. Mietobjekt: Gewerbeeinheit GE 2, Erdgeschoss", "GE 2"),
        ("Garage 7, WE 12b", "Garage 7"),
        ("Whg. Nr. 4c", "WE 4C"),
        ("kein Bezug", None),
        (None, None),
    ],
)
def test_unit_hint(text, unit):
    assert lease_parties.unit_of(text) == unit


def test_long_texts_are_read_in_linear_time():
    text = "wort, Wort und Wort 7\n" * 50_000 + CONTRACT
    assert [p["first"] for p in lease_parties.read_parties(text)["tenants"]] == ["Karl", "Ute"]
    assert lease_parties.unit_of(text) == "WE 3"
