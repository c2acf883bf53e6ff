"""Fixtures for functions whose results no table of the driver shows."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import bank, cells, labels, people, similarity, text
from foliospark.operators import relational, rules
from foliospark.sources import formats, tables
from foliospark.streaming import incremental


def value(spark, make, x):
    return spark.createDataFrame([(x,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "want"), [("1.950,00 €", "1950.00"), ("(12.5)", "-12.50"), ("1.250", "1250.00"), ("12.50", "12.50"), ("-3,005", "-3.00"), ("abc", None), ("", None), (None, None), ("0,125", "0.12")])
def test_amounts(spark, raw, want):
    got = value(spark, cells.amount_value, raw)
    assert (None if got is None else str(got)) == want


@pytest.mark.parametrize(("raw", "want"), [("1.2.1999", "1999-02-01"), ("01.02.70", "1970-02-01"), ("01.02.68", "2068-02-01"), ("5-3-2021", "2021-03-05"), ("2021-03-05 7:08:09", "2021-03-05"), ("2020-02-30", None), ("3/2021", "2021-03-01"), ("2021", "2021-01-01"), (None, None)])
def test_dates(spark, raw, want):
    got = value(spark, lambda c: cells.parse_date(c)["value"], raw)
    assert (None if got is None else str(got)) == want


@pytest.mark.parametrize(("raw", "key", "kind"), [("WE 01", "WE1", "apartment"), ("we.12a", "WE12A", "apartment"), ("7", "7", "apartment"), ("TG-3", "TG3", "other"), ("Keller", "KELLER", "other"), ("WE 007 - Hof links", "WE7", "apartment")])
def test_unit_labels(spark, raw, key, kind):
    got = value(spark, labels.parse_unit, raw)
    assert (got["key"], got["type"]) == (key, kind)


def test_mod97_and_mask(spark):
    assert value(spark, bank.mod97, "DE02 1203 0000 0000 2020 51")
    assert not value(spark, bank.mod97, "DE03 1203 0000 0000 2020 51")
    assert value(spark, bank.mask_text, None) is None


MASKED = [
    ("an DE02 1203 0000 0000 2020 51, Konto: 1234567", "an [IBAN_****2051], Konto: 1234567", ["iban"]),
    ("IBAN DE02120300000000202051 Inhaber", "IBAN [IBAN_****2051] Inhaber", ["iban"]),
    ("DE89 37O4 OO44 O532 O13O OO", "[IBAN_****3000]", ["iban"]),
    ("AT61 1904 3002 3457 3201 und NL91 ABNA 0417 1643 00", "[IBAN_****3201] und [IBAN_****4300]", ["iban", "iban"]),
    ("BIC: COBADEFFXXX, BIC hausgeld, HAUSGELD FAELLIG", "BIC: [BIC], BIC hausgeld, HAUSGELD FAELLIG", ["bic"]),
    ("SWIFT-Code: COBADEFF", "SWIFT-Code: [BIC]", ["bic"]),
    ("BLZ 370 400 44, Konto-Nr. 123456789012345, Kto.-Nr.: 123 456 78", "BLZ [BLZ], Konto-Nr. [KONTONR], Kto.-Nr.: [KONTONR]", ["blz", "kontonummer", "kontonummer"]),
    ("Personalausweisnummer: L01X00T47A; Reisepass C01X00T478. Ausweiskopie L01X00T47", "Personalausweisnummer: [AUSWEISNR]; Reisepass [AUSWEISNR]. Ausweiskopie [AUSWEISNR]", ["ausweisnummer"] * 3),
    ("Telefon +49 1522 9233185, Rechnung 2025-004711, MEA 123/10.000, Aktenzeichen 12 O 345/24", None, []),
    ("XY12 ABCD EFGH", None, []),
    ("", "", []),
]


@pytest.mark.parametrize(("raw", "shown", "kinds"), MASKED)
def test_masking(spark, raw, shown, kinds):
    got = value(spark, bank.mask_text, raw)
    assert got["text"] == (raw if shown is None else shown)
    assert [h["kind"] for h in got["hits"]] == kinds
    assert value(spark, bank.contains_sensitive, raw) is bool(kinds)
    again = value(spark, bank.mask_text, got["text"])
    assert again["text"] == got["text"] and not again["hits"]


@pytest.mark.parametrize(
    ("raw", "shown"),
    [
        ("AT61 1904 3002 3457 3201 BIC: OPSKATWW", "[IBAN]: [BIC]"),
        ("BE68 5390 0754 7034 BIC GKCCBEBB", "[IBAN] [BIC]"),
        ("AT611904300234573201 BLZ 19043000", "[IBAN] [BLZ]"),
        ("NL91 ABNA 0417 1643 00 BIC ABNANL2A", "[IBAN] BIC [BIC]"),
        ("LU28 0019 4006 4475 0000 Kto.-Nr. 123 456 78", "[IBAN] Kto.-Nr. [KONTONR]"),
        ("AT61 1904 3002 3457 3201 DE89 3704 0044 0532 0130 00", "[IBAN] [IBAN]"),
        ("AT61 1904 3002 3457 3201 AT61 1904 3002 3457 3201", "[IBAN] [IBAN]"),
        ("AB12 CDEF BLZ 370 400 44", "AB12 CDEF BLZ [BLZ]"),  # too short for an account
        ("DE02 1203 0000 0000 2020 51 SWIFT BYLADEM1001 Pass-Nr. C01X00T478", "[IBAN] SWIFT [BIC] Pass-Nr. [AUSWEISNR]"),
    ],
)
def test_masking_behind_accounts(spark, raw, shown):
    """An account number of whole groups reads on into the next word, which must not hide the number behind it."""
    assert value(spark, lambda c: bank.mask_text(c, "log"), raw)["text"] == shown
    assert value(spark, bank.contains_sensitive, raw)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.sampled_from(["AT61 1904 3002 3457 3201", "BE68539007547034", "DE89 3704 0044 0532 0130 00", "XY12 ABCD EFGH", "AB12", "1234", "O0O0", "L01X00T478", "COBADEFF", "37040044", "\n", "und", "DE"]),
            st.sampled_from(["BIC", "SWIFT-Code:", "BLZ", "Bankleitzahl:", "Konto-Nr.", "kto.nr", "KONTONUMMER", "Pass-Nr.", "Ausweiskopie"]),
        ),
        max_size=12,
    ),
    st.sampled_from(["fulltext", "prompt", "log"]),
)
def test_nothing_is_left_in_a_masked_text(words, mode):
    """Of each kind, searched on its own in the original, every number is masked or shares characters with an earlier kind."""
    text, mask = " ".join(words), bank.Masker(mode, None)
    got = mask(text)
    assert mask(got["text"])["hits"] == []
    spans = [(h["start"], h["stop"]) for h in got["hits"]]
    assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    alone = [m.span() for p in mask.accounts for m in p.finditer(text) if mask.account(m.group())] + [m.span(2) for _, p in mask.after_words for m in p.finditer(text)]
    assert all(any(a < stop and start < b for a, b in spans) for start, stop in alone)


def test_masking_hits(spark):
    import hashlib
    import hmac

    raw = "zu DE02 1203 OOOO 0000 2020 51 und BLZ: 12030000"
    got = value(spark, lambda c: bank.mask_text(c, "log", b"key"), raw)
    account, blz = got["hits"]
    assert got["text"] == "zu [IBAN] und BLZ: [BLZ]"
    assert raw[account["start"] : account["stop"]].startswith("DE02") and raw[blz["start"] : blz["stop"]] == "12030000"
    assert (account["last4"], account["valid"], blz["context"]) == ("2051", True, "BLZ")
    assert account["hash"] == hmac.new(b"key", b"DE02120300000000202051", hashlib.sha256).hexdigest()


@pytest.mark.parametrize(("raw", "want"), [("BRD", "DE"), ("deu", "DE"), ("U.S.A.", "US"), ("Dänemark", "DK"), ("Türkei", "TR"), ("Atlantis", None), ("", None)])
def test_countries(spark, raw, want):
    assert value(spark, lambda c: cells.country_iso2(c)["value"], raw) == want


@pytest.mark.parametrize(("raw", "want", "reason"), [("vorhanden", True, None), ("erteilt", True, None), ("nicht vorhanden", False, None), ("kein", False, None), ("-", None, "unparseable_bool"), ("", None, "empty")])
def test_booleans(spark, raw, want, reason):
    got = value(spark, cells.parse_bool, raw)
    assert (got["value"], got["reason"]) == (want, reason)


def test_scrubbing(spark):
    import json

    got = value(spark, bank.scrub_json, json.dumps({"iban": "x", "iban_last4": "1234", "deep": [{"Password": [1]}, "BLZ 370 400 44", "y" * 3000]}))
    assert json.loads(got) == {"iban": "[GESCHWAERZT]", "iban_last4": "1234", "deep": [{"Password": "[GESCHWAERZT]"}, "BLZ [BLZ]", "y" * 2000]}
    assert json.loads(value(spark, bank.scrub_json, "no json, BIC COBADEFF")) == "no json, BIC [BIC]"
    assert value(spark, bank.scrub_json, None) is None


def test_keyed_hash(spark):
    import hashlib
    import hmac

    assert value(spark, lambda c: bank.hmac_sha256(c, b"k" * 80), "abc") == hmac.new(b"k" * 80, b"abc", hashlib.sha256).hexdigest()


PARTIES = [
    ("Weber, Anna & Karl", [("Weber", "Anna"), ("Weber", "Karl")], "high"),
    ("Weber, Anna u. Karl", [("Weber", "Anna"), ("Weber", "Karl")], "high"),
    ("Anna und Karl Weber", [("Weber", "Anna"), ("Weber", "Karl")], "medium"),
    ("Anna u. Karl Weber", [("Weber", "Anna"), ("Weber", "Karl")], "medium"),
    ("Weber, Anna / Müller, Karl", [("Weber", "Anna"), ("Müller", "Karl")], "high"),
    ("Weber, Anna; Klein, Ute", [("Weber", "Anna"), ("Klein", "Ute")], "high"),
    ("Eheleute Klein", [("Klein", None), ("Klein", None)], "low"),
    ("Ehepaar Karl und Ute Klein", [("Karl und Ute Klein", None)] * 2, "low"),
    ("Dr. Anna Weber-Klein", [("Weber-Klein", "Anna")], "high"),
    ("Anna Ida Weber Klein", [("Klein", "Anna Ida Weber")], "low"),
    ("Anna Ida Weber", [("Weber", "Anna Ida")], "medium"),
    ("Weber", [("Weber", None)], "medium"),
    ("Anna & Karl", [(None, "Anna"), (None, "Karl")], "low"),
    ("Weber, Herrn Dr. med. Karl", [("Weber", "Karl")], "high"),
    ("Undine Bauer", [("Bauer", "Undine")], "high"),
    ("", [], "low"),
    ('"', [], "low"),
    (" , & ;", [], "low"),
]


@pytest.mark.parametrize(("raw", "persons", "band"), PARTIES)
def test_persons(spark, raw, persons, band):
    got = value(spark, people.split_names, raw)
    assert (got["kind"], got["band"]) == ("natural_person", band)
    assert [(p["last"], p["first"]) for p in got["persons"]] == persons
    assert ("name_missing" in got["reasons"]) == (not persons)


@pytest.mark.parametrize(
    ("raw", "kind", "company", "care_of"),
    [
        ("Weber GbR", "legal_entity", "Weber GbR", None),
        ("Wohnbau eG", "legal_entity", "Wohnbau eG", None),
        ("Gemeinschaft Klein", "community", "Gemeinschaft Klein", None),
        ("Erbengemeinschaft Weber, c/o Klein", "community", "Erbengemeinschaft Weber", "c/o Klein"),
        ("Weber, Anna c/o Haus und Hof", "natural_person", None, "c/o Haus und Hof"),
        ("Agenda Weber", "natural_person", None, None),
    ],
)
def test_kinds_of_parties(spark, raw, kind, company, care_of):
    got = value(spark, people.split_names, raw)
    assert (got["kind"], got["company"], got["care_of"]) == (kind, company, care_of)
    assert bool(got["persons"]) == (kind == "natural_person")


def test_titles_salutations_and_limits(spark):
    got = value(spark, people.split_names, "Hr. Prof. Dr. Karl Weber")
    assert [p.asDict() for p in got["persons"]] == [{"first": "Karl", "last": "Weber", "salutation": "Herr", "title": "Prof. Dr.", "pattern": "space", "confidence": 0.9}]
    assert value(spark, people.split_names, "Frau Weber, Dipl.-Kffr. Anna")["persons"][0]["title"] == "Dipl.-Kffr."
    assert value(spark, lambda c: people.split_names(c, high=0.7, medium=0.5), "Anna und Karl Weber")["band"] == "high"
    assert value(spark, people.split_names, None) is None
    assert [value(spark, people.has_marker, x) for x in ("Bau GmbH, Ulm", "Agenda", "e.v.", "Erbengemeinschaft AG", None)] == ["GmbH", None, "e.V.", "Erbengemeinschaft", None]


def test_similarity_is_indel_based(spark):
    assert similarity.ratio("abcd", "abxd") == 75.0
    assert similarity.token_set_ratio("max muster", "muster max gmbh") == 100.0
    assert similarity.partial_ratio("haus", "das haus am see") == 100.0
    assert spark.createDataFrame([("a", None)], "a string, b string").select(similarity.similarity(F.col("a"), F.col("b"))).first()[0] is None


def test_ocr_repair(spark):
    for raw, want in [("l2", "12"), ("1o", "10"), ("3l4", "314"), ("12b", "12b"), ("", "")]:
        assert value(spark, labels.repair_ocr_digits, raw) == want


def test_html(spark):
    html = "<html><head><title>x</title></head><body><p>A&amp;B</p><script>var a='<p>'</script><div>C<br>D</div></body>"
    assert value(spark, formats.html_to_text, html) == "A&B\n\nC\nD"
    assert value(spark, text.looks_like_html, html)


def test_rules_validate():
    with pytest.raises(ValueError):
        rules.validate({"id": "x", "when": {"colour": ["a"]}, "then": {"category": "1"}})
    with pytest.raises(Exception):
        rules.validate({"id": "x", "when": {"text": ["("]}, "then": {"category": "1"}})


def test_ragged_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Name;Ort\nMüller; Köln \n".encode("cp1252"))
    (tmp_path / "b.csv").write_text('"Weiß, Max",1\n"Abel, Eva",2\n', encoding="utf-8")
    rows = {(r["path"].rsplit("/", 1)[-1], r["row_no"]): (r["cells"], r["delimiter"]) for r in tables.ragged(spark, str(tmp_path)).collect()}
    assert rows["a.csv", 1] == (["Müller", "Köln"], ";")
    assert rows["b.csv", 0] == (["Weiß, Max", "1"], ",")


def test_messages(spark, tmp_path):
    (tmp_path / "m.eml").write_text("From: Max <MAX@haus.example>\nTo: b@c.example\nSubject: AW: Miete\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n\nHallo\n")
    r = formats.read_messages(spark, str(tmp_path)).first()
    assert (r["from_address"], r["from_name"], r["subject"], r["date"]) == ("max@haus.example", "Max", "AW: Miete", "2024-01-01T10:00:00+00:00")
    assert "Hallo" in r["text"]


def test_polls_leave_no_row_of_one_time_out(spark):
    """Every poll ends among rows of one time; together they read each row once, and none without a time."""
    rows = [(k, None if k == 30 else k // 7) for k in range(40)] + [(None, 3)]
    df = spark.createDataFrame(rows, "event_id long, ts long").repartition(4)
    seen, mark = [], None
    while got := incremental.since(df, "ts", "event_id", mark, 3).collect():
        seen += [(r["ts"], r["event_id"]) for r in got]
        mark = seen[-1]
        if mark[1] is None:
            mark = (mark[0], -1)
    assert seen == sorted(((t, k) for k, t in rows if t is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0))


def test_debounce_stream(spark, tmp_path):
    """The stream swallows what comes within a minute of the request that armed the timer."""
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:30"), (1, "2024-01-01 00:01:10"), (2, "2024-01-01 00:00:05"), (3, "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "k int, t string").selectExpr("k", "cast(t as timestamp) t")
    df.write.parquet(str(tmp_path / "in"))
    batch = incremental.debounced_batch(df, "k", "t", 60)
    assert {(r["k"], r["armed_us"] // 1_000_000 % 86_400) for r in batch.collect()} == {(1, 0), (1, 70), (2, 5), (3, 18_000)}
    stream = incremental.debounced(incremental.file_feed(spark, str(tmp_path / "in"), df.schema), "k", "t", 60)
    out = incremental.run_available(stream, str(tmp_path / "out"), ["k", "armed_at"], "append")
    got = {(r["k"], r["armed_at"].hour * 3600 + r["armed_at"].minute * 60 + r["armed_at"].second, r["swallowed"]) for r in out.collect()}
    assert (1, 0, 1) in got


def test_stream_without_rows(spark, tmp_path):
    spark.createDataFrame([], "k int, t timestamp").write.parquet(str(tmp_path / "in"))
    stream = incremental.windowed_counts(incremental.file_feed(spark, str(tmp_path / "in"), "k int, t timestamp"), "t", "k", "1 day", "1 day").select("k", F.unix_micros("window.start").alias("s"), "n")
    assert incremental.run_available(stream, str(tmp_path / "out"), ["k", "s"]).count() == 0


def test_debounce_over_batches(spark):
    """A key that goes on over many batches, against a walk over its times."""
    rows = [(k % 3, (k * k * 31) % 50_000) for k in range(3_000)]
    df = spark.createDataFrame(rows, "k int, s long").selectExpr("k", "timestamp_seconds(s) AS t")
    want = set()
    for key in range(3):
        armed = None
        for t in sorted(s for k, s in rows if k == key):
            if armed is None or t >= armed + 60:
                armed = t
                want.add((key, t))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["k"], r["armed_us"] // 1_000_000) for r in incremental.debounced_batch(df, "k", "t", 60).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_trees(spark):
    """A path of 40 nodes, a small tree and a lone node."""
    edges = [(k, k - 1 if k else None) for k in range(40)] + [(100, None), (101, 100), (102, 100), (103, 102), (200, None)]
    df = spark.createDataFrame(edges, "n long, p long")
    tops = {r["n"]: r["top"] for r in relational.top_of(df, "n", "p").collect()}
    assert tops == {n: 0 if n < 40 else 200 if n == 200 else 100 for n, _ in edges}
    marked = spark.createDataFrame([(5,), (103,)], "n long")
    assert {r["n"] for r in relational.with_marked_below(df, marked, "n", "p").collect()} == {0, 1, 2, 3, 4, 5, 100, 102, 103}


def test_mapping_equals_a_walk(spark):
    import random

    from foliospark.operators import mapping

    rng = random.Random(5)
    rows = [(b, c, t, rng.randrange(4) / 2) for b in range(6) for c in range(5) for t in range(4)]
    got = {tuple(r) for r in mapping.propose(spark.createDataFrame(rows, "b int, c int, t int, s double"), "b", "c", "t", "s").collect()}
    want = set()
    for b in range(6):
        free = sorted((r for r in rows if r[0] == b), key=lambda r: (-r[3], r[1], r[2]))
        while free:
            best = free[0]
            want.add(best)
            free = [r for r in free if r[1] != best[1] and r[2] != best[2]]
    assert got == want
