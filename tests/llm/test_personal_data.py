import pytest

from siltstone.llm import personal_data as P

PARTS = {"kalola": "given", "ilik": "given", "thorvadze": "family", "corvquist": "family"}


def types(text):
    return sorted({s[0] for s in P.spans_of(text, PARTS) if s[3]})


@pytest.mark.parametrize("text", ["mail a.b+c@mail.host.test now", "<a_1@b.example>", "a%40b.example", "a (at) mail (dot) b (dot) test", "a [at] b.example", "write a.b at mail dot host dot test", "A.B@HOST.EXAMPLE", "mailto:x@y.example&next=1", "a.b @ mail.host.test"])
def test_emails(text):
    assert types(text) == ["email"]


@pytest.mark.parametrize("text", ["(303) 555‑0173", "Tel. 303 555 0109", "+49 (0)30 23125 439", "+44 20 7946 0526", "020 7946 0140", "01632 960687", "0033 1 99 00 12 53", "+19195550152", "tel:+1-303-555-0193", "212.555.0164", "919 555 0131 ext. 51", "phone=415-555-0197 retry=3"])
def test_phones(text):
    assert types(text) == ["phone"]


@pytest.mark.parametrize("text", ["SSN 000-59-2564", "ssn=666943570", "social security number: 000 35 2455", "national id 053 189 149 33", "Steuer-ID 18 136 806 718", "DNI 49698300-Y", "TC kimlik no 23471831821", "NI number QQ 13 44 88 B", "passport JC3106225", "passport no. W93553344"])
def test_id_numbers(text):
    assert types(text) == ["id_number"]


@pytest.mark.parametrize("text", ["at 2396 N Millgate Ave. Apt 4", "509 HERONGATE ROAD\nOSTSTEAD 47576", "Flat 23, 54 Larchwood Court, Falford", "Fenwoodstraße 38, 97124 Ketitz", "Ashhurststr. 32b, 54436 Ludenau", "41 rue du Saddlegate, 30295 Falholm", "Calle Quarrygate 108, 2º A, 49511 Wynnholm", "Millbrook Sokak No: 16 Daire 8"])
def test_addresses(text):
    assert types(text) == ["address"]


@pytest.mark.parametrize("text", ["Kalola Thorvadze", "by kalola thorvadze", "KALOLA THORVADZE", "Thorvadze, Kalola", "K. Thorvadze", "Ilik D. Corvquist"])
def test_names(text):
    assert types(text) == ["name"]


@pytest.mark.parametrize("text", ["Clone git@host.example:tools/x.git first.", "Pin rodvo-core@7.6.5 in the lock file", "`@sebri.wraps` hides it", "Part no. 94-3499-98 is a key", "Ticket X-43971 blocks", "Run id 5096615961 finished", "Epoch 1713992058 is when", "Trace 7a414a77-d208-45d2-a353-5576f0579352 is complete", "The node 10.227.84.164:9662 answers", "Range 2025-03-14 to 2025-04-10", "Values like [EMAIL] or [PHONE]", "Lane 4 of the tokenizer drive is idle", "The Thorvadze heuristic", "kalola.thorvadze", "Commit b134565610a9 broke it", "", "points at a dot"])
def test_decoys(text):
    assert types(text) == []


def test_unknown_parts_are_found_by_what_is_around_them(spark):
    known = [f"Customer: Kalola {f} reported that it failed." for f in ("Thorvadze", "Corvquist")] * 8
    new = ["Customer: Kalola Zumberg reported that it failed.", "Customer: Ilik Zumberg reported that it failed."] * 4
    both = ["Customer: Orund Feldmark reported that it failed."]
    plain = ["The kalola branch is behind.", "The Corvquist heuristic beats it."] * 12
    rows = [("message", f"m{i}", t) for i, t in enumerate(known + new + both + plain)] + [("message", "null", None), ("queue", "empty", ""), ("message", "m0", known[0])]
    texts = spark.createDataFrame(rows, "record_type string, record_id string, text string")
    roster = spark.createDataFrame([("Kalola", "given"), ("ILIK", "given"), ("thorvadze", "family"), ("Corvquist", "family"), (None, "given")], "name_part string, part_kind string")
    got = {r.record_id for r in P.found_types(texts, roster).collect() if r.pii_type == "name"}
    assert got == {f"m{i}" for i in range(len(known + new + both))}
    out = {r.record_id: r.text for r in P.redacted(texts, roster).collect()}
    assert out["m0"] == "Customer: [NAME] reported that it failed." and out["null"] is None and out["empty"] == "" and len(out) == len(rows) - 1
    assert out[f"m{len(rows) - 5}"] == plain[-2]


def test_no_rows(spark):
    texts = spark.createDataFrame([], "record_type string, record_id string, text string")
    roster = spark.createDataFrame([], "name_part string, part_kind string")
    assert P.found_types(texts, roster).count() == 0 and P.redacted(texts, roster).count() == 0


def test_redaction_keeps_the_rest():
    assert P.redact("abc def ghi", [(4, 7, "name"), (5, 9, "email")]) == "abc [NAME]hi"
    assert P.redact("abc", []) == "abc"


@pytest.mark.parametrize("gap", [" ", "\n", "\t", "  "])
def test_signs_pass_all_that_the_street_patterns_match(gap):
    ends = ["", ".", ",", ")", ";", "\n"]
    texts = [f"12 Elm{gap}{w}{e}" for w in P._STREETS.split("|") for e in ends]
    texts += [f"12{gap}{w.replace(chr(92), '')}{gap}Bellecour{e}" for w in P._RUES.split("|") for e in ends]
    texts += [f"{w}{gap}Mayor{gap}12" for w in ("Calle", "C/", "Avenida", "Avda", "Avda.", "Plaza", "Paseo", "Camino", "Carrer", "CALLE", "calle", "Via", "Viale", "Rua", "Vİa", "Vıale", "Plaza")]
    texts += [f"12 elm{gap}{w}{gap}London{gap}12345" for w in ("street", "road", "avenue", "lane", "court", "boulevard")]
    texts += [f"{w}{gap}12" for w in ("Hauptstraße", "Hauptstrasse", "Hauptstr.", "Holzweg", "Seegasse", "Marktplatz", "Lindenallee", "HAUPTSTRASSE", "HAUPTSTR.", "Lange Straße", "Lange Str.", "Langer Weg")]
    texts += [f"Gül{gap}{w}{gap}No: 12" for w in ("Sokak", "Sokağı", "Sok.", "Sk.", "Caddesi", "Cad.", "Cd.", "Bulvarı", "SOKAK", "CADDESİ", "CADDESI", "sokak", "caddesi")]
    for text in texts:
        matching = [p for p in P._ADDRESSES if p.search(text)]
        assert matching and set(matching) <= set(P._streets(text, text.lower())), text


@pytest.mark.parametrize("text", ["12 place Bellecour", "8 route Napoléon", "45 ELM ST", "(45 ELM ST)", "45 Elm\nAvenue"])
def test_addresses_with_no_other_sign(text):
    assert [s[0] for s in P.spans_of(text, {})] == ["address"]


def texts_of(spark, rows):
    return spark.createDataFrame(rows, "record_type string, record_id string, text string")


def test_patterns_find_loose_emails_and_addresses(spark):
    roster = spark.createDataFrame([("Kalola", "given")], "name_part string, part_kind string")
    seeds = [f"You can reach me via u{c}@mail.example for the rest." for c in "abcdefghij"] + [f"The parcel was shipped to {n} Elm Street by courier." for n in range(10, 22)]
    loose = ["You can reach me via jane at host . example for the rest.", "The parcel was shipped to 17 Rosewood Mews by courier."]
    # The same forms in places that no seed speaks for.
    prose = ["They met at config . yaml and left it.", "We counted 17 Blue Workers in the pool."]
    rows = [("message", f"m{i}", t) for i, t in enumerate(seeds + loose + prose)]
    got = {(r.record_id, r.pii_type) for r in P.found_types(texts_of(spark, rows), roster).collect()}
    n = len(seeds)
    assert got == {(f"m{i}", "email") for i in range(10)} | {(f"m{i}", "address") for i in range(10, n)} | {(f"m{n}", "email"), (f"m{n + 1}", "address")}
    alone = {r.record_id for r in P.found_types(texts_of(spark, rows[n:]), roster).collect()}
    assert alone == set()


def test_texts_of_one_id_are_redacted_apart(spark):
    roster = spark.createDataFrame([], "name_part string, part_kind string")
    rows = [("message", "x", "a long way to ann@mail.example here"), ("message", "x", "bob@mail.example"), ("message", "x", "plain"), ("message", "x", "plain"), ("queue", None, "cy@mail.example"), ("queue", None, "nothing"), ("queue", None, None)]
    out = sorted((r.record_id or "", r.text or "") for r in P.redacted(texts_of(spark, rows), roster).collect())
    assert out == [("", ""), ("", "[EMAIL]"), ("", "nothing"), ("x", "[EMAIL]"), ("x", "a long way to [EMAIL] here"), ("x", "plain")]
    assert {(r.record_type, r.record_id) for r in P.found_types(texts_of(spark, rows), roster).collect()} == {("message", "x"), ("queue", None)}
