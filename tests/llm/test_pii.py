import pytest

from conftest import rows_of
from quillmesh.llm import pii


@pytest.mark.parametrize(
    ("text", "kinds", "redacted"),
    [
        ("write to ann.lee@mail.example.test now", ["email"], "write to [EMAIL] now"),
        ("ann.lee (at) mail (dot) example (dot) test", ["email"], "[EMAIL]"),
        ("You can reach me at ann.lee at mail dot example dot test.", ["email"], "You can reach me at [EMAIL]."),
        ("contact: <mailto:a_b@c.example>", ["email"], "contact: <mailto:[EMAIL]>"),
        ("ann[at]c.example", ["email"], "[EMAIL]"),
        ("аnn.lее@mаil.ехаmple.test", ["email"], "[EMAIL]"),
        ("a​nn@c.example!", ["email"], "[EMAIL]!"),
        ("use @Guard(9308) on Service, velkin@3.6.1, user@ alone, at least 5 entries", [], None),
        ("Call (421) 555-0105 please", ["phone"], "Call [PHONE] please"),
        ("+44 7700 900092", ["phone"], "[PHONE]"),
        ("text me on five five five zero one three three Both", ["phone"], "text me on [PHONE] Both"),
        ("Mi teléfono es (+34) 55501 0046.", ["phone"], "Mi teléfono es [PHONE]."),
        ("Build 5.0.0 failed on 192.0.2.205 at 2025-03-16 03:27:00, order 005737-42-5737, limit 2412-19, run 00-1508-3", [], None),
        ("uuid f883170b-f883-4883-a831-f883170b3100", [], None),
        ("SSN: 902-34-2504.", ["national_id"], "SSN: [NATIONAL_ID]."),
        ("my social is 914 13 9104", ["national_id"], "my social is [NATIONAL_ID]"),
        ("CPF 213 454 427 90", ["national_id"], "CPF [NATIONAL_ID]"),
        ("documento nacional 99.995.491-R para", ["national_id"], "documento nacional [NATIONAL_ID] para"),
        ("A social security number has three groups of digits.", [], None),
        ("at 260 Larkmoor Street, Apt 21, Wexford Hollow", ["address"], "at [ADDRESS]"),
        ("Moro na Rua do Moinho Torto, 147 - fundos", ["address"], "Moro na [ADDRESS]"),
        ("La factura va a Calle Conde de Valmoreda, 12, piso 3.", ["address"], "La factura va a [ADDRESS]."),
        ("the path /street/0042/avenue is a route; Amber Lane is a service name", [], None),
        ("My name is Ann Thornebrook.", ["person_name"], "My name is [PERSON_NAME]."),
        ("my name is ann thornebrook.", ["person_name"], "my name is [PERSON_NAME]."),
        ("Signed: THORNEBROOK, ANN", ["person_name"], "Signed: [PERSON_NAME]"),
        ("I spoke with I. Okonderu about this.", ["person_name"], "I spoke with [PERSON_NAME] about this."),
        ("Ann Lee <x@y.example>", ["email", "person_name"], "[PERSON_NAME] <[EMAIL]>"),
        ("Is it on?\nann thornebrook", ["person_name"], "Is it on?\n[PERSON_NAME]"),
        ("no content", [], None),
        (r'{"note": "Ann Thornebrook\n12 Larkmoor Road, Apt 3\n+44 7700 900092"}', ["address", "person_name", "phone"], r'{"note": "[PERSON_NAME]\n[ADDRESS]\n[PHONE]"}'),
        ("Thanks, Orsava Support", [], None),
        ("My name is the value of the Drasmont field.", [], None),
        ("", [], None),
        (None, [], None),
    ],
)
def test_find_and_redact(text, kinds, redacted):
    assert sorted({k for _, _, k in pii.find(text)}) == kinds
    assert pii.redact(text) == (text if redacted is None else redacted)


def test_spans_map_back_to_the_source():
    text = "x​ ann (at) ｃ (dot) example, then five five five zero one three three"
    spans = pii.find(text)
    assert [text[a:b] for a, b, _ in spans] == ["ann (at) ｃ (dot) example", "five five five zero one three three"]
    t = pii.Tracked("abc")
    t.rewrite([(1, 2, "XYZ")])
    assert t.text == "aXYZc" and t.source(0, 5) == (0, 3) and t.source(2, 3) == (1, 2)


def test_tables(spark):
    long = "filler text. " * 20_000 + "mail a@b.example"
    df = spark.createDataFrame([("1", "a@b.example and c@d.example", "k"), ("1", "a@b.example and c@d.example", "k"), ("2", None, "k"), (None, "a@b.example", "k"), ("3", long, "k")], "id string, text string, kinds string")
    got = rows_of(pii.personal_information({"t": (df, "id", "text"), "u": (df.limit(0), "id", "text")}), "source_table", "record_id", "kind")
    assert got == [("t", "1", "email"), ("t", "3", "email")]
    red = {r.record_id: r.redacted for r in pii.redact_column(df, "id", "text").collect()}
    assert red["1"] == "[EMAIL] and [EMAIL]" and red["2"] is None and red["3"].endswith("mail [EMAIL]")


def _met(spark):
    """Texts in which names follow cues, and the same words of technical lines are used in lower case."""
    rows = [(f"c{i}", f"My name is {n}.") for i, n in enumerate(["María Ruiz", "María Soto", "María Vega", "Pedro López", "Ana López", "Iris López", "Priya Rao", "Priya Sen", "Priya Nair", "Tom Natarajan", "Kim Natarajan", "Lee Natarajan"])]
    rows += [(f"w{i}", t) for i, t in enumerate(["say hello to the world and to data", "the release of a candidate is new science", "start docker and compose the world again", "a hello, a release, a candidate for docker to compose, data science"] * 3)]
    rows += [("n1", "I met María López yesterday at the office."), ("n2", "The report by Priya Natarajan was late."), ("n3", "Zorn Quex was there too."), ("t1", "Hello World"), ("t2", "Release Candidate"), ("t3", "docker compose"), ("t4", "We use Docker Compose and Data Science a lot."), ("a1", "Orin Thornebrook"), ("a2", "orin thornebrook"), ("x", None), ("y", "")]
    return spark.createDataFrame(rows, "id string, text string")


def test_names_inside_sentences_are_found_and_technical_lines_are_not(spark):
    df = _met(spark)
    got = {r.record_id for r in pii.personal_information({"t": (df, "id", "text")}).collect() if r.kind == "person_name"}
    assert got == {f"c{i}" for i in range(12)} | {"n1", "n2", "a1", "a2"}
    red = {r.record_id: r.redacted for r in pii.redact_tables({"t": (df, "id", "text"), "none": (df.limit(0), "id", "text")}).collect()}
    assert red["n1"] == "I met [PERSON_NAME] yesterday at the office." and red["t1"] == "Hello World" and red["x"] is None and red["y"] == ""


def test_evidence_of_no_texts(spark):
    e = pii.name_evidence(_met(spark).limit(0).select("text"))
    assert not e.is_person("María López") and not e.is_common("Hello World")
    assert pii.find("Signed: Ann Thornebrook", e) == pii.find("Signed: Ann Thornebrook")
