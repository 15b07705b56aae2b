from threadloom.llm import pii
from tests.conftest import block, record

CASES = [
    ("You can reach me at zelda dot haldahl at team dot northquay dot example, ok", {("email", "zelda dot haldahl at team dot northquay dot example")}),
    ("cc IHALOVA@EXAMPLE.ORG pls, or halina[at]labs[dot]invalid", {("email", "IHALOVA@EXAMPLE.ORG"), ("email", "halina[at]labs[dot]invalid")}),
    ("Clone it from git@forge.example:a/b.git, package @belvo/rel@1.9.4, selector user@{host}", set()),
    ("If the pager stays silent, try +44 20 7946 0769 ext. 4 instead", {("phone", "+44 20 7946 0769")}),
    ("Позвони мне по номеру +7 (000) 000-04-93, если", {("phone", "+7 (000) 000-04-93")}),
    ("Appelle-moi au 01 99 00 56 77 si", {("phone", "01 99 00 56 77")}),
    ("如果构建又失败了，请打电话 +86 100 0000 3309 联系我。", {("phone", "+86 100 0000 3309")}),
    ("The address 10.6.2.6:6256 is local; build 20260905-5344 took 3087 ms; went from 8121 9419", set()),
    ("WARN signup rejected user=ursula-kelvik@example.org ssn=99.097.701-Q rc=4", {("email", "ursula-kelvik@example.org"), ("id_number", "99.097.701-Q")}),
    ("I pasted SSN QQ 41 37 93 A by mistake; X58424712 is visible; id 00 424 023 288 too", {("id_number", "QQ 41 37 93 A"), ("id_number", "X58424712"), ("id_number", "00 424 023 288")}),
    ("Pickup is at 612 Old Hazelbrook St., next to the bakery", {("address", "612 Old Hazelbrook St.")}),
    ("Das Testgerät geht an Larkmoorallee 204a, zweiter Stock.", {("address", "Larkmoorallee 204a")}),
    ("partir au 912 bis, rue Wickerby, deuxième étage", {("address", "912 bis, rue Wickerby")}),
    ("El mapa no encuentra C/ Pinfold, 46 en la ciudad", {("address", "C/ Pinfold, 46")}),
    ("At 6 o’clock the Main Street dataset in /data/street/3727 was locked. Amber Harbor and Quiet Lantern.", set()),
    ("Dr. Grisvik, Delphine asked for the raw numbers", {("name", "Grisvik, Delphine")}),
    ("Célia Y. Ildivan’s row is duplicated", {("name", "Célia Y. Ildivan")}),
    ("Ask edvin ostivan whether the export works", {("name", "edvin ostivan")}),
    ('{"row": 122, "assignee": "C. Dravova", "contact": "x"}', {("name", "C. Dravova")}),
]


def _find(make_records, rows):
    return {(r.rec_id, r.block_no, r.pii_kind, r.pii_value) for r in pii.find(make_records(rows)).collect()}


def test_known_cases(make_records):
    rows = [record(k, blocks=[block(text="nothing here"), block(text=t)]) for k, (t, _) in enumerate(CASES)]
    want = {(k, 1, kind, v) for k, (_, found) in enumerate(CASES) for kind, v in found}
    assert _find(make_records, rows) == want


def test_blocks_fields_and_repeats(make_records):
    mail = "a.moro@inbox.test"
    rows = [
        record(1, blocks=[block("tool_use", input='{"command": "mail a.moro@inbox.test a.moro@inbox.test"}'), block("tool_result", content="to a.moro@inbox.test")]),
        record(2, uuid="u1", text=f"to {mail}"), record(3, blocks=[block(text=None)]), record(4, blocks=[]), record(5, text="x " * 50_000 + mail),
    ]
    assert _find(make_records, rows) == {(1, 0, "email", mail), (1, 1, "email", mail), (2, 0, "email", mail), (5, 0, "email", mail)}
    assert _find(make_records, []) == set()


def test_redacted_texts_keep_the_rest(make_records):
    rows = [record(k, text=t) for k, (t, _) in enumerate(CASES)]
    got = {r.rec_id: r.value for r in pii.redact(make_records(rows)).collect()}
    assert got[3] == "If the pager stays silent, try [PHONE] ext. 4 instead"
    assert got[8] == "WARN signup rejected user=[EMAIL] ssn=[ID_NUMBER] rc=4"
    assert got[2] == CASES[2][0]


def test_label_model_separates_contradicted_spans():
    import numpy as np

    votes = np.array([[1, 1, 1, 1, 0], [1, 1, 0, 1, 0], [1, -1, 0, -1, -1]], float)
    _, p = pii.label_model(votes, np.array([500, 100, 60.0]))
    assert p[0] > 0.9 and p[1] > 0.9 and p[2] < 0.1


#: Names, numbers and places that no list holds; sentences of everyday kind.
HELD_OUT = [
    ("Ask Priya Raghunathan whether the figures are right.", "name", "Priya Raghunathan"), ("Please contact Wei Zhang about the invoice.", "name", "Wei Zhang"),
    ("Mr. Mohammed Al-Farsi wrote to us on Monday.", "name", "Mohammed Al-Farsi"), ("Dr. John Smith said it would take a week.", "name", "John Smith"),
    ("Thank Jennifer Miller for the kind words.", "name", "Jennifer Miller"), ("reviewed by Oluwaseun Adeyemi", "name", "Oluwaseun Adeyemi"), ("Frau Annegret Hubschmid ruft morgen an.", "name", "Annegret Hubschmid"),
    ("Mme Solène Kerbrat est absente.", "name", "Solène Kerbrat"), ("author: Siobhan O'Connell", "name", "Siobhan O'Connell"), ("передай Ивану Петрову отчёт", "name", "Ивану Петрову"),
    ("请联系王伟先生处理这件事。", "name", "王伟"), ("我叫李小龙。", "name", "李小龙"), ("田中 太郎さんに連絡してください。", "name", "田中 太郎"), ("Signora Giulia Ferrero ha chiamato.", "name", "Giulia Ferrero"),
    ("the ssn 123456789 was in the log", "id_number", "123456789"), ("passport number X1234567 is on file", "id_number", "X1234567"), ("phone 5551234567 for help", "phone", "5551234567"), ("Tel: 02079460958", "phone", "02079460958"),
    ("he moved to Via Roma 15, Milano", "address", "Via Roma 15"), ("she lives at Linkstraat 12 now", "address", "Linkstraat 12"), ("the parcel goes to 14 Elm Street, Springfield", "address", "14 Elm Street"),
]
NOTHING = ["IBAN DE89 3704 0044 0532 0130 00 is on the invoice", "Amber Harbor and Quiet Lantern are code names", "Open Source and Pull Request", "The Main Street dataset", "version 123456789 of the tool"]


def test_recall_on_what_no_list_holds(spark, make_records):
    """By the classifier trained on the test table: at least nine in ten, and no harmless text."""
    from threadloom.session import read_table

    weights, _ = pii.fit(pii.spans(pii.block_fields(read_table(spark, "/root/testdata/sf0.01", "records"))))
    found = lambda t: {(k, t[a:b]) for a, b, k, form, votes in pii.candidates(t) if pii.score(weights, k, form, votes) >= 0.5}
    missed = [(t, found(t)) for t, kind, value in HELD_OUT if (kind, value) not in found(t)]
    assert len(missed) <= len(HELD_OUT) // 10, missed
    assert {t: found(t) for t in NOTHING if found(t)} == {}
