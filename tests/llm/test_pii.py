import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import pii

KEY = b"secret"
CASES = [
    ("Reviewed by Tomke Radulov last week.", "person_name", "Tomke Radulov"),
    ("According to Dr. Isaura de Quental the fix holds", "person_name", "Isaura de Quental"),
    ("cc OYELARAN-BECK, TUNDE", "person_name", "OYELARAN-BECK, TUNDE"),
    ("owner = R. Achterberg-Szabo", "person_name", "R. Achterberg-Szabo"),
    ("reviewed by T. M. Sjöbérgh", "person_name", "T. M. Sjöbérgh"),
    ("[p](mailto:zan.web+q@lab.field.test)", "email", "zan.web+q@lab.field.test"),
    ("to <a_b (at) example (dot) org>.", "email", "a_b (at) example (dot) org"),
    ("tomke.radulov @ mail.example;", "email", "tomke.radulov @ mail.example"),
    ("Phone=+44 (0)7700 900 539;", "phone", "+44 (0)7700 900 539"),
    ("dial (303) 555.0109 ext. 4", "phone", "(303) 555.0109"),
    ("01.99.00.40.69", "phone", "01.99.00.40.69"),
    ("030 23125 520", "phone", "030 23125 520"),
    ("SSN 000-12-1327.", "national_id", "000-12-1327"),
    ("QQ 35 24 48 C", "national_id", "QQ 35 24 48 C"),
    ("32.852.173-S.", "national_id", "32.852.173-S"),
    ("1 32 99 40 610 586 98", "national_id", "1 32 99 40 610 586 98"),
    ("we met at 17B Marrowwick Rd and talked", "street_address", "17B Marrowwick Rd"),
    ("to 214 N. Tolvergate Ave.. Then", "street_address", "214 N. Tolvergate Ave."),
    ("to 38 SEDGELDEN DRIVE.", "street_address", "38 SEDGELDEN DRIVE"),
    ("in Am Orvalfielder Platz 223.", "street_address", "Am Orvalfielder Platz 223"),
    ("Wrenndenstr. 84b", "street_address", "Wrenndenstr. 84b"),
    ("189 bis, boulevard de Pellanfield", "street_address", "189 bis, boulevard de Pellanfield"),
    ("Vive en Plaza Kestencroft nº 85.", "street_address", "Plaza Kestencroft nº 85"),
]
NONE = ["Pinned garidol@9.77.5 in the lockfile.", "@pripozesk(limit=01)", "byte offset 359911732 of 637822387", "trace 5977874b-3710-5073", "192.0.2.139:8107", "2026-05-24T05:11:03Z", "Chapter 27 Dravidruz Road map", "", None, "Elxobik Playbook is new"]


@pytest.mark.parametrize(("text", "kind", "value"), CASES)
def test_found(text, kind, value):
    assert [(k, text[a:b]) for a, b, k in pii.find(text)] == [(kind, value)]


@pytest.mark.parametrize("text", NONE)
def test_not_found(text):
    assert pii.find(text) == []


def test_email_hides_the_name():
    assert [k for _, _, k in pii.find("isaura.quental @ inbox.example.org")] == ["email"]


@settings(deadline=None)
@given(st.text("0123456789", max_size=30))
def test_permutation_is_undone(digits):
    new = pii.permute_digits(digits, KEY, "t")
    assert len(new) == len(digits) and pii.restore_digits(new, KEY, "t") == digits


def test_permutation_is_one_to_one():
    assert len({pii.permute_digits(f"{i:03d}", KEY) for i in range(1000)}) == 1000


def test_placeholders_link_and_keep_the_rest():
    text = "Call +44 20 7946 0783 or Bela; name: Radulov, Tomke.\r\n  Dr. Tomke Radulov, +44 20 7946 0783"
    out = pii.redact(text, KEY)
    phone = pii.pseudonym("phone", "+44 20 7946 0783", KEY)
    name = pii.pseudonym("person_name", "Tomke Radulov", KEY)
    assert out == f"Call [phone:{phone}] or Bela; name: [person_name:{name}].\r\n  Dr. [person_name:{name}], [phone:{phone}]"
    assert phone.startswith("+44 ") and phone != "+44 20 7946 0783" and len(phone) == 16
    assert pii.pseudonym("phone", "+44 20 7946 0783", b"other") != phone
    assert pii.redact(None, KEY) is None and pii.redact("nothing", KEY) == "nothing"


def test_tables(spark):
    long = "Nothing here. " * 20_000 + "Mail a.b@example.org now"
    df = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (2, None, "x"), (3, "", "x"), (None, "a.b@example.org", "x")], "doc_id long, text string, pii_type string")
    assert {(r.doc_id, r.pii_value) for r in pii.findings(df).collect()} == {(1, "a.b@example.org")}
    assert pii.redacted(df, key=KEY).count() == 5 and pii.findings(df.where("false")).count() == 0


ELSEWHERE = [
    ("Then Maria Schmidt left.", "person_name", "Maria Schmidt"),
    ("Reviewed by Frau Ottokar Zwirner today", "person_name", "Ottokar Zwirner"),
    ("Dear Xanthe O'Brien,", "person_name", "Xanthe O'Brien"),
    ("name: García, Iñaki", "person_name", "García, Iñaki"),
    ("Kind regards,\nBjörn Åkesson", "person_name", "Björn Åkesson"),
    ("Ask Wenzel van der Berg about it", "person_name", "Wenzel van der Berg"),
    ("dial +49 30 901820.", "phone", "+49 30 901820"),
    ("dial +49 30 1234567.", "phone", "+49 30 1234567"),
    ("dial +41 44 668 18 00", "phone", "+41 44 668 18 00"),
    ("dial +43 1 58858 0", "phone", "+43 1 58858 0"),
    ("dial +39 06 6982 1234", "phone", "+39 06 6982 1234"),
    ("dial 030 901820", "phone", "030 901820"),
    ("dial 0049 30 901820", "phone", "0049 30 901820"),
]


@pytest.mark.parametrize(("text", "kind", "value"), ELSEWHERE)
def test_names_and_phones_outside_the_lists(text, kind, value):
    assert [(k, text[a:b]) for a, b, k in pii.find(text)] == [(kind, value)]


@pytest.mark.parametrize("text", ["Der Server lief", "The Build Team said no", "2026-01-02 03:04:05", "+12 rows", "offset 0042 1234", "Dear Team Members,", "USER ASKED FOR CLOSET HOLPLALETH TOUR"])
def test_no_names_and_phones_outside_the_lists(text):
    assert pii.find(text) == []


def test_country_code_of_three_digits_stays():
    assert pii.pseudonym("phone", "+351 21 346 3000", KEY).startswith("+351 ")


@pytest.mark.parametrize("value", [a.replace(" ", "\xa0") if "der" not in a else a.replace(" B", "\xa0B").replace(" 3", "\xa03") for a in ("Lindenweg 5", "Nordufer 5", "Altdamm 5", "Südring 5", "Am Bach 3", "Im Bach 3", "Zum Bach 3", "Zur Bach 3", "An der Bach 3", "Auf der Bach 3", "In der Bach 3", "Berliner Tor 3")])
def test_german_streets_with_no_break_spaces_alone(value):
    assert [(k, t) for a, b, k in pii.find(f"wohnt {value}") for t in [f"wohnt {value}"[a:b]]] == [("street_address", value)]


ORDINARY = {
    "I spoke to John Smith about it.": ["John Smith"],
    "Signed by Maria García-López today": ["Maria García-López"],
    "Angela Merkel opened the fair.": ["Angela Merkel"],
    "My name is Jean-Luc Picard.": ["Jean-Luc Picard"],
    "cc Wei Zhang, please": ["Wei Zhang"],
    "Dr. Priya Patel and Emma Müller came": ["Priya Patel", "Emma Müller"],
    "written by J. R. R. Tolkien.": ["J. R. R. Tolkien"],
    "| Oluwaseun Adeyemi | oadeyemi@mail.example |": ["Oluwaseun Adeyemi"],
}


@pytest.mark.parametrize("text", ORDINARY)
def test_ordinary_names(text):
    assert [text[a:b] for a, b, k in pii.find(text) if k == "person_name"] == ORDINARY[text]


def _made(rnd, n):
    """Names of random letters, so that none is in any list."""
    word = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4))).capitalize()
    return [word() for _ in range(n)], [word() + rnd.choice("nrstk") for _ in range(n)]


def _corpus(seed, docs):
    """Texts with names of unknown parts, most of them with surroundings that say so, and other capitalised words. ``(text, names)`` each."""
    import random

    rnd = random.Random(seed)
    given_, family = _made(rnd, 40)
    things, more = _made(rnd, 40)
    sure = ["Reviewed by {} today.", "Dear {},\nthe build is green.", "author: {}\n", "Kind regards,\n{}", "{} said so.", "I asked Dr. {} for it."]
    bare = ["Later {} came back.", "We saw {} in the hall.", "That was {} again."]
    forms = [lambda g, f: f"{g} {f}", lambda g, f: f"{g} {f}".upper(), lambda g, f: f"{f}, {g}", lambda g, f: f"{g} K. {f}", lambda g, f: f"{g} van {f}"]
    out = []
    for _ in range(docs):
        names, text = [], ""
        for _ in range(3):
            name = rnd.choice(forms)(rnd.choice(given_), rnd.choice(family))
            names.append(name)
            text += rnd.choice(sure if rnd.random() < 0.6 else bare).format(name) + "\n"
            text += f"The {rnd.choice(things)} {rnd.choice(more)} is slow. We opened {rnd.choice(things)} {rnd.choice(more)} there.\n"
        out.append((text, names))
    return out


def test_names_of_parts_in_no_list_are_learned(spark):
    docs = _corpus(7, 400)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, text string")
    want = {(i, n) for i, (_, names) in enumerate(docs) for n in names}
    got = {(r.doc_id, r.pii_value) for r in pii.findings(df).where("pii_type = 'person_name'").collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)
    joined = {(r.doc_id, r.pii_value) for r in pii.findings(df, broadcast_words=0).where("pii_type = 'person_name'").collect()}
    assert joined == got  # the way of large lexicons
    alone = {(i, t[a:b]) for i, (t, _) in enumerate(docs) for a, b, k in pii.find(t) if k == "person_name"}
    assert len(alone & want) < 0.8 * len(want)  # it is the lexicon that finds the others


def test_lower_case_names_of_the_lexicon(spark):
    rows = [(i, "Reviewed by Ozan Kirvel today.") for i in range(3)] + [(9, "then ozan kirvel and kirvel ozan, OZAN KIRVEL; Ozankirvel no")]
    found = pii.findings(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 9").collect()
    assert [r.pii_value for r in sorted(found, key=lambda r: r.start)] == ["ozan kirvel", "kirvel ozan", "OZAN KIRVEL"]


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 99_999_999))
def test_validity_of_control_letters_stays(n):
    right = f"{n:08d}{pii.dni_letter(n)}"
    new = pii.pseudonym("national_id", right, KEY)
    assert pii.dni_letter(int(new[:8])) == new[8]
    wrong = f"{n:08d}{pii.dni_letter(n + 1)}"
    new = pii.pseudonym("national_id", wrong, KEY)
    assert pii.dni_letter(int(new[:8])) != new[8]
    assert pii.pseudonym("national_id", f"X-{n % 10**7:07d}-{pii.dni_letter(n % 10**7)}", KEY)[-1] == pii.dni_letter(int(pii.pseudonym("national_id", f"X-{n % 10**7:07d}-{pii.dni_letter(n % 10**7)}", KEY)[2:9]))


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 99), st.integers(1, 12), st.integers(0, 99_999_999), st.sampled_from(["", "2A", "2B"]))
def test_validity_of_keys_and_birth_months_stays(year, month, rest, corsica):
    body = f"1{year:02d}{month:02d}" + (corsica + f"{rest:08d}"[:6] if corsica else f"{rest:08d}")
    new = pii.pseudonym("national_id", f"{body}{pii.nir_key(body):02d}", KEY)
    assert len(new) == 15 and new[0] == "1" and 1 <= int(new[3:5]) <= 12 and pii.nir_key(new[:13]) == int(new[13:])
    assert not corsica or new[5:7][1] == corsica[1]


def test_social_security_numbers_of_unissued_ranges_stay_so():
    for value in ("000-12-1327", "900-11-2222", "666-01-0001"):
        assert not pii._issued("".join(c for c in pii.pseudonym("national_id", value, KEY) if c.isdigit()))
    assert pii._issued(pii.pseudonym("national_id", "123-45-6789", KEY).replace("-", ""))


def test_phones_keep_trunk_and_country():
    new = pii.pseudonym("phone", "+1 (303) 555-0109", KEY)
    assert new.startswith("+1 (") and new[4] not in "01" and new[9] not in "01"
    assert pii.pseudonym("phone", "030 901820", KEY).startswith("0")
    assert len({pii.pseudonym("phone", f"0{i}", KEY) for i in range(10, 100)}) == 90


@settings(deadline=None, max_examples=60)
@given(st.dates(min_value=__import__("datetime").date(1900, 1, 1), max_value=__import__("datetime").date(2099, 12, 31)))
def test_dates_are_permuted_among_days(day):
    assert 1900 <= pii.permute_date(day, KEY).year <= 2099
    assert pii.pseudonym("birth_date", f"{day:%d.%m.%Y}", KEY) == f"{pii.permute_date(day, KEY):%d.%m.%Y}"


def test_birth_dates_on_demand():
    text = "born 1987-03-14, geboren am 14.03.1987; released 2020-01-01; dob: 31.02.1990"
    assert pii.find(text) == []
    assert [text[a:b] for a, b, _ in pii.find(text, dates=True)] == ["1987-03-14", "14.03.1987", "31.02.1990"]
    assert pii.redact(text, KEY, dates=True).count("birth_date") == 3


def test_restored_is_the_text(spark):
    rows = [(1, "Ask John Smith at a.b@example.org, +49 30 901820, [phone:1] \U0001f600 Dr. Emma Kirvel"), (2, None), (3, ""), (4, "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in pii.restored(pii.redacted(df, key=KEY), pii.findings(df, key=KEY)).collect()} == set(rows)
