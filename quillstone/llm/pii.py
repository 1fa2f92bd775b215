"""Personal information in free text: finding it, and putting typed, linkable placeholders in its place.

Numbers are recognised by the formats of their countries, not by labels next to them;
addresses by the word for the street and the place of the number; names as ``names``
says, with a lexicon that is learned from the documents themselves. All offsets are in
code points of the text as it is.

A placeholder holds the type and a pseudonym. Digits of phone and identity numbers are
permuted by a keyed Feistel network over their own decimal format, so signs, spaces,
country codes and length stay, numbers stay valid (or invalid) as they were, with their
control letter or key recomputed, and equal numbers get equal pseudonyms in all documents;
dates of birth, which are looked for on demand, are permuted among days. Other values get a Feistel-permuted 40-bit code of their normalised form.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.names import BROADCAST_WORDS, FOLD, NONE, Lexicon, find_names, learn, with_lexicon

_AT = r"(?:[  ]?@[  ]?|[  ]?[\[({]\s?(?:at|arroba)\s?[\])}][  ]?|[  ]at[  ]|&#64;|&#x40;|%40|＠)"
_DOT = r"(?:\.|[  ]?[\[({]\s?(?:dot|punkt|punto|point)\s?[\])}][  ]?|[  ]dot[  ])"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_SIGN = re.compile(r"@|[\[({]\s?(?:at|arroba)\s?[\])}]|&#64;|&#x40;|%40|＠|(?<=[  ])at(?=[  ][a-z0-9-]+(?:\.|[  ]dot[  ])[a-z0-9])", re.I)
_DOMAIN = re.compile(rf"[  ]?{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[a-z]{{2,24}}(?![\w-])", re.I)

_s = r"[   .\-/]?"
_r = r"[   .\-/]"
PHONE = re.compile(
    r"(?<![\w+])\+(?:"
    rf"1{_s}(?:\(\d{{3}}\)|\d{{3}}){_s}\d{{3}}{_s}\d{{4}}"
    rf"|44{_s}(?:\(0\){_s})?(?:20{_s}\d{{4}}{_s}\d{{4}}|\d{{4}}{_s}\d{{3}}{_s}\d{{3}}|\d{{3}}{_s}\d{{3}}{_s}\d{{4}})"
    rf"|49{_s}(?:\(0\){_s})?\d{{2,4}}{_s}\d{{5}}{_s}\d{{3}}"
    rf"|33{_s}(?:\(0\){_s})?[1-9](?:{_s}\d\d){{4}}"
    rf"|34{_s}[6-9]\d\d(?:{_s}\d{{3}}{_s}\d{{3}}|(?:{_s}\d\d){{3}})"
    r")(?![\w])"
    r"|(?<![\w.\-/+(])(?:"
    rf"\([2-9]\d\d\){_s}\d{{3}}{_r}\d{{4}}"
    rf"|[2-9]\d\d{_r}\d{{3}}{_r}\d{{4}}"
    rf"|\(?0\d\d\)?{_r}\d{{4}}{_r}\d{{4}}"
    rf"|\(?0\d{{4}}\)?{_r}\d{{3}}{_s}\d{{3}}|07\d{{9}}"
    rf"|\(?0\d{{2,4}}\)?{_r}\d{{5}}{_s}\d{{3}}"
    rf"|0[1-9](?:{_r}\d\d){{4}}|0[1-9]\d{{8}}"
    rf"|[69]\d\d{_r}(?:\d{{3}}{_r}\d{{3}}|\d\d{_r}\d\d{_r}\d\d)"
    r")(?![\w]|[.\-/]\d)"
)
#: Numbers of any country (E.164, 8 to 15 digits, after a plus sign or 00), and national ones with a trunk zero (8 to 12 digits) in groups of any length.
ANY_PHONE = re.compile(
    r"(?<![\w.\-/+(,:])(?:"
    rf"(?P<abroad>(?:\+|00(?=[1-9]\d{{0,2}}[ \u00a0\u202f.\-/(]))[1-9]\d{{0,2}}(?:{_s}\(0\))?(?:{_s}\(\d{{1,4}}\))?(?:{_s}\d+){{1,7}})"
    rf"|(?:\(0[1-9]\d{{0,4}}\)[ \u00a0\u202f.\-/]?|0[1-9]\d{{1,4}}{_r})\d{{2,8}}(?:[ \u00a0\u202f\-]\d{{1,5}}){{0,3}}"
    r")(?![\w]|[.\-/:,]\d)"
)
NATIONAL = re.compile(
    r"(?<![\w.\-/+])(?:"
    r"\d{3}([-  ])\d\d\1\d{4}"
    r"|[A-Z]{2}[  ]?\d\d[  ]?\d\d[  ]?\d\d[  ]?[A-D]"
    r"|\d{8}-?[A-Z]|\d\d\.\d{3}\.\d{3}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r"|[12][  .]\d\d[  .]\d\d[  .]\d[\dAB][  .]\d{3}[  .]\d{3}(?:[  .]\d\d)?"
    r"|[12]\d\d(?:0[1-9]|1[0-2]|99)\d[\dAB]\d{6}(?:\d\d)?"
    r"|[A-Z]{2}\d{7}"
    r")(?![\w]|[.\-/]\d)"
)

_CAP = r"[^\W\d_][\w'’-]*"
_NO = r"\d{1,4}(?:[  ]?[A-Za-z](?![\w]))?"
_EN_WORDS = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Court|Ct|Drive|Dr|Close|Crescent|Terrace|Way|Square|Sq|Place|Pl|Boulevard|Blvd|Row|Mews"
_EN = f"(?:{_EN_WORDS}|{_EN_WORDS.upper()})"
#: Words that make a compound with the word for a street (road map, square root, court order), which then is none.
_COMPOUND = "maps?|views?|works|blocks?|orders?|cases?|roots?|feet|foot|met(?:er|re)s?|counts?|points?|buttons?|brackets?|letters?|names?|shafts?|trains?|tests?"
#: For each language, words of which one must be in a text before it is searched, and the pattern.
STREETS = tuple(
    (words, re.compile(pattern))
    for words, pattern in (
        ((), rf"(?<![\w.,\-/])\d{{1,4}}[A-Za-z]?[  ](?:(?:Old|New|Upper|Lower|Great|Little|North|South|East|West|[NSEW]\.)[  ])?[A-Z]{_CAP}(?:[  ][A-Z]{_CAP})?[  ](?:{_EN}(?![\w])(?:(?<=Ave)\.|(?<!et|ad|ne|ue|rt)\.(?=[.,;\"')]))?)(?![  ](?:{_COMPOUND})\b)"),
        (("straße", "strasse", "str.", "gasse", "allee", "platz", "Platz", "Ring", "Weg", "Ufer", "Damm", "Straße", "Allee", "Markt", "straÃ", *(w + gap for w in ("weg", "ufer", "damm", "ring", "Tor", "Am", "An der", "Auf der", "Im", "In der", "Zum", "Zur") for gap in " \xa0")), rf"(?<![\w-])(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm|ring|straÃ\x9fe)|(?:Am|An der|Auf der|Im|In der|Zum|Zur)[  ][A-ZÄÖÜ][\wäöüß-]*(?:[  ](?:Platz|Ring|Weg|Ufer|Damm|Straße|Allee|Tor|Markt))?|[A-ZÄÖÜ][\wäöüß-]*er[  ](?:Platz|Ring|Weg|Ufer|Damm|Straße|Allee|Tor|Markt))[  ]\d{{1,4}}[  ]?(?:[a-zA-Z](?![\w]))?"),
        (("rue ", "boulevard ", "bd ", "avenue ", "av. ", "place ", "chemin ", "allée ", "allee ", "impasse ", "quai ", "cours ", "route ", "square ", "\xa0"), rf"(?<![\w.\-/])\d{{1,4}}(?:[  ](?:bis|ter|quater))?,?[  ](?:rue|boulevard|bd|avenue|av\.|place|chemin|allée|allee|impasse|quai|cours|route|square)[  ](?:(?:de la|de l['’]|des|du|de|d['’])[  ]?)?(?:la[  ])?[A-ZÀ-Ý][\w'’-]*"),
        (("Calle", "C/", "Plaza", "Pza.", "Avenida", "Avda.", "Av.", "Paseo", "Pº", "Camino", "Ronda", "Travesía"), rf"(?<![\w-])(?:Calle|C/|Plaza|Pza\.|Avenida|Avda\.|Av\.|Paseo|Pº|Camino|Ronda|Travesía)[  ]?(?:(?:de la|de los|de las|del|de)[  ])?[A-ZÀ-Ý][\w'’-]*,?[  ](?:(?:nº|n\.º|núm\.|n°|no\.)[  ]?)?\d{{1,4}}(?:[  ]?[A-Za-z](?![\w]))?"),
    )
)
_CHAPTER = re.compile(r"(?:chapter|section|part|page|figure|table|kapitel|chapitre|capítulo)[  ]$", re.I)
_DIGIT = re.compile(r"\d")

ORDER = {k: i for i, k in enumerate(("email", "birth_date", "street_address", "national_id", "phone", "person_name"))}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    for m in _SIGN.finditer(text):
        a, b = m.span()
        if a and text[a - 1] in "  ":
            a -= 1
        if not a or not (text[a - 1].isalnum() or text[a - 1] == "_"):
            continue
        domain = _DOMAIN.match(text, b)
        if not domain:
            continue
        while a and (text[a - 1].isalnum() or text[a - 1] in "_.+%'-"):
            a -= 1
        while not (text[a].isalnum() or text[a] == "_"):
            a += 1
        yield a, domain.end()


def _streets(text: str) -> Iterator[tuple[int, int]]:
    for words, pattern in STREETS:
        if words and not any(w in text for w in words):
            continue
        for m in pattern.finditer(text):
            if not _CHAPTER.search(text, max(0, m.start() - 12), m.start()):
                yield m.start(), m.start() + len(m[0].rstrip("  "))


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        yield m.span()
    for m in ANY_PHONE.finditer(text):
        digits = sum(map(str.isdigit, m[0])) - 2 * m[0].startswith("00")
        if 8 <= digits <= (15 if m["abroad"] else 12):
            yield m.span()


def find(text: str | None, lexicon: Lexicon = NONE, *, dates: bool = False) -> list[tuple[int, int, str]]:
    """``(start, end, type)`` of every finding, by start; findings don't overlap. Where they would, the earlier of ``ORDER`` stays."""
    if not text:
        return []
    out = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(a, b, "street_address") for a, b in _streets(text)]
        out += [(m.start(), m.end(), "national_id") for m in NATIONAL.finditer(text)]
        out += [(a, b, "phone") for a, b in _phones(text)]
        out += [(*m.span("day"), "birth_date") for m in BIRTH.finditer(text)] if dates else []
    out += [(a, b, "person_name") for a, b in find_names(text, lexicon)]
    kept: list[tuple[int, int, str]] = []
    for f in sorted(out, key=lambda f: (ORDER[f[2]], f[0])):
        at = bisect_left(kept, f)
        if (at == 0 or kept[at - 1][1] <= f[0]) and (at == len(kept) or f[1] <= kept[at][0]):
            kept.insert(at, f)
    return kept


def _round(key: bytes, n: int, value: str, width: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{n}|{width}|{value}".encode(), key=key, digest_size=16).digest(), "big")


def permute_digits(digits: str, key: bytes, tweak: str = "") -> str:
    """A keyed permutation of the decimal strings of this length: ten Feistel rounds over two halves. ``restore_digits`` undoes it."""
    if len(digits) < 2:
        return str((int(digits) + _round(key, 0, tweak, 1)) % 10) if digits else ""
    u = len(digits) // 2
    a, b = digits[:u], digits[u:]
    for n in range(10):
        m = len(a)
        a, b = b, str((int(a) + _round(key, n, tweak + b, m)) % 10**m).zfill(m)
    return a + b


def restore_digits(digits: str, key: bytes, tweak: str = "") -> str:
    if len(digits) < 2:
        return str((int(digits) - _round(key, 0, tweak, 1)) % 10) if digits else ""
    u = len(digits) // 2
    a, b = digits[:u], digits[u:]
    for n in reversed(range(10)):
        m = len(b)
        a, b = str((int(b) - _round(key, n, tweak + a, m)) % 10**m).zfill(m), a
    return a + b


def _code(value: str, key: bytes) -> str:
    x = int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=5).digest(), "big")
    a, b = x >> 20, x & 0xFFFFF
    for n in range(8):
        a, b = b, a ^ (_round(key, n, str(b), 20) & 0xFFFFF)
    return f"{a << 20 | b:010x}"


def normal(kind: str, value: str) -> str:
    """What makes two spellings of a value the same person's."""
    v = value.translate(FOLD).lower()
    if kind == "person_name":
        last, comma, first = v.partition(",")
        return " ".join(f"{first} {last}".split() if comma else v.split())
    if kind == "email":
        v = re.sub(rf"{_AT}", "@", v, flags=re.I, count=1)
        return re.sub(rf"{_DOT}", ".", v, flags=re.I)
    return " ".join(v.split())


#: Country codes of two digits; those that begin otherwise have three, but for 1 and 7.
TWO_DIGIT = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _walk(digits: str, key: bytes, tweak: str, valid: Callable[[str], bool]) -> str:
    """The permutation confined to the digit strings for which ``valid`` is what it is for these: applied until one comes out."""
    want, new = valid(digits), permute_digits(digits, key, tweak)
    while valid(new) != want:
        new = permute_digits(new, key, tweak)
    return new


def _refill(value: str, digits: str) -> str:
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in value)


def _phone(value: str, key: bytes) -> str:
    """Country code, trunk zero and signs stay; the first digit behind them stays one that may stand there."""
    digits = "".join(c for c in value if c.isdigit())
    abroad = value.startswith("+") or digits.startswith("00")
    begin = 2 if digits.startswith("00") else 0
    keep = begin + (1 if digits[begin] in "17" else 2 if digits[begin : begin + 2] in TWO_DIGIT else 3) if abroad else int(digits[0] == "0")
    if "(0)" in value and digits[keep : keep + 1] == "0":
        keep += 1
    rest, code = digits[keep:], digits[begin:keep]
    if (code == "1" if abroad else not keep) and len(rest) == 10:  # area and exchange begin with 2 to 9
        return _refill(value, digits[:keep] + _walk(rest, key, "phone", lambda d: d[0] not in "01" and d[3] not in "01"))
    return _refill(value, digits[:keep] + _walk(rest, key, "phone", lambda d: d[:1] != "0"))


#: The control letters of Spanish identity numbers, by the number's rest modulo 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def dni_letter(number: int) -> str:
    return DNI_LETTERS[number % 23]


def nir_key(body: str) -> int:
    """The control key of a French identity number's first 13 signs."""
    return 97 - int(body.replace("2A", "19").replace("2B", "18")) % 97


def _issued(digits: str) -> bool:
    """Whether a US social security number's parts are of ranges that are issued."""
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _national(value: str, key: bytes) -> str:
    """Digits permuted within what the format allows; control letters and keys are those of the new number where they were those of the old."""
    signs = "".join(c for c in value if c.isalnum())
    digits = "".join(c for c in value if c.isdigit())
    if len(signs) == 9 and len(digits) in (7, 8) and signs[-1].isalpha() and (digits == signs[:8] or signs[0] in "XYZ" and digits == signs[1:8]):
        lead = str("XYZ".index(signs[0])) if signs[0] in "XYZ" else ""
        new = permute_digits(digits, key, "national_id")
        shift = (DNI_LETTERS.index(signs[-1]) - int(lead + digits)) % 23 if signs[-1] in DNI_LETTERS else None
        letter = signs[-1] if shift is None else DNI_LETTERS[(int(lead + new) + shift) % 23]
        at = len(value) - 1
        return _refill(value[:at], new) + letter
    if len(signs) in (13, 15) and signs[0] in "12" and (digits == signs or signs[6] in "AB"):
        body, old = signs[:13], signs[13:]
        stay = {0, 5, 6} if body[6] in "AB" else {0}  # the sex, and the departments that have a letter; year and month of birth lead the rest
        free = "".join(c for i, c in enumerate(body) if i not in stay)
        new = iter(_walk(free, key, "national_id", lambda d: 1 <= int(d[2:4]) <= 12))
        changed = "".join(c if i in stay else next(new) for i, c in enumerate(body))
        right = f"{nir_key(changed):02d}"
        tail = old and (right if int(old) == nir_key(body) else _walk(old, key, "key", lambda d: d == right))
        put = iter(changed + tail)
        return "".join(next(put) if c.isalnum() else c for c in value)
    if len(signs) == 9 and digits == signs:
        return _refill(value, _walk(digits, key, "national_id", _issued))
    return _refill(value, permute_digits(digits, key, "national_id"))


FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), 73049
#: Dates of birth behind their label; only where ``dates`` is asked for.
BIRTH = re.compile(r"(?<!\w)(?:born(?: on)?|dob|date of birth|birth ?date|geboren(?: am)?|geb\.|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)[ \t:=]*(?P<day>(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)|(?P<d2>\d\d?)(?P<sep>[./])(?P<m2>\d\d?)(?P=sep)(?P<y2>\d{4}))(?!\d)", re.I)


def permute_date(day: date, key: bytes) -> date:
    """A keyed permutation of the days of 1900 to 2099; other days stay."""
    n = day.toordinal() - FIRST_DAY
    return date.fromordinal(FIRST_DAY + int(_walk(f"{n:05d}", key, "date", lambda d: int(d) < DAYS))) if 0 <= n < DAYS else day


def _birth_date(value: str, key: bytes) -> str:
    """The permuted day in the form of the old one; what names no day gets a code."""
    numbers = re.split(r"[./-]", value)
    first = len(numbers[0]) == 4
    try:
        new = permute_date(date(*map(int, numbers if first else numbers[::-1])), key)
    except ValueError:
        return _code(f"birth_date|{value}", key)
    sep = "-" if first else "." if "." in value else "/"
    return new.isoformat() if first else f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year:04d}"


_FORMATS = {"phone": _phone, "national_id": _national, "birth_date": _birth_date}


def pseudonym(kind: str, value: str, key: bytes) -> str:
    return _FORMATS[kind](value, key) if kind in _FORMATS else _code(f"{kind}|{normal(kind, value)}", key)


def redact(text: str | None, key: bytes, lexicon: Lexicon = NONE, *, dates: bool = False) -> str | None:
    """The text with each finding replaced by ``[type:pseudonym]``; all else stays as it was."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind in find(text, lexicon, dates=dates):
        out += [text[at:start], f"[{kind}:{pseudonym(kind, text[start:end], key)}]"]
        at = end
    return "".join([*out, text[at:]])


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def findings(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", *, key: bytes = b"", dates: bool = False, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``doc_id, pii_type, pii_value, start, end, pseudonym``: every finding; the pseudonym is null without a key.

    The lexicon of names is learned from all these documents first, in a scan of its own.

    * Null ids and null texts have none. Repeated rows repeat their findings. Other columns are not read.
    * ``dates`` also finds dates of birth behind their label, as type ``birth_date``.
    """
    rows, held = with_lexicon(known := _texts(documents, doc_id, text).where("doc_id is not null and text is not null"), learn(known.select("text")), broadcast_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, lexicon in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), held(batch)):
                out += [(doc, kind, text[a:b], a, b, pseudonym(kind, text[a:b], key) if key else None) for a, b, kind in find(text, lexicon, dates=dates)]
            cols = list(zip(*out)) if out else [[]] * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "pii_type", "pii_value", "start", "end", "pseudonym"])

    return rows.mapInArrow(run, "doc_id long, pii_type string, pii_value string, start int, end int, pseudonym string")


def redacted(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", *, key: bytes, dates: bool = False, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``doc_id, text`` with placeholders; a null text stays null, and every row of the input gives one row. The lexicon as in ``findings``."""
    known = _texts(documents, doc_id, text)
    rows, held = with_lexicon(known, learn(known.where("doc_id is not null").select("text")), broadcast_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t, key, x, dates=dates) for t, x in zip(batch.column(1).to_pylist(), held(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")


def restored(redacted: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, text``: the redacted texts with the values of ``findings`` (made with the same key) in their old places again.

    For ids that are unique. A document without findings stays as it is. Raises where a placeholder is not where it should be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for text, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at, gone = [], 0, 0  # gone: by how much the redacted text is longer so far
                for v in sorted(values or (), key=lambda v: v["start"]):
                    mark = f"[{v['pii_type']}:{v['pseudonym']}]"
                    start = v["start"] + gone
                    if not text.startswith(mark, start):
                        raise ValueError(f"no placeholder {mark} at {start}")
                    parts += [text[at:start], v["pii_value"]]
                    at, gone = start + len(mark), gone + len(mark) - len(v["pii_value"])
                out.append("".join([*parts, text[at:]]) if parts else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    values = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "pii_type", "pii_value", "pseudonym")).alias("found"))
    return redacted.select("doc_id", "text").join(values, "doc_id", "left").mapInArrow(run, "doc_id long, text string")
