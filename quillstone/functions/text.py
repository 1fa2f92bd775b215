"""Row-level text functions as column expressions. Each has the same text in SQL in ``plans.sqltext``."""

from __future__ import annotations

import datetime as dt
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import words as W

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def identifier_tokens(x: Column) -> Column:
    """Words of a text or identifier: cut where a lower letter meets A-Z and at anything that is no letter or digit; ASCII lower case; one-byte words and stop words dropped. Order and repeats stay; null gives null."""
    cut = F.regexp_replace(x, r"([a-z]|[^\x00-\x7F])([A-Z])", "$1 $2")
    parts = F.split(F.regexp_replace(ascii_lower(cut), r"[^\p{L}\p{N}]+", " "), " ")
    stop = _literals(W.STOPWORDS)
    return F.filter(parts, lambda t: (F.octet_length(t) > 1) & ~F.array_contains(stop, t))


def tokens_of(text: str) -> list[str]:
    """``identifier_tokens`` of one text, on the driver, for queries."""
    cut = re.sub(r"([a-z]|[^\x00-\x7F])([A-Z])", r"\1 \2", text)
    parts = re.split(r"[\W_]+", "".join(c.lower() if c.isascii() else c for c in cut))
    return [t for t in parts if len(t.encode()) > 1 and t not in W.STOPWORDS]


def variants(tokens: list[str]) -> list[str]:
    """Runs of two or three tokens (of one, if there is just one), joined by a blank, ``_``, ``-`` and nothing."""
    widths = [1] if len(tokens) == 1 else range(2, min(3, len(tokens)) + 1)
    joined = [sep.join(tokens[i : i + w]) for w in widths for i in range(len(tokens) - w + 1) for sep in (" ", "_", "-", "")]
    return list(dict.fromkeys(joined))


def concepts(tokens: list[str]) -> list[str]:
    return list(dict.fromkeys(W.CANONICAL[t] for t in tokens if t in W.CANONICAL))


def core_tokens(tokens: list[str]) -> list[str]:
    """Query tokens without the words of asking and recalling."""
    return [t for t in tokens if t not in W.SCAFFOLD]


def _unmarked() -> tuple[str, str]:
    """Letters of the Latin blocks that are another letter with marks, and those other letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, UNMARKED = _unmarked()


def lexical_fold(x: Column) -> Column:
    """Lower case without diacritics of Latin letters, composed or combining."""
    return F.regexp_replace(F.lower(F.translate(x, MARKED, UNMARKED)), "[\u0300-\u036f]", "")


def lexical_folded(text: str) -> str:
    """``lexical_fold`` of one text, on the driver, for queries."""
    return re.sub("[\u0300-\u036f]", "", text.translate(str.maketrans(MARKED, UNMARKED)).lower())


def lexical_words(x: Column) -> Column:
    """Words of the inverted index: folded, not cut inside identifiers."""
    return F.regexp_extract_all(lexical_fold(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def split_identifier(x: Column) -> Column:
    """Words of an identifier, acronyms kept together (``HTTPServer`` gives http, server); lower case."""
    x = F.regexp_replace(x, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    x = F.regexp_replace(x, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")), " "), lambda t: t != "")


def slug_hyphen(x: Column) -> Column:
    return F.btrim(F.regexp_replace(ascii_lower(x), r"[^a-z0-9]+", "-"), F.lit("-"))


def slug_underscore(x: Column) -> Column:
    return F.btrim(F.regexp_replace(ascii_lower(x), r"[^a-z0-9]", "_"), F.lit("_"))


def squeezed(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"\s+", " "))


def excerpt(x: Column, n: int) -> Column:
    """White space collapsed, cut to ``n`` characters and ``...``."""
    s = squeezed(x)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def normalised(x: Column) -> Column:
    """Trimmed; null where nothing is left."""
    return F.nullif(F.btrim(x, F.lit(" \t\r\n")), F.lit(""))


def base_name(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, r"([^/\\]*)$", 1), F.lit("?"))


def extension(path: Column) -> Column:
    """Lower case with its dot; empty without one. A leading dot starts a name, not an extension."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def short_date(x: Column) -> Column:
    return F.left(x, F.lit(10))


def memory_date(x: Column) -> Column:
    """The date of an RFC 3339 text in its own offset, of ``YYYY/MM/DD (Day) HH:MM``, or of the first ten characters; null else."""
    iso = F.when(F.left(x, F.lit(10)).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.left(x, F.lit(10)), F.lit("yyyy-MM-dd")).cast("date"))
    slashed = F.regexp_extract(x, r"^(\d{4}/\d{2}/\d{2}) \(", 1)
    return F.coalesce(iso, F.when(slashed != "", F.try_to_timestamp(slashed, F.lit("yyyy/MM/dd")).cast("date")))


def parse_date(text: str | None) -> dt.date | None:
    """``memory_date`` on the driver."""
    for pattern, form in ((r"^\d{4}-\d{2}-\d{2}", "%Y-%m-%d"), (r"^\d{4}/\d{2}/\d{2}(?= \()", "%Y/%m/%d")):
        if text and (m := re.match(pattern, text)):
            try:
                return dt.datetime.strptime(m[0], form).date()
            except ValueError:
                pass
    return None


def relative_date(query: str, as_of: str | None) -> dt.date | None:
    """The day that a query means by ``yesterday``, ``last monday`` or ``three weeks ago``, seen from ``as_of``.

    Months have 30 days and years 365. Only the first ``last`` counts; a number out of range gives no day at all.
    """
    today = parse_date(as_of)
    if today is None:
        return None
    t = [x for x in re.split(r"[^a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in query)) if x]
    if "yesterday" in t:
        return today - dt.timedelta(days=1)
    if "last" in t:
        follower = t[t.index("last") + 1 :][:1]
        if follower and follower[0] in W.WEEKDAYS:
            return today - dt.timedelta(days=(today.weekday() - W.WEEKDAYS.index(follower[0])) % 7 or 7)
    units = {"day": 1, "week": 7, "month": 30, "year": 365}
    for amount, unit, ago in zip(t, t[1:], t[2:]):
        number = int(amount) if amount.isdigit() else W.NUMBER_WORDS.index(amount) + 1 if amount in W.NUMBER_WORDS else None
        if ago == "ago" and number is not None and unit.rstrip("s") in units:
            try:
                return today - dt.timedelta(days=number * units[unit.rstrip("s")])
            except OverflowError:
                return None
    return None


def relative_day(query: Column, as_of: Column) -> Column:
    """``relative_date`` over columns."""
    today = memory_date(as_of)
    q = F.concat(F.lit(" "), F.regexp_replace(ascii_lower(query), r"[^a-z0-9]+", " "), F.lit(" "))
    back = F.lit(None).cast("int")
    for i, day in enumerate(W.WEEKDAYS):
        days = F.pmod(F.weekday(today) - i, F.lit(7))
        back = F.when(F.regexp_extract(q, r"^(?:(?! last ).)* last ([a-z0-9]+) ", 1) == day, F.when(days == 0, 7).otherwise(days)).otherwise(back)
    amount = F.regexp_extract(q, rf" (\d{{1,6}}|{'|'.join(W.NUMBER_WORDS)}) (?:day|week|month|year)s* ago ", 1)
    unit = F.regexp_extract(q, rf" (?:\d{{1,6}}|{'|'.join(W.NUMBER_WORDS)}) (day|week|month|year)s* ago ", 1)
    number = F.coalesce(F.expr("try_cast(NULL AS INT)"), F.when(amount.rlike(r"^\d+$"), amount.try_cast("int")))
    for i, word in enumerate(W.NUMBER_WORDS):
        number = F.when(amount == word, F.lit(i + 1)).otherwise(number)
    days = number * F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365)
    return F.when(F.contains(q, F.lit(" yesterday ")), F.date_sub(today, 1)).when(back.isNotNull(), F.date_sub(today, back)).when(days.isNotNull(), F.date_sub(today, days))


def content_kind(path: Column, wing: Column, room: Column, missing: str = "prose") -> Column:
    """Kind of content by the first rule that holds: diary, code by extension, conversation by a marker, documentation by extension or name; else prose, or ``missing`` where there is no path."""
    p = F.replace(ascii_lower(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    wing, room = ascii_lower(wing), ascii_lower(room)
    ext = F.regexp_extract(p, r"[^/]\.([^./]+)$", 1)
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    marked = F.lit(False)
    for marker in W.CHAT_MARKERS:
        for x in (wing, room, p):
            marked = marked | F.coalesce(F.contains(x, F.lit(marker)), F.lit(False))
    doc = ext.isin(W.DOC_EXTENSIONS)
    for prefix in W.DOC_PREFIXES:
        doc = doc | F.startswith(name, F.lit(prefix))
    return (
        F.when((room == "diary") | F.array_contains(F.split(p, "/"), "diary"), "diary")
        .when(ext.isin(W.CODE_EXTENSIONS), "code")
        .when(marked, "conversation")
        .when(doc, "documentation")
        .when(path.isNotNull(), "prose")
        .otherwise(missing)
    )


def known_kind(kind: Column) -> Column:
    """A stored kind, ``unknown`` where it isn't one."""
    k = F.lower(F.btrim(kind))
    return F.when(k.isin(list(W.KINDS)), k).otherwise("unknown")


def language(path: Column) -> Column:
    """Programming language by extension; null else."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for name, exts in W.LANGUAGES.items():
        out = F.when(ext.isin([f".{e}" for e in exts.split()]), name).otherwise(out)
    return out


def room_of_path(path: Column) -> Column:
    """First folder of a relative path, lower case, blanks as ``_``; ``general`` for a file without folder or no path."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) > 1, F.replace(F.lower(F.btrim(parts[0])), F.lit(" "), F.lit("_"))).otherwise("general")


def without_front_matter(x: Column) -> Column:
    """Text behind a leading ``---`` block; both fences must have the same kind of line end."""
    unix = F.regexp_replace(x, r"\A---\n(?s:.*?)\n---\n", "")
    return F.when(F.startswith(x, F.lit("---\r\n")), F.regexp_replace(x, r"\A---\r\n(?s:.*?)\r\n---\r\n", "")).otherwise(unix)


def diary_topic(source: Column) -> Column:
    return F.regexp_replace(source, "^diary/", "")


def compact_path(path: Column) -> Column:
    """The last six parts of a path, with slashes."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 5, F.lit(1)), F.lit(6)), "/")


def embedding_input(content: Column, retrieval_text: Column, source_file: Column, kind: Column) -> Column:
    """What is encoded: the retrieval text or else the content; for code with its path and up to 48 different identifier words in front."""
    body = F.coalesce(retrieval_text, content)
    source = F.coalesce(compact_path(source_file), F.lit(""))
    names = F.slice(F.array_distinct(F.concat(F.coalesce(identifier_tokens(source_file), F.array().cast("array<string>")), F.coalesce(identifier_tokens(body), F.array().cast("array<string>")))), 1, 48)
    code = F.concat(
        F.when(source != "", F.concat(F.lit("source: "), source, F.lit("\n"))).otherwise(""),
        F.when(F.size(names) > 0, F.concat(F.lit("identifiers: "), F.array_join(names, " "), F.lit("\n"))).otherwise(""),
        body,
    )
    return F.when(kind == "code", code).otherwise(body)


def code_retrieval_text(path: Column, lang: Column, enclosing: Column, symbol: Column, code: Column) -> Column:
    enclosing, symbol = F.coalesce(enclosing, F.lit("file")), F.coalesce(symbol, F.lit("file"))
    words = F.array_join(F.concat(split_identifier(symbol), split_identifier(enclosing)), " ")
    lines = [("path: ", path), ("\nlanguage: ", lang), ("\nenclosing: ", enclosing), ("\nsymbol: ", symbol), ("\nidentifier words: ", words), ("\ncode:\n", code)]
    return F.concat(*[x for label, value in lines for x in (F.lit(label), value)])


def diary_retrieval_text(path: Column, room: Column, agent: Column, filed_at: Column, chunk: Column) -> Column:
    in_path = F.regexp_extract(path, r"(?:^|[/_])(\d{4}-\d{2}-\d{2})", 1)
    def dated(x: Column) -> Column:
        return F.when(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).isNotNull(), x)
    date = F.coalesce(dated(F.left(filed_at, F.lit(10))), dated(in_path), F.lit("unknown"))
    source = F.coalesce(F.concat(F.lit("\nsource: "), path), F.lit(""))
    return F.concat(F.lit("kind: diary\ndate: "), date, F.lit("\nagent: "), agent, F.lit("\ntopic: "), room, source, F.lit("\nverbatim:\n"), chunk)


def prose_retrieval_text(path: Column, chunk: Column) -> Column:
    return F.coalesce(F.concat(F.lit("kind: prose\nsource: "), path, F.lit("\nverbatim:\n"), chunk), chunk)


_ROLES = ("user", "assistant", "system", "developer", "tool")


def _turns(value, out: list[str]) -> None:
    if isinstance(value, dict):
        role, content = value.get("role"), value.get("content")
        if role in _ROLES:
            if isinstance(content, str):
                said = " ".join(content.split())
            elif isinstance(content, list):
                parts = [p for p in content if isinstance(p, dict)]
                said = " ".join(t for p in parts if isinstance(t := p.get("text", p.get("content")), str)) or None
            else:
                said = content.get("text") if isinstance(content, dict) and isinstance(content.get("text"), str) else None
            if said is not None:
                out.append(f"{role}: {said}")
        value = list(value.values())
    for inner in value if isinstance(value, list) else ():
        _turns(inner, out)


def turns_of(chunk: str | None) -> str:
    """``role: text`` lines of the JSON lines of a chunk, neighbours that are equal once."""
    out: list[str] = []
    for line in (chunk or "").splitlines():
        if line.lstrip()[:1] in ("{", "["):
            try:
                _turns(json.loads(line), out)
            except (ValueError, RecursionError):
                pass
    return "\n".join(t for i, t in enumerate(out) if not i or out[i - 1] != t)


def _all_turns(chunks):
    return chunks.map(turns_of)


_all_turns.__annotations__ = {"chunks": pd.Series, "return": pd.Series}


def conversation_retrieval_text(path: Column, wing: Column, room: Column, chunk: Column) -> Column:
    turns = F.pandas_udf(_all_turns, "string")(chunk)
    source = F.coalesce(F.concat(F.lit("\nsource: "), path), F.lit(""))
    roles = F.when(turns != "", F.concat(F.lit("\nroles:\n"), turns)).otherwise("")
    return F.concat(F.lit("kind: conversation\nsession: "), wing, F.lit("/"), room, source, roles, F.lit("\nverbatim:\n"), chunk)


def documentation_retrieval_text(path: Column, document: Column, chunk: Column) -> Column:
    """With the document's title (its first ``# `` line, or the file's name) and the last three headings before the chunk."""
    title = F.nullif(F.btrim(F.regexp_extract(document, r"(?m)^[ \t]*# ([^\r\n]*)", 1)), F.lit(""))
    stem = F.nullif(F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1), F.lit(""))
    at = F.instr(document, chunk)
    before = F.when(at > 0, F.substring(document, F.lit(1), at - 1)).otherwise(document)
    heads = F.filter(F.transform(F.regexp_extract_all(before, F.lit(r"(?m)^[ \t]*#+([^\r\n]*)"), F.lit(1)), lambda h: F.btrim(h)), lambda h: h != "")
    last = F.slice(heads, F.greatest(F.size(heads) - 2, F.lit(1)), F.lit(3))
    source = F.coalesce(F.concat(F.lit("\nsource: "), path), F.lit(""))
    headings = F.when(F.size(heads) > 0, F.concat(F.lit("\nheadings: "), F.array_join(last, " > "))).otherwise("")
    return F.concat(F.lit("kind: documentation"), source, F.lit("\ntitle: "), F.coalesce(title, stem, F.lit("document")), headings, F.lit("\nverbatim:\n"), chunk)
