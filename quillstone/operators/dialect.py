"""Compact text dialect: one header line and one line of entities, topics, a key sentence, moods and flags for each text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of moods by their names, and of moods and flags by words that hint at them, in this order.
MOODS = {
    "vulnerability": "vul",
    "vulnerable": "vul",
    "joy": "joy",
    "joyful": "joy",
    "fear": "fear",
    "mild_fear": "fear",
    "trust": "trust",
    "trust_building": "trust",
    "grief": "grief",
    "raw_grief": "grief",
    "wonder": "wonder",
    "philosophical_wonder": "wonder",
    "rage": "rage",
    "anger": "rage",
    "love": "love",
    "devotion": "love",
    "hope": "hope",
    "despair": "despair",
    "hopelessness": "despair",
    "peace": "peace",
    "relief": "relief",
    "humor": "humor",
    "dark_humor": "humor",
    "tenderness": "tender",
    "raw_honesty": "raw",
    "brutal_honesty": "raw",
    "self_doubt": "doubt",
    "anxiety": "anx",
    "exhaustion": "exhaust",
    "conviction": "convict",
    "quiet_passion": "passion",
    "warmth": "warmth",
    "curiosity": "curious",
    "gratitude": "grat",
    "frustration": "frust",
    "confusion": "confuse",
    "satisfaction": "satis",
    "excitement": "excite",
    "determination": "determ",
    "surprise": "surprise",
}
MOOD_HINTS = [
    ("decided", "determ"),
    ("prefer", "convict"),
    ("worried", "anx"),
    ("excited", "excite"),
    ("frustrated", "frust"),
    ("confused", "confuse"),
    ("love", "love"),
    ("hate", "rage"),
    ("hope", "hope"),
    ("fear", "fear"),
    ("trust", "trust"),
    ("happy", "joy"),
    ("sad", "grief"),
    ("surprised", "surprise"),
    ("grateful", "grat"),
    ("curious", "curious"),
    ("wonder", "wonder"),
    ("anxious", "anx"),
    ("relieved", "relief"),
    ("satisf", "satis"),
    ("disappoint", "grief"),
    ("concern", "anx"),
]
FLAG_HINTS = [
    ("decided", "DECISION"),
    ("chose", "DECISION"),
    ("switched", "DECISION"),
    ("migrated", "DECISION"),
    ("replaced", "DECISION"),
    ("instead of", "DECISION"),
    ("because", "DECISION"),
    ("founded", "ORIGIN"),
    ("created", "ORIGIN"),
    ("started", "ORIGIN"),
    ("born", "ORIGIN"),
    ("launched", "ORIGIN"),
    ("first time", "ORIGIN"),
    ("core", "CORE"),
    ("fundamental", "CORE"),
    ("essential", "CORE"),
    ("principle", "CORE"),
    ("belief", "CORE"),
    ("always", "CORE"),
    ("never forget", "CORE"),
    ("turning point", "PIVOT"),
    ("changed everything", "PIVOT"),
    ("realized", "PIVOT"),
    ("breakthrough", "PIVOT"),
    ("epiphany", "PIVOT"),
    ("api", "TECHNICAL"),
    ("database", "TECHNICAL"),
    ("architecture", "TECHNICAL"),
    ("deploy", "TECHNICAL"),
    ("infrastructure", "TECHNICAL"),
    ("algorithm", "TECHNICAL"),
    ("framework", "TECHNICAL"),
    ("server", "TECHNICAL"),
    ("config", "TECHNICAL"),
]
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into about between "
    "through during before after above below up down out off over under again further then once here there when where why how all each every both few more most other "
    "some such no nor not only own same so than too very just don now and but or if while that this these those it its i we you he she they me him her us them my your "
    "his our their what which who whom also much many like because since get got use used using make made thing things way well really want need"
).split()
DECISION_WORDS = "decided because instead prefer switched chose realized important key critical discovered learned conclusion solution reason why breakthrough insight".split()
FEELING_WORDS = "love fear remember soul feel stupid scared beautiful destroy respect trust consciousness alive forget waiting peace matter real guilt escape rest hope dream lost found".split()
SPEECH = "says: said: articulates: reveals: admits: confesses: asks: say:".split()


def signals(text: Column, hints: list[tuple[str, str]]) -> Column:
    """The first three different codes whose hints are in the text, in the order of the table."""
    low = F.lower(text)
    found = F.array(*[F.when(F.contains(low, F.lit(hint)), F.lit(code)) for hint, code in hints])
    return F.slice(F.array_distinct(F.array_compact(found)), 1, 3)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?\n]"), lambda s: F.btrim(s, F.lit(" \t\r\n"))), lambda s: s != "")


def key_sentence(text: Column) -> Column:
    """The sentence of more than ten bytes that decides most: words of decision count, as does brevity; the first of equals, cut to 52 characters. Empty without one."""

    def scored(s: Column, i: Column) -> Column:
        low, n = F.lower(s), F.octet_length(s)
        points = sum((F.when(F.contains(low, F.lit(w)), 2).otherwise(0) for w in DECISION_WORDS), F.lit(0))
        points = points + F.when(n < 80, 1).otherwise(0) + F.when(n < 40, 1).otherwise(0) - F.when(n > 150, 2).otherwise(0)
        return F.struct(points.alias("points"), (-i).alias("back"), s.alias("s"))

    longer = F.filter(sentences(text), lambda s: F.octet_length(s) > 10)
    best = F.coalesce(F.array_max(F.transform(longer, scored))["s"], F.lit(""))
    return F.when(F.length(best) > 55, F.concat(F.substring(best, 1, 52), F.lit("..."))).otherwise(best)


def token_estimate(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.greatest(F.floor(words * 1.3), F.lit(1)).cast("int")


def _weighed(words: pd.Series) -> pd.Series:
    """The three weightiest of each list of words, joined."""
    stop, own, shape = frozenset(STOPWORDS), {}, re.compile("[_-]|^.+[A-Z]", re.S)
    out = []
    for found in words:
        weights: dict[str, int] = {}
        for w in found if found is not None else ():
            known = own.get(w)
            if known is None:
                low = w.lower()
                known = own[w] = (low, 0 if low in stop else (len(low) >= 3) + 2 * ("A" <= w[0] <= "Z") + 2 * bool(shape.search(w)))
            if known[1]:
                weights[known[0]] = weights.get(known[0], 0) + known[1]
        out.append("_".join(sorted(weights, key=lambda t: (-weights[t], t))[:3]) or None)
    return pd.Series(out, dtype=object)


def topics_of(text: Column) -> Column:
    """The three weightiest words of a text, joined by ``_``, equal weights by name; null without any.

    A word weighs its count (from three letters on), twice as much again where it is capitalised, and again where it
    has a hyphen, an underscore or a capital inside. Counting is one row's own work: nothing is exploded or shuffled.
    """
    words = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z_-]+"), F.lit(0)), lambda w: w.rlike("^[A-Za-z]"))
    return F.pandas_udf(_weighed, "string")(words)


def topics(texts: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``id, topics`` of texts that have any."""
    return texts.select(F.col(id_col).alias("id"), topics_of(F.col(text_col)).alias("topics")).where("topics is not null")


def entity_codes(text: Column, known: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> Column:
    """Up to three codes: of known names in the text, by name; without any, three letters of capitalised words behind the first."""
    out = []
    for name in sorted(known or {}):
        if name != name.lower() and not any(s in name.lower() for s in skip):
            out.append(F.when(F.contains(F.lower(text), F.lit(name.lower())), F.lit(known[name])))
    named = F.slice(F.array_distinct(F.array_compact(F.array(*out))), 1, 3) if out else F.array().cast("array<string>")
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    clean = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
    if skip:
        clean = F.filter(clean, lambda w: ~F.lower(w).rlike("|".join(re.escape(s) for s in skip)))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    titled = F.filter(clean, lambda w: w.rlike("^[A-Z][a-z]+$") & ~F.array_contains(stop, F.lower(w)))
    guessed = F.slice(F.array_distinct(F.transform(titled, lambda w: F.upper(F.left(w, F.lit(3))))), 1, 3)
    return F.when(F.size(named) > 0, named).otherwise(guessed)


def compressed(drawers: DataFrame, known: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """``id, dialect, original_tokens, summary_tokens, original_chars, summary_chars`` for drawers; null contents count as empty."""
    rows = drawers.withColumn("content", F.coalesce("content", F.lit("")))
    rows = rows.withColumn("topics", topics_of(F.col("content")))
    text = F.col("content")
    stem = F.regexp_extract("source_file", r"([^/]*?)(?:(?<=[^/])\.[^./]*)?$", 1)
    header = F.concat_ws("|", F.coalesce("wing", F.lit("")), F.coalesce("room", F.lit("")), F.coalesce(F.left("filed_at", F.lit(10)), F.lit("?")), F.coalesce(stem, F.lit("?")))
    entities = F.coalesce(F.nullif(F.array_join(entity_codes(text, known, skip), "+"), F.lit("")), F.lit("???"))
    quote = key_sentence(text)
    parts = F.array(
        F.concat(F.lit("0:"), entities),
        F.coalesce("topics", F.lit("misc")),
        F.when(quote != "", F.concat(F.lit('"'), quote, F.lit('"'))),
        F.nullif(F.array_join(signals(text, MOOD_HINTS), "+"), F.lit("")),
        F.nullif(F.array_join(signals(text, FLAG_HINTS), "+"), F.lit("")),
    )
    rows = rows.select("id", "content", F.concat(header, F.lit("\n"), F.array_join(F.array_compact(parts), "|")).alias("dialect"))
    return rows.select(
        "id", "dialect", token_estimate(text).alias("original_tokens"), token_estimate(F.col("dialect")).alias("summary_tokens"), F.octet_length(text).alias("original_chars"), F.octet_length("dialect").alias("summary_chars")
    )


def totals(rows: DataFrame) -> DataFrame:
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("original_tokens", "summary_tokens", "original_chars", "summary_chars")])
    return sums.withColumn("ratio", F.col("original_tokens") / F.greatest("summary_tokens", F.lit(1)))


def decoded(dialect: Column) -> Column:
    """``header, entries, tunnels, arc`` of dialect text: a line is an arc, a tunnel, an entry (a colon before the first bar) or a header (the last one holds)."""
    lines = F.filter(F.transform(F.split(dialect, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    plain = lambda x: ~F.startswith(x, F.lit("ARC:")) & ~F.startswith(x, F.lit("T:"))
    entry = lambda x: F.contains(x, F.lit("|")) & F.contains(F.substring_index(x, "|", 1), F.lit(":"))
    heads = F.filter(lines, lambda x: plain(x) & ~entry(x) & F.contains(x, F.lit("|")))
    return F.struct(
        F.try_element_at(heads, F.lit(-1)).alias("header"),
        F.filter(lines, lambda x: plain(x) & entry(x)).alias("entries"),
        F.filter(lines, lambda x: F.startswith(x, F.lit("T:"))).alias("tunnels"),
        F.try_element_at(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("ARC:"))), lambda x: F.substring(x, 5, 1 << 30)), F.lit(-1)).alias("arc"),
    )


# --- records with people, topics and weights; one file is one small JSON text ---


def weight_text(w: float) -> str:
    """Three places, without trailing zeros."""
    return f"{w:.3f}".rstrip("0").rstrip(".")


def encode_entity(name: str, known: dict[str, str], skip: tuple[str, ...] = ()) -> str | None:
    low = name.lower()
    if any(s in low for s in skip):
        return None
    for key in (name, low):
        if key in known:
            return known[key]
    for key in sorted(known):
        if key.lower() != key and key.lower() in low:
            return known[key]
    return "".join(c for c in name if c.isascii() and c.isalpha())[:3].upper() or None


def entity_code(names: Column, known: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> Column:
    """``encode_entity`` of a column."""

    def run(batch):
        return batch.map(lambda n: None if n is None else encode_entity(n, known or {}, skip))

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(names)


def weight_texts(weights: Column) -> Column:
    """``weight_text`` of a column."""

    def run(batch):
        return batch.map(weight_text)

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(weights)


def encode_moods(moods: list[str]) -> str:
    return "+".join(list(dict.fromkeys(MOODS.get(m, m[:4]) for m in moods))[:3])


def flags(z: dict) -> str:
    notes, label = z.get("notes", "").lower(), z.get("origin_label", "").lower()
    rules = (
        ("ORIGIN", z.get("origin_moment", False)),
        ("SENSITIVE", z.get("sensitivity", "").upper().startswith("MAXIMUM")),
        ("CORE", "foundational pillar" in notes or "core" in notes),
        ("GENESIS", "genesis" in notes or "genesis" in label),
        ("PIVOT", "pivot" in notes),
    )
    return "+".join(name for name, holds in rules if holds)


def key_quote(z: dict) -> str:
    """The most telling quotation of a record: quoted or spoken, at least eight bytes; else the title behind `` - ``."""
    text = f"{z.get('content', '')} {z.get('origin_label', '')} {z.get('notes', '')}"
    found = [q.strip() for q in re.findall(r'"([^"]*)"', text)]
    found += [q.strip() for q in re.findall(r"(?:(?<=[\s(])|^)'(.+?)'(?=[\s.,;:!?)]|$)", text)]
    found = [q for q in found if 8 <= len(q) <= 55]
    for marker in SPEECH:
        for m in re.finditer(re.escape(marker), text, re.I):
            said = re.match(r"[ \"']*([^.!?]{0,55})", text[m.end() :])[1].strip().strip("\"'")
            if len(said) >= 10:
                found.append(said)

    def points(q: str) -> int:
        return 2 * q[:1].isupper() + 2 * sum(w in q.lower() for w in FEELING_WORDS) + (len(q) > 20) - 2 * q.startswith(("The ", "This ", "She "))

    unique = [q for q in dict.fromkeys(found) if len(q.encode()) >= 8]
    if unique:
        return max(unique, key=points)
    return z.get("title", "").partition(" - ")[2][:45]


def _people(names: list[str], known: dict[str, str], skip: tuple[str, ...]) -> list[str]:
    return sorted({c for n in names if (c := encode_entity(n, known, skip))}) or ["???"]


def encode_record(z: dict, known: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> str:
    quote, topic = key_quote(z), "_".join(z.get("topics", [])[:2]) or "misc"
    parts = [f"{z.get('id', '').rpartition('-')[2]}:{'+'.join(_people(z.get('people', []), known or {}, skip))}", topic, f'"{quote}"' if quote else ""]
    parts += [weight_text(z.get("emotional_weight") or 0.5), encode_moods(z.get("emotional_tone", [])), flags(z)]
    return "|".join(p for p in parts if p)


def encode_link(t: dict) -> str:
    return f"T:{t.get('from', '').rpartition('-')[2]}<->{t.get('to', '').rpartition('-')[2]}|{t.get('label', '').partition(':')[0][:30]}"


def encode_file(data: dict, known: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> str:
    records, source = data.get("zettels", []), data.get("source_file") or "unknown"
    head, dash, tail = source.rpartition("-")
    title = tail.replace(".txt", "").strip() if dash else source
    people = _people([p for z in records for p in z.get("people", [])], known or {}, skip)
    day = (records[0].get("date_context") if records else "") or "unknown"
    lines = [f"{source.split('-')[0]}|{'+'.join(people[:3])}|{day}|{title}"]
    if data.get("emotional_arc"):
        lines.append(f"ARC:{data['emotional_arc']}")
    return "\n".join([*lines, *(encode_record(z, known, skip) for z in records), *(encode_link(t) for t in data.get("tunnels", []))])


def encoded_files(files: DataFrame, known: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """``path, dialect`` for rows ``path, json``, one file in each; malformed files give a null."""
    def run(texts):
        def one(t):
            try:
                return encode_file(json.loads(t), known, skip)
            except (TypeError, ValueError, AttributeError):
                return None

        return texts.map(one)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return files.select("path", F.pandas_udf(run, "string")("json").alias("dialect"))


def digest(files: list[dict], known: dict[str, str] | None = None, threshold: float = 0.85, skip: tuple[str, ...] = (), day: str = "", sections: dict[str, list[str]] | None = None) -> str:
    """The story of the weightiest records by day, and up to eight links; made on the driver of the few records that are kept."""
    kept = []
    for data in files:
        records = data.get("zettels", [])
        when = (records[0].get("date_context", "") if records else "unknown").split(",")[0].strip()
        kept += [(when, z) for z in records if z.get("emotional_weight", 0) >= threshold or z.get("origin_moment") or set(flags(z).split("+")) & {"ORIGIN", "CORE", "GENESIS"}]
    kept.sort(key=lambda x: -x[1].get("emotional_weight", 0))
    lines = ["## LAYER 1 -- ESSENTIAL STORY", f"## Made from record files. Updated {day}.", ""]
    for name, own in sorted((sections or {}).items()):
        lines += [f"={name}=", *own, ""]
    for when in sorted({w for w, _ in kept}):
        lines.append(f"=MOMENTS[{when}]=")
        for z in (z for w, z in kept if w == when):
            title = z.get("title", "")
            hint = title.partition(" - ")[2][:30] if " - " in title else "_".join(z.get("topics", [])[:2])
            quote, own = key_quote(z), flags(z)
            parts = ["+".join(_people(z.get("people", []), known or {}, skip)), hint, f'"{quote}"' if quote and quote not in (hint, title) else ""]
            parts += ["SENSITIVE" if z.get("sensitivity") and "SENSITIVE" not in own else "", weight_text(z.get("emotional_weight") or 0.5), own]
            lines.append("|".join(p for p in parts if p))
        lines.append("")
    links = [t for data in files for t in data.get("tunnels", [])][:8]
    if links:
        lines += ["=TUNNELS=", *(t.get("label", "").partition(":")[0][:40] for t in links), ""]
    return "\n".join(lines)


def next_code(name: str, used: set[str]) -> str:
    """The shortest unused beginning of a name, from three letters on; then with a number behind."""
    letters = "".join(c for c in name.upper() if c.isascii() and c.isalpha()) or "ENT"
    for n in range(min(3, len(letters)), len(letters) + 1):
        if letters[:n] not in used:
            return letters[:n]
    number = 2
    while f"{letters[:3]}{number}" in used:
        number += 1
    return f"{letters[:3]}{number}"
