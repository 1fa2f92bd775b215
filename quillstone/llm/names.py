"""Names of people in free text, by how they are written and what stands around them, and by a lexicon learned from the corpus.

No list of family names is held. Two or more capitalised words (or an initial and a word)
are a candidate. A candidate is a name where its surroundings say so: a title, label,
greeting, closing or phrase that people follow, a verb of saying behind it, an email
address whose local part holds its family name, or a common given name in front.

``learn`` counts, over all documents, how often each word stands in the given and in the
family place of candidates, and how often with such surroundings. Words for which that
share is high make the lexicon; a given and a family name of it next to each other are a
name anywhere, in any order and case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTICLES = "de la|de las|de los|van der|van den|von der|von und zu|al|bin|da|das|de|del|della|den|der|di|dos|du|el|la|le|ten|ter|van|von|zu|zum|zur".split("|")

#: Letters with marks are read without them and in lower case, one for one, so that offsets stay.
_MARKED, _PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüýñç", "aaaaaaeeeeiiiiooooouuuuync"
FOLD = str.maketrans(_MARKED + _MARKED.upper() + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _PLAIN * 2 + "abcdefghijklmnopqrstuvwxyz")

_any = "|".join
_W = "[ \t\xa0 ​]{1,2}"
_U = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞİĶŁŃŇŐŒŘŚŞŠŤŪŮŰŸŹŻŽΑ-ΩА-ЯЁІЇЄ"
_N = rf"(?:[{_U}][^\W\d_]+|[{_U}]['’][{_U}][^\W\d_]+)(?:['’-][^\W\d_]+)*"
_J = rf"[{_U}]\.(?:{_W})?"
_Q = rf"(?:(?i:{_any(sorted(PARTICLES, key=len, reverse=True))}){_W})"
#: Capitalised words that begin no name.
_NO_NAME = (
    "Dear|Hi|Hello|Hey|Hallo|Lieber?|Geehrter?|Bonjour|Chère?|Hola|Estimad[oa]|Querid[oa]|Mr|Mrs|Ms|Mx|Miss|Dr|Prof|Professor|Doctor|Herrn?|Frau|Monsieur|Madame|Mme|Mlle|Señora?|Sra?|Srta|Don|Doña|Sir|Thanks|Regards|Best|Cheers|Sincerely|Danke|Grüße|Merci|"
    "Cordialement|Saludos|Gracias|The|This|That|These|A|An|And|Or|But|If|In|On|At|By|For|From|To|With|Our|My|Your|His|Her|Their|All|Team|Everyone|Every|Each|New|Old|Der|Die|Das|Ein|Eine|Le|La|Les|Un|Une|El|Los|Las|Una|Ask|Asked|Call|Note|See|Chapter|Section|"
    "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|May|June|July|August|September|October|November|December"
)
#: Words that no name ends in.
_NO_FAMILY = "Team|Members?|All|Everyone|Group|Inc|Ltd|GmbH|LLC|Corp|University|School|Street|Road|Avenue|Lane|Drive|Playbook|Project|Service|Server|Platform|Department|Committee|Customer|Colleagues?|Map|Guide|Manual|Handbook|Library|Engine|Cloud|Data|Database"
_NO_NAME, _NO_FAMILY = (f"{x}|{x.upper()}" for x in (_NO_NAME, _NO_FAMILY))
_R = rf"(?:[^\W\d_]+|['’][^\W\d_]+)(?:['’-][^\W\d_]+)*"
#: Begins with the capital letter, so that the search runs from capital to capital; the group is what follows it.
SHAPE = re.compile(rf"[{_U}](?<![\w@.+'’-][{_U}])(?=((?:(?:{_R}{_W}|\.(?:{_W})?)(?:{_J}){{0,2}}(?:{_N}{_W})?{_Q}?(?=[{_U}])(?!(?:{_NO_FAMILY}|{_NO_NAME})\b){_N}|{_R},{_W}(?=[{_U}])(?!(?:{_NO_NAME}|{_NO_FAMILY})\b)(?:{_N}|{_J}))(?:{_W}[{_U}]\.(?!\w))?)(?![\w@]|[-'.+_]\w))")
NO_NAME = re.compile(rf"(?:{_NO_NAME})\b")
_TITLES = "mrs?|ms|mx|miss|dr|prof|professor|doctor|dres|herrn?|frau|monsieur|madame|mme|mlle|señora?|sra?|srta|don|doña|dipl\\.-ing|ing"
_ROLES = (
    "(?:full |contact |person |customer |employee |patient |display |user )?name|full_name|display_name|person(?:_name)?|owner|author|assignee|assigned to|reviewer|reviewed by|contact|customer|patient|employee|manager|signed|signed by|approved by|created by|"
    "ansprechpartner(?:in)?|bearbeiter(?:in)?|kund(?:e|in)|verantwortlich|auteur|nom|autor(?:a)?|nombre|responsable|contacto|attn|from|to|von|de|an|à"
)
_PHRASES = (
    "(?:reviewed|written|signed|approved|authored|reported|prepared|filed) by|assigned to|according to|(?:spoke|speak|talk(?:ed)?|met|paired|checked) (?:with|to)|ask|asked|cc|attn|my name is|i am|contact|call|geprüft von|verfasst von|unterschrieben von|rückfragen an|"
    "(?:abge|be)stimmt mit|gesprochen mit|ich heiße|mein name ist|relu par|écrit par|signé par|voir avec|parlé avec|je m['’]appelle|revisado por|escrito por|firmado por|pregunta a|hablé con|me llamo"
)
_GREETINGS = "dear|hi|hello|hey|hallo|liebe[rs]?|guten tag|sehr geehrte[rs]?|bonjour|chère?|hola|estimad[oa]|querid[oa]"
_CLOSINGS = "thanks|thank you|many thanks|(?:kind |best |warm )?regards|best(?: wishes)?|yours(?: sincerely| truly| faithfully)?|sincerely|cheers|(?:viele |beste |liebe |mit freundlichen )?grü(?:ß|ss)en?|vg|mfg|danke|cordialement|bien à vous|merci|saludos(?: cordiales)?|un saludo|atentamente|gracias"
BEFORE = re.compile(
    rf"(?:(?<!\w)(?:{_TITLES})\.?{_W}|(?<!\w)(?:{_ROLES})[\"']?[ \t]?[:=][ \t]?[\"']?|(?<!\w)(?:{_PHRASES}|{_GREETINGS}){_W}|TODO\(|(?<!\w)(?:{_CLOSINGS})[,.!]?[ \t]*(?:\r?\n)+[ \t]*|(?:^|\n)--[ ]?\r?\n)\Z",
    re.I,
)
AFTER = re.compile(rf"{_W}(?:wrote|said|told|asked|replied|schrieb|sagte|meinte|a écrit|a dit|escribió|dijo)(?!\w)")
#: Common given names, from general knowledge; with one in front, two capitalised words are a name anywhere.
GIVEN = frozenset(
    "adam alan albert alexander alice amanda ana andrea andreas andrew angela anna anne antonio arthur barbara beatriz benjamin bernard brian brigitte carl carlos carmen caroline catherine charles charlotte christian christina christine christopher claire claudia daniel david "
    "diana diego edward elena elizabeth emily emma eric esther eva fatima felix fernando francisco frank frederic gabriel george hannah hans heike heinrich helen henry ines isabel jack jacob jacques james jan jane javier jean jennifer jessica joachim johanna john jonas "
    "jorge jose joseph juan judith julia julien jurgen karen karl katharina katherine kenneth kevin klaus kristina lars laura lena leon linda lisa louise lucas lucia luis manfred manuel marc margaret maria marie mark markus martha martin mary matthew matthias max michael "
    "miguel mohammed monika nadia nathalie nicholas nicole nina nora olga oliver olivia pablo patricia patrick paul pedro peter philippe pierre rachel rafael rebecca ricardo richard robert rosa ruth sabine samuel sandra sara sarah sebastian simon sofia sophie stefan stephen "
    "susan sven teresa thomas tobias tom ulrich ursula vanessa victor victoria walter werner wilhelm william wolfgang zoe".split()
)

#: A word is learned for a place where it stands there with a name's surroundings so often, and in so great a share of all its candidates.
SUPPORT, SHARE = 2, 0.2
#: Lexicons up to so many words are broadcast; of larger ones each document gets the words that it holds.
BROADCAST_WORDS = 500_000

_PART = re.compile(r"[^\W\d_]{2,}(?:['’][^\W\d_]+)*")
_FRONT = re.compile(rf"(?<![\w@.+'-])(?:([^\W\d_]+(?:-[^\W\d_]+)*){_W}|[^\W\d_]\.(?:{_W})?)(?:[^\W\d_]\.(?:{_W})?){{0,2}}(?:(?:{_any(sorted(PARTICLES, key=len, reverse=True))}){_W})?\Z")
_LEAD = re.compile(rf"(?<![\w@.+'-])(?:(?:{_any(sorted(PARTICLES, key=len, reverse=True))}){_W})\Z", re.I)
_BACK = re.compile(rf"(?:,{_W}|{_W})([^\W\d_]+(?:-[^\W\d_]+)*)(?:{_W}[^\W\d_]\.(?!\w))?")
_END = re.compile(r"(?![\w@]|[-'.+_]\w)")
_LONG = re.compile(r"\S{2,}(?<!\.)(?:\s|\Z)")
_PARTICLE = re.compile(rf"\s(?:{_any(PARTICLES)})\s", re.I)
_START = re.compile(r"(?<![\w@.+'-])")
_LOCAL = re.compile(r"[\w.+%-]{2,64}(?=[ \xa0]?(?:@|[\[({] ?(?:at|arroba) ?[\])}]))")
_LABELLED = re.compile(rf"(\S+{_W}\S+(?:{_W}\S+)*){_W}\S+\Z")
_REACH = 80


@dataclass(frozen=True)
class Lexicon:
    given: frozenset[str] = field(default=frozenset())
    family: frozenset[str] = field(default=frozenset())


NONE = Lexicon()


def places(value: str) -> tuple[str, str]:
    """The given and the family name of a candidate, folded; an initial is no given name."""
    folded = value.translate(FOLD).lower()
    last, comma, first = folded.partition(",")
    words = [w for w in (first if comma else folded).split() if not w.endswith(".")]
    given = words[0] if words else ""
    return (given, last.split()[-1]) if comma else (given if len(words) > 1 else "", words[-1] if words else "")


def _locals(text: str) -> str:
    """The local parts of the text's email addresses, folded, in one string."""
    return "\n".join(_LOCAL.findall(text.translate(FOLD))).lower() if "@" in text or "(at)" in text or "[at]" in text or "arroba" in text else ""


def candidates(text: str) -> Iterator[tuple[int, int, bool]]:
    """``(start, end, whether the surroundings make it a name)``. A candidate within one that is a name is left out."""
    done, mailed = 0, None
    for m in SHAPE.finditer(text):
        a, b = m.start(), m.end(1)
        if a < done or NO_NAME.match(text, a):
            continue
        if "," in m[1] and (lead := _LEAD.search(text, max(done, a - 16), a)):
            a = lead.start()
        if text[b : b + 1] in (":", "=") and (cut := _LABELLED.match(text, a, b)):
            b = cut.end(1)  # the last word is the label of what follows
        sure = bool(BEFORE.search(text, max(0, a - 40), a) or AFTER.match(text, b))
        if not sure:
            mailed = _locals(text) if mailed is None else mailed
            family = places(text[a:b])[1] if mailed else ""
            sure = len(family) >= 4 and family in mailed
        if sure:
            done = b
        yield a, b, sure


def _lexical(text: str, lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    """Given and family names of the lexicon next to each other, with initials and particles, in any order and case."""
    folded, done = text.lower() if text.isascii() else text.translate(FOLD).lower(), 0
    if len(folded) != len(text):  # a letter whose small form is longer would move the offsets
        folded = text.translate(FOLD)
    there = lexicon.family.intersection(_PART.findall(folded))
    if not there:
        return
    words = re.compile(rf"(?<![^\W\d_])(?:{_any(sorted(map(re.escape, there)))})(?:-[^\W\d_]+)*(?![^\W\d_]|['’][^\W\d_])")
    for m in words.finditer(folded):
        a, b = m.span()
        if a < done:
            continue
        front = _FRONT.search(folded, max(done, a - _REACH), a)
        if front and (front[1] is None or front[1] in lexicon.given):
            if _END.match(folded, b):
                yield front.start(), b
                done = b
            continue
        back = _BACK.match(folded, b)
        if back and back[1] in lexicon.given and _END.match(folded, back.end()):
            lead = _LEAD.search(folded, max(done, a - 16), a)
            start = lead.start() if lead else a
            if _START.match(folded, start):
                yield start, back.end()
                done = back.end()


def find_names(text: str, lexicon: Lexicon = NONE) -> list[tuple[int, int]]:
    """``(start, end)`` of every name, by start, none within another."""
    found = list(_lexical(text, lexicon)) if lexicon.family else []
    at = 0
    for a, b, sure in candidates(text):
        while at < len(found) and found[at][1] <= a:
            at += 1
        if at < len(found) and found[at][0] < b:
            continue
        given, family = places(text[a:b])
        if sure or given in GIVEN or given in lexicon.given or family in lexicon.family:
            found.insert(at, (a, b))
            at += 1
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    sures: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for a, b, sure in candidates(text):
                value = text[a:b]
                if len(_LONG.findall(value)) > 2 and not _PARTICLE.search(value):
                    continue  # of three words the last may belong to what follows
                given, family = places(value)
                keys = [(given, True)] if given else []
                keys += [(p, False) for p in {family, *family.split("-")} if p]
                total.update(keys)
                if sure:
                    sures.update(keys)
        if len(total) > 200_000:
            yield _sums(total, sures)
            total.clear(), sures.clear()
    yield _sums(total, sures)


def _sums(total: Counter, sures: Counter) -> pa.RecordBatch:
    keys = list(total)
    columns = [pa.array([w for w, _ in keys], pa.string()), pa.array([g for _, g in keys], pa.bool_()), pa.array([sures[k] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["word", "given", "sure", "n"])


def learn(texts: DataFrame, *, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """``word, given``: words of given names, and (``given`` false) of family names, learned from all texts of a single-column table.

    A word is learned for a place if candidates hold it there at least ``support`` times with a name's surroundings, in
    at least ``share`` of all its candidates of that place. Null texts take no part.
    """
    counted = texts.where(F.col(texts.columns[0]).isNotNull()).mapInArrow(_counts, "word string, given boolean, sure long, n long")
    sums = counted.groupBy("word", "given").agg(F.sum("sure").alias("sure"), F.sum("n").alias("n"))
    return sums.where((F.col("sure") >= support) & (F.col("sure") >= share * F.col("n")) & (F.length("word") > 1)).select("word", "given")


def _lexicon(words: list[str], given: list[bool]) -> Lexicon:
    return Lexicon(frozenset(w for w, g in zip(words, given) if g), frozenset(w for w, g in zip(words, given) if not g))


def with_lexicon(rows: DataFrame, lexicon: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[Lexicon]]]:
    """Rows ``doc_id, text``, and how to get each row's lexicon from a batch of them.

    A lexicon of at most ``broadcast_words`` words, which is found out without taking more than that, is broadcast. Of a larger one every
    document gets its own words as a third column, by a join on the word; the result is the same.
    """
    spark = rows.sparkSession
    words = lexicon.limit(broadcast_words + 1).toPandas()  # no more than that come to the driver
    if len(words) <= broadcast_words:
        held = spark.sparkContext.broadcast(_lexicon(words["word"].tolist(), words["given"].tolist()))
        return rows, lambda batch: [held.value] * batch.num_rows
    own = rows.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(_folded(F.col("text"))), F.lit(r"\p{L}+"), F.lit(0)))).alias("word")).distinct()
    whole = rows.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(_folded(F.col("text"))), F.lit(r"\p{L}+(?:['’-]\p{L}+)+"), F.lit(0)))).alias("word")).distinct()
    mine = own.unionByName(whole).join(lexicon, "word").groupBy("doc_id").agg(F.collect_list(F.struct("word", "given")).alias("lexicon"))
    return rows.join(mine, "doc_id", "left"), lambda batch: [_lexicon([x["word"] for x in v or ()], [x["given"] for x in v or ()]) for v in batch.column(2).to_pylist()]


def _folded(text):
    return F.translate(text, _MARKED + _MARKED.upper(), _PLAIN + _PLAIN.upper())
