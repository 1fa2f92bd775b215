"""People and projects named in texts: candidates by frequency, signals around them, a class for each.

Signals are taken out of the texts by patterns that hold for any name, then joined to
the candidates by name, so texts and candidates never meet as a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.dialect import STOPWORDS as COMMON

#: Words that begin with a capital without being names, beside the common ones; a parameter of ``candidates``.
STOPWORDS = (
    *COMMON,
    *(
        "must yes ok okay still even already true false none null new old any some return print def class import step usage run check find add set list path file type name note "
        "example option result error warning info next last first second test stop start source target output input data item key value hey hi hello thanks thank right let click "
        "open close save load search show hide decision remember please"
    ).split(),
)
# What people do and how they are addressed, and what is done with projects.
DEEDS = r"said|asked|told|replied|laughed|smiled|cried|felt|thinks?|wants?|loves?|hates?|knows?|decided|pushed|wrote"
GREETINGS = r"hey|thanks?|hi|dear"
PRONOUNS = r"(?i)\b(?:she|hers?|he|him|his|they|them|their)\b"
MADE = r"building|built|ship(?:ping|ped)?|launch(?:ing|ed)?|deploy(?:ing|ed)?|install(?:ing|ed)?|import|pip\s+install"
LEAST, CAPS, BYTES = 3, {"person": 15, "project": 10, "uncertain": 8}, 5000
_NAME = r"[A-Za-z]+(?:[ \t]+[A-Za-z]+){0,2}"


def _grams(words: Column, side: str) -> Column:
    """Runs of one to three words that end (``last``) or begin (``first``) a text, lower case."""
    w = F.split(F.lower(words), r"\s+")
    n = F.size(w)
    runs = [F.when(n >= k, F.array_join(F.slice(w, n - k + 1 if side == "last" else F.lit(1), F.lit(k)), " ")) for k in (1, 2, 3)]
    return F.array_compact(F.array(*runs))


def candidates(texts: DataFrame, least: int = LEAST, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """``name, frequency``: capitalised words of 2 to 20 letters and runs of capitalised words, without stop words, that occur ``least`` times in all texts together."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    single = F.filter(F.regexp_extract_all("content", F.lit(r"\b[A-Z][a-z]{1,19}\b"), F.lit(0)), lambda w: ~F.array_contains(stop, F.lower(w)))
    runs = F.regexp_extract_all("content", F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"), F.lit(0))
    runs = F.filter(runs, lambda r: ~F.arrays_overlap(F.split(F.lower(r), r"\s+"), stop))
    rows = texts.where("content is not null").select(F.explode(F.concat(single, runs)).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def signals(texts: DataFrame) -> DataFrame:
    """``name, signal, n``: how often each lower-cased run of words appears with a signal, over all texts."""
    rows = texts.where("content is not null")

    def found(pattern: str, side: str, signal: str) -> DataFrame:
        hits = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
        return rows.select(F.explode(hits).alias("h")).select(F.explode(_grams(F.col("h"), side)).alias("name"), F.lit(signal).alias("signal"))

    parts = [
        found(rf"(?i)\b({_NAME})\s+(?:{DEEDS})\b", "last", "action"),
        found(rf"(?i)\b(?:{GREETINGS})\s+({_NAME})\b", "first", "action"),
        found(rf"(?i)\b(?:hey|thanks?|hi)\s+({_NAME})\b", "first", "addressed"),
        found(rf"(?im)^(?:>\s*|\[)?({_NAME})(?:\]|:\s)", "first", "dialogue"),
        found(rf"(?i)\b(?:{MADE})\s+({_NAME})\b", "first", "project verb"),
        found(rf"(?i)\bthe\s+({_NAME})\s+(?:architecture|pipeline|system|repo)\b", "last", "project verb"),
        found(rf"(?i)\b({_NAME})(?:\s+v\d+\b|\.py\b|-core\b|-local\b)", "last", "project verb"),
        found(rf"(?i)\b({_NAME})[-v]\w+", "last", "versioned"),
        found(rf"(?i)\b({_NAME})\.(?:py|js|ts|yaml|yml|json|sh)\b", "last", "code file"),
    ]
    lines = rows.select("id", F.posexplode(F.split("content", r"\r?\n")).alias("no", "line"))
    near = Window.partitionBy("id").orderBy("no").rowsBetween(-2, 2)
    lines = lines.withColumn("near", F.max(F.col("line").rlike(PRONOUNS)).over(near)).where("near")
    words = F.filter(F.split(F.lower("line"), r"[^a-z]+"), lambda w: w != "")
    runs = [F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i, k=k: F.array_join(F.slice(words, i, F.lit(k)), " ")) for k in (1, 2, 3)]
    runs = [F.when(F.size(words) >= k, r).otherwise(F.array().cast("array<string>")) for k, r in zip((1, 2, 3), runs)]
    parts.append(lines.select(F.explode(F.array_distinct(F.concat(*runs))).alias("name"), F.lit("pronoun").alias("signal")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("name", "signal").agg(F.count("*").alias("n"))


WEIGHTS = {"dialogue": 3, "action": 2, "pronoun": 2, "addressed": 4, "project verb": 2, "versioned": 3, "code file": 3}
PERSONAL = ("dialogue", "action", "pronoun", "addressed")


def classified(rows: DataFrame) -> DataFrame:
    """Scores and a class for rows ``name, frequency`` with a count for each signal.

    Without signals a name stays uncertain. Seven tenths of the score personal, of two kinds and five points: a
    person; three tenths or less: a project; anything else is uncertain.
    """
    count = lambda s: F.coalesce(F.col(s), F.lit(0))
    person = sum((count(s) * WEIGHTS[s] for s in PERSONAL), F.lit(0))
    project = sum((count(s) * w for s, w in WEIGHTS.items() if s not in PERSONAL), F.lit(0))
    kinds = sum((F.when(count(s) > 0, 1).otherwise(0) for s in PERSONAL), F.lit(0))
    rows = rows.select("name", "frequency", person.alias("person"), project.alias("project"), kinds.alias("kinds"), F.array_compact(F.array(*[F.when(count(s) > 0, F.concat(F.lit(s + " ("), count(s).cast("string"), F.lit("x)"))) for s in WEIGHTS])).alias("signals"))
    total, ratio = F.col("person") + F.col("project"), F.col("person") / (F.col("person") + F.col("project"))
    is_person = (ratio >= 0.7) & (F.col("kinds") >= 2) & (F.col("person") >= 5)
    kind = F.when(total == 0, "uncertain").when(is_person, "person").when(ratio >= 0.7, "uncertain").when(ratio <= 0.3, "project").otherwise("uncertain")
    confidence = (
        F.when(total == 0, F.least(F.col("frequency") / 50, F.lit(0.4)))
        .when(is_person, F.least(0.5 + ratio * 0.5, F.lit(0.99)))
        .when(ratio >= 0.7, 0.4)
        .when(ratio <= 0.3, F.least(0.5 + (1 - ratio) * 0.5, F.lit(0.99)))
        .otherwise(0.5)
    )
    return rows.select("name", "frequency", kind.alias("kind"), confidence.alias("confidence"), F.slice("signals", 1, 3).alias("signals"))


def detected(texts: DataFrame, least: int = LEAST, caps: dict[str, int] | None = None, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """``name, frequency, kind, confidence, signals``: for texts ``id, content``, the surest people and projects and the most frequent uncertain names, as many as ``caps`` says."""
    names = candidates(texts, least, stopwords).withColumn("key", F.lower(F.regexp_replace("name", r"\s+", " ")))
    counts = signals(texts).withColumnRenamed("name", "key").join(names.select("key").distinct(), "key", "left_semi").groupBy("key").pivot("signal", list(WEIGHTS)).agg(F.sum("n"))
    rows = classified(names.join(counts, "key", "left"))
    order = Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "uncertain", F.lit(0.0)).otherwise(-F.col("confidence")), F.desc("frequency"), "name")
    most = F.lit(0)
    for kind, n in (caps or CAPS).items():
        most = F.when(F.col("kind") == kind, n).otherwise(most)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
