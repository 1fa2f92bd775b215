"""Project files: what is listed, what is skipped, what is text."""

from __future__ import annotations

import fnmatch
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T

# Fixed values.
SKIPPED_FOLDERS = (
    ".git node_modules __pycache__ .venv venv env dist build .next coverage .ruff_cache .mypy_cache .pytest_cache .cache .tox .nox .idea .vscode .ipynb_checkpoints .eggs htmlcov target"
).split()
SKIPPED_NAMES = (".gitignore", "package-lock.json", "quillstone.yaml", "quillstone.yml")
BINARY = (
    "7z a avi avif bin bmp bz2 class cur db dib dll doc docx dylib eot exe fla flac gif gz ico jar jpeg jpg lib m4a mkv mov mp3 mp4 o obj ogg otf pdf png ppt pptx pyc pyd so sqlite sqlite3 svgz swf "
    "tar ttf wav webm webp woff woff2 xls xlsx xz zip"
).split()
DATA, DATA_FOLDERS, DATA_MOST = ("json", "csv", "sql"), ("assets", "migrations", "fixtures", "generated", "seed", "seeds"), 256 * 1024
SNIFFED = 8 * 1024
PROSE, READABLE = ("txt", "md", "rst", "csv"), ("py", "js", "ts", "json", "yaml", "yml", "toml", "sh", "rb", "go", "rs")


def in_skipped_folder(path: Column) -> Column:
    """Whether a folder on the way is never looked into; ``path`` is relative to the project."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(folders, lambda p: p.isin(SKIPPED_FOLDERS) | F.endswith(p, F.lit(".egg-info")))


def skipped_name(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return name.isin(list(SKIPPED_NAMES)) | T.extension(path).isin([f".{e}" for e in BINARY])


def noisy_data(path: Column, size: Column) -> Column:
    """Data files in folders of data, and data files that are large."""
    folders = F.transform(F.split(path, "/"), F.lower)
    return T.extension(path).isin([f".{e}" for e in DATA]) & (F.exists(folders, lambda p: p.isin(list(DATA_FOLDERS))) | (size > DATA_MOST))


def looks_like_text(sample: bytes) -> bool:
    """No zero byte, at most one control byte in a hundred, at most one undecodable character in ten; nothing at all is text."""
    if not sample:
        return True
    controls = sum(sample.count(b) for b in (*range(1, 9), 11, 12, *range(14, 32)))
    if 0 in sample or controls * 100 > len(sample):
        return False
    decoded = sample.decode("utf-8", "replace")
    return decoded.count("�") * 100 <= len(decoded) * 10


def _sniff(samples):
    return samples.map(lambda b: looks_like_text(bytes(b[:SNIFFED])) if b is not None else False)


_sniff.__annotations__ = {"samples": pd.Series, "return": pd.Series}


def is_text(content: Column) -> Column:
    return F.pandas_udf(_sniff, "boolean")(F.substring(content, 1, SNIFFED))


def project_files(spark: SparkSession, root: str, *, ignore: list[str] | None = None, exclude_data: bool = True, limit: int | None = None) -> DataFrame:
    """``path, source_file, length, content``: readable text files below a folder, by path; ``ignore`` holds patterns of relative paths.

    Listing and reading are Spark's; of a skipped file only the name is looked at, since the filters on path and size
    come before the content is needed.
    """
    root = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.withColumn("source_file", F.regexp_replace("path", rf"^(?:file:/*)?/?{root.lstrip('/').replace('.', '[.]')}/", ""))
    rows = rows.where(~in_skipped_folder(F.col("source_file")) & ~skipped_name(F.col("source_file")))
    for pattern in ignore or []:
        regex = fnmatch.translate(pattern.strip("/")).replace("(?s:", "(?s:(?:.*/)?").replace(r")\Z", r"(?:/.*)?)$").replace(r")\z", r"(?:/.*)?)$")
        rows = rows.where(~F.col("source_file").rlike("^" + regex))
    if exclude_data:
        rows = rows.where(~noisy_data(F.col("source_file"), F.col("length")))
    rows = rows.where(is_text(F.col("content"))).withColumn("content", F.decode("content", "UTF-8")).select("path", "source_file", "length", "content")
    return rows if limit is None else rows.orderBy("source_file").limit(limit)


def for_detection(files: DataFrame, most: int) -> DataFrame:
    """Files to look for names in: prose if there are three of it, else prose and then other readable ones; by path, at most ``most``."""
    ext = F.regexp_replace(T.extension(F.col("source_file")), r"^\.", "")
    rows = files.withColumn("_p", F.when(ext.isin(list(PROSE)), 0).when(ext.isin(list(READABLE)), 1)).where("_p is not null")
    enough = rows.agg((F.count_if(F.col("_p") == 0) >= 3).alias("_e"))
    return rows.crossJoin(F.broadcast(enough)).where("_p = 0 or not _e").orderBy("_p", "source_file").limit(most).drop("_p", "_e")


def routing_config(folder: str) -> str | None:
    """The nearest ``quillstone.yaml`` or ``.yml`` from a folder upwards."""
    folder = os.path.abspath(folder)
    while True:
        for name in ("quillstone.yaml", "quillstone.yml"):
            if os.path.exists(path := os.path.join(folder, name)):
                return path
        if folder == os.path.dirname(folder):
            return None
        folder = os.path.dirname(folder)


def routed_room(path: Column, content: Column, rooms: list[tuple[str, list[str]]]) -> Column:
    """The room of a file by configured names and keywords: by a folder, by the file's name, by how often the words occur in the first 2,000 characters; else ``general``.

    Within a rule the outermost folder decides, then the order of the rooms; of equal counts the first room holds.
    """
    if not rooms:
        return T.room_of_path(path)
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    stem = F.lower(F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1))

    def of_folder(p: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, keywords in reversed(rooms):
            hit = F.lit(False)
            for c in (name.lower(), *(k.lower() for k in keywords)):
                hit = hit | F.contains(p, F.lit(c)) | F.contains(F.lit(c), p)
            out = F.when(hit, name).otherwise(out)
        return out

    by_folder = F.get(F.array_compact(F.transform(folders, of_folder)), F.lit(0))
    by_name = F.lit(None).cast("string")
    for name, _ in reversed(rooms):
        by_name = F.when(F.contains(F.lit(name.lower()), stem) | F.contains(stem, F.lit(name.lower())), name).otherwise(by_name)
    head = F.lower(F.left(content, F.lit(2000)))
    counts = []
    for i, (name, keywords) in enumerate(rooms):
        n = sum((F.regexp_count(head, F.lit(f"\\Q{k.lower()}\\E")) for k in (*keywords, name)), F.lit(0))
        counts.append(F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*counts))
    return F.coalesce(by_folder, by_name, F.when(best["n"] > 0, best["name"]), F.lit("general"))
