"""Cutting files into chunks. Sizes are bytes of UTF-8; positions never fall inside a character."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

# Fixed values.
SIZE, OVERLAP, LEAST, UNIT_MOST = 800, 100, 50, 1600


def _floor(data: bytes, at: int) -> int:
    """The start of the character at a position, or the position itself at the end."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def text_chunks(text: str | None) -> list[str]:
    """Windows of 800 bytes with 100 bytes of overlap, ended at the last blank line or else the last line end in their second half; chunks under 50 bytes are left out."""
    data = (text or "").strip().encode("utf-8", "surrogatepass")
    out: list[str] = []
    at = 0
    while at < len(data):
        stop = _floor(data, min(at + SIZE, len(data)))
        if stop < len(data):
            for mark in (b"\n\n", b"\n"):
                found = data.rfind(mark, at, stop)
                if found - at > SIZE // 2:
                    stop = found
                    break
        piece = data[at:stop].decode("utf-8", "replace").strip()
        if len(piece.encode("utf-8", "surrogatepass")) >= LEAST:
            out.append(piece)
        if stop >= len(data):
            break
        at = _floor(data, stop - OVERLAP)
    return out


def _trim(data: bytes, a: int, b: int) -> tuple[int, int] | None:
    part = data[a:b].decode("utf-8", "replace")
    lead = len(part[: len(part) - len(part.lstrip())].encode("utf-8", "surrogatepass"))
    size = len(part.strip().encode("utf-8", "surrogatepass"))
    return (a + lead, a + lead + size) if size else None


def line_ranges(data: bytes, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Ranges of whole lines of about 800 bytes, without overlap: to the last line end in the second half, or else on to the next one."""
    whole = _trim(data, start, len(data) if end is None else end)
    if whole is None:
        return []
    at, end = whole
    out = []
    while at < end:
        want = _floor(data, min(at + SIZE, end))
        if want >= end:
            stop = end
        else:
            back = data.rfind(b"\n", at, want)
            on = data.find(b"\n", want, end)
            stop = back + 1 if back - at >= SIZE // 2 else end if on < 0 else on + 1
        kept = _trim(data, at, stop)
        if kept and kept[1] - kept[0] >= LEAST:
            out.append(kept)
        at = stop
    return out


_QUIET = re.compile(rb'//[^\n]*|/\*.*?\*/|r(#*)".*?"\1|"(?:\\.|[^"\\])*"|\'(?:\\.[^\']*|[^\'\\\n])\'', re.S)
_FN = re.compile(rb"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)", re.M)
_HOLDER = re.compile(rb"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:(?:struct|enum|trait|mod)\s+(\w+)|impl(?:\s*<[^{]*?>)?\s+(?:[^{;]*?\bfor\s+)?([\w:]+))", re.M)
_MATCH = re.compile(rb"\bmatch\b[^{};]*\{")


def _masked(data: bytes) -> bytes:
    """The code with comments and literals blanked, so that braces can be counted."""
    return _QUIET.sub(lambda m: re.sub(rb"[^\n]", b" ", m[0]), data)


def _close(code: bytes, at: int) -> int:
    """The position behind the brace that closes the first one opened from here; -1 without one before a semicolon."""
    depth = 0
    for m in re.finditer(rb"[{};]", code[at:]):
        c = m[0]
        if c == b"{":
            depth += 1
        elif c == b"}":
            depth -= 1
            if depth <= 0:
                return at + m.end()
        elif depth == 0:
            return -1
    return -1


def _arms(code: bytes, a: int, b: int) -> Iterator[tuple[int, int, str]]:
    """Arms of the match block whose braces are at a and b - 1: start, end with its comma, and the name in the pattern."""
    at = a + 1
    while at < b - 1:
        arrow = code.find(b"=>", at, b - 1)
        if arrow < 0:
            return
        start = at + len(code[at:arrow]) - len(code[at:arrow].lstrip())
        depth, stop = 0, b - 1
        for m in re.finditer(rb"[][(){},]", code[arrow + 2 : b - 1]):
            c = m[0]
            if c in b"([{":
                depth += 1
            elif c in b")]}":
                depth -= 1
                if c == b"}" and depth == 0:
                    stop = arrow + 2 + m.end()
                    tail = re.match(rb"[ \t]*,", code[stop:b])
                    stop += tail.end() if tail else 0
                    break
            elif depth == 0:
                stop = arrow + 2 + m.end()
                break
        name = re.match(r"[|&\s]*([^\s({@|&]+)", code[start:arrow].decode("utf-8", "replace"))
        yield start, stop, name[1] if name and name[1] != "_" else ""
        at = stop


def structural_units(data: bytes) -> list[tuple[int, int, str | None, str | None]]:
    """Functions without match arms and single match arms, each of 50 to 1,600 bytes, with their own and their enclosing name; no two overlap.

    Read by a scanner of braces, not by a grammar: it knows comments and literals, but no macros.
    """
    code = _masked(data)
    holders = [(m.start(), _close(code, m.end()), (m[1] or m[2]).decode()) for m in _HOLDER.finditer(code)]
    functions = [(m.start(), _close(code, m.end()), m[1].decode()) for m in _FN.finditer(code)]
    functions = [f for f in functions if f[1] > 0]

    def around(a: int, b: int, spans) -> str | None:
        inside = [s for s in spans if s[0] <= a and b <= s[1] and (s[0], s[1]) != (a, b)]
        return max(inside)[2] if inside else None

    units: list[tuple[int, int, str | None, str | None]] = []
    for m in _MATCH.finditer(code):
        brace = m.end() - 1
        end = _close(code, brace)
        if end < 0:
            continue
        for a, b, name in _arms(code, brace, end):
            line = data.rfind(b"\n", 0, a) + 1
            a = line if not data[line:a].strip() else a
            if LEAST <= b - a <= UNIT_MOST:
                units.append((a, b, name or None, around(a, b, functions) or around(a, b, holders)))
    for a, b, name in functions:
        if LEAST <= b - a <= UNIT_MOST and not _MATCH.search(code, a, b):
            units.append((a, b, name, around(a, b, holders)))
    kept: list[tuple[int, int, str | None, str | None]] = []
    for u in sorted(units, key=lambda u: (u[0], -u[1])):
        if not kept or u[0] >= kept[-1][1]:
            kept.append(u)
    return kept


def structural_chunks(text: str) -> list[tuple[str, str | None, str | None]]:
    """Units as they stand, and what lies between them by lines: (code, symbol, enclosing)."""
    data = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    for a, b, symbol, enclosing in [*structural_units(data), (len(data), len(data), None, None)]:
        out += [(data[x:y].decode("utf-8", "replace"), None, None) for x, y in line_ranges(data, at, a)]
        if b > a:
            out.append((data[a:b].decode("utf-8", "replace"), symbol, enclosing))
        at = b
    return out


def chunk_file(content: str | None, language: str | None) -> list[tuple[str, str | None, str | None]]:
    """Chunks of a file by its language: structural, by lines, or as text; with symbol and enclosing name where known."""
    if not content:
        return []
    if language == "rust":
        return structural_chunks(content)
    if language:
        data = content.encode("utf-8", "surrogatepass")
        return [(data[a:b].decode("utf-8", "replace"), None, None) for a, b in line_ranges(data)]
    return [(c, None, None) for c in text_chunks(content)]


def _chunks(contents, languages):
    return pd.Series([[(c, s, e) for c, s, e in chunk_file(t, g)] for t, g in zip(contents, languages)])


_chunks.__annotations__ = {"contents": pd.Series, "languages": pd.Series, "return": pd.Series}


def chunks(content: Column, language: Column) -> Column:
    """``chunk_file`` over columns, as an array of (code, symbol, enclosing)."""
    return F.pandas_udf(_chunks, "array<struct<chunk string, symbol string, enclosing string>>")(content, language)


def chunked(files: DataFrame, path: str = "source_file", content: str = "content") -> DataFrame:
    """The rows with ``chunk_index, chunk, symbol, enclosing`` for each chunk; rows without chunks go."""
    rows = files.withColumn("_c", chunks(F.coalesce(F.col(content), F.lit("")), T.language(F.col(path))))
    return rows.select(*files.columns, F.posexplode("_c").alias("chunk_index_new", "_x")).select(*files.columns, F.col("chunk_index_new"), "_x.*")
