"""Chunks of markdown, code and plain text as a table function, joined laterally to the rows that hold the texts.

Markdown is cut at its headings (those of fenced blocks are not headings) and keeps the stack of headings as a
path; code is cut where a line at the margin follows a blank line, so that functions and classes stay
whole. Neighbouring units share a chunk while it is shorter than ``least`` and the sum fits in ``most``; a longer
unit is cut as plain text is. The raw index counts every chunk, blank ones too, which are then left out,
so that an id does not change with what is dropped. Lines count from 1; a piece of a longer unit has that unit's lines.

Null and blank texts have no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lattice.operators.text import CHUNK_LEAST, CHUNK_MOST, split_text
from lattice.session import ship

MARKDOWN, CODE, TEXT = "markdown", "code", "text"
SCHEMA = "raw_index INT, heading STRING, start_line INT, end_line INT, text STRING, total INT"

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")

#: heading path, first line, last line, text
Unit = tuple[str, int, int, str]


def markdown_units(text: str) -> Iterator[Unit]:
    """Sections: a heading's line and what follows up to the next heading; what comes before the first has an empty path."""
    stack: list[tuple[int, str]] = []
    held: list[str] = []
    fence, start, path = "", 1, ""
    for n, line in enumerate(text.split("\n"), 1):
        mark = _FENCE.match(line)
        if mark and (not fence or (mark[1].startswith(fence) and not line[mark.end() :].strip(" \t`~"))):
            fence = "" if fence else mark[1]
        head = None if fence or mark else _HEADING.match(line)
        if head:
            if held:
                yield path, start, n - 1, "\n".join(held)
            level = len(head[1])
            stack = [s for s in stack if s[0] < level] + [(level, (head[2] or "").strip())]
            held, start, path = [], n, " > ".join(s[1] for s in stack)
        held.append(line)
    if held:
        yield path, start, start + len(held) - 1, "\n".join(held)


def code_units(text: str) -> Iterator[Unit]:
    """Blocks that begin with a line at the margin after a blank line; the path is the block's first line that is not a comment or decorator."""
    lines = text.split("\n")
    cuts = [0] + [k for k in range(1, len(lines)) if lines[k][:1].strip() and lines[k][0] not in ")]}" and not lines[k - 1].strip()] + [len(lines)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        names = (x.strip() for x in lines[a:b])
        yield next((x[:120] for x in names if x and x[0] not in "#@/*"), ""), a + 1, b, "\n".join(lines[a:b])


def plain_units(text: str) -> Iterator[Unit]:
    yield "", 1, text.count("\n") + 1, text


_UNITS = {MARKDOWN: markdown_units, CODE: code_units}


def pack(units: Iterator[Unit], least: int, most: int) -> Iterator[Unit]:
    """Chunks of units, in order."""
    held: list[Unit] = []
    size = 0

    def close() -> Unit:
        return held[0][0], held[0][1], held[-1][2], "\n".join(u[3] for u in held)

    for u in units:
        n = len(u[3])
        if held and (size >= least or size + 1 + n > most):
            yield close()
            held, size = [], 0
        if n > most:
            if held:
                yield close()
                held, size = [], 0
            yield from ((u[0], u[1], u[2], piece) for piece in split_text(u[3], least, most))
        else:
            size += n + bool(held)
            held.append(u)
    if held:
        yield close()


def chunk(text: str | None, kind: str | None, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> list[tuple[int, str, int, int, str, int]]:
    """(raw index, path, first line, last line, text, number of raw chunks) of a text."""
    if text is None or not text.strip():
        return []
    found = list(pack(_UNITS.get(kind or TEXT, plain_units)(text), least, most))
    return [(k, path, a, b, body, len(found)) for k, (path, a, b, body) in enumerate(found) if body.strip()]


@udtf(returnType=SCHEMA)
class Chunks:
    """The table function: text, kind, least, most."""

    def eval(self, text: str, kind: str, least: int, most: int) -> Iterator[tuple]:
        from lattice.operators.chunking import chunk

        yield from chunk(text, kind, least, most)


def register(spark: SparkSession, name: str = "text_chunks") -> None:
    """Makes the function known to SQL: ``SELECT ... FROM docs, LATERAL text_chunks(text, 'markdown', 200, 1500)``."""
    ship(spark)
    spark.udtf.register(name, Chunks)


def chunked(docs: DataFrame, text: str, kind: Column | str, *, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> DataFrame:
    """Every row of ``docs``, without its text, with each of its chunks: raw_index, heading, start_line, end_line, text, total."""
    ship(docs.sparkSession)
    of = kind if isinstance(kind, Column) else F.lit(kind)
    source = docs.withColumns({"__text": F.col(text), "__kind": of}).drop(text)
    found = source.lateralJoin(Chunks(F.col("__text").outer(), F.col("__kind").outer(), F.lit(least), F.lit(most)))
    return found.drop("__text", "__kind")
