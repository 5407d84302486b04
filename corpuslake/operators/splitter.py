"""Cutting texts into overlapping pieces at the coarsest separators that allow it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship
from ..sources.parsers import mapped

#: The separators, coarsest first; the last one stands for a cut between any two characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
PIECE_CHARS, OVERLAP_CHARS = 900, 120


def _parts(text: str, separators: tuple[str, ...]) -> tuple[list[str], tuple[str, ...]]:
    """The text cut before every occurrence of the first separator that it has, and the finer separators."""
    for i, s in enumerate(separators):
        if not s:
            return list(text), ()
        if s in text:
            first, *more = text.split(s)
            return [p for p in (first, *(s + p for p in more)) if p], separators[i + 1 :]
    return list(text), ()


def _packed(parts: list[str], most: int, overlap: int) -> Iterator[str]:
    """Neighbouring parts joined while they fit; a piece begins with the last parts of the one before that make up `overlap` characters at most."""
    held: deque[str] = deque()
    size = 0
    for part in parts:
        if size + len(part) > most and held:
            yield "".join(held)
            while size > overlap or size + len(part) > most:
                size -= len(held.popleft())
        held.append(part)
        size += len(part)
    if held:
        yield "".join(held)


def split_text(text: str, most: int = PIECE_CHARS, overlap: int = OVERLAP_CHARS, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `most` characters, trimmed, none empty. A part that is too long at one separator is cut at the next, and only at the last one
    within words; parts that fit are joined up to `most`."""
    if overlap >= most:
        raise ValueError("overlap must be below most")
    pieces: list[str] = []
    todo: list[tuple[str, tuple[str, ...]] | str] = [(text, separators)]
    while todo:
        now = todo.pop()
        if isinstance(now, str):
            pieces.append(now)
            continue
        parts, finer = _parts(*now)
        ordered: list[tuple[str, tuple[str, ...]] | str] = []
        run: list[str] = []
        for part in parts:
            if len(part) <= most:
                run.append(part)
                continue
            ordered += _packed(run, most, overlap)
            run = []
            ordered.append((part, finer))
        ordered += _packed(run, most, overlap)
        todo += reversed(ordered)
    return [p for p in map(str.strip, pieces) if p]


def with_pieces(df: DataFrame, text: str, most: int = PIECE_CHARS, overlap: int = OVERLAP_CHARS, out: str = "_pieces") -> DataFrame:
    """df with an array of split_text() of a column; null gives none. Rows keep their place, and nothing is shuffled."""
    ship(df.sparkSession)
    if overlap >= most:
        raise ValueError("overlap must be below most")

    def read(x: str) -> list[str]:
        return split_text(x, most, overlap)

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])
    return df.mapInArrow(mapped([*df.columns, out], df.columns.index(text), read, pa.list_(pa.string())), schema)
