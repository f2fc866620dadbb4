"""Hashed letter features of whole texts, computed on flat arrays of code points.

Texts are lower-cased; every character that is no letter becomes the border
code 0. Features never span a border, so a text longer than ``PIECE``
characters is cut at white space and its pieces are treated one after another:
memory stays bounded and the features are those of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 1 << 20
_LATE_SPACE = re.compile(r"\s")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a row (null for a null id)."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


@cache
def _letters() -> np.ndarray:
    """Per code point: itself if a letter, else 0."""
    table = np.arange(0x110000, dtype=np.uint64)
    table[[not chr(i).isalpha() for i in range(0x110000)]] = 0
    return table


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def pieces(text: str) -> Iterator[str]:
    """The text cut at white space after every ``PIECE`` characters."""
    at = 0
    while len(text) - at > PIECE:
        gap = _LATE_SPACE.search(text, at + PIECE)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, row) of the texts, about ``PIECE`` characters at a time.

    ``row`` is the index of the text of each code. Every piece has a border on
    either side. Null texts count as empty.
    """
    held: list[str] = []
    rows: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in pieces((text or "").lower()):
            held.append(f" {piece} ")
            rows.append(i)
            size += len(piece) + 2
            if size >= PIECE:
                yield _codes(held, rows)
                held, rows, size = [], [], 0
    if held:
        yield _codes(held, rows)


def _codes(held: list[str], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(held).encode("utf-32-le", "replace"), np.uint32)
    return _letters()[points], np.repeat(np.array(rows), [len(x) for x in held])


def _mix(h: np.ndarray, bits: int) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def char_ngrams(codes: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the n-grams with at least one letter and no border inside."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = codes != 0
    if n == 1:
        ok = letter
    elif n == 2:
        ok = letter[:-1] | letter[1:]
    else:
        ok = letter[1 : size + 1].copy()
        for k in range(2, n - 1):
            ok &= letter[k : k + size]
    at = np.flatnonzero(ok[:size])
    h = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[at + k]
    return at, _mix(h, bits)


def words(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the words: runs of letters."""
    letter = codes != 0
    begins = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    if not len(begins):
        return begins, np.zeros(0, np.int64)
    ends = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1
    lengths = ends - begins
    inside = np.flatnonzero(letter)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
        h = np.add.reduceat(codes[inside] * power[place], np.cumsum(lengths) - lengths)
    return begins, _mix(h, bits)
