"""Exact merge-type (BPE) encoding by backtracking, and decoding.

A merge-type encoder joins the best-ranked adjacent pair until none is left.
The same result is found from left to right: a sequence of pieces is the
encoding of a text exactly when every two neighbours are the encoding of their
own concatenation. So pieces are tried longest first at each position
(Aho-Corasick gives all matches of a text in one pass), a neighbour is accepted
only if re-merging the two yields the same two pieces, and positions from which
the rest proved impossible are kept in a bit field, so none is tried twice.
Pieces that merging can never produce are left out of the automaton.

No piece holds a space mark after another character, and some characters occur
in no longer piece; no merge crosses such a border, so texts are cut there and
the segments, words mostly, are encoded once per task and remembered. The
memory of segments is bounded; long texts are streamed through it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"  # the mark that stands for a space in pieces
#: Segments and piece pairs remembered per Python worker.
SEGMENTS, PAIRS = 400_000, 500_000
ROWS = 512  # texts in Python's hands at a time
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields; 32-bit values as raw bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Encoder:
    """Pieces of a model file with the tables the encoding needs."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        normalizer: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("needs a BPE model with identity normalisation, a dummy prefix and escaped, uncollapsed spaces")
        if USER in self.kinds or self.kinds.count(BYTE) != 256:
            raise ValueError("needs a model with byte fallback and without user-defined symbols")
        self.ids = {p: i for i, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)) if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)) if kind == BYTE}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.lengths = [len(p) for p in self.pieces]
        self.joined = {c for p in self.ids if len(p) > 1 for c in p}
        automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1 or self.merged(p) == [p]:
                automaton.add_word(p, i)
        automaton.make_automaton()
        self.automaton = automaton
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in self.joined)
        # a run of space marks and what follows it, up to the next mark or a character that never merges
        self.cut = re.compile(f" *[^ {alone}]+| +|[{alone}]+" if alone else " *[^ ]+| +")
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self.byte_of = {i: byte for byte, i in self.bytes.items()}
        self.pairs: dict[int, bool] = {}  # left * number of pieces + right
        self.known = _Words(self)
        self.singles = frozenset(p for p in self.ids if len(p) == 1)
        self.plain_lines = "\n" in alone
        # a byte below 0x80 is a character of its own; only higher bytes have to be put together
        self.high_bytes = np.zeros(len(self.pieces), dtype=bool)
        for byte, i in self.bytes.items():
            self.high_bytes[i] = byte >= 128

    def _surface(self, i: int) -> str:
        kind = self.kinds[i]
        if kind == CONTROL:
            return ""
        if kind == BYTE:
            return chr(int(self.pieces[i][3:5], 16))  # for those below 0x80; higher ones are never looked up
        return " ⁇ " if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ")

    def merged(self, text: str) -> list[str]:
        """The definition: join the best-scored adjacent pair, the leftmost among equals, until none is left."""
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                at = self.ids.get(parts[i] + parts[i + 1])
                if at is not None and (best is None or self.scores[at] > best):
                    best, where = self.scores[at], i
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' concatenation anew yields the same two pieces."""
        key = left * len(self.pieces) + right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            found = self.pairs[key] = self.merged(a + b) == [a, b]
        return found

    def backtrack(self, segment: str) -> list[int] | None:
        """Ids of a segment all of whose characters are pieces; None if no sequence is consistent."""
        size, lengths, seen, width = len(segment), self.lengths, self.pairs.get, len(self.pieces)
        matches: list[list[int]] = [[] for _ in range(size)]
        for end, i in self.automaton.iter(segment):
            matches[end + 1 - lengths[i]].append(i)  # shorter ones first, as their ends come first
        failed = 0  # bit p: nothing consistent starts at p after the piece tried before it
        ids: list[int] = []
        ranks: list[int] = []
        at, rank, last = 0, len(matches[0]) - 1, -1
        while at < size:
            options = matches[at]
            while rank >= 0:
                i = options[rank]
                if not failed >> (at + lengths[i]) & 1:
                    if last < 0:
                        break
                    fits = seen(last * width + i)
                    if self.compatible(last, i) if fits is None else fits:
                        break
                rank -= 1
            if rank >= 0:
                ids.append(i)
                ranks.append(rank)
                last = i
                at += lengths[i]
                rank = len(matches[at]) - 1 if at < size else -1
                continue
            failed |= 1 << at
            if not ids:
                return None
            at -= lengths[ids.pop()]
            rank = ranks.pop() - 1
            last = ids[-1] if ids else -1
        return ids

    def segment(self, segment: str) -> list[int]:
        """Ids of one segment with space marks; characters without a piece become bytes."""
        if self.singles.issuperset(segment):
            return self._run(segment)
        found: list[int] = []
        begin = 0
        ids = self.ids
        for at, c in enumerate(segment):
            if c not in ids:
                found += self._run(segment[begin:at])
                found += [self.bytes[b] for b in c.encode("utf-8", "replace")]
                begin = at + 1
        return found + self._run(segment[begin:])

    def _run(self, run: str) -> list[int]:
        if not run:
            return []
        ids = self.backtrack(run)
        if ids is None:
            raise ValueError(f"no consistent encoding of {run[:40]!r}")
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without begin or end ids; null and empty texts have none."""
        if not text:
            return []
        known = self.known
        text = text.replace(SPACE, " ")
        if self.plain_lines:
            # a word stands for itself with a space mark before it, a line break takes the mark's place
            lines = text.replace("\n", " \n")
            if "  " not in lines and lines[0] != " " and lines[-1] != " ":
                return list(chain.from_iterable(map(known.__getitem__, lines.split(" "))))
        out: list[int] = []
        for word in self.cut.findall(" " + text):
            out += self.segment(word.replace(" ", SPACE)) if word[0] != " " or word[1:2] in ("", " ") else known[word[1:]]
        return out

    def decode(self, ids: list[int], high: bool = True) -> str:
        """Text of ids: the dummy space goes, bytes are read as UTF-8, each byte that is not becomes U+FFFD.

        ``high=False`` says that no byte of 0x80 or more is among them.
        """
        surface = self.surface
        if not high:
            text = "".join(map(surface.__getitem__, ids))
        else:
            held = bytearray()
            parts: list[str] = []
            for i in ids:
                byte = self.byte_of.get(i)
                if byte is not None:
                    held.append(byte)
                    continue
                if held:
                    parts.append(_utf8(bytes(held)))
                    held.clear()
                parts.append(surface[i])
            parts.append(_utf8(bytes(held)))
            text = "".join(parts)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text


class _Words(dict):
    """Ids of words seen, each with a space mark before it; at most ``SEGMENTS`` short ones are kept."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, word: str) -> list[int]:
        tool = self.encoder
        found: list[int] = []
        for part in tool.cut.findall(word if word[:1] == "\n" else " " + word):
            found += tool.segment(part.replace(" ", SPACE))
        if len(word) <= 64:
            if len(self) >= SEGMENTS:
                self.clear()
            self[word] = found
        return found


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out: list[str] = []
    at = 0
    while at < len(data):  # each byte outside a valid character is replaced on its own
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_ENCODERS: dict[int, tuple[bytes, Encoder]] = {}


def encoder(model: bytes) -> Encoder:
    """The worker's encoder of a model; one is kept."""
    held = _ENCODERS.get(0)
    if held is None or held[0] != model:
        _ENCODERS[0] = held = (model, Encoder(model))
    return held[1]


def encode(df: DataFrame, text: str, model: bytes, name: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns of ``df`` with ``name`` array<int>: the ids of every whole text.

    ``decoded`` names a further column for the text read back from those ids,
    made in the same pass. A null text has no ids, like an empty one. Columns
    with these names are replaced. Rows stay as they are: repeated rows repeat,
    an empty table stays empty. The model's bytes (a fixed file, well under a
    megabyte) travel with the task.
    """
    df = df.drop(name, decoded) if decoded else df.drop(name)
    fields = [*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                lists = [tool.encode(t) for t in batch[text].to_pylist()]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(lists), np.int32, ends[-1])
                made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    made.append(_texts(tool, flat, ends))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))


def _texts(tool: Encoder, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    high = np.concatenate([[0], np.cumsum(tool.high_bytes[flat])])[ends]
    ids = flat.tolist()
    return pa.array([tool.decode(ids[a:b], x < y) for a, b, x, y in zip(ends, ends[1:], high, high[1:], strict=False)], pa.string())


def decode(df: DataFrame, ids: str, model: bytes, name: str = "decoded") -> DataFrame:
    """All columns of ``df`` with ``name`` string: the text of the ids; null ids count as none."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = encoder(model)
        for rows in batches:
            ends = np.cumsum([0, *(n or 0 for n in rows.value_lengths().to_pylist())])
            yield _texts(tool, rows.flatten().to_numpy(zero_copy_only=False), ends)

    return df.withColumn(name, texts(F.col(ids)))


def digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), 256)
