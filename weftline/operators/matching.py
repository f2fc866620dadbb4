"""Many literal terms looked for in many texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.rows import unpack
from weftline.session import Rounds

GRAM = 4  # characters of a term that stand in for it
BLOCK_CHARS = 4_000_000  # characters of terms that are with a task at a time
CACHED_WORDS = 200_000  # words whose terms a task remembers
FEW_PHRASES = 20  # so many terms with white space are looked for one by one
STAND_IN = "\ud800"  # no text holds it: it has no UTF-8


class TermIndex:
    """Terms by their first characters; the work on a text does not grow with the number of terms.

    A term without white space lies within a word of the text, and words come
    again and again, so words are looked at once and remembered: all pieces of
    a word that are long enough are looked up. In longer words, and in whole
    texts for terms with white space, the next few characters say which lengths
    a term may have at a position, and each such piece is looked up.
    """

    def __init__(self, terms: list[str]) -> None:
        single = [t for t in terms if t.split() == [t]]
        self._words, self._starts = frozenset(single), self._lengths(single)
        self._shortest = min(map(len, single), default=0)
        phrases = [t for t in terms if t.split() != [t]]
        self._phrases, self._phrase_starts = frozenset(phrases), self._lengths(phrases)
        self._known: dict[str, tuple[str, ...]] = {}

    @staticmethod
    def _lengths(terms: list[str]) -> dict[int, dict[str, list[int]]]:
        starts: dict[int, dict[str, set[int]]] = defaultdict(lambda: defaultdict(set))
        for t in terms:
            starts[min(len(t), GRAM)][t[:GRAM]].add(len(t))
        return {n: {start: sorted(lengths) for start, lengths in found.items()} for n, found in starts.items()}

    @staticmethod
    def _pieces(value: str, terms: frozenset[str], starts: dict[int, dict[str, list[int]]]) -> set[str]:
        found: set[str] = set()
        for n, lengths in starts.items():
            for i in range(len(value) - n + 1):
                for length in lengths.get(value[i : i + n], ()):
                    piece = value[i : i + length]
                    if piece in terms:
                        found.add(piece)
        return found

    def _in_word(self, word: str) -> tuple[str, ...]:
        size, low = len(word), self._shortest
        if size > 4 * GRAM:
            return tuple(self._pieces(word, self._words, self._starts))
        return tuple(self._words & {word[i:j] for i in range(size - low + 1) for j in range(i + low, size + 1)})

    def hits(self, value: str) -> set[str]:
        """The distinct terms in a text."""
        if len(self._phrases) <= FEW_PHRASES:
            found = {t for t in self._phrases if t in value}
        else:
            found = self._pieces(value, self._phrases, self._phrase_starts)
        known = self._known
        for word in set(value.split()) if self._words else ():
            if len(word) >= self._shortest:
                here = known.get(word)
                if here is None:
                    here = self._in_word(word)
                    if len(word) <= 64:
                        if len(known) >= CACHED_WORDS:
                            known.clear()
                        known[word] = here
                found.update(here)
        return found


class TermReplacer(dict):
    """Texts with ``STAND_IN`` for each term, as if the terms were replaced one after another, longest first, equal lengths in code point order.

    A term without white space lies within a word, so each word is replaced
    once and remembered here. Most words hold no term, which is told by as many
    characters as the shortest term has. A text that holds a term with white
    space is taken as a whole.
    """

    def __init__(self, terms: list[str]) -> None:
        super().__init__()
        single = [t for t in terms if t.split() == [t]]
        self._words, self._low = frozenset(single), min(map(len, single), default=0)
        starts: dict[str, set[int]] = defaultdict(set)
        for t in single:
            starts[t[: self._low]].add(len(t))
        self._starts = {start: tuple(lengths) for start, lengths in starts.items()}
        self._phrases = TermIndex([t for t in terms if t.split() != [t]])

    def _word_hits(self, value: str) -> list[str]:
        """The terms without white space in a text, some more than once."""
        low, starts = self._low, self._starts
        at = [i for i in range(len(value) - low + 1) if value[i : i + low] in starts] if low else ()
        if not at:
            return []
        pieces = [value[i : i + length] for i in at for length in starts[value[i : i + low]]]
        return [piece for piece in pieces if piece in self._words]

    @staticmethod
    def _without(value: str, terms: Iterable[str]) -> str:
        for t in sorted(set(terms), key=lambda t: (-len(t), t)):
            value = value.replace(t, STAND_IN)
        return value

    def __missing__(self, word: str) -> str:
        terms = self._word_hits(word)
        found = self._without(word, terms) if terms else word
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found

    def replaced(self, value: str) -> str:
        phrases = self._phrases.hits(value)
        if phrases:
            return self._without(value, [*phrases, *self._word_hits(value)])
        return " ".join(map(self.__getitem__, value.split(" ")))


def term_blocks(terms: DataFrame, term: str, block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """The distinct non-empty terms in as few blocks as keep each at about ``block_chars`` characters."""
    named = terms.select(F.col(term).alias("_term")).filter("_term <> ''").distinct()
    chars = named.agg(F.sum(F.length("_term") + GRAM)).first()[0] or 0
    blocks = -(-chars // block_chars)
    if blocks == 1:
        return [named]
    return [named.filter(F.pmod(F.xxhash64("_term"), F.lit(blocks)) == b) for b in range(blocks)]


def terms_in(text: Column, block: DataFrame) -> Column:
    """The terms of a block that occur in a text, sorted by code point, as an array."""
    terms = [r[0] for r in block.collect()]  # at most block_chars characters
    made: list[TermIndex] = []

    @F.arrow_udf("array<string>")
    def found(values: pa.Array) -> pa.Array:
        if not made:
            made.append(TermIndex(terms))
        return pa.array([sorted(made[0].hits(v or "")) for v in values.to_pylist()], pa.list_(pa.string()))

    return found(text)


def term_arrays(texts: DataFrame, terms: DataFrame, text: str, term: str, keys: tuple[str, ...], out: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``texts`` with the distinct non-empty terms that occur in each, as written, sorted by code point, in a column ``out``.

    ``keys`` identify a row. Containment has no join key: a text meets the
    terms in its own task, see :class:`TermIndex`. The terms travel to the
    tasks, so they are counted first. As long as they have no more than
    ``block_chars`` characters nothing is shuffled; a longer table goes block by
    block, one pass over the texts for each block, and the hits of a text are
    put together under its keys.
    """
    blocks = term_blocks(terms, term, block_chars)
    if not blocks:
        return texts.withColumn(out, F.array().cast("array<string>"))
    if len(blocks) == 1:
        return texts.withColumn(out, terms_in(F.col(text), blocks[0]))
    hits = reduce(DataFrame.unionByName, [texts.select(*keys, terms_in(F.col(text), b).alias(out)) for b in blocks])
    gathered = hits.filter(F.size(out) > 0).groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(out))).alias(out))
    return texts.join(gathered, list(keys), "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def term_hits(texts: DataFrame, terms: DataFrame, text: str, term: str, keys: tuple[str, ...], block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(keys, term): the distinct non-empty terms that occur in each text, as written; texts are not shuffled."""
    blocks = term_blocks(terms, term, block_chars)
    if not blocks:
        return texts.select(*keys, F.lit("").alias(term)).filter(F.lit(False))
    return reduce(DataFrame.unionByName, [unpack(texts, list(keys), terms_in(F.col(text), b), item=term) for b in blocks])


def _in_blocks(terms: Iterable[str], block_chars: int) -> Iterator[list[str]]:
    """The terms, in their order, in blocks of about ``block_chars`` characters."""
    block, chars = [], 0
    for t in terms:
        block.append(t)
        chars += len(t) + GRAM
        if chars >= block_chars:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _replaced(value: Column, terms: list[str], mark: str | None) -> Column:
    """A text, or the parts that earlier terms left of it, with ``mark`` for the terms of a block; without a mark the parts they leave."""
    made: list[TermReplacer] = []

    @F.arrow_udf("array<string>" if mark is None else "string")
    def replaced(values: pa.Array) -> pa.Array:
        if not made:
            made.append(TermReplacer(terms))
        whole = (STAND_IN.join(v) if isinstance(v, list) else v for v in values.to_pylist())
        done = [None if v is None else made[0].replaced(v) for v in whole]
        if mark is None:
            return pa.array([None if v is None else v.split(STAND_IN) for v in done], pa.list_(pa.string()))
        return pa.array([None if v is None else v.replace(STAND_IN, mark) for v in done], pa.string())

    return replaced(value)


def replace_terms(texts: DataFrame, terms: DataFrame, text: str, term: str, mark: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``texts`` with ``mark`` for the terms that occur in ``text``, as if they were replaced one after another.

    Longer terms come first, equal lengths in code point order; marks are never
    searched. Null and empty terms replace nothing, a null text stays null. No
    text is shuffled: the terms, read once, travel to the tasks in that order,
    in blocks of about ``block_chars`` characters, and the parts that a block
    leaves of the texts are written for the next one.
    """
    rounds = Rounds(texts.sparkSession)
    named = rounds.keep("terms", terms.select(F.col(term).alias("_term")).filter("_term <> ''").distinct())
    blocks = _in_blocks((r[0] for r in named.orderBy(F.length("_term").desc(), "_term").toLocalIterator()), block_chars)
    block, found = next(blocks, None), texts
    while block:
        after = next(blocks, None)
        found = found.withColumn(text, _replaced(F.col(text), block, None if after else mark))
        if after:
            found = rounds.keep("texts", found)
        block = after
    rounds.drop("terms")
    return found
