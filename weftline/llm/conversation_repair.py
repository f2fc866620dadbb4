"""Conversation structure repair: bidirectional Dijkstra over the edit lattice.

A conversation is repaired by one edit per row, and by insertions between rows:

    K  keep       0   as it is
    R  rerole     1   to user or assistant
    D  delete     2   required for blank and duplicate rows
    I  insert     5   an empty user or assistant text

A truncated row that is not deleted costs 5 more. The role initials of the
result must read ``(s?(ua)+)?``. A node of the lattice is (rows read, state),
where the state says what was written last: nothing, ``s``, ``u`` or ``a``;
edges are edits. Two heaps settle nodes from either end. They go on until their
least keys add up to more than the best crossing, so every crossing of that
cost is known, and the least concatenation of prefix, crossing and suffix is
read off one character at a time: equal-cost paths to a node never begin one
another, so it is enough to follow the nodes that the least text so far can be
at. That is linear in the rows, and no path is held twice.

A conversation is what is repaired at once: its rows meet in one task, sorted
by Spark, and its lattice has four nodes a row. Cost and audit depend on one
letter per row, so conversations of the same shape are solved once per task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SHAPES = 20_000  # shapes remembered per Python worker, of at most SHAPE_ROWS rows
SHAPE_ROWS = 64
BATCH_CHARS = 1 << 22  # characters of a batch handed back to Spark

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {"su", "ua", "au"}

REPAIRED = ("conv_id {id}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
            "repaired array<struct<role: string, text: string>>")


def _written(state: int) -> int:
    """The state after a user or assistant row, whichever may follow."""
    return ASSISTANT if state == USER else USER


def _keeps(letter: str, state: int) -> int | None:
    """The state after a kept row, None if it may not follow."""
    if letter == "s":
        return SYSTEM if state == NOTHING else None
    if letter == "u":
        return USER if state != USER else None
    return ASSISTANT if letter == "a" and state == USER else None


def _row_edits(code: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, state after it) of a row read in ``state``."""
    yield "D", DELETE, state
    if code != "x":
        extra = TRUNCATED if code.isupper() else 0
        yield "R", REROLE + extra, _written(state)
        after = _keeps(code.lower(), state)
        if after is not None:
            yield "K", extra, after


def _before(code: str) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """Per state: (edit, cost, state before it)."""
    into: list[list[tuple[str, int, int]]] = [[], [], [], []]
    for state in range(4):
        for edit, cost, after in _row_edits(code, state):
            into[after].append((edit, cost, state))
    return tuple(map(tuple, into))


CODES = "suaoSUAOx"
LEAVING = {code: tuple(tuple(_row_edits(code, state)) for state in range(4)) for code in CODES}
ENTERING = {code: _before(code) for code in CODES}


def solve(codes: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of one conversation, the ASCII-least of them.

    One letter per row: ``s``, ``u``, ``a`` or ``o`` (another role), a capital
    if truncated, ``x`` if the row must be deleted.
    """
    n = len(codes)
    goal = 4 * (n + 1)  # after either state in which a conversation may end
    never = 1 << 60

    def following(node: int) -> Iterator[tuple[str, int, int]]:
        at, state = divmod(node, 4)
        yield "I", INSERT, 4 * at + _written(state)
        if at < n:
            for edit, cost, after in LEAVING[codes[at]][state]:
                yield edit, cost, 4 * at + 4 + after
        elif state in (NOTHING, ASSISTANT):
            yield "", 0, goal

    def preceding(node: int) -> Iterator[tuple[str, int, int]]:
        if node == goal:
            yield "", 0, 4 * n + NOTHING
            yield "", 0, 4 * n + ASSISTANT
            return
        at, state = divmod(node, 4)
        if state >= USER:
            for before in (NOTHING, SYSTEM, ASSISTANT) if state == USER else (USER,):
                yield "I", INSERT, 4 * at + before
        if at:
            for edit, cost, before in ENTERING[codes[at - 1]][state]:
                yield edit, cost, 4 * at - 4 + before

    far = ([never] * (goal + 1), [never] * (goal + 1))
    done = (bytearray(goal + 1), bytearray(goal + 1))
    heaps: tuple[list, list] = ([(0, 0)], [(0, goal)])
    far[0][0] = far[1][goal] = 0
    steps = (lambda node: following(node) if node != goal else (), preceding)
    best = never
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = int(heaps[1][0][0] <= heaps[0][0][0])  # the goal first, so that a path settled from the start alone crosses at its end
        cost, node = heapq.heappop(heaps[side])
        mine, other = far[side], far[1 - side]
        if done[side][node]:
            continue
        done[side][node] = 1
        for _, weight, there in steps[side](node):
            if cost + weight < mine[there]:
                mine[there] = cost + weight
                heapq.heappush(heaps[side], (cost + weight, there))
            best = min(best, cost + weight + other[there])
    ahead, behind = far
    # what is left to pay at every node of a cheapest path: settled from the end, or before a crossing of the best cost
    left = {node: behind[node] for node in range(goal + 1) if done[1][node]}
    front = [
        node for node in range(goal) if done[0][node]
        and any(done[1][there] and ahead[node] + weight + behind[there] == best for _, weight, there in following(node))
    ]
    seen = set(front)
    while front:
        node = front.pop()
        left[node] = best - ahead[node]
        for _, weight, before in preceding(node):
            if before not in seen and done[0][before] and ahead[before] + weight == ahead[node]:
                seen.add(before)
                front.append(before)
    audit, nodes = [], {0}
    while goal not in nodes:
        steps_on = [(edit, there) for node in nodes for edit, weight, there in following(node) if left.get(there, never) + weight == left[node]]
        edit = min(edit for edit, _ in steps_on)
        nodes = {there for found, there in steps_on if found == edit}
        audit.append(edit)
    return best, "".join(audit)


class Shapes(dict):
    """Cost and audit of the short shapes met; emptied when full."""

    def __missing__(self, codes: str) -> tuple[int, str]:
        found = solve(codes)
        if len(codes) <= SHAPE_ROWS:
            if len(self) >= SHAPES:
                self.clear()
            self[codes] = found
        return found


def apply(audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired rows; reroled and inserted rows take the role their place asks for."""
    out: list[tuple[str, str]] = []
    given = iter(rows)
    state = NOTHING
    for edit in audit:
        role, text = next(given) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        else:
            state = _written(state)
            role = "user" if state == USER else "assistant"
        out.append((role, text))
    return out


def repaired(turns: list[int | None], rows: list[tuple[str, str]], shapes: Shapes) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired rows) of one conversation in order."""
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    codes, seen, faults = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for row in rows:
        role, text = row
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        said = text.rstrip(BLANKS)
        if not said:
            fault, code = "blank", "x"
        elif row in seen:
            fault, code = "duplicate", "x"
        elif said[-1] not in ENDS:
            fault, code = "truncated", letter.upper()
        else:
            fault, code = "", letter
        seen.add(row)
        codes.append(code)
        if fault:
            faults[fault] += 1
    illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = shapes["".join(codes)]
    return gaps, *faults.values(), illegal, cost, audit, apply(audit, rows)


def repair(rows: DataFrame, conversation: str, turn: str, role: str, text: str, present: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), one row per conversation.

    ``gaps`` counts turns missing between the smallest and the largest, the
    faults count rows by their first one, ``illegal`` adjacent role initials
    other than ``su``, ``ua`` and ``au``; ``repaired`` has role and text of
    the rows after the cheapest edits. Rows are taken by turn, nulls first,
    ties by role and text. Rows of which ``present`` is not true only name
    their conversation; one without other rows has zeros and nothing else.
    Null roles and texts count as one space, an empty role as another role.
    Rows with a null conversation are one conversation; repeated rows are
    duplicates. Other columns are ignored. An empty table gives no row.
    """
    id_type = rows.schema[conversation].dataType
    there = F.coalesce(present, F.lit(False)) if present is not None else F.lit(True)
    value = lambda c: F.when(there, F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    given = rows.select(
        F.col(conversation).alias("conv_id"), there.alias("present"), F.when(there, F.col(turn).cast("bigint")).alias("turn"),
        value(role).alias("role"), value(text).alias("text"))
    placed = given.repartition("conv_id").sortWithinPartitions("conv_id", "present", F.asc_nulls_first("turn"), "role", "text")
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")
    pair = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    types = (*[pa.int64()] * 6, pa.string(), pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        shapes = Shapes()
        now, turns, lines, kind = None, [], [], None

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            rows_of = [[{"role": r, "text": t} for r, t in done] for done in columns[8]]
            arrays = [pa.array(columns[0], kind), *[pa.array(c, k) for c, k in zip((*columns[1:8], rows_of), types, strict=True)]]
            return pa.RecordBatch.from_arrays(arrays, names=list(names))

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, is_row, at, who, said in zip(*(batch[c].to_pylist() for c in ("conv_id", "present", "turn", "role", "text")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append((now[0], *repaired(turns, lines, shapes)))
                        if size > BATCH_CHARS:
                            yield batch_of(out)
                            out, size = [], 0
                    now, turns, lines = (conv,), [], []
                if is_row:
                    turns.append(at)
                    lines.append((who, said))
                    size += len(said) + 64
        if now is not None:
            out.append((now[0], *repaired(turns, lines, shapes)))
            yield batch_of(out)

    return placed.mapInArrow(run, REPAIRED.format(id=id_type.simpleString()))
