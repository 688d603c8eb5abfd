"""Repair of conversation structure (operator 13): the cheapest edits to alternating turns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultsift.session import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a stretch of the lattice whose prices converge together.
STRETCH = 16
#: Where the text stands: at the start, behind a system, a user or an assistant turn. Legal ends are
#: the start and behind an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The role that a turn put or renamed at a place gets; it is the only legal one there.
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 60
BLANKS = " \t\n\v\f\r"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, again) after the damage: a rule of crc32("conv_id:turn") % 20.

    0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats the row
    (again = 1), 4 makes it a user's. Nulls count as one space in role, text and the rule; conv_id and
    turn themselves stay null.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce(F.col("text"), space)
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("_role"), text.alias("_text"), (F.crc32(name) % 20).alias("_rule"))
    return rows.where("_rule != 0").select(
        "conv_id",
        "turn",
        F.when(F.col("_rule") == 4, F.lit("user")).otherwise(F.col("_role")).alias("role"),
        F.when(F.col("_rule") == 1, F.lit("")).when(F.col("_rule") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text")).alias("text"),
        F.explode(F.when(F.col("_rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    )


def faults(turns: DataFrame) -> DataFrame:
    """Rows in order, with their first fault.

    Columns: conv_id, turn, role, text, place (from 1; by turn, nulls first, ties by role, text and
    `again`), fault (blank, duplicate, truncated or empty), illegal (whether role initials of this and
    the row before are none of su, ua, au) and new_turn (whether the turn is the first of its number).
    Null conv_id is one conversation. A conversation is sorted in one task, which spills; nothing of
    it is held.
    """
    order = [F.asc_nulls_first("turn"), "role", "text", "again"]
    inside = Window.partitionBy("conv_id").orderBy(*order)
    same = Window.partitionBy("conv_id", "role", "text").orderBy(*order)
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(bare == "", "blank")
        .when(F.row_number().over(same) > 1, "duplicate")
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(inside), initial)
    return turns.select(
        "conv_id", "turn", "role", "text", F.row_number().over(inside).cast("long").alias("place"), fault.alias("fault"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        F.coalesce(F.col("turn") != F.coalesce(F.lag("turn").over(inside), F.col("turn") - 1), F.lit(False)).alias("new_turn"),
    )


def code_of(fault: Column, role: Column) -> Column:
    """One letter that says all the lattice needs of a row: what it may become at which cost.

    x: must go; s, u, a, o (any other initial, or none); capital letters for truncated rows.
    """
    initial = F.substring(role, 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(kind)).otherwise(kind)


def _arcs_of(code: str) -> list[list[tuple[str, int, int, int]]]:
    """By state: (letter, cost, rows further, state) of the arcs at a row, least letter first."""
    at_state = []
    for state in range(4):
        arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, FOLLOWS[NEXT[state]][state])]
        if code != "x":
            more = TRUNCATED if code.isupper() else 0
            kept = FOLLOWS.get(code.lower(), {}).get(state)
            if kept is not None:
                arcs.append(("K", KEEP + more, 1, kept))
            arcs.append(("R", REROLE + more, 1, FOLLOWS[NEXT[state]][state]))
        at_state.append(arcs)
    return at_state


ARCS = {code: _arcs_of(code) for code in "xsuaoSUAO"}
#: Behind the last row turns can only be put.
TAIL = [[("I", INSERT, 0, FOLLOWS[NEXT[state]][state])] for state in range(4)]
#: What a row costs at least, from any state.
LEAST = {code: min(cost for arcs in at_state for _, cost, further, _ in arcs if further) for code, at_state in ARCS.items()}


def _auction(codes: str, prices: list[list[int]], first: int, last: int, origin: int) -> None:
    """Raise the prices of rows `first` to `last` until a shortest path from (first, origin) is tight.

    The path grows from the origin by its best arc, the least letter among equals. If the price
    of its end is below what the best arc asks, the price rises to that and the path shrinks by
    the end. Prices at `last` are fixed: reaching it ends the auction.
    """
    path = [(first, origin)]
    while True:
        row, state = path[-1]
        if row == last:
            return
        best, to = FAR, None
        for _, cost, further, goal in ARCS[codes[row]][state]:
            offer = cost + prices[row + further][goal]
            if offer < best:
                best, to = offer, (row + further, goal)
        if prices[row][state] < best:
            prices[row][state] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def shortest_edits(codes: str) -> tuple[int, str]:
    """The least cost, and of the edits that have it the letters that come first in ASCII.

    Nodes of the lattice are (row, state). Stretches of rows are worked off from the end. Prices of a
    stretch start as the least price behind it and what the rows between cost at least, which no
    arc contradicts; the auction raises them until each of the four states at its start has a tight
    path to its end. Prices at the start are distances by then. So work grows with the rows, not
    with their square. Following the least letter among tight arcs (price = cost + price behind) from the
    start gives the edits: as ties went to the least letter in the auction, no such arc leads
    astray. Behind the last row only puts are left, whose prices are known.
    """
    n = len(codes)
    tail = [0, 2 * INSERT, INSERT, 0]  # at the end: done, put u and a, put a, done
    prices: list[list[int]] = [[] for _ in range(n)] + [tail]
    for last in range(n, 0, -STRETCH):
        first, floor = max(0, last - STRETCH), min(prices[last])
        for row in range(last - 1, first - 1, -1):
            floor += LEAST[codes[row]]
            prices[row] = [floor] * 4
        for origin in range(4):
            _auction(codes, prices, first, last, origin)
    letters, row, state = [], 0, START
    while row < n or state not in (START, ASSISTANT):
        for letter, cost, further, goal in TAIL[state] if row == n else ARCS[codes[row]][state]:
            if prices[row][state] == cost + prices[row + further][goal]:
                letters.append(letter)
                row, state = row + further, goal
                break
        else:
            raise ValueError(f"no tight arc at {row, state} of {codes}")
    return prices[0][START], "".join(letters)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(first column, iterator of the other columns' rows) of consecutive rows with an equal first column.

    A batch is held, never a group.
    """
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
    for name, group in groupby(rows, key=lambda row: row[0]):
        yield name, (row[1:] for row in group)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a thousand rows or about a million characters of their last column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) == 1_000 or size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")


def _mapped(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], kinds: str) -> DataFrame:
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(kinds).fields])
    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(lambda batches: _batches(function(batches), arrow), schema)


def cheapest_edits(rows: DataFrame) -> DataFrame:
    """(conv_id, cost, audit) of every conversation of `faults`; a byte a row is held besides its prices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known: dict[str, tuple[int, str]] = {}  # of short conversations; most have one of few forms
        for name, group in _grouped(batches):
            codes = "".join(code for _, code in group)
            if codes not in known:
                found = shortest_edits(codes)
                if len(known) == 10_000:
                    known.clear()
                if len(codes) <= 32:
                    known[codes] = found
            yield name, *(known[codes] if codes in known else found)

    codes = rows.select("conv_id", "place", code_of(F.col("fault"), F.col("role")).alias("code"))
    return _mapped(_in_order(codes), run, "cost long, audit string")


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, line, edit, role, text) of the repaired conversations, line from 1, in order inside partitions.

    `rows` is the result of `faults`, `edits` that of `cheapest_edits`. Kept turns are as they are, put
    ones have an empty text and no place in the input. Rows pass by one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for name, group in _grouped(batches):
            _, letters, _ = next(group)  # the edits come first
            state, line, at = START, 0, 0
            for _, text, role in group:
                while letters[at] == "I":
                    line, at = line + 1, at + 1
                    yield name, line, "I", NAMES[NEXT[state]], ""
                    state = FOLLOWS[NEXT[state]][state]
                if letters[at] != "D":
                    kept = letters[at] == "K"
                    line += 1
                    yield name, line, letters[at], role if kept else NAMES[NEXT[state]], text
                    state = FOLLOWS[role[0] if kept else NEXT[state]][state]
                at += 1
            for _ in letters[at:]:
                line += 1
                yield name, line, "I", NAMES[NEXT[state]], ""
                state = FOLLOWS[NEXT[state]][state]

    first = edits.select("conv_id", F.lit(0).cast("long").alias("place"), F.col("audit").alias("text"), F.lit("").alias("role"))
    both = first.unionByName(rows.select("conv_id", "place", "text", "role"))
    return _mapped(_in_order(both), run, "line long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the `role:text` lines of `repaired_turns`, taken up as they pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for name, group in _grouped(batches):
            found = hashlib.sha256()
            for line, _, role, text in group:
                found.update(f"{chr(10) if line > 1 else ''}{role}:{text}".encode())
            yield name, found.hexdigest()

    return _mapped(repaired, run, "sha256 string")


def repair_report(turns: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation of `turns` after the damage.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Every
    conv_id of `turns` has one row, null is a conversation like any other; one without rows after the
    damage has zeros, an empty audit and the digest of nothing. Null turns come first and open no
    gap. A role without an initial of s, u, a, an empty one too, fits no place: its row is renamed or
    goes. Rows that repeat are duplicates. Other columns are ignored; an empty table has no rows.
    """
    ids = turns.select("conv_id").distinct()
    rows = stage(faults(damaged(turns)), "turns")
    edits = stage(cheapest_edits(rows), "edits")

    def count(condition: Column, name: str) -> Column:
        return F.sum(condition.cast("long")).alias(name)

    gaps = F.max("turn") - F.min("turn") + 1 - F.sum(F.col("new_turn").cast("long"))
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == name, name) for name in ("blank", "duplicate", "truncated")],
        count(F.col("illegal"), "illegal"),
    )
    found = digests(repaired_turns(rows, edits)).withColumnRenamed("sha256", "repaired_sha256")
    parts = ids.unionByName(counts, True).unionByName(edits, True).unionByName(found, True)
    zeros = {name: F.lit(0) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing = zeros | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return parts.groupBy("conv_id").agg(*[F.coalesce(F.max(name), empty).alias(name) for name, empty in nothing.items()])
