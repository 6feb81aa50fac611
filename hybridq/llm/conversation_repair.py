"""Conversation structure repair by dynamic programming over runs of equal symbols.

A row is one of nine symbols: the initial of its role (s, u, a or other) with a clean or a truncated
end, or a row that has to go (blank or duplicate).  A symbol's edits (keep, rerole, delete, inserts
before it) are a min-plus matrix over four states: nothing yet, after s, after u, after a.

1. Rows without their texts (two hashes and flags) are counted by content; the earliest row of a text
   in its conversation is no duplicate.  Keys are unique here, so a hot conversation or text spreads.
2. These rows are range-partitioned by conversation and order, which also cuts a long
   conversation.  Each task collapses equal neighbours to runs and multiplies the runs' matrices,
   advancing a run through cached binary powers.  A segment of at most SEGMENT rows leaves as runs and
   one matrix.
3. Segments stream backwards through each conversation: one vector of costs to go is held.
4. Texts stream forwards beside their segments.  A segment's runs are unrolled into the edits of
   the cheapest, then ASCII-least audit, and each row gets its edit as it passes.

Step 4 sees a conversation as a stream in one task, because a digest of all its text asks for that; held are a
segment's edits, an Arrow batch and the audit.  Texts are shuffled once, everything else is some
ten bytes a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SEGMENT = 65_536
#: Rows of a run that are unrolled with their costs held at once.
STRETCH = 1024
WHITE = " \t\n\x0b\x0c\r"
#: Fixed values of the contract.
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
FAR = 1 << 60
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: State after a user or an assistant turn; None where the role can't stand there.
AS_USER = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}
AS_ASSISTANT = {AFTER_U: AFTER_A}
AS_SYSTEM = {START: AFTER_S}
KEEPS = {"u": AS_USER, "a": AS_ASSISTANT, "s": AS_SYSTEM, "x": {}}
#: A state has exactly one role that may come next by rerole or insert.
NEXT = AS_USER | AS_ASSISTANT
NAME = {AFTER_U: "user", AFTER_A: "assistant"}

#: Symbols: clean and truncated rows by role, and rows to delete; the fault tells blank from duplicate.
SYMBOLS = [("s", ""), ("u", ""), ("a", ""), ("x", ""), ("s", "t"), ("u", "t"), ("a", "t"), ("x", "t"), ("", "b"), ("", "d")]


# ---------------------------------------------------------------------------
# Min-plus algebra over the four states
# ---------------------------------------------------------------------------
def times(a, b):
    return tuple(tuple(min(min(x + y for x, y in zip(row, col)), FAR) for col in zip(*b)) for row in a)


def apply(a, v):
    return tuple(min(min(x + y for x, y in zip(row, v)), FAR) for row in a)


def _inserts():
    """Costs of any number of inserts between two states."""
    step = [[FAR] * 4 for _ in range(4)]
    for i in range(4):
        step[i][i] = 0
        step[i][NEXT[i]] = COSTS["I"]
    return times(times(step, step), step)


def _options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of one row, without inserts, in ASCII order."""
    role, fault = SYMBOLS[symbol]
    out = [("D", COSTS["D"], state)]
    if fault in ("b", "d"):
        return out
    extra = TRUNCATED if fault else 0
    if state in KEEPS[role]:
        out.append(("K", COSTS["K"] + extra, KEEPS[role][state]))
    out.append(("R", COSTS["R"] + extra, NEXT[state]))
    return out


INSERTS = _inserts()
ENDED = apply(INSERTS, (0, FAR, FAR, 0))


@lru_cache(maxsize=None)
def power(symbol: int, k: int):
    """The matrix of 2^k rows with this symbol, inserts before each row included."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    row = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in _options(symbol, state):
            row[state][to] = min(row[state][to], cost)
    return times(INSERTS, row)


def back(symbol: int, count: int, v):
    """Costs to go before `count` equal rows, from those after them."""
    for k in range(count.bit_length()):
        if count >> k & 1:
            v = apply(power(symbol, k), v)
    return v


@lru_cache(maxsize=1 << 16)
def matrix(runs: tuple):
    """The matrix of several runs, one after the other."""
    out = None
    for symbol, count in reversed(runs):
        for k in range(count.bit_length()):
            if count >> k & 1:
                out = power(symbol, k) if out is None else times(power(symbol, k), out)
    return out


def unroll(runs, state: int, v_end) -> tuple[str, int]:
    """(edits of all rows with the inserts before them, state after) on the least cheapest path."""
    ahead = [v_end]
    for symbol, count in reversed(runs):
        ahead.append(back(symbol, count, ahead[-1]))
    out: list[str] = []
    for i, (symbol, count) in enumerate(runs):
        state = _stretch(symbol, count, state, ahead[len(runs) - 1 - i], out)
    return "".join(out), state


def _stretch(symbol: int, count: int, state: int, v_end, out: list[str]) -> int:
    while count > STRETCH:
        part = 1 << (count.bit_length() - 1)
        part = part // 2 if part == count else part
        state = _stretch(symbol, part, state, back(symbol, count - part, v_end), out)
        count -= part
    ahead = [v_end]
    for _ in range(count):
        ahead.append(apply(power(symbol, 0), ahead[-1]))
    for left in range(count, 0, -1):
        to_go, after = ahead[left][state], ahead[left - 1]
        while True:
            options = _options(symbol, state)
            edit, cost, to = options[0]
            if cost + after[to] == to_go:  # D is the least letter
                break
            inserted = COSTS["I"] + ahead[left][NEXT[state]]
            if inserted == to_go:
                out.append("I")
                state, to_go = NEXT[state], to_go - COSTS["I"]
                continue
            edit, cost, to = next(o for o in options[1:] if o[1] + after[o[2]] == to_go)
            break
        out.append(edit)
        state = to
    return state


def closing(state: int) -> int:
    """How many inserts end a conversation."""
    return ENDED[state] // COSTS["I"]


# ---------------------------------------------------------------------------
# Rows
# ---------------------------------------------------------------------------
def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by a hash of `conv_id:turn` (nulls: one space).

    Of twenty remainders 0 drops the row (no copies), 1 empties its text, 2 removes `.!?`, 3 repeats it, 4 makes
    it the user's.  Other columns are ignored."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, F.lit("user")).otherwise(said("role")).alias("role"),
        text.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def _rows(conversations: DataFrame) -> DataFrame:
    said = lambda name: F.coalesce(F.col(name), F.lit(" "))
    role, text = said("role"), said("text")
    copies = F.col("copies") if "copies" in conversations.columns else F.lit(1)
    key = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select(
        "conv_id", F.col("turn").isNotNull().alias("known"), "turn",
        F.unhex(F.sha2(key.cast("binary"), 256)).alias("digest"), role.alias("role"), text.alias("text"),
        copies.cast("long").alias("copies"),
    )


def _symbol() -> Column:
    """Position in SYMBOLS of a row with `blank`, `truncated`, `opening` and `who`."""
    role = F.when(F.col("who") == "s", 0).when(F.col("who") == "u", 1).when(F.col("who") == "a", 2).otherwise(3)
    return F.when(F.col("blank"), 8).when(F.col("opening").isNull(), 9).otherwise(role + F.when(F.col("truncated"), 4).otherwise(0))


ORDER = ["known", "turn", "digest"]
PLAN = "conv_id long, known boolean, turn long, digest binary, symbols binary, counts array<long>"


def _plans(rows: DataFrame, segment: int) -> DataFrame:
    """(conv_id, order of the first row, runs, costs to go after them) of each segment."""
    core = F.rtrim("text", F.lit(WHITE))
    flat = rows.where(F.col("copies") > 0).select(
        "conv_id", *ORDER, "copies", F.substring("role", 1, 1).alias("who"), (core == "").alias("blank"),
        (~F.substring(core, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    flat = flat.groupBy("conv_id", *ORDER).agg(
        F.sum("copies").alias("n"), *[F.first(c).alias(c) for c in ("who", "blank", "truncated")]
    )
    first = flat.groupBy("conv_id", "digest").agg(F.min(F.struct("known", "turn")).alias("f"))
    first = first.select(F.col("conv_id").alias("_c"), F.col("f.turn").alias("_t"), F.col("digest").alias("_d"), F.lit(True).alias("opening"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("digest") == F.col("_d"))
    marked = flat.join(first, same, "left").select("conv_id", *ORDER, "n", _symbol().cast("byte").alias("symbol"))
    placed = marked.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    segments = placed.mapInArrow(_segments(segment), f"{PLAN}, matrix array<long>")
    backwards = segments.repartition("conv_id").sortWithinPartitions("conv_id", *[F.desc(c) for c in ORDER])
    return backwards.mapInArrow(_backwards, f"{PLAN}, ahead array<long>")


def _segments(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *ORDER, "symbols", "counts", "matrix"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        head, runs, size, made = None, [], 0, []

        def close():
            flat = [x for row in matrix(tuple(runs)) for x in row]
            made.append((*head, bytes(s for s, _ in runs), [n for _, n in runs], flat))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)
            made.clear()
            return out

        for batch in batches:
            conv, known, turn, digest, n, symbol = (batch.column(c).to_pylist() for c in ("conv_id", *ORDER, "n", "symbol"))
            for i in range(batch.num_rows):
                if head is None or conv[i] != head[0] or size >= most:
                    if head is not None:
                        close()
                    head, runs, size = (conv[i], known[i], turn[i], digest[i]), [], 0
                size += 1
                opening = SYMBOLS[symbol[i]][1] not in ("b", "d")
                # of equal rows, all but the first are duplicates (blank ones stay blank)
                for s, count in ((symbol[i], 1), (9, n[i] - 1)) if opening else ((symbol[i], n[i]),):
                    if count and runs and runs[-1][0] == s:
                        runs[-1] = (s, runs[-1][1] + count)
                    elif count:
                        runs.append((s, count))
            if len(made) > 4096:
                yield flush()
        if head is not None:
            close()
        if made:
            yield flush()

    return run


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ahead, last = ENDED, (False, None)
    for batch in batches:
        out = []
        for conv, flat in zip(batch.column("conv_id").to_pylist(), batch.column("matrix").to_pylist()):
            if last != (True, conv):
                ahead, last = ENDED, (True, conv)
            out.append(list(ahead))
            ahead = apply([flat[4 * i : 4 * i + 4] for i in range(4)], ahead)
        kept = [batch.column(c) for c in ("conv_id", *ORDER, "symbols", "counts")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.int64()))], ["conv_id", *ORDER, "symbols", "counts", "ahead"])


def _beside(conversations: DataFrame, segment: int) -> DataFrame:
    """Texts and plans, conversation by conversation, a plan before the rows it is for."""
    rows = _rows(conversations)
    plans = _plans(rows, segment).withColumn("side", F.lit(0))
    both = plans.unionByName(rows.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER, "side")


def _walk(batches: Iterator[pa.RecordBatch]):
    """("row", conv_id, turn, edit, role, text, fault) for every edit, ("end", conv_id) after each conversation.

    Inserted rows have a null turn; faults are the letters of SYMBOLS."""
    conv, open_, state, edits, faults, at = None, False, START, "", iter(()), 0

    def insert():
        nonlocal walked
        walked = NEXT[walked]
        return ("row", conv, None, "I", NAME[walked], "", "")

    def finish():
        nonlocal walked
        for _ in range(closing(state)):
            yield insert()
        yield ("end", conv)

    walked = START  # state after the edits given out so far
    for batch in batches:
        names = ["conv_id", "side", "turn", "role", "text", "copies", "symbols", "counts", "ahead"]
        for c, side, turn, role, text, copies, symbols, counts, ahead in zip(*(batch.column(n).to_pylist() for n in names)):
            if not open_ or c != conv:
                if open_:
                    yield from finish()
                conv, open_, state, walked, edits, at = c, True, START, START, "", 0
            if side == 0:
                runs = list(zip(symbols, counts))
                edits, state = unroll(runs, state, ahead)
                faults, at = (SYMBOLS[s][1] for s, count in runs for _ in range(count)), 0
                continue
            for _ in range(copies):
                while edits[at] == "I":
                    at += 1
                    yield insert()
                edit, fault, at = edits[at], next(faults), at + 1
                if edit == "R":
                    walked = NEXT[walked]
                elif edit == "K":
                    walked = KEEPS[role[:1]][walked]
                yield ("row", conv, turn, edit, NAME[walked] if edit == "R" else role, text, fault, role)
    if open_:
        yield from finish()


REPAIRED = "conv_id long, position long, turn long, edit string, role string, text string"
SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["conv_id", "position", "turn", "edit", "role", "text"]
    rows, held, position = [], 0, 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for event in _walk(batches):
        if event[0] == "end":
            position = 0
            continue
        _, conv, turn, edit, role, text = event[:6]
        rows.append((conv, position, turn, edit, role, text))
        position, held = position + 1, held + len(text)
        if len(rows) >= 8192 or held > 4 << 20:
            yield flush()
            rows, held = [], 0
    if rows:
        yield flush()


class _Summary:
    """What a conversation's report needs, updated row by row."""

    LEGAL = {"su", "ua", "au"}

    def __init__(self):
        self.turns, self.low, self.high = 0, None, None
        self.faults = {"b": 0, "d": 0, "t": 0}
        self.illegal, self.before, self.cost = 0, None, 0
        self.audit, self.sha, self.first = [], hashlib.sha256(), True

    def row(self, turn, edit, role, text, fault, original=None):
        self.audit.append(edit)
        self.cost += COSTS[edit]
        if edit != "I":
            if turn is not None and turn != self.high:  # turns come in order
                self.turns, self.high = self.turns + 1, turn
                self.low = turn if self.low is None else self.low
            if fault:
                self.faults[fault] += 1
            if fault == "t" and edit != "D":
                self.cost += TRUNCATED
            initial = original[:1]
            self.illegal += self.before is not None and self.before + initial not in self.LEGAL
            self.before = initial
        if edit != "D":
            self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False

    def result(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        f = self.faults
        return (gaps, f["b"], f["d"], f["t"], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in SUMMARY.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    out, own, held = [], _Summary(), 0
    for event in _walk(batches):
        if event[0] == "end":
            out.append((event[1], *own.result()))
            held, own = held + len(out[-1][7]), _Summary()
            if len(out) >= 4096 or held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out, held = [], 0
        else:
            own.row(*event[2:])
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, position, turn, edit, role, text: every row with its edit and every inserted row, in order.

    `conversations` has conv_id, turn, role, text and optionally copies (how often a row counts; 0 only
    names its conversation).  Edits are K, R (role is the new one), D and I (null turn, empty text); what is not D is the
    repaired conversation.  Of the cheapest repairs the one with the ASCII-least edits is taken.  Rows are
    ordered by turn, nulls first; rows with one turn by SHA-256 of the role's length in characters, a
    colon, role and text, so that equal rows are neighbours.  Null role and text count as one space;
    a null conv_id is a conversation; roles that start otherwise than s, u and a can't be kept.  Other columns are
    ignored; an empty table gives no rows.  `segment` bounds the rows that are planned at once."""
    return _beside(conversations, segment).mapInArrow(_repaired, REPAIRED)


def repair_report(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation: its gaps in turns, faults, cost, audit and the digest of the repaired text.

    A conversation without rows has zeros, an empty audit and the digest of an empty string."""
    return _beside(conversations, segment).mapInArrow(_summaries, SUMMARY)
