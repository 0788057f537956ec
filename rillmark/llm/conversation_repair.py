"""Conversation structure repair: cheapest edits to a well-formed dialogue, by Hirschberg's divide and conquer.

A conversation is well formed if its roles' initials read (s?(ua)+)?. States: START (nothing yet), after SYSTEM, after
USER, after ASSISTANT; START and after ASSISTANT may end. Edits of a row: Keep, Rerole (to user or assistant), Delete;
Insert stands before a row or at the end. An audit, the edits' initials in order, settles all roles, as the state and
the edit give the next state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, staged

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a new user or assistant turn, by the state before it.
TURN = (USER, USER, ASSISTANT, USER)
#: The state behind a kept row by its initial and the state before it; None where it can't stand.
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
ENDS = (START, ASSISTANT)
NEVER = 1 << 60
INITIALS = "sua"
#: A row's code: its initial's place in INITIALS (3 for any other), plus 4 if truncated; GONE if it must be deleted.
OTHER, TRUNCATED, GONE = 3, 4, 8

Vector = tuple[int, int, int, int]


def _options(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row, without those before it; letters ascend."""
    out = [("D", DELETE, state)]
    if code != GONE:
        late = CUT if code & TRUNCATED else 0
        kept = KEPT[INITIALS[code & 3]][state] if code & 3 != OTHER else None
        if kept is not None:
            out.append(("K", KEEP + late, kept))
        out.append(("R", REROLE + late, TURN[state]))
    return out


#: By code and state, made once.
OPTIONS = {code: [_options(code, s) for s in range(4)] for code in range(9)}


def _inserted(cost: Vector) -> Vector:
    """Costs to go where turns may be inserted first."""
    c = list(cost)
    for _ in range(2):  # a third insertion never helps: two lead from any state to ASSISTANT
        for s in range(4):
            c[s] = min(c[s], INSERT + c[TURN[s]])
    return tuple(c)


def backward(codes: bytes, lo: int, hi: int, after: Vector) -> Vector:
    """Costs to go from each state before row lo, given those behind row hi - 1."""
    for i in range(hi - 1, lo - 1, -1):
        after = _inserted(tuple(min(c + after[t] for _, c, t in OPTIONS[codes[i]][s]) for s in range(4)))
    return after


def forward(codes: bytes, lo: int, hi: int, state: int) -> Vector:
    """Costs from state before row lo to each state behind row hi - 1."""
    cost = [NEVER] * 4
    cost[state] = 0
    for i in range(lo, hi):
        for _ in range(2):
            for s in range(4):
                cost[TURN[s]] = min(cost[TURN[s]], cost[s] + INSERT)
        new = [NEVER] * 4
        for s in range(4):
            for _, c, t in OPTIONS[codes[i]][s]:
                new[t] = min(new[t], cost[s] + c)
        cost = new
    return tuple(cost)


def _solve(codes: bytes, lo: int, hi: int, state: int, after: Vector, out: list[str]) -> int:
    """Writes the audit-least cheapest edits of rows lo to hi - 1 to out; gives the state behind them.

    after: the cost to go from each state behind row hi - 1. Longer pieces are cut in the middle, where the forward
    vector of the left half and the backward vector of the right half meet: their least sum marks the optimal crossings.
    With one, it alone is left open to the left half; among several, the left half itself finds the audit-least, as it
    takes the least letter wherever the costs to go allow it. Beside codes and out, memory holds one vector a level.
    """
    if hi - lo > 1:
        mid = (lo + hi) // 2
        back = backward(codes, mid, hi, after)
        front = forward(codes, lo, mid, state)
        best = min(f + b for f, b in zip(front, back))
        crossing = tuple(b if f + b == best else NEVER for f, b in zip(front, back))
        state = _solve(codes, lo, mid, state, crossing, out)
        return _solve(codes, mid, hi, state, after, out)
    if hi == lo:
        return state
    row = OPTIONS[codes[lo]]
    there = tuple(min(c + after[t] for _, c, t in row[s]) for s in range(4))
    full = _inserted(there)
    while True:
        for letter, cost, to in (*row[state][:1], ("I", INSERT, TURN[state]), *row[state][1:]):  # D, I, K, R
            if cost + (full[to] if letter == "I" else after[to]) == full[state]:
                break
        out.append(letter)
        state = to
        if letter != "I":
            return state


def repair_audit(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation's rows by their codes."""
    end = _inserted(tuple(0 if s in ENDS else NEVER for s in range(4)))
    out: list[str] = []
    cost = backward(codes, 0, len(codes), end)[START]
    state = _solve(codes, 0, len(codes), START, end, out)
    while state not in ENDS:
        out.append("I")
        state = TURN[state]
    return cost, "".join(out)


_short_audit = lru_cache(1 << 16)(repair_audit)


def _filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The four columns and copies: rows after damage by crc32 of `conv:turn` modulo 20, nulls being one blank.

    0 drops a row (no copies), 1 empties its text, 2 removes its end marks, 3 doubles it, 4 makes it the user's.
    """
    fate = F.crc32(F.concat(_filled(F.col(conv_col)), F.lit(":"), _filled(F.col(turn_col))).cast("binary")) % 20
    text = _filled(F.col(text_col))
    return conversations.select(
        F.col(conv_col),
        F.col(turn_col),
        F.when(fate == 4, "user").otherwise(_filled(F.col(role_col))).alias(role_col),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias(text_col),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def _streams(df: DataFrame, handle: Callable[[], tuple[Callable, Callable]], schema: str, names: list[str]) -> DataFrame:
    """A conversation after another of df (conv, ..., dealt and sorted): rows go to a new handler's take, its end gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, own, take, end, done = False, None, None, None, []
        kind = [None] * len(names)
        for batch in batches:
            kind[0] = batch.column(0).type
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or conv != own:
                    if begun:
                        done.append((own, *end()))
                    (take, end), own, begun = handle(), conv, True
                take(*rest)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kind)], names=names)
                done = []
        if begun:
            done.append((own, *end()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kind)], names=names)

    return df.mapInArrow(run, schema)


def _account() -> tuple[Callable, Callable]:
    """Counts a conversation's faults and finds its audit; one byte a row is kept."""
    codes, seen = bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    last = None

    def take(turn, role, digest, n, n_duplicates, is_blank, is_cut) -> None:
        nonlocal last
        initial = role[:1]
        code = INITIALS.find(initial) if initial and initial in INITIALS else OTHER
        for k in range(n):
            if last is not None:
                seen["illegal"] += last + initial not in ("su", "ua", "au")
            last = initial
            if is_blank or k >= n - n_duplicates:
                seen["blank" if is_blank else "duplicate"] += 1
                codes.append(GONE)
            else:
                seen["truncated"] += is_cut
                codes.append(code + (TRUNCATED if is_cut else 0))

    def end() -> tuple:
        cost, found = _short_audit(bytes(codes)) if len(codes) <= 64 else repair_audit(bytes(codes))
        return seen["blank"], seen["duplicate"], seen["truncated"], seen["illegal"], cost, found

    return take, end


def _digest() -> tuple[Callable, Callable]:
    """Hashes a conversation's repaired rows as they come; the audit comes first and is all that is kept."""
    sha, at, edits, state, first = hashlib.sha256(), 0, "", START, True

    def write(role: str, text: str) -> None:
        nonlocal first
        sha.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False

    def turn() -> str:
        nonlocal state
        state = TURN[state]
        return "user" if state == USER else "assistant"

    def inserts() -> None:
        nonlocal at
        while at < len(edits) and edits[at] == "I":
            write(turn(), "")
            at += 1

    def take(is_row, _turn, role, _digest, text, copies, audit) -> None:
        nonlocal at, edits, state
        if not is_row:
            edits = audit
            return
        for _ in range(copies):
            inserts()
            edit, at = edits[at], at + 1
            if edit == "K":
                state = KEPT[role[:1]][state]
                write(role, text)
            elif edit == "R":
                write(turn(), text)

    def end() -> tuple:
        inserts()
        return (sha.hexdigest(),)

    return take, end


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation.

    copies_col, if given, says how many rows stand for one; a conversation of none but rows with 0 is empty. A null role
    or text is one blank. Other columns are ignored, whatever their names; no rows give none.

    A conversation's rows are ordered by turn, nulls first, then role, then MD5 of the text; copies stand side by side.
    Each row's first fault counts: blank (no character but white space), duplicate (role and text seen earlier in the
    conversation), truncated (its last such character is no end mark). gaps are the turns missing between the least and
    the largest. illegal counts adjacent rows whose initials are not su, ua or au; a role without an initial makes its
    pairs illegal, and can't be kept. The audit is the cheapest one (module), ASCII-least among equals.

    Equal rows of a turn are one row with a count before anything is shuffled by conversation, and what is earlier is
    told by least turns of a text's digest, so neither copies nor a much repeated text meet in one task. The accounts
    read one byte a row; texts are shuffled once, sorted, and hashed as a stream behind their audit: as an audit and a
    hash are one value of a conversation, one task must go through its rows, but holds only the audit. A conversation
    all of whose rows were dropped has zeros, an empty audit and the hash of nothing; null ids are one conversation.
    """
    copies = F.col(copies_col) if copies_col else F.lit(1)
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), _filled(F.col(role_col)).alias("role"), _filled(F.col(text_col)).alias("text"), copies.alias("copies"))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = rows.select("conv", "turn", "role", "digest", "copies", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    each = light.groupBy("conv", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").cast("int").alias("n"))
    live = each.filter("n > 0")
    at = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    text_keys = ["conv", "role", "digest"]
    again = live.groupBy(*(F.col(k).alias(f"_{k}") for k in text_keys)).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    told = each.join(again, same, "left").withColumn("n_duplicates", F.when(F.col("first") < at, F.col("n")).otherwise(F.greatest(F.col("n") - 1, F.lit(0))))
    told = told.select("conv", "turn", "role", "digest", "n", "n_duplicates", "blank", "cut")
    order = ["conv", F.asc_nulls_first("turn"), "role", "digest"]
    kind = conversations.schema[conv_col].dataType.simpleString()
    faults = ["blank", "duplicate", "truncated", "illegal", "cost"]
    accounts = staged(_streams(told.repartition("conv").sortWithinPartitions(*order), _account, f"conv {kind}, {', '.join(f'{c} bigint' for c in faults)}, audit string", ["conv", *faults, "audit"]), "accounts")
    turn = F.when(F.col("n") > 0, F.col("turn"))
    span = each.groupBy("conv").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn), F.lit(0)).cast("long").alias("gaps"))
    none = lambda t: F.lit(None).cast(t)
    texts = rows.filter("copies > 0").select("conv", F.lit(True).alias("is_row"), "turn", "role", "digest", "text", "copies", none("string").alias("audit"))
    heads = accounts.select("conv", F.lit(False).alias("is_row"), none(conversations.schema[turn_col].dataType).alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), none("int").alias("copies"), "audit")
    dealt = texts.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "is_row", F.asc_nulls_first("turn"), "role", "digest")
    hashes = _streams(dealt, _digest, f"conv {kind}, repaired_sha256 string", ["conv", "repaired_sha256"])
    out = accounts.join(span.withColumnRenamed("conv", "_c"), F.col("conv").eqNullSafe(F.col("_c"))).join(hashes.withColumnRenamed("conv", "_h"), F.col("conv").eqNullSafe(F.col("_h")))
    return out.select(F.col("conv").alias(conv_col), "gaps", *faults, "audit", "repaired_sha256")
