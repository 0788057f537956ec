"""Conversation repair against trying all edits, and against a plain loop over rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from rillmark.llm import conversation_repair as C

FORM = re.compile(r"(s?(ua)+)?\Z")
WHITE = " \t\n\x0b\f\r"


def by_trying(codes):
    """(cost, audit) by all edit sequences with up to two insertions at a place, checked by the pattern itself."""
    best = None

    def go(i, cost, audit, said):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(codes):
            for n in range(3):
                for tail in {"": [""], "I": ["u", "a"], "II": ["ua", "au"]}["I" * n]:
                    if FORM.match(said + tail):
                        found = (cost + 5 * n, audit + "I" * n)
                        best = min(best or found, found)
            return
        for n, tail in ((0, ""), (1, "u"), (1, "a"), (2, "ua"), (2, "au")):
            at, a, s = cost + 5 * n, audit + "I" * n, said + tail
            go(i + 1, at + 2, a + "D", s)
            if codes[i] != C.GONE:
                late = 5 if codes[i] & 4 else 0
                go(i + 1, at + late, a + "K", s + "sua?"[codes[i] & 3])
                go(i + 1, at + 1 + late, a + "R", s + "u")
                go(i + 1, at + 1 + late, a + "R", s + "a")

    go(0, 0, "", "")
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_audits_equal_trying_all_edits(n):
    r = random.Random(n)
    for _ in range(1 if n == 0 else 9 if n == 1 else 60):
        codes = bytes(r.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(n))
        assert C.repair_audit(codes) == by_trying(codes), codes


def table_audit(codes):
    """(cost, audit) from a whole table of costs to go."""

    @lru_cache(None)
    def go(i, state):
        """(cost, audit) from row i in state; the audit-least of the cheapest."""
        if i == len(codes):
            ends = [(0, "")] if state in (0, 3) else []
        else:
            ends = []
            for letter, cost, to in C.OPTIONS[codes[i]][state]:
                c, a = go(i + 1, to)
                ends.append((c + cost, letter + a))
        return min(ends) if ends else (10**9, "~")

    out = {}
    for i in range(len(codes), -1, -1):
        plain = [go(i, s) for s in range(4)]
        for s in range(4):
            ways = [plain[s]]
            to, n = s, 0
            for n in (1, 2):
                to = C.TURN[to]
                ways.append((plain[to][0] + 5 * n, "I" * n + plain[to][1]))
            out[i, s] = min(ways)
        go.cache_clear()
        there = [out[i, s] for s in range(4)]

        def go(j, s, there=there, i=i):  # noqa: F811 - the rows behind are settled
            if j == i:
                return there[s]
            if j == len(codes):
                return (0, "") if s in (0, 3) else (10**9, "~")
            ends = [(there[to][0] + cost, letter + there[to][1]) for letter, cost, to in C.OPTIONS[codes[j]][s]]
            return min(ends)

        go = lru_cache(None)(go)
    return out[0, 0]


@pytest.mark.parametrize("n", [5, 17, 64, 300])
def test_divided_audits_equal_the_whole_table(n):
    r = random.Random(n)
    for k in range(30 if n < 100 else 5):
        codes = bytes(r.choices(range(9), [1, 6, 6, 1, 1, 1, 1, 1, 2] if k % 2 else [1] * 9, k=n))
        assert C.repair_audit(codes) == table_audit(codes)


def test_vectors_meet_in_the_middle():
    codes = bytes(random.Random(1).choices(range(9), k=40))
    end = C._inserted(tuple(0 if s in C.ENDS else C.NEVER for s in range(4)))
    best = C.backward(codes, 0, 40, end)[C.START]
    for mid in range(41):
        assert min(f + b for f, b in zip(C.forward(codes, 0, mid, C.START), C.backward(codes, mid, 40, end))) == best


def plain_repair(rows):
    """The whole report by a loop over rows (conv, turn, role, text) of one conversation."""
    blank_or = lambda x: " " if x is None else str(x)
    after = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{blank_or(conv)}:{blank_or(turn)}".encode()) % 20
        role, text = blank_or(role), blank_or(text)
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        after += [(turn, role, text)] * (2 if fate == 3 else 1)
    after.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).digest()))
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen, codes = [0, 0, 0], set(), []
    for _, role, text in after:
        bare = text.rstrip(WHITE)
        initial = "sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3
        if not bare:
            faults[0] += 1
            codes.append(8)
        elif (role, text) in seen:
            faults[1] += 1
            codes.append(8)
        else:
            faults[2] += bare[-1] not in ".!?"
            codes.append(initial + (4 if bare[-1] not in ".!?" else 0))
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
    cost, audit = table_audit(bytes(codes)) if codes else (0, "")
    lines, last, at = [], "", 0
    for letter in audit:
        if letter == "I":
            last = "a" if last == "u" else "u"
            lines.append({"u": "user:", "a": "assistant:"}[last])
            continue
        _, role, text = after[at]
        at += 1
        if letter == "K":
            last = role[0]
            lines.append(f"{role}:{text}")
        elif letter == "R":
            last = "a" if last == "u" else "u"
            lines.append(f"{ {'u': 'user', 'a': 'assistant'}[last]}:{text}")
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def odd_conversations():
    r = random.Random(4)
    out = [
        (1, None, "user", "No turn."), (1, None, None, None), (1, 0, "system", "Be kind."), (1, 0, "system", "Be kind."), (1, 5, "", "no role."),
        (2, 0, None, None), (2, 1, "assistant", " \t\n"), (None, 0, "user", "Who?"), (None, 1, "assistant", "No id!"), (None, None, "user", ""),
        (3, -4, "User", "capital."), (3, 9, "tool", "x" * 100_000), (4, None, "user", None),
    ]
    for conv in range(5, 60):
        for turn in range(r.randrange(1, 12)):
            if r.random() < 0.9:
                out.append((conv, turn, r.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), r.choice(["Yes.", "No!", "why", "", None, f"Own {conv} {turn}.", "Üñï 日本?"])))
    return out + [(60, t, "user" if t % 2 else "assistant", "Again and again." if t % 3 else f"Turn {t}.") for t in range(600)]


def test_repair_equals_a_plain_loop(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*x, "n", "d") for x in rows], "conv_id long, turn long, role string, text string, conv string, digest string")
    got = {x.conv_id: x for x in C.repair(C.damaged(df), copies_col="copies").collect()}
    assert set(got) == {x[0] for x in rows}
    for conv, x in got.items():
        want = plain_repair([y for y in rows if y[0] == conv])
        assert tuple(x)[1:] == want, conv
    assert any(x.gaps for x in got.values()) and any(x.duplicate for x in got.values()) and {c for x in got.values() for c in x.audit} >= set("DKR")  # an insertion costs more than what it saves


def test_a_conversation_of_which_nothing_is_left(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    (x,) = C.repair(C.damaged(df), copies_col="copies").collect()
    assert tuple(x) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.repair(C.damaged(df.limit(0)), copies_col="copies").collect() == []


def test_rows_without_damage(spark):
    df = spark.createDataFrame([("c", 0, "user", "Hi."), ("c", 1, "assistant", "Hello."), ("c", 2, "user", "And?")], "conv_id string, turn int, role string, text string")
    (x,) = C.repair(df).collect()
    assert (x.cost, x.audit) == (2, "KKD") and x.repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Hello.").hexdigest()
