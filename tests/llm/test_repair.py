"""Conversation repair against a search over strings, in one block or many."""

import hashlib
import random
import re
import zlib
from itertools import product

import pyarrow.parquet as pq
import pytest

from scorenet.llm import conversation_repair, turn_repair
from scorenet.llm import queries as q

SF = "/root/testdata/sf0.001"
GOAL = re.compile(r"(s?(ua)+)?")


def order(row):
    conv, turn, role, text = row
    whole = f"{'' if conv is None else conv}:{len(role.encode())}:{role}{text}"
    return (turn is not None, turn or 0, role.encode(), hashlib.sha256(whole.encode()).digest())


def fault(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, turns) over strings: for each initials state the least (cost, audit), held whole."""
    faults = fault(rows)
    # state: last initial, or "" before all; s is told apart as a lone start
    now = {"": (0, "", ())}

    def grow(state, one):
        return {"": {"u", "s"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}[state] & {one}

    def insert(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, a, t) in list(out.items()):
                for role in ("user", "assistant"):
                    if grow(s, role[0]):
                        new = (c + 2, a + "I", (*t, f"{role}:"))
                        if role[0] not in out or new[:2] < out[role[0]][:2]:
                            out[role[0]] = new
        return out

    # Strings can be prefixes of others before the turn that ends them, so runs are kept apart by length.
    for (_, _, role, text), f in zip(rows, faults):
        nxt = {}
        for n in range(4):
            runs = {s: [v] for s, v in now.items()}
            level = dict(now)
            for _ in range(n):
                grown = {}
                for s, (c, a, t) in level.items():
                    for r in ("user", "assistant"):
                        if grow(s, r[0]):
                            new = (c + 2, a + "I", (*t, f"{r}:"))
                            if r[0] not in grown or new[:2] < grown[r[0]][:2]:
                                grown[r[0]] = new
                level = grown
            for s, (c, a, t) in level.items():
                options = [(s, c + 3, "D", t)]
                if f not in ("blank", "duplicate"):
                    more = f == "truncated"
                    if grow(s, role[:1]):
                        options.append((role[:1], c + more, "K", (*t, f"{role}:{text}")))
                    options += [(r[0], c + 2 + more, "R", (*t, f"{r}:{text}")) for r in ("user", "assistant") if grow(s, r[0])]
                for s2, c2, e, t2 in options:
                    new = (c2, a + e, t2)
                    if s2 not in nxt or new[:2] < nxt[s2][:2]:
                        nxt[s2] = new
        now = nxt
    ends = [v for s, v in insert(now).items() if s in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def expected(rows):
    """A conversation's result from its rows in any order."""
    rows = sorted(rows, key=order)
    faults = fault(rows)
    cost, audit, turns = cheapest(rows)
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(case, text)
        out += [(conv, turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    return out


def test_search_agrees_with_enumeration():
    """The search by strings itself, against all edits of up to two turns, with runs of up to three."""
    runs = [""] + ["I" * n for n in range(1, 4)]
    for initials in product("sua", repeat=2):
        rows = [(1, k, {"s": "system", "u": "user", "a": "assistant"}[x], f"text {k}.") for k, x in enumerate(initials)]
        best = None
        for edits in product("KRD", repeat=2):
            for gaps in product(runs, repeat=3):
                parts = [g + e for g, e in zip(gaps, (*edits, ""))]
                cost = 2 * sum(map(len, gaps)) + sum({"K": 0, "R": 2, "D": 3}[e] for e in edits)
                letters = [c for p, x in zip(parts, (*initials, "")) for c in [*["ua"] * (len(p) - (x != "")), *([x] if p[-1:] == "K" else ["ua"] if p[-1:] == "R" else [])]]
                if any(GOAL.fullmatch("".join(way)) for way in product(*letters)):
                    best = min(best or (cost, "".join(parts)), (cost, "".join(parts)))
        assert cheapest(rows)[:2] == best


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_layers_agree_with_strings(block):
    rng = random.Random(5)
    layers = turn_repair.Layers()
    for n in range(400):
        roles = rng.choice((["user"], ["user", "assistant"], ["system", "user", "assistant", "tool", ""], ["assistant", "system"]))
        rows = [(1, k, rng.choice(roles), rng.choice(("One.", f"Number {k}.", "", " ", "open", f"open {k}"))) for k in range(rng.randrange(0, 12 if n else 300))]
        kinds = [(r[2][:1], f) for r, f in zip(rows, fault(rows))]
        pieces = [kinds[i : i + block] for i in range(0, len(kinds), block)]
        cost, states = turn_repair.joined([[layers.through(s, p) for s in range(4)] for p in pieces])
        codes = [c for k, p in enumerate(pieces) for c in layers.codes(states[k], states[k + 1], p)]
        turns, audit = turn_repair.repaired([r[2:] for r in rows], codes)
        assert (cost, audit, tuple(turns)) == cheapest(rows)
        assert GOAL.fullmatch("".join(t[0] for t in turns))
    assert len(layers.steps) < 20_000


def test_op13_whole_table(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    by = {}
    for r in damaged(rows):
        by.setdefault(r[0], []).append(r)
    got = {r.conv_id: tuple(r)[2:] for r in q.op13_conversation_repair(spark, SF).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    gaps = {r.conv_id: r.gaps for r in q.op13_conversation_repair(spark, SF).collect()}
    assert got == {i: expected(by.get(i, [])) for i in {r[0] for r in rows}}
    for i, g in gaps.items():
        turns = [r[1] for r in by.get(i, [])]
        assert g == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)


@pytest.mark.parametrize("block", [2, 4096])
def test_repair_odd_rows(spark, block):
    kinds = "conv_id long, turn long, role string, text string, key string, part int, pos long, kind int, blank boolean"
    long = "word " * 50_000
    rows = [
        (1, None, "user", "First?"), (1, 0, None, None), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 2, "assistant", "Yes."),
        (2, None, "system", "S."), (None, 1, "user", "A."), (None, None, "tool", "B."), (3, 5, "", ""), (4, 0, "user", long), (4, 1, "assistant", long + "."),
        *((5, k, "user", "Same.") for k in range(9)), *((6, k, "user" if k % 3 else "assistant", f"No {k}!") for k in range(20)), *[(7, 3, "user", "One.")] * 12,
    ]
    frame = spark.createDataFrame([(*r, "k", 1, 2, 3, False) for r in rows], kinds)
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((c, t, " " if role is None else role, " " if text is None else text))
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(frame, block).collect()}
    assert got == {c: expected(v) for c, v in by.items()}
    assert conversation_repair.repair(frame.limit(0)).count() == 0
    hurt = {}
    for r in damaged(rows):
        hurt.setdefault(r[0], []).append(r)
    back = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(conversation_repair.damaged(conversation_repair.turns_of(frame)), block).collect()}
    assert back == {c: expected(v) for c, v in hurt.items()}
