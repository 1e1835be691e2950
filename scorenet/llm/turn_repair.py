"""Cheapest repair of a sequence of turns, by layers of ranks instead of strings.

A turn is kept, given another role or deleted, after a run of at most two inserted turns (more are never
cheapest: two neighbours among them could go). Run and edit together are one code, a string of I ended by
K, R or D; no code begins another, so strings of as many codes compare as their first differing codes do,
and a layer needs no strings: a state's string is known by its rank among those of the layer, by where it
came from and by its last code. Layers that differ only by a constant cost are one, so few layers exist and
their successors are remembered.

States: nothing yet (0), a system turn alone (1), a user turn last (2), an assistant turn last (3).
"""

from __future__ import annotations

CODES = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
RUN, KEEP, REROLE, DELETE = 2, 0, 2, 3
INSERT, OPEN = 2, 1
#: Initials that a kept turn may have in a state, the state that follows it, and the role that fits.
FOLLOWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FITS = ("user", "user", "assistant", "user")
ADDED = (2, 2, 3, 2)
#: What a legal end takes from each state.
TAILS = ("", "II", "I", "")

Layer = tuple  # of (cost, rank) or None for each state


def after(state: int, code: str, initial: str) -> int | None:
    """The state after a code on a turn; None if the turn may not be kept there."""
    for _ in code[:-1]:
        state = ADDED[state]
    if code[-1] == "D":
        return state
    return FOLLOWS.get((state, initial)) if code[-1] == "K" else ADDED[state]


class Layers:
    """Remembered steps from layer to layer, for kinds of turns (initial, fault)."""

    def __init__(self):
        self.steps: dict[tuple, tuple] = {}
        self.starts = [tuple((0, 0) if t == s else None for t in range(4)) for s in range(4)]

    def step(self, layer: Layer, kind: tuple[str, str]) -> tuple[Layer, int, tuple]:
        """(next layer less its least cost, that cost, (state before, code) of each state)."""
        found = self.steps.get((layer, kind))
        if found is None:
            found = self.steps[layer, kind] = self._step(layer, *kind)
        return found

    @staticmethod
    def _step(layer: Layer, initial: str, fault: str) -> tuple[Layer, int, tuple]:
        best: list[tuple | None] = [None] * 4
        for s, had in enumerate(layer):
            if had is None:
                continue
            for k, code in enumerate(CODES):
                if code[-1] != "D" and fault in ("blank", "duplicate"):
                    continue
                t = after(s, code, initial)
                if t is None:
                    continue
                cost = {"D": DELETE, "K": KEEP, "R": REROLE}[code[-1]] + INSERT * (len(code) - 1) + OPEN * (code[-1] != "D" and fault == "truncated")
                now = (had[0] + cost, had[1], k, s)
                if best[t] is None or now < best[t]:
                    best[t] = now
        least = min(b[0] for b in best if b)
        keys = sorted({b[1:3] for b in best if b})
        layer = tuple(b and (b[0] - least, keys.index(b[1:3])) for b in best)
        return layer, least, tuple(b and (b[3], b[2]) for b in best)

    def through(self, start: int, kinds: list[tuple[str, str]]) -> tuple[Layer, int]:
        layer, total = self.starts[start], 0
        for kind in kinds:
            layer, least, _ = self.step(layer, kind)
            total += least
        return layer, total

    def codes(self, start: int, end: int, kinds: list[tuple[str, str]]) -> list[int]:
        """Numbers of the codes of the best way from ``start`` to ``end``, by parent pointers."""
        layer, back = self.starts[start], []
        for kind in kinds:
            layer, _, came = self.step(layer, kind)
            back.append(came)
        out = []
        for came in reversed(back):
            end, code = came[end]
            out.append(code)
        return out[::-1]


def joined(pieces: list[list]) -> tuple[int, list[int]]:
    """(cost, states between pieces, the first 0) of the best way through pieces, each a list of (layer,
    cost) for its four starts: ranks before a piece decide, then those within it."""
    now: list[tuple | None] = [(0, (0,)), None, None, None]
    back = []
    for piece in pieces:
        best: list[tuple | None] = [None] * 4
        for s, had in enumerate(now):
            if had is None:
                continue
            layer, base = piece[s]
            for t, way in enumerate(layer):
                if way is not None:
                    one = (had[0] + base + way[0], (*had[1], way[1]), s)
                    if best[t] is None or one < best[t]:
                        best[t] = one
        keys = sorted({b[1] for b in best if b})
        back.append([b and b[2] for b in best])
        now = [b and (b[0], (keys.index(b[1]),)) for b in best]
    cost, _, t = min((b[0] + INSERT * len(TAILS[t]), b[1], t) for t, b in enumerate(now) if b)
    states = [t]
    for came in reversed(back):
        states.append(came[states[-1]])
    return cost, states[::-1]


def repaired(turns, codes) -> tuple[list[str], str]:
    """(role of each turn that is left, audit string): for tests and short lists. ``turns`` are (role,
    text) pairs; inserted turns have no text."""
    out, audit, state = [], [], 0
    for (role, text), code in zip(turns, codes, strict=True):
        pieces, state = edited(state, CODES[code], role, text)
        out += pieces
        audit.append(CODES[code])
    pieces, _ = edited(state, TAILS[state] + "D", "", "")
    return out + pieces, "".join(audit) + TAILS[state]


def edited(state: int, code: str, role: str, text: str) -> tuple[list[str], int]:
    """(turns written as role:text, state after) of one code on a turn."""
    out = []
    for _ in code[:-1]:
        out.append(f"{FITS[state]}:")
        state = ADDED[state]
    if code[-1] == "D":
        return out, state
    if code[-1] == "K":
        return [*out, f"{role}:{text}"], FOLLOWS[state, role[:1]]
    return [*out, f"{FITS[state]}:{text}"], ADDED[state]
