"""Chinese-restaurant seating of many restaurants at once, by numbers of tables.

A pair is a dish of a restaurant with its customers. Which customer sits where does not matter for
predictive probabilities, only how many tables serve the dish, so a Gibbs step draws that number from its
distribution given all other tables: proportional to the chance of opening that many tables times the
number of seatings (a generalized Stirling number). Pairs of one restaurant are drawn side by side, each
given the others' tables of the step before.
"""

from __future__ import annotations

import numpy as np

#: Customers up to which the distribution of tables is summed up exactly. Beyond, customers are seated one
#: after another (from the 65th on in groups of an eighth, with one chance of a new table for a group), as
#: often as TRIES, and one of these seatings is drawn by its weight.
EXACT, TRIES = 64, 4


def log_seatings(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of S(c, t): the weight of all seatings of c customers at t tables, but for new ones."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(1, most):
            t = np.arange(1, c + 2)
            out[c + 1, t] = np.logaddexp(out[c, t - 1], out[c, t] + np.log(np.maximum(c - discount * t, 0)))
    return out


def discount_of(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class Seating:
    """``place``: each pair's restaurant, ``customers``: how many eat its dish there. ``tables`` starts
    with one for each pair that has customers."""

    def __init__(self, place: np.ndarray, customers: np.ndarray, places: int, discount: float, strength: float, rng: np.random.Generator):
        self.place, self.places, self.discount, self.strength, self.rng = place, places, discount, strength, rng
        self.seatings = log_seatings(discount)
        self.tables = np.zeros(len(place), np.int64)
        self.set_customers(customers)

    def set_customers(self, customers: np.ndarray) -> None:
        self.customers = customers
        self.tables = np.clip(self.tables, np.minimum(customers, 1), customers)
        many = np.flatnonzero(customers > 1)
        many = many[np.argsort(customers[many], kind="stable")]
        n = customers[many]
        cuts = [*(np.flatnonzero(n[1:] != n[:-1]) + 1), len(n)]
        self.groups = [(int(n[a]), many[a:b]) for a, b in zip([0, *cuts], cuts, strict=False) if a < b and n[a] <= EXACT]
        self.rest = many[n > EXACT]

    def sweep(self, base: np.ndarray) -> None:
        """Draw the tables of every pair anew; its parent serves the dish with probability ``base``."""
        total = np.bincount(self.place, self.tables, self.places)
        other = self.strength / self.discount + total[self.place] - self.tables  # in units of the discount
        after = self.tables.copy()
        for c, pairs in self.groups:
            open_ = np.log((other[pairs, None] + np.arange(c)) * (self.discount * base[pairs, None])).cumsum(1)
            open_ += self.seatings[c, 1 : c + 1]
            open_ -= open_.max(1, keepdims=True)
            ends = np.exp(open_).cumsum(1)
            after[pairs] = 1 + (ends < ends[:, -1:] * self.rng.random((len(pairs), 1))).sum(1)
        if len(self.rest):
            after[self.rest] = self._in_turn(other[self.rest], base[self.rest], self.customers[self.rest])
        self.tables = after

    def _in_turn(self, other: np.ndarray, base: np.ndarray, customers: np.ndarray) -> np.ndarray:
        shape = (TRIES, len(customers))
        tables, weight = np.ones(shape), np.zeros(shape)
        seated = 1
        while (live := np.flatnonzero(customers > seated)).size:
            step = 1 if seated < EXACT else seated // 8
            n = np.minimum(customers[live] - seated, step)
            new = self.discount * (other[live] + tables[:, live]) * base[live]
            old = seated - self.discount * tables[:, live]
            weight[:, live] += n * np.log(new + old)
            tables[:, live] += self.rng.binomial(np.broadcast_to(n, new.shape), new / (new + old))
            seated += step
        ends = np.exp(weight - weight.max(0)).cumsum(0)
        pick = (ends < ends[-1] * self.rng.random(len(customers))).sum(0)
        return np.minimum(tables[pick, np.arange(len(customers))].astype(np.int64), customers)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """(each pair's share of its own customers, each restaurant's weight for its parent): the
        probability of a dish is the share, plus the weight times that by the parent."""
        c = np.bincount(self.place, self.customers, self.places)
        t = np.bincount(self.place, self.tables, self.places)
        own = (self.customers - self.discount * self.tables) / (self.strength + c)[self.place]
        return own, (self.strength + self.discount * t) / (self.strength + c)
