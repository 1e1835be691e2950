"""The reduction rules on whole small components, many of them together as arrays.

The rules are those of ``reduce`` on tables, in the same order. A component's rules depend on it alone, but
for the lower bound: it decides which isolated nodes stay, which is settled when all components are done.
Nodes are numbered in the order of their ids, so ties fall as in tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from scorenet.operators.components import merge_labels

#: Arcs that the searches for detours of a few candidates may go over together.
SEARCHED = 1_000_000
SETTLED = "old long, new long, score double, copy boolean"


class Part:
    """Nodes 0 to n - 1 with their components, and edges (u, v) with u < v. ``to`` tells in which node each
    original one is, ``alive`` which nodes are there, ``open`` those of components that may still change."""

    def __init__(self, comp: np.ndarray, score: np.ndarray, root: np.ndarray, u: np.ndarray, v: np.ndarray):
        n = len(comp)
        self.n, self.comp, self.score, self.root = n, comp, score, root
        self.to, self.alive, self.open = np.arange(n), np.ones(n, bool), np.ones(n, bool)
        self.copies: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.set_edges(u, v)

    def set_edges(self, u: np.ndarray, v: np.ndarray) -> None:
        """Edges as given, with repeats and loops left out; the neighbours of node i are the ``deg[i]`` places
        of ``nbr`` from ``first[i]``, ascending."""
        key = np.unique(np.minimum(u, v) * self.n + np.maximum(u, v))
        self.u, self.v = np.divmod(key, max(1, self.n))
        apart = self.u != self.v
        self.u, self.v = self.u[apart], self.v[apart]
        arcs = np.sort(np.concatenate([self.u * self.n + self.v, self.v * self.n + self.u]))
        src, self.nbr = np.divmod(arcs, max(1, self.n))
        self.deg = np.bincount(src, minlength=self.n)
        self.first = np.cumsum(self.deg) - self.deg

    def live(self) -> np.ndarray:
        return self.alive & self.open

    def remove(self, gone: np.ndarray) -> None:
        self.alive[gone] = False
        keep = self.alive[self.u] & self.alive[self.v]
        self.set_edges(self.u[keep], self.v[keep])

    def merge(self, label: np.ndarray) -> None:
        """Node i becomes part of ``label[i]``, which is part of itself."""
        self.score = np.bincount(label, self.score, self.n)
        self.alive &= label == np.arange(self.n)
        self.to = label[self.to]
        self.set_edges(label[self.u], label[self.v])

    def close(self, comps: np.ndarray) -> None:
        """Components other than ``comps`` change no more."""
        self.open &= np.isin(self.comp, comps)
        keep = self.open[self.u]
        self.set_edges(self.u[keep], self.v[keep])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, a, b) of nodes with just two neighbours a < b."""
        i = np.flatnonzero(self.live() & (self.deg == 2))
        return i, self.nbr[self.first[i]], self.nbr[self.first[i] + 1]


def neg_deg01(p: Part) -> np.ndarray:
    return np.flatnonzero(p.live() & (p.score < 0) & (p.deg <= 1) & ~p.root)


def pos_edges(p: Part) -> np.ndarray:
    fit = (p.score >= 0) & ~p.root
    return fit[p.u] & fit[p.v]


def neg_chain_edges(p: Part) -> np.ndarray:
    fit = (p.score <= 0) & (p.deg == 2) & ~p.root
    return fit[p.u] & fit[p.v]


def pos_diamond(p: Part) -> np.ndarray:
    i, a, b = p.pairs()
    fit = p.score[i] >= 0
    key, c = np.unique(a[fit] * p.n + b[fit], return_counts=True)
    a, b = np.divmod(key, p.n)
    both = (p.score[a] <= 0) & (p.score[b] <= 0) & (p.deg[a] == c) & (p.deg[b] == c)
    first = both & (p.score[a] <= p.score[b]) & ~p.root[a]
    second = both & ~first & (p.score[b] <= p.score[a]) & ~p.root[b]
    return np.unique(np.concatenate([a[first], b[second]]))


def mirrored_hubs(p: Part) -> np.ndarray:
    i = np.flatnonzero(p.live() & (p.score <= 0) & (p.deg >= 3))
    seen, gone = set(), []
    for x in i[np.lexsort((i, -p.score[i], ~p.root[i]))].tolist():  # the one that stays comes first
        near = p.nbr[p.first[x] : p.first[x] + p.deg[x]].tobytes()
        if near in seen and not p.root[x]:
            gone.append(x)
        seen.add(near)
    return np.array(gone, np.int64)


def shortest_path(p: Part) -> np.ndarray:
    i, a, b = p.pairs()
    low = (p.score[i] <= 0) & ~p.root[i]
    i, a, b = i[low], a[low], b[low]
    arcs = np.bincount(p.comp, p.deg, p.n)[p.comp[i]]
    chunk = (np.cumsum(arcs) // SEARCHED).astype(np.int64)
    near = p.deg[a] <= p.deg[b]
    start, goal = np.where(near, a, b), np.where(near, b, a)
    cand = np.zeros(p.n, bool)
    cand[i] = True
    cuts = np.flatnonzero(np.diff(chunk)) + 1
    found = [_detours(p, *x, cand) for x in zip(*(np.split(y, cuts) for y in (i, start, goal)), strict=True)]
    return i[np.concatenate(found)]


def _detours(p: Part, key: np.ndarray, start: np.ndarray, goal: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Which of the candidates ``key`` have a detour from ``start`` to ``goal``."""
    found = np.zeros(len(key), bool)
    cost, most = np.maximum(-p.score, 0.0), -p.score[key]
    known, dists = np.arange(len(key)) * p.n + start, np.zeros(len(key))
    k, at, dist = np.arange(len(key)), start, dists
    while len(k):
        times = p.deg[at]
        row = np.repeat(np.arange(len(k)), times)
        x = p.nbr[np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + p.first[at][row]]
        k, dist = k[row], dist[row]
        end = x == goal[k]
        dist = dist + np.where(end, 0.0, cost[x])
        later = (p.score[x] > p.score[key[k]]) | ((p.score[x] == p.score[key[k]]) & (x > key[k]))
        fit = (x != key[k]) & (dist <= most[k]) & (end | ~cand[x] | later)
        found[k[fit & end]] = True
        fit &= ~found[k]
        k, x, dist = k[fit], x[fit], dist[fit]
        code = k * p.n + x
        order = np.lexsort((dist, code))
        order = order[np.r_[True, np.diff(code[order]) > 0]] if len(order) else order
        code, dist = code[order], dist[order]
        place = np.minimum(np.searchsorted(known, code), len(known) - 1)
        have = known[place] == code
        better = ~have | (dist < dists[place])
        dists[place[have & better]] = dist[have & better]
        fresh = ~have
        put = np.searchsorted(known, code[fresh])
        known, dists = np.insert(known, put, code[fresh]), np.insert(dists, put, dist[fresh])
        k, at = np.divmod(code[better], p.n)
        dist = dist[better]
    return found


def _pos_deg01(p: Part, floor: float, rooted: bool) -> bool:
    bound = max(floor, 0.0, p.score[p.alive].max(initial=0.0))
    fit = p.live() & (p.score >= 0) & ~p.root
    gone, leaf = np.flatnonzero(fit & (p.deg == 0) & (p.score < bound)), fit & (p.deg == 1)
    i = np.flatnonzero(leaf)
    nbr = p.nbr[p.first[i]]
    stays = ~leaf[nbr] | (i > nbr)  # of two joined leaves the later goes
    i, nbr = i[stays], nbr[stays]
    if not rooted:
        copied = np.zeros(p.n, bool)
        copied[i[p.score[i] >= bound]] = True
        members = np.flatnonzero(copied[p.to])
        p.copies.append((p.to[members], members, p.score[p.to[members]]))
    p.alive[gone] = False
    if len(i):
        label = np.arange(p.n)
        label[i] = nbr
        p.merge(label)
    return bool(len(gone) or len(i))


def _removing(find: Callable[[Part], np.ndarray]):
    def rule(p: Part) -> bool:
        gone = find(p)
        if len(gone):
            p.remove(gone)
        return bool(len(gone))

    return rule


def _contracting(find: Callable[[Part], np.ndarray]):
    def rule(p: Part) -> bool:
        which = find(p)
        if which.any():
            p.merge(merge_labels(np.arange(p.n), p.u[which], p.v[which]))
        return bool(which.any())

    return rule


def settle(p: Part, floor: float, rooted: bool) -> None:
    """All rules until none changes anything. A leaf that reaches ``floor`` and all of ``p`` leaves a copy."""
    phases = [
        [_removing(neg_deg01), _contracting(pos_edges), _contracting(neg_chain_edges), lambda p: _pos_deg01(p, floor, rooted)],
        [_removing(pos_diamond), _removing(mirrored_hubs)],
    ]
    while p.open.any():
        if any(any([rule(p) for rule in rules]) for rules in phases):
            continue
        gone = shortest_path(p)
        p.remove(gone)
        p.close(p.comp[gone])


def settled(rows: pa.Table, floor: float, rooted: bool) -> pa.Table:
    """What becomes of the nodes of whole components, given as rows (comp, u, v, score, is_root): nodes are u
    where v is null, other rows edges. Rows (old, new) that are no ``copy`` tell in which node another one goes,
    null if it is removed; those that are tell which nodes the copy of a leaf ``old`` stands for, and its score."""
    is_node = np.array(rows.column("v").is_null())
    nodes = rows.filter(pa.array(is_node)).combine_chunks().sort_by("u")
    edges = rows.filter(pa.array(~is_node))
    ids = nodes.column("u").to_numpy()
    u, v = (np.searchsorted(ids, edges.column(c).to_numpy()) for c in "uv")
    comp = np.unique(nodes.column("comp").to_numpy(), return_inverse=True)[1]
    p = Part(comp, nodes.column("score").to_numpy().copy(), nodes.column("is_root").to_numpy(zero_copy_only=False), u, v)
    settle(p, floor, rooted)
    moved = np.flatnonzero(~p.alive)
    stays = p.alive[p.to[moved]]
    leaf, member, score = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *p.copies, strict=True))
    own, copies = len(moved), len(leaf)
    new = pa.concat_arrays([pa.array(ids[p.to[moved]], mask=~stays), pa.array(ids[member])])
    scores = pa.concat_arrays([pa.nulls(own, pa.float64()), pa.array(score)])
    return pa.table([pa.array(np.concatenate([ids[moved], ids[leaf]])), new, scores, pa.array(np.repeat([False, True], [own, copies]))], names=["old", "new", "score", "copy"])
