"""Search inside one component: blocks, tree DP, exact search, Monte Carlo. Plain Python over small
graphs; networks reach it one component at a time, after they have been reduced as tables."""

from __future__ import annotations

import heapq
import random
import time
from collections import defaultdict, deque


def adjacency(edges: list[tuple[int, int]], nodes=()) -> dict[int, set[int]]:
    adj: dict[int, set[int]] = {v: set() for v in nodes}
    for u, v in edges:
        if u != v:
            adj.setdefault(u, set()).add(v)
            adj.setdefault(v, set()).add(u)
    return adj


def biconnected(edges: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Edges of each biconnected component, in order of discovery from the least node; iterative."""
    return [block for _, block in blocks_under(edges)]


def blocks_under(edges: list[tuple[int, int]]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Edges of each biconnected component after its node nearest the least of all that hang together."""
    adj = adjacency(edges)
    order, low, out, stack = {}, {}, [], []
    for root in sorted(adj):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        walk = [(root, None, iter(sorted(adj[root])))]
        while walk:
            v, parent, it = walk[-1]
            for w in it:
                if w == parent:
                    continue
                if w not in order:
                    stack.append((v, w))
                    order[w] = low[w] = len(order)
                    walk.append((w, v, iter(sorted(adj[w]))))
                    break
                if order[w] < order[v]:
                    stack.append((v, w))
                    low[v] = min(low[v], order[w])
            else:
                walk.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] >= order[parent]:
                        block = []
                        while True:
                            e = stack.pop()
                            block.append((min(e), max(e)))
                            if e == (parent, v):
                                break
                        out.append((parent, sorted(block)))
    return out


def separation_pairs(adj: dict[int, set[int]], deadline: float | None = None):
    """(p, q, parts) for pairs p < q without which a biconnected graph falls apart, and the parts. Node by
    node, the articulation points of what is left are found; out of time, no more are looked for."""
    for p in sorted(adj):
        if deadline and time.monotonic() > deadline:
            return
        blocks = biconnected([(u, v) for u in adj for v in adj[u] if u < v and p not in (u, v)])
        count: dict[int, int] = defaultdict(int)
        for b in blocks:
            for x in {x for e in b for x in e}:
                count[x] += 1
        for q in sorted(x for x, n in count.items() if n > 1 and x > p):
            left, parts = set(adj) - {p, q}, []
            while left:
                seen = {next(iter(left))}
                todo = list(seen)
                while todo:
                    for y in adj[todo.pop()] & left - seen:
                        seen.add(y)
                        todo.append(y)
                parts.append(seen)
                left -= seen
            yield p, q, parts


def trimmed(adj: dict[int, set[int]], w: dict[int, float], keep: set[int], deadline: float | None = None) -> dict[int, set[int]]:
    """A block without what no best set needs: of a part between two nodes that has no positive node and
    none to keep, all but the cheapest path between the two, and that too if they are adjacent. A set
    enters such a part just to join the two."""
    gone: set[int] = set()
    for p, q, parts in separation_pairs(adj, deadline):
        if p in gone or q in gone:
            continue
        for part in parts:
            part = part - gone
            if not part or part & keep or any(w[x] > 0 for x in part):
                continue
            path: set[int] = set()
            if q not in adj[p]:
                inside = {x: adj[x] & (part | {p, q}) for x in part | {p, q}}
                inside[p], inside[q] = inside[p] - {q}, inside[q] - {p}
                dist, before = shortest_paths(inside, {x: -w[x] if x in part else 0.0 for x in inside}, p)
                x = before.get(q) if q in dist else None
                while x is not None and x != p:
                    path.add(x)
                    x = before[x]
            gone |= part - path
    return {x: adj[x] - gone for x in adj if x not in gone}


class OutOfTime(Exception):
    pass


class Search:
    """Branch and bound for the best connected set that holds a root. A state is a connected set, the
    forbidden nodes and the total; its bound adds all positive nodes still reachable, each less its share
    of a node that it must be joined by: a negative node's cost is shared by its positive neighbours, and
    a positive node with negative neighbours alone needs one of them."""

    def __init__(self, adj, weight, must=frozenset(), deadline: float | None = None):
        self.adj, self.w, self.must, self.deadline = adj, weight, frozenset(must), deadline
        self.best, self.best_set, self.open_bound = float("-inf"), None, float("-inf")
        wanted = {v for v in adj if weight[v] > 0 or v in self.must}
        #: What a node costs each of its wanted neighbours at least; nothing if it is wanted itself.
        self.share = {v: 0.0 if v in wanted else -weight[v] / max(1, len(adj[v] & wanted)) for v in adj}

    def _reach(self, inside: set, forbidden: set) -> tuple[float, set]:
        seen, todo, gain = set(inside), list(inside), 0.0
        while todo:
            for y in self.adj[todo.pop()]:
                if y not in seen and y not in forbidden:
                    seen.add(y)
                    todo.append(y)
        for y in seen - inside:
            if y in self.must or self.w[y] > 0:
                rest = self.w[y] - min(0.0 if x in inside else self.share[x] for x in self.adj[y] if x in seen)
                gain += rest if y in self.must else max(0.0, rest)
        return gain, seen

    def open(self, inside, out, total: float) -> float:
        """The most that a state can still come to; minus infinity if it can't hold all that it must."""
        gain, seen = self._reach(set(inside), set(out))
        return total + gain if self.must <= seen else float("-inf")

    def work(self, stack: list, steps: float = float("inf")) -> list:
        """Expand states (inside, out, total), the last first, until there is none, ``steps`` are done or
        the time is up; the states that are left. ``best`` and ``best_set`` are kept up to date."""
        while stack and steps > 0 and not (self.deadline and time.monotonic() > self.deadline):
            steps -= 1
            inside, out, total = stack.pop()
            if self.open(inside, out, total) <= self.best:
                continue
            if total > self.best and self.must <= inside:
                self.best, self.best_set = total, inside
            edge = {y for x in inside for y in self.adj[x] if y not in inside and y not in out}
            if not edge:
                continue
            free = [y for y in edge if self.w[y] >= 0 or y in self.must]
            if free:  # always worth taking
                stack.append((inside | set(free), out, total + sum(self.w[y] for y in free)))
                continue
            y = max(edge, key=lambda y: (self.w[y] + sum(max(0, self.w[z]) for z in self.adj[y] if z not in inside and z not in out), -y))
            stack.append((inside, out | {y}, total))
            stack.append((inside | {y}, out, total + self.w[y]))
        return stack

    def run(self, root, forbidden=frozenset()) -> None:
        left = self.work([(frozenset([root]), frozenset(forbidden), self.w[root])])
        if left:
            self.open_bound = max([self.open_bound, *(self.open(*state) for state in left)])
            raise OutOfTime


def joined(adj, must) -> frozenset:
    """A connected set that holds ``must``: shortest paths from its least node; what is unreachable is
    left out."""
    top = min(must)
    parent, todo = {top: None}, deque([top])
    while todo:
        x = todo.popleft()
        for y in sorted(adj[x]):
            if y not in parent:
                parent[y] = x
                todo.append(y)
    out = {top}
    for x in must:
        while x in parent and x not in out:
            out.add(x)
            x = parent[x]
    return frozenset(out)


def _rooted(adj, w, root, must, deadline):
    """(value, set, bound) of the best connected set with root and must. Out of time, the best so far,
    at least the set that simply joins them."""
    s = Search(adj, w, must, deadline)
    first = joined(adj, frozenset(must) | {root})
    if must <= first:
        s.best, s.best_set = sum(w[x] for x in first), first
    try:
        s.run(root)
    except OutOfTime:
        return s.best, s.best_set, max(s.best, s.open_bound)
    return s.best, s.best_set, s.best


def _free(adj, w, deadline, least=0.0):
    """(value, set, bound) of the best connected set, empty and ``least`` if none is better. The set's
    first positive node in order of weight is its root, so no set is searched twice."""
    s = Search(adj, w, frozenset(), deadline)
    s.best, s.best_set = least, frozenset()
    before: set = set()
    order = sorted((v for v in adj if w[v] > 0), key=lambda v: (-w[v], v))
    for k, v in enumerate(order):
        try:
            s.run(v, frozenset(before))
        except OutOfTime:
            rest = sum(w[x] for x in order[k + 1 :])
            return s.best, s.best_set, max(s.best, s.open_bound, rest)
        before.add(v)
    return s.best, s.best_set, s.best


def solve_component(nodes: dict[int, float], edges: list[tuple[int, int]], roots=frozenset(), seconds: float = 10.0, draws: int = 10, trace=None):
    """(value, sorted ids, upper bound, status) for one component by block decomposition: from the
    leaves of the block-cut tree, a block's gain over its cut node alone is added to the cut node's
    weight. Gains never depend on the cut node's own weight and add up, so none is lost where several
    small gains pay for a negative cut node together. Out of time, the blocks that are left still give
    their bounds and what is known of them, so the set is connected and the bound holds. The search
    starts from the best of ``draws`` spanning trees. ``trace(seconds, value)`` is told of better sets."""
    began = time.monotonic()
    deadline = began + seconds
    roots = frozenset(roots)
    adj = adjacency(edges, nodes)
    w = dict(nodes)
    carried: dict[int, set[int]] = defaultdict(set)
    found = [set(x for e in b for x in e) for b in biconnected(edges)]
    best, best_set, bound = (0.0, frozenset(), 0.0) if not roots else (float("-inf"), None, float("-inf"))
    must = set(roots)
    loose = 0.0  # what gains may be short of their bounds

    def better(value, ids):
        nonlocal best, best_set
        if value > best:
            best, best_set = value, frozenset(ids)
            if trace:
                trace(time.monotonic() - began, value)

    def whole(s):
        out, todo = set(), list(s)
        while todo:
            x = todo.pop()
            if x not in out:
                out.add(x)
                todo.extend(carried[x])
        return out

    if not found:
        v = next(iter(nodes))
        if roots or w[v] > 0:
            return w[v], [v], w[v], "OPTIMAL"
        return 0.0, [], 0.0, "OPTIMAL"
    if draws:
        value, ids = monte_carlo(nodes, edges, roots, seeds=range(draws), deadline=began + seconds / 5)
        if ids:
            better(value, ids)
    of = defaultdict(list)
    for k, b in enumerate(found):
        for x in b:
            of[x].append(k)
    start = of[min(roots)][0] if roots else 0
    order, parent, todo = [], {start: None}, deque([start])
    while todo:
        k = todo.popleft()
        order.append(k)
        for x in found[k]:
            for j in of[x]:
                if j not in parent:
                    parent[j] = x
                    todo.append(j)
    for k in reversed(order):
        block, cut = found[k], parent[k]
        need = must & block
        sub = trimmed({x: adj[x] & block for x in block}, w, need | ({cut} - {None}), min(deadline, time.monotonic() + seconds / 20))
        if cut is None:
            if roots:
                value, got, up = _rooted(sub, w, min(need), need, deadline)
                bound = up + loose
            else:
                value, got, up = _free(sub, w, deadline, best)
                bound = max(bound, up + loose)
            if got:
                better(value, whole(got))
            break
        if not roots:
            rest = {x: sub[x] - {cut} for x in sub if x != cut}
            value, got, up = _free(rest, w, deadline, best)
            if got:
                better(value, whole(got))
            bound = max(bound, up + loose)
        value, got, up = _rooted(sub, w, cut, need | {cut}, deadline)
        if need - {cut}:
            must.add(cut)
        w[cut] = value
        loose += up - value
        carried[cut] |= set(got) - {cut}
    bound = max(bound, best)
    status = "OPTIMAL" if bound <= best + 1e-9 * max(1.0, abs(best)) else "TIME_LIMIT"
    return best, sorted(best_set), bound, status


def tree_dp(nodes: dict[int, float], edges: list[tuple[int, int]], roots=frozenset()):
    """(value, sorted ids) of the best connected set of a tree; the whole path to every root is taken."""
    adj = adjacency(edges, nodes)
    top = min(roots) if roots else min(nodes)
    order, parent = [top], {top: None}
    for v in order:
        for y in sorted(adj[v]):
            if y not in parent:
                parent[y] = v
                order.append(y)
    dp, need = dict(nodes), set(roots)
    for v in reversed(order):
        p = parent[v]
        if p is not None and v in need:
            need.add(p)
    for v in reversed(order):
        p = parent[v]
        if p is not None and (dp[v] > 0 or v in need):
            dp[p] += dp[v]
    head = top if roots else max(order, key=lambda v: (dp[v], -v))
    if not roots and dp[head] <= 0:
        return 0.0, []
    out, todo = [], [head]
    while todo:
        v = todo.pop()
        out.append(v)
        todo += [y for y in adj[v] if parent.get(y) == v and (dp[y] > 0 or y in need)]
    return dp[head], sorted(out)


def spanning_tree(nodes, edges: list[tuple[int, int]], cost: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    up = {v: v for v in nodes}

    def find(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    out = []
    for e in sorted(edges, key=lambda e: (cost[e], e)):
        a, b = find(e[0]), find(e[1])
        if a != b:
            up[a] = b
            out.append(e)
    return out


STRATEGIES = ("fixed", "random", "uniform_random", "min_max")


def edge_costs(nodes: dict[int, float], edges, strategy: str, seed: int) -> dict[tuple[int, int], float]:
    """Costs by node: fixed -(w_u + w_v); random 2 - (r_u + r_v); uniform_random the same with r up to
    the node's scaled score; min_max 2 - the scaled scores. Draws are keyed by seed and node."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    lo, hi = min(nodes.values()), max(nodes.values())
    norm = {v: (w - lo) / (hi - lo) if hi > lo else 0.0 for v, w in nodes.items()}
    if strategy == "fixed":
        return {(u, v): -(nodes[u] + nodes[v]) for u, v in edges}
    if strategy == "min_max":
        r = norm
    else:
        r = {v: random.Random(f"{seed}/{v}").random() for v in nodes}
        if strategy == "uniform_random":
            r = {v: x * norm[v] for v, x in r.items()}
    return {(u, v): 2 - (r[u] + r[v]) for u, v in edges}


def hub_costs(nodes: dict[int, float], edges, cost: dict[tuple[int, int], float], seed: int) -> dict[tuple[int, int], float]:
    """``cost`` with the edges between sampled negative hubs and nodes that are not negative made nearly
    free. A tenth of the hubs that pay (their score and those neighbours' no less than the best of these),
    one at least, is drawn by benefit without replacement, and a tenth of the others by chance."""
    rng = random.Random(f"{seed}/hubs")
    adj = adjacency(edges, nodes)
    gain = {}
    for v in sorted(nodes):
        near = [nodes[y] for y in adj[v] if nodes[y] >= 0]
        if nodes[v] < 0 and near and nodes[v] + sum(near) >= max(near):
            gain[v] = max(0, round(nodes[v] + sum(near)))
    live = {v: x for v, x in gain.items() if x > 0}
    order = sorted(live, key=lambda v: -rng.random() ** (1 / live[v]))
    picked = set(order[: max(1, len(gain) // 10)])
    picked |= {v for v in gain if v not in picked and rng.random() < 0.1}
    return {(u, v): rng.random() * 1e-3 if (u in picked and nodes[v] >= 0) or (v in picked and nodes[u] >= 0) else c for (u, v), c in cost.items()}


def monte_carlo(nodes: dict[int, float], edges, roots=frozenset(), strategy: str = "random", seeds=range(20), deadline: float | None = None, hubs: bool = False):
    """(value, sorted ids): the best tree optimum over spanning trees of drawn costs, of at least one;
    ``hubs`` also samples negative hubs, whose edges come first."""
    best, ids = (float("-inf"), None) if roots else (0.0, [])
    for k, s in enumerate(seeds):
        if k and deadline and time.monotonic() > deadline:
            break
        cost = edge_costs(nodes, edges, strategy, s)
        tree = spanning_tree(nodes, edges, hub_costs(nodes, edges, cost, s) if hubs else cost)
        value, got = tree_dp(nodes, tree, roots)
        if value > best:
            best, ids = value, got
        if strategy in ("fixed", "min_max") and not hubs:
            break
    return best, ids


def shortest_paths(adj, cost: dict[int, float], source: int) -> tuple[dict[int, float], dict[int, int | None]]:
    """(distance, node before) from ``source``; to enter a node costs ``cost``, none of it negative."""
    dist, before, done, heap = {source: 0.0}, {source: None}, set(), [(0.0, source)]
    while heap:
        d, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        for y in adj[x]:
            if y not in done and d + cost[y] < dist.get(y, float("inf")):
                dist[y], before[y] = d + cost[y], x
                heapq.heappush(heap, (d + cost[y], y))
    return dist, before


def is_path_ok(weights: list[float]) -> bool:
    """Whether the sums along a path reach their greatest at its end, and that is not negative."""
    total, top = 0.0, float("-inf")
    for x in weights:
        total += x
        top = max(top, total)
    return total >= top and total >= 0


def dependent_pairs(nodes: dict[int, float], edges) -> list[tuple[int, int]]:
    """(i, j), i depends on j: positive nodes whose cheapest path from i to j, each node costing what it
    lies below the greatest weight, adds up as ``is_path_ok`` asks."""
    adj, top = adjacency(edges, nodes), max(nodes.values(), default=0.0)
    cost = {v: top - x for v, x in nodes.items()}
    positive = sorted(v for v in nodes if nodes[v] > 0)
    out = []
    for i in positive:
        _, before = shortest_paths(adj, cost, i)
        for j in positive:
            if j != i and j in before:
                path, x = [], j
                while x != i:
                    path.append(nodes[x])
                    x = before[x]
                if is_path_ok(path[::-1]):
                    out.append((i, j))
    return out


def max_flow(arcs: list[tuple[int, int, float]], source: int, sink: int) -> tuple[float, set[int], set[int]]:
    """(value, nodes on the source's side of the first minimum cut, nodes on the sink's side of the last)
    for directed arcs (u, v, capacity), by shortest augmenting paths."""
    room: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for u, v, c in arcs:
        room[u][v] += c
        room[v][u] += 0.0
    value = 0.0

    def reach(start, back):
        before, todo = {start: None}, deque([start])
        while todo:
            x = todo.popleft()
            for y in room[x]:
                if y not in before and (room[y][x] if back else room[x][y]) > 1e-12:
                    before[y] = x
                    todo.append(y)
        return before

    while sink in (before := reach(source, False)):
        path, x = [], sink
        while before[x] is not None:
            path.append((before[x], x))
            x = before[x]
        least = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= least
            room[b][a] += least
        value += least
    return value, set(before), set(reach(sink, True))


def disjoint_paths(adj, cost: dict[int, float], source: int, sink: int, k: int) -> list[list[int]]:
    """At most k paths from source to sink that share no inner node, of least total cost of the nodes
    entered, as many as there are: by shortest augmenting paths in the graph of split nodes."""
    flow: dict[int, tuple[int | None, int | None]] = {}  # inner node: the nodes before and after it on its path
    heads: set[int] = set()
    count = 0
    while count < k:
        # States (node, side): side 0 on entry, 1 on exit; Bellman-Ford, as undone steps have negative cost.
        dist, before, todo = {(source, 1): 0.0}, {(source, 1): None}, deque([(source, 1)])
        while todo:
            x, side = todo.popleft()
            steps = []
            if side == 1:
                for y in adj[x]:
                    if y == source or (y in flow and flow[y][0] == x) or (x == source and y == sink and sink in heads):
                        continue
                    steps.append(((y, 0), cost[y]))
                if x in flow:
                    steps.append(((x, 0), 0.0))
            elif x != sink:
                if x not in flow:
                    steps.append(((x, 1), 0.0))
                elif flow[x][0] != source:
                    steps.append(((flow[x][0], 1), -cost[x]))
            for to, c in steps:
                if dist[(x, side)] + c < dist.get(to, float("inf")) - 1e-12:
                    dist[to], before[to] = dist[(x, side)] + c, (x, side)
                    todo.append(to)
        if (sink, 0) not in before:
            break
        used = {(a, b) for a, (_, b) in flow.items()} | {(source, y) for y in heads}
        at = (sink, 0)
        while before[at] is not None:
            prev = before[at]
            if prev[1] == 1 and at[1] == 0 and prev[0] != at[0]:
                used.add((prev[0], at[0]))
            elif prev[1] == 0 and at[1] == 1 and prev[0] != at[0]:
                used.discard((at[0], prev[0]))
            at = prev
        heads = {b for a, b in used if a == source}
        flow = {}
        for a, b in used:
            if b != sink:
                flow[b] = (a, flow.get(b, (None, None))[1])
            if a != source:
                flow[a] = (flow.get(a, (None, None))[0], b)
        count += 1
    out = []
    for x in sorted(heads):
        path = [source, x]
        while path[-1] != sink:
            path.append(flow[path[-1]][1])
        out.append(path)
    return out
