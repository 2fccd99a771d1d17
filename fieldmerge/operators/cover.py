"""The best partition of one component into legal groups, for components that are too dense to be searched group by group.

A group is a connected set of observations of different fields; it costs one object, then the weight of its best tree. The
least cost of a partition is bounded by linear programming: prices of the observations such that no group costs less than
its observations' prices. What a group costs more is its excess; the excesses of a partition's groups add up to its cost less
all prices, so only groups of little excess can be in a best partition, and few are left; among these, branches settle what the program takes in part, and
what no longer hangs together is settled apart. Partner lists are then
fixed one by one: links are forced in and out while a best partition exists.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Steps of all linear programs of a component before the search gives up, and groups that may stay in question.
PIVOTS, TIGHT = 400_000, 60_000
#: Prices are cut to whole numbers of this part, so that excesses add up exactly.
UNIT = 1 << 16


class WorkExceeded(RuntimeError):
    """The component needs more than the allowed steps; no answer is better than a wrong one."""


class FieldForest:
    """Trees of nodes, each with the fields it holds as a bit mask, that can be taken back to an earlier state."""

    def __init__(self, masks: Iterable[int]):
        self.masks = list(masks)
        self.up = list(range(len(self.masks)))
        self.done: list[tuple[int, int, int]] = []

    def root(self, node: int) -> int:
        while self.up[node] != node:
            node = self.up[node]
        return node

    def union(self, a: int, b: int) -> bool:
        """Link two trees; False, and no change, within one tree or where they share a field."""
        a, b = self.root(a), self.root(b)
        if a == b or self.masks[a] & self.masks[b]:
            return False
        if self.masks[a].bit_count() < self.masks[b].bit_count():
            a, b = b, a
        self.done.append((a, b, self.masks[a]))
        self.up[b], self.masks[a] = a, self.masks[a] | self.masks[b]
        return True

    def checkpoint(self) -> int:
        return len(self.done)

    def rollback(self, state: int) -> None:
        while len(self.done) > state:
            a, b, mask = self.done.pop()
            self.up[b], self.masks[a] = b, mask


class Program:
    """The linear program of a partition: how much to take of each group so that each of n nodes is covered once, at the
    least cost. groups: a row of nodes each, filled up with n; those of one node come first, in order, and may be barred by
    a high cost, but stay as a way to start. Solved by the revised simplex method, from an earlier basis where there is one."""

    def __init__(self, groups: np.ndarray, n: int, pivots: int = PIVOTS):
        self.groups, self.n, self.left = groups, n, pivots
        # amounts that differ a little keep degenerate steps from going in circles; prices don't depend on them
        self.needed = 1 + np.random.default_rng(7).uniform(0, 1e-4, n)

    def solve(self, cost: np.ndarray, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The prices of the nodes and the basis (its groups, and its inverse)."""
        groups, n = self.groups, self.n
        basis, inverse = (np.arange(n), np.eye(n)) if start is None else (start[0].copy(), start[1].copy())
        size = float(np.median(cost)) or 1.0
        amount, base = inverse @ self.needed, cost[basis].astype(float)
        price, near, turn = np.zeros(n + 1), np.zeros(0, np.int64), 0
        while True:
            price[:n] = base @ inverse
            gain = cost[near] - price[groups[near]].sum(axis=1)
            if not len(near) or gain.min() > -1e-7 * size:
                gain = cost - price[groups].sum(axis=1)
                if gain.min() > -1e-9 * size:
                    return price[:n], (basis, inverse)
                near = np.argpartition(gain, min(200, len(gain) - 1))[:200]
                near = near[gain[near] < 0]
                gain = gain[near]
            turn += 1
            self.left -= 1
            if self.left < 0:
                raise WorkExceeded("too many steps of the linear programs")
            enter = near[gain.argmin()]
            change = inverse[:, groups[enter][groups[enter] < n]].sum(axis=1)
            ratio = np.full(n, np.inf)
            np.divide(amount, change, out=ratio, where=change > 1e-9)
            leave = int(ratio.argmin())
            amount -= ratio[leave] * change
            amount[leave] = ratio[leave]
            row = inverse[leave] / change[leave]
            inverse -= np.outer(change, row)
            inverse[leave] = row
            base[leave], basis[leave] = cost[enter], enter
            if turn % 300 == 0:
                inverse = np.linalg.inv(self.columns(basis))
                amount = inverse @ self.needed

    def columns(self, basis: np.ndarray) -> np.ndarray:
        whole = np.zeros((self.n + 1, self.n))
        whole[self.groups[basis].T, np.arange(self.n)] = 1
        return whole[: self.n]

    def excess(self, cost: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, int]:
        """What each group costs more than its nodes' prices, none less than 0, and all prices, in whole UNITs."""
        whole = np.append(np.floor(price * UNIT), 0).astype(np.int64)
        over = cost * UNIT - whole[self.groups].sum(axis=1)
        if over.min() < 0:
            whole[: self.n] += over.min()  # for what floating point left; a group has a node at least
            over = cost * UNIT - whole[self.groups].sum(axis=1)
        return over, int(whole.sum())

    def least(self, cost: np.ndarray, limit: int, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[int] | None, tuple[np.ndarray, np.ndarray]]:
        """The groups of a partition of the least cost, if that is within the limit, else None; and the basis of the first
        program. Branches on two nodes in one group or apart, where the program takes parts of groups."""
        barred, root = limit + 1, None
        best, stack = None, [(cost, start)]
        while stack:
            own, before = stack.pop()
            price, state = self.solve(own, before)
            root = root or state
            over, floor = self.excess(own, price)
            if -(-floor // UNIT) > limit:
                continue
            amount = state[1].sum(axis=1)
            used = amount > 1e-6
            taken, amount = state[0][used], amount[used]
            if (amount > 1 - 1e-6).all():
                total = int(own[taken].sum())
                if total <= limit:
                    best, limit = taken.tolist(), total - 1
                continue
            together: dict[tuple[int, int], float] = {}
            for g, part in zip(taken.tolist(), amount.tolist(), strict=True):
                nodes = [v for v in self.groups[g].tolist() if v < self.n]
                for i, a in enumerate(nodes):
                    for b in nodes[i + 1 :]:
                        together[a, b] = together.get((a, b), 0.0) + part
            a, b = min((p for p, x in together.items() if 1e-6 < x < 1 - 1e-6), key=lambda p: (abs(together[p] - 0.5), p))
            holds = (self.groups == a).any(axis=1), (self.groups == b).any(axis=1)
            own = np.where(over > (limit + 1) * UNIT - floor, np.maximum(own, barred), own)
            stack.append((np.where(holds[0] & holds[1], np.maximum(own, barred), own), state))
            stack.append((np.where(holds[0] != holds[1], np.maximum(own, barred), own), state))
        return best, root


def best_partition(fields: list[int], ranks: list[int], groups: np.ndarray, weights: np.ndarray, pivots: int = PIVOTS) -> tuple[int, int, list[tuple[int, int]]]:
    """(links, weight, chosen links) of the best forest over nodes 0 .. n - 1 in uid order.

    groups: all legal groups, a row of nodes in ascending order each, filled up with n; weights: of their best trees; those
    of one node come first, in order, and those of two are the links. Fewest objects first, then least weight, then least
    partner lists (by ranks) in node order."""
    n = len(fields)
    cost = weights.astype(np.int64) + int(n * weights.max(initial=0) + 1)
    root = Program(groups, n, pivots)
    price, _ = root.solve(cost)
    over, floor = root.excess(cost, price)
    # costs are whole: the least whole cost above all prices first, then more and more above it
    least, slack, found = -(-floor // UNIT), 0, None
    while found is None:
        limit = least + slack
        kept = np.flatnonzero((over <= limit * UNIT - floor) | (np.arange(len(cost)) < n))
        if len(kept) > TIGHT:
            raise WorkExceeded(f"{len(kept)} groups in question")
        within = Program(groups[kept], n, root.left)
        found, _ = within.least(np.where(over[kept] <= limit * UNIT - floor, cost[kept], limit + 1), limit)
        root.left, slack = within.left, 2 * slack + 1
    chosen: set[tuple[int, int]] = set()
    links = _links(groups, weights, n)
    members = {int(g): [v for v in groups[g].tolist() if v < n] for g in kept}
    open_ = [(list(range(n)), [int(g) for g in kept if over[g] <= limit * UNIT - floor], [int(kept[g]) for g in found])]
    while open_:
        nodes, inside, cover = open_.pop()
        part = Part(nodes, inside, members, {g: int(cost[g]) for g in inside}, sum(int(cost[g]) for g in cover), root)
        split = part.split()
        if len(split) > 1:
            open_ += [(own, groups_, [g for g in cover if members[g][0] in set(own)]) for own, groups_ in split]
        else:
            chosen |= _least_lists(fields, ranks, {g: int(weights[g]) for g in part.inside}, links, part, cover)
        root.left = part.left
    return len(chosen), int(sum(links[e] for e in chosen)), sorted(chosen)


class Part:
    """Nodes that hang together by the groups in question, with the cost of their best partition. Prices of the part alone
    leave out groups that those of the whole couldn't."""

    def __init__(self, nodes: list[int], inside: list[int], members: dict[int, list[int]], cost: dict[int, int], total: int, before: Program):
        self.nodes, self.members, self.total = nodes, members, total
        place, n = {v: i for i, v in enumerate(nodes)}, len(nodes)
        single = {members[g][0]: g for g in inside if len(members[g]) == 1}
        rest = [g for g in inside if len(members[g]) > 1]
        width = max((len(members[g]) for g in inside), default=1)
        rows = [[place[v]] for v in nodes] + [[place[v] for v in members[g]] for g in rest]
        self.ids = [single.get(v, -1) for v in nodes] + rest
        self.program = Program(np.array([r + [n] * (width - len(r)) for r in rows]), n, before.left)
        self.cost = np.array([cost.get(g, total + 1) for g in self.ids], np.int64)
        price, self.state = self.program.solve(self.cost)
        over, floor = self.program.excess(self.cost, price)
        self.inside = [g for g, e in zip(self.ids, over.tolist(), strict=True) if g >= 0 and e <= total * UNIT - floor]

    @property
    def left(self) -> int:
        return self.program.left

    def split(self) -> list[tuple[list[int], list[int]]]:
        """The nodes and groups that still hang together, apart."""
        whole = FieldForest(1 << i for i in range(len(self.nodes)))
        place = {v: i for i, v in enumerate(self.nodes)}
        for g in self.inside:
            for v in self.members[g][1:]:
                whole.union(place[self.members[g][0]], place[v])
        out: dict[int, tuple[list[int], list[int]]] = {}
        for v in self.nodes:
            out.setdefault(whole.root(place[v]), ([], []))[0].append(v)
        for g in self.inside:
            out[whole.root(place[self.members[g][0]])][1].append(g)
        return list(out.values())

    def cover(self, alive: set[int]) -> list[int] | None:
        """A best partition of the part by groups of `alive`, or None."""
        open_ = np.array([g in alive for g in self.ids])
        found, state = self.program.least(np.where(open_, self.cost, self.total + 1), self.total, self.state)
        if found is None:
            return None
        self.state = state
        return [self.ids[i] for i in found]


def _links(groups: np.ndarray, weights: np.ndarray, n: int) -> dict[tuple[int, int], int]:
    two = groups[n:][(groups[n:] < n).sum(axis=1) == 2][:, :2]
    of = weights[n:][(groups[n:] < n).sum(axis=1) == 2]
    return {(int(a), int(b)): int(w) for (a, b), w in zip(two, of, strict=True)}


def _least_lists(fields: list[int], ranks: list[int], sizes: dict[int, int], links: dict[tuple[int, int], int], part: Part, found: list[int]) -> set[tuple[int, int]]:
    """The links of the best partition of a part with the least partner lists, fixed node by node and partner by partner."""
    n, own = len(fields), set(part.nodes)
    members = part.members
    of_node: list[list[int]] = [[] for _ in range(n)]
    for g in part.inside:
        for v in members[g]:
            of_node[v].append(g)
    partners: list[list[int]] = [[] for _ in range(n)]
    for a, b in links:
        if a not in own or b not in own:
            continue
        partners[a].append(b)
        partners[b].append(a)
    forest, inner = FieldForest(1 << f for f in fields), {}
    forced, barred = set(), set()
    link = lambda a, b: (a, b) if a < b else (b, a)

    def tree(g: int) -> list[tuple[int, int]] | None:
        """A best tree of the group with the links forced in and without those forced out, if it weighs no more."""
        nodes = members[g]
        if g not in inner:
            inner[g] = sorted((links[a, b], a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a, b) in links)
        state, chosen, weight = forest.checkpoint(), [], 0
        for first in (True, False):
            for w, a, b in inner[g]:
                if ((a, b) in forced) == first and (a, b) not in barred:
                    if forest.union(a, b):
                        chosen.append((a, b))
                        weight += w
                    elif first:
                        weight = sizes[g] + 1
        forest.rollback(state)
        return chosen if weight == sizes[g] and len(chosen) == len(nodes) - 1 else None

    alive = set(part.inside)
    witness = {e for g in found for e in tree(g)}

    def feasible(v: int, add: set, drop: set) -> bool:
        """Whether a best partition exists with more links of node v forced in and out; if so, they stay."""
        nonlocal alive, witness, forced, barred
        if add <= witness and not drop & witness:
            forced |= add
            barred |= drop
            alive -= {g for g in alive & touched(v, add) if not fits(g)}
            return True
        before = forced, barred
        forced, barred = forced | add, barred | drop
        gone = {g for g in alive & touched(v, add) if not fits(g)}
        cover = part.cover(alive - gone)
        if cover is None:
            forced, barred = before
            return False
        alive -= gone
        witness = {e for g in cover for e in tree(g)}
        return True

    def touched(v: int, add: set) -> set[int]:
        return set(of_node[v]).union(*(of_node[x] for e in add for x in e))

    def fits(g: int) -> bool:
        nodes = set(members[g])
        return all((a in nodes) == (b in nodes) for a, b in forced) and tree(g) is not None

    for v in part.nodes:
        order = sorted(partners[v], key=ranks.__getitem__)
        placed = [p for p in order if link(v, p) in forced]
        open_ = [p for p in order if link(v, p) not in forced and link(v, p) not in barred]
        while open_:
            if not placed and feasible(v, set(), {link(v, p) for p in open_}):
                break
            below = [p for p in open_ if not placed or ranks[p] < ranks[placed[0]]]
            taken = next((p for i, p in enumerate(below) if feasible(v, {link(v, p)}, {link(v, q) for q in below[:i]})), None)
            if taken is not None:
                open_ = [p for p in open_ if ranks[p] > ranks[taken]]
                continue
            # the next forced partner comes before what is open above it
            feasible(v, set(), {link(v, p) for p in below})
            open_ = [p for p in open_ if ranks[p] > ranks[placed[0]]]
            placed.pop(0)
    return witness
