"""Least covers of a bundle's structures by chains: overlap graph by a sweep, contraction, minimum-cost matching, paths.

Structures are nodes; one comes before another if it begins and ends no later, they overlap and their gaps agree where they do. That
relation is a partial order once it is closed, and a maximum matching of its pairs leaves the least number of chains (Dilworth);
among these a chain's neighbours are to be spliced in alike. A chain may pass through nodes of others, which share what they cover.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np

Blocks = list[tuple[int, int]]

#: Costs are in millionths of the log of what two neighbours' shares have in common; the last stands for pairs that can't be judged.
COST_UNIT, LEAST_COST, NO_COST = 1e6, 1, 999_999_999


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits."""
    h = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Structures:
    """Structures in order of their start, end and blocks, with the gaps of all in one array."""

    def __init__(self, blocks: list[Blocks]):
        self.blocks = blocks
        self.n = len(blocks)
        self.lo = np.array([b[0][0] for b in blocks], np.int64)
        self.hi = np.array([b[-1][1] for b in blocks], np.int64)
        self.bases = np.array([sum(y - x for x, y in b) for b in blocks], np.int64)
        gaps = [[(x[1], y[0]) for x, y in zip(b, b[1:], strict=False)] for b in blocks]
        self.n_gaps = np.array([len(g) for g in gaps], np.int64)
        numbers: dict[tuple[int, int], int] = {}
        which = np.array([numbers.setdefault(g, len(numbers)) for row in gaps for g in row], np.int64)
        flat = np.array([g for row in gaps for g in row], np.int64).reshape(-1, 2)
        # Each different gap has a mixed number; equal sums of 64 bits stand for equal sets.
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(which), dtype=np.uint64)])
        #: The only gap of a structure that has one.
        self.single = np.full(self.n, -1)
        first = np.cumsum(self.n_gaps) - self.n_gaps
        one = self.n_gaps == 1
        self.single[one] = which[first[one]]
        base = int(self.lo.min(initial=0))
        self.reach = int(self.hi.max(initial=0)) - base + 1
        owner = np.repeat(np.arange(self.n), self.n_gaps)
        self.base, self.ends, self.starts = base, owner * self.reach + flat[:, 1] - base, owner * self.reach + flat[:, 0] - base

    def _inside(self, which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A number for the gaps of each structure that reach into [lo, hi)."""
        offset = which * self.reach - self.base
        a, b = np.searchsorted(self.ends, offset + lo, "right"), np.searchsorted(self.starts, offset + hi, "left")
        return self.sums[np.maximum(a, b)] - self.sums[a]

    def agree(self, i: int, others: np.ndarray) -> np.ndarray:
        """Whether structure i overlaps each of the others and has the same gaps where it does."""
        lo, hi = np.maximum(self.lo[i], self.lo[others]), np.minimum(self.hi[i], self.hi[others])
        out = lo < hi
        some = np.flatnonzero(out)
        here = np.full(len(some), i)
        out[some] = self._inside(here, lo[some], hi[some]) == self._inside(others[some], lo[some], hi[some])
        return out


def _bits(mask: np.ndarray) -> int:
    return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")


def _members(bits: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n])


def holders(s: Structures) -> list[int]:
    """For each structure the first one, by start and then the longest, that it lies in and agrees with: itself if there is none."""
    out = list(range(s.n))
    order = np.lexsort((-s.hi, s.lo))
    kept: list[int] = []
    open_until: list[tuple[int, int]] = []
    active = np.zeros(0, np.int64)
    for j in order.tolist():
        while open_until and open_until[0][0] <= s.lo[j]:
            heapq.heappop(open_until)
        if len(active) > 2 * len(open_until) + 16:
            active = active[s.hi[active] > s.lo[j]]
        around = active[s.hi[active] >= s.hi[j]]
        around = around[s.agree(j, around)] if len(around) else around
        if len(around):
            out[j] = int(around[0])
        else:
            kept.append(j)
            active = np.append(active, j)
            heapq.heappush(open_until, (int(s.hi[j]), j))
    return out


def overlap_graph(s: Structures) -> tuple[list[list[int]], list[int]]:
    """(direct successors, all predecessors as bits) of each structure, none of which may lie in another that it agrees with.

    Structures come by start; those whose end is passed leave the active ones. Of the active ones that agree with a new one the
    latest come first, and what precedes one of them is not joined again: the edges are those of the transitive reduction.
    """
    after: list[list[int]] = [[] for _ in range(s.n)]
    above = [0] * s.n
    active = np.zeros(0, np.int64)
    for j in range(s.n):
        active = active[s.hi[active] > s.lo[j]]
        near = active[s.hi[active] <= s.hi[j]]
        near = near[s.agree(j, near)] if len(near) else near
        reached = 0
        for i in near[::-1].tolist():
            if not reached >> i & 1:
                after[i].append(j)
                reached |= above[i] | 1 << i
        above[j] = reached
        active = np.append(active, j)
    return after, above


def contracted(after: list[list[int]]) -> list[list[int]]:
    """Runs of nodes of which each is the only successor of the one before, which is its only predecessor."""
    n = len(after)
    before = [0] * n
    for row in after:
        for j in row:
            before[j] += 1
    follows = [row[0] if len(row) == 1 and before[row[0]] == 1 else -1 for row in after]
    inner = {j for j in follows if j >= 0}
    runs = []
    for i in range(n):
        if i not in inner:
            run = [i]
            while follows[run[-1]] >= 0:
                run.append(follows[run[-1]])
            runs.append(run)
    return runs


def merged(parts: list[Blocks]) -> Blocks:
    """The union of the blocks of structures."""
    out: list[list[int]] = []
    for lo, hi in sorted(x for b in parts for x in b):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def spliced_in(nodes: Structures, hits: Structures, mass: np.ndarray) -> np.ndarray:
    """Each node's density of hits that it holds, as a share of those of all nodes that overlap it: what agrees with it over all."""
    both = Structures(nodes.blocks + hits.blocks)
    n = nodes.n
    order = np.argsort(hits.lo, kind="stable")
    density = np.zeros(n)
    for i in range(n):
        a, b = np.searchsorted(hits.lo[order], [nodes.lo[i], nodes.hi[i]], "left")
        inside = order[a:b]
        inside = inside[hits.hi[inside] <= nodes.hi[i]]
        density[i] = mass[inside[both.agree(i, n + inside)]].sum() / max(1, nodes.bases[i])
    every = np.arange(n)
    out = np.zeros(n)
    for i in range(n):
        overlap = every[(nodes.lo < nodes.hi[i]) & (nodes.hi > nodes.lo[i])]
        total = density[overlap].sum()
        if total > 0:
            out[i] = density[overlap[both.agree(i, overlap)]].sum() / total
    return out


def costs(s: Structures, share: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Of following structure i by each of the others: less the more alike their shares. Two with the same only gap tell nothing."""
    with np.errstate(divide="ignore"):
        alike = -np.log1p(-np.abs(share[i] - share[others])) * COST_UNIT
    out = np.clip(np.rint(np.minimum(alike, NO_COST - 1)), LEAST_COST, NO_COST - 1).astype(np.int64)
    same = (s.single[others] == s.single[i]) & (s.single[i] >= 0) & (s.lo[others] < s.hi[i]) & (s.lo[i] < s.hi[others])
    out[same | (share[others] <= 0) | (share[i] <= 0)] = NO_COST
    return out


def matching(n: int, row: list[np.ndarray], cost: list[np.ndarray]) -> list[int]:
    """For each left node its right node or -1: of all matchings with the most pairs one of least total cost.

    row[i], cost[i]: the right nodes of left node i, and what each pair costs. Shortest augmenting paths with potentials; a
    node that finds no free partner may take one away from another that then goes without, if that is cheaper.
    """
    far = np.int64(1 << 60)
    to, of = [-1] * n, np.full(n, -1)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # A node left alone costs more than any set of pairs, so that the most pairs are made first.
    alone = np.int64((n + 1) * NO_COST)
    for start in range(n):
        if not len(row[start]):
            continue
        distance, parent = np.full(n, far), np.full(n, -1)
        done = np.zeros(n, bool)
        i, base = start, np.int64(0)
        tree: list[tuple[int, np.int64]] = []
        best_alone, who = far, -1
        while True:
            tree.append((i, base))
            # Its own place of being alone ends the path here.
            own = base + alone - left[i]
            if own < best_alone:
                best_alone, who = own, i
            here = base + cost[i] - left[i] - right[row[i]]
            better = (here < distance[row[i]]) & ~done[row[i]]
            at = row[i][better]
            distance[at], parent[at] = here[better], i
            open_ = np.where(done, far, distance)
            j = int(open_.argmin())
            if open_[j] >= best_alone:
                total, end = best_alone, -1
                break
            done[j] = True
            base = distance[j]
            if of[j] < 0:
                total, end = base, j
                break
            i = int(of[j])
        # New potentials keep all reduced costs of pairs at zero or more, those of matched pairs at zero.
        for k, at in tree:
            left[k] += total - at
        seen = np.flatnonzero(done & (distance < total))
        right[seen] -= total - distance[seen]
        if end < 0:
            end = to[who]
            to[who] = -1
            if end >= 0:
                of[end] = -1
            if who == start:
                continue
        # Along the path each node takes the partner that was found for it.
        while end >= 0:
            i = int(parent[end])
            before = to[i]
            to[i], of[end] = end, i
            if i == start:
                break
            end = before
    return to


def chains(blocks: list[Blocks], mass: np.ndarray, hits: list[Blocks] | None = None, hit_mass: np.ndarray | None = None) -> tuple[list[list[int]], list[list[int]]]:
    """(chains, paths): a least cover of structures by chains, of least cost, and each chain as a path of the graph from end to end.

    blocks are in order of start, end and blocks, and none lies in another that it agrees with. hits: what shares are counted from.
    """
    s = Structures(blocks)
    after, _ = overlap_graph(s)
    runs = contracted(after)
    runs.sort(key=lambda r: (s.lo[r[0]], s.hi[r[-1]], r[0]))
    of_node = {k: r for r, run in enumerate(runs) for k in run}
    m = len(runs)
    step = [[of_node[j] for j in after[run[-1]]] for run in runs]
    if not any(step):
        return runs, runs
    into: list[list[int]] = [[] for _ in range(m)]
    for a, row in enumerate(step):
        for b in row:
            into[b].append(a)
    # Every node's predecessors, in an order in which these come first.
    above, waiting, order = [0] * m, [len(x) for x in into], deque()
    order.extend(k for k in range(m) if not waiting[k])
    below = [0] * m
    line = []
    while order:
        a = order.popleft()
        line.append(a)
        for b in step[a]:
            above[b] |= above[a] | 1 << a
            waiting[b] -= 1
            if not waiting[b]:
                order.append(b)
    for a in reversed(line):
        for b in step[a]:
            below[a] |= below[b] | 1 << b
    nodes = Structures([merged([blocks[k] for k in run]) for run in runs])
    share = spliced_in(nodes, s if hits is None else Structures(hits), mass if hit_mass is None else hit_mass)
    row = [_members(x, m) for x in below]
    to = matching(m, row, [costs(nodes, share, i, r) for i, r in enumerate(row)])
    followed = {j for j in to if j >= 0}
    found, paths = [], []
    for k in range(m):
        if k not in followed:
            chain = [k]
            while to[chain[-1]] >= 0:
                chain.append(to[chain[-1]])
            path = [chain[0]]
            for b in chain[1:]:
                path += _way(step, path[-1], b, above)
            while into[path[0]]:
                path.insert(0, _alike(nodes, share, path[0], into[path[0]]))
            while step[path[-1]]:
                path.append(_alike(nodes, share, path[-1], step[path[-1]]))
            found.append([x for r in chain for x in runs[r]])
            paths.append([x for r in path for x in runs[r]])
    return found, paths


def _alike(s: Structures, share: np.ndarray, i: int, others: list[int]) -> int:
    """The one of others that costs least beside i; ties to the first."""
    return others[int(costs(s, share, i, np.array(others)).argmin())]


def _way(step: list[list[int]], a: int, b: int, above: list[int]) -> list[int]:
    """The nodes after a of a path with the fewest edges to b."""
    came: dict[int, int] = {a: -1}
    line = deque([a])
    while b not in came:
        x = line.popleft()
        for y in step[x]:
            if y not in came and (y == b or above[b] >> y & 1):
                came[y] = x
                line.append(y)
    out = [b]
    while came[out[-1]] != a:
        out.append(came[out[-1]])
    return out[::-1]


def models(blocks: list[Blocks], mass: np.ndarray) -> list[tuple[Blocks, float]]:
    """(exons, mass) of each chain's path. A structure's mass goes to the paths through it, by what each has to itself."""
    if len(blocks) == 1:
        return [(blocks[0], float(mass[0]))]
    held = holders(Structures(blocks))
    kept = sorted(set(held), key=lambda k: (blocks[k][0][0], blocks[k][-1][1], blocks[k]))
    if len(kept) == 1:
        return [(blocks[kept[0]], float(mass.sum()))]
    place = {k: i for i, k in enumerate(kept)}
    weight = np.zeros(len(kept))
    np.add.at(weight, [place[k] for k in held], mass)
    _, paths = chains([blocks[k] for k in kept], weight, blocks, mass)
    through = np.bincount(np.concatenate([np.array(p) for p in paths]), minlength=len(kept))
    alone = np.array([weight[[k for k in p if through[k] == 1]].sum() for p in paths])
    total = np.zeros(len(kept))
    for p, a in zip(paths, alone, strict=True):
        total[p] += a
    out = []
    for p, a in zip(paths, alone, strict=True):
        out.append((merged([blocks[kept[k]] for k in p]), float(sum(weight[k] * (a / total[k] if total[k] > 0 else 1 / through[k]) for k in p))))
    return out
