"""Suffix and common-prefix arrays of a byte text by external induced sorting.

A suffix is sorted by what its successor's place induces, so nothing but queues is needed: a monotone priority
queue with one lane for each first byte, in which tuples (suffix, common prefix with the lane's last tuple) wait
in order of arrival.  The seeds, the leftmost suffixes of each rising run, come first: the same induction, begun with the seeds in the
order of the text, sorts their substrings; equal ones get one name; and the string of names, at most half as long, is
sorted by recursion, in which a lane stands for a range of names.  A name of the k-th recursion spans 2 ** k bytes or more, so the
recursion ends where names span ``depth`` bytes, or before where all names differ or the string of names fits in memory.

Whatever grows with the text (types, seeds, names, lanes, orders) is in memory up to ``budget`` bytes each and beyond in a
file that has no name, so that nothing is left behind, in the task's own temporary folder: up to 60 bytes for each byte of the text.  A
string of names that fits the budget is the recursion's base: it is sorted in memory, by ranks that are doubled.

Common prefixes count up to ``depth`` bytes; suffixes that agree so far may stand in either order.  No end mark is needed: what is
behind the text counts as smaller than any byte.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

BUDGET, BLOCK = 32 << 20, 1 << 20
NAME_BYTES = 48  #: what a name takes while a string of names is sorted in memory, which may take twice the budget
LANE_NAMES = 8192  #: suffixes in a lane of names, about
_DTYPE = np.dtype([("at", "<i8"), ("lcp", "u1")])
_AT = np.dtype("<i8")


def room(n: int, kind, budget: int) -> np.ndarray:
    """An array of n zeros, in a file if it is larger than the budget."""
    if n * np.dtype(kind).itemsize <= budget:
        return np.zeros(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


class Spool:
    """An array that grows at its end, beyond ``budget`` bytes in a file."""

    def __init__(self, kind, budget: int = BUDGET):
        self.kind, self.budget, self.parts, self.n, self.file = np.dtype(kind), budget, [], 0, None

    def put(self, a) -> None:
        a = np.ascontiguousarray(a, self.kind)
        self.n += len(a)
        self.parts.append(a)
        if self.file is not None or self.n * self.kind.itemsize > self.budget:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # noqa: SIM115
            for p in self.parts:
                self.file.write(p.tobytes())
            self.parts = []

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.empty(0, self.kind)
        self.file.flush()
        return np.memmap(self.file, self.kind, "r+", shape=(self.n,))


def blocks(n: int, size: int | None = None) -> Iterator[tuple[int, int]]:
    size = size or BLOCK
    for s in range(0, n, size):
        yield s, min(s + size, n)


class Lanes:
    """Tuples (position, common prefix), or positions alone, in lanes, first in first out, beyond ``budget`` bytes on disk."""

    def __init__(self, budget: int = BUDGET, kind: np.dtype = _DTYPE):
        self.lanes: dict[int, list] = {}
        self.held, self.budget, self.file, self.kind = 0, budget, None, kind

    def put(self, lane: int, at: np.ndarray, lcp: np.ndarray | None = None) -> None:
        if lcp is None:
            block = np.array(at, self.kind)
        else:
            block = np.empty(len(at), self.kind)
            block["at"], block["lcp"] = at, lcp
        self.lanes.setdefault(lane, []).append(block)
        self.held += block.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115
        self.file.seek(0, 2)
        for waiting in self.lanes.values():
            kept, here = [], []
            for b in [*waiting, None]:
                if isinstance(b, np.ndarray):
                    here.append(b)
                    continue
                if here:  # what stands in memory of a lane becomes one piece of the file
                    whole = here[0] if len(here) == 1 else np.concatenate(here)
                    for s, e in blocks(len(whole)):
                        kept.append((self.file.tell(), e - s))
                        self.file.write(whole[s:e].tobytes())
                    here = []
                if b is not None:
                    kept.append(b)
            waiting[:] = kept
        self.held = 0

    def _load(self, block) -> np.ndarray:
        if isinstance(block, tuple):
            self.file.seek(block[0])
            return np.frombuffer(self.file.read(block[1] * self.kind.itemsize), self.kind)
        return block

    def pop(self, lane: int) -> Iterator[np.ndarray]:
        """The lane's tuples in blocks; what is put meanwhile comes too."""
        waiting = self.lanes.get(lane, [])
        while waiting:
            part, n, k = [], 0, 0
            while k < len(waiting) and n < BLOCK:
                b = waiting[k]
                if isinstance(b, np.ndarray):
                    self.held -= b.nbytes
                part.append(self._load(b))
                n += len(part[-1])
                k += 1
            del waiting[:k]
            yield part[0] if len(part) == 1 else np.concatenate(part)

    def read(self, lane: int, backwards: bool = False) -> Iterator[np.ndarray]:
        waiting = self.lanes.get(lane, [])
        for b in reversed(waiting) if backwards else waiting:
            yield self._load(b)[::-1] if backwards else self._load(b)

    def close(self) -> None:
        self.lanes = {}
        if self.file is not None:
            self.file.close()


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value in low..high, both included, by doubled minima."""
    if not len(low):
        return values[:0]
    level = np.frexp((high - low + 1).astype(float))[1] - 1
    out = np.empty(len(low), values.dtype)
    table, k = values, 0
    while True:
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << k) + 1])
        k += 1
        if 1 << k > len(values) or k > level.max():
            return out
        table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])


class _Induction:
    """One pass: hands each processed suffix's predecessor, if of the wanted type, to the lane of its first byte."""

    def __init__(self, text, rise, wanted: bool, lanes: Lanes, depth: int):
        self.text, self.rise, self.wanted, self.lanes, self.depth = text, rise, wanted, lanes, depth
        self.since = np.full(256, -1, np.int16)  # least prefix since a lane's last arrival; -1 before the first

    def process(self, at: np.ndarray, lcp: np.ndarray) -> None:
        lcp = lcp.astype(np.int16)
        before = at - 1
        idx = np.flatnonzero(before >= 0)
        idx = idx[self.rise[before[idx]] == self.wanted]
        least = lcp.min()
        if not len(idx):
            np.minimum(self.since, least, out=self.since)
            return
        lane = self.text[before[idx]]
        order = np.argsort(lane, kind="stable")
        idx, lane = idx[order], lane[order]
        first = np.append(True, lane[1:] != lane[:-1])
        low = np.where(first, 0, np.append(0, idx[:-1] + 1))
        shared = _range_min(lcp, low, idx)
        shared[first] = np.minimum(shared[first], self.since[lane[first]])
        shared = np.minimum(shared + 1, self.depth).astype(np.uint8)
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(idx))
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.int16(255))
        np.minimum(self.since, least, out=self.since)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            c = int(lane[s])
            self.lanes.put(c, before[idx[s:e]], shared[s:e])
            self.since[c] = after[idx[e - 1] + 1]


def _types(text: np.ndarray, budget: int) -> np.ndarray:
    """Whether the text rises from each place on, that is, its suffix is smaller than the next one."""
    rise = room(len(text), bool, budget)
    char, up = -1, False
    for s, e in reversed(list(blocks(len(text)))):
        here = text[s:e].astype(np.int64)
        behind = np.append(here[1:], char)
        differs = np.where(here != behind, np.arange(e - s), e - s)
        known = np.minimum.accumulate(differs[::-1])[::-1]  # the next place that differs from what is behind it
        rise[s:e] = np.append(here < behind, up)[known]
        char, up = int(here[0]), bool(rise[s])
    return rise


def _seeds(rise: np.ndarray, budget: int) -> np.ndarray:
    found = Spool(np.int64, budget)
    for s, e in blocks(len(rise) - 1):
        found.put(np.flatnonzero(rise[s + 1 : e + 1] & ~rise[s:e]) + s + 1)
    return found.array()


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; a view, for places that have eight."""
    return np.ndarray((max(0, len(text) - 7),), ">u8", text, strides=(1,))


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of suffixes a and b, up to depth."""
    n, words, out = len(text), _words(text), np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(0, depth, 8):
        i, j = a[live] + k, b[live] + k
        whole = np.maximum(i, j) + 8 <= n
        for r in np.flatnonzero(~whole).tolist():  # at most eight places are near the end
            x, y = text[i[r] : i[r] + 8], text[j[r] : j[r] + 8]
            m = max(0, min(len(x), len(y)))
            differs = np.flatnonzero(x[:m] != y[:m])
            out[live[r]] = k + (int(differs[0]) if len(differs) else m)
        live, i, j = live[whole], i[whole], j[whole]
        gap = words[i] ^ words[j]
        same = gap == 0
        out[live] = k + np.where(same, 8, (63 - np.frexp(gap.astype(np.longdouble))[1] + 1) // 8)  # leading equal bytes of a word
        live = live[same]
    return np.minimum(out, depth)


def _doubled(rank: np.ndarray, cap: int) -> np.ndarray:
    """Places of a string of names in order of its suffixes, as far as ``cap`` names tell, in memory."""
    m = len(rank)
    order = np.argsort(rank, kind="stable")
    rank = rank.copy()
    first = np.append(True, rank[order][1:] != rank[order][:-1])
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]  # a group's rank is where it starts
    step = 1
    while step < cap:
        alone = first & np.append(first[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        sub = order[tied]
        after = np.zeros(len(sub), np.int64)
        inside = sub + step < m
        after[inside] = rank[sub[inside] + step] + 1
        key = rank[sub] * (m + 1) + after
        by = np.argsort(key, kind="stable")
        sub, key = sub[by], key[by]
        order[tied] = sub
        new = np.append(True, key[1:] != key[:-1])
        first[tied] = new
        rank[sub] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
        step *= 2
    return order


class _Lane:
    """Lanes of characters: of one each, or of ranges of names.  ``of`` tells the lane of a character."""

    def __init__(self, of: np.ndarray, single: np.ndarray):
        self.of, self.single, self.n = of, single, len(single)


def _byte_lanes() -> _Lane:
    return _Lane(np.arange(256, dtype=np.uint8), np.ones(256, bool))


def _name_lanes(names: np.ndarray, kinds: int, budget: int) -> _Lane:
    """Ranges of about LANE_NAMES suffixes; a name that stands beside itself has a lane of its own, as its runs are worked off there."""
    count, runs = room(kinds, np.int64, budget), room(kinds, bool, budget)
    for s, e in blocks(len(names)):
        np.add.at(count, names[s:e], 1)
        here = names[s : min(e + 1, len(names))]
        runs[here[:-1][here[1:] == here[:-1]]] = True
    of, single, lane, used = room(kinds, np.int32, budget), [], -1, 0
    alone = True
    for s, e in blocks(kinds):
        for c, (n, run) in enumerate(zip(count[s:e].tolist(), runs[s:e].tolist(), strict=True), s):
            own = run or n > LANE_NAMES
            if own or alone or used + n > LANE_NAMES:
                lane, used = lane + 1, 0
                single.append(own)
                alone = own
            used += n
            of[c] = lane
    if lane < 1 << 16:  # numbers of two bytes are grouped faster
        small = room(kinds, np.uint16, budget)
        for s, e in blocks(kinds):
            small[s:e] = of[s:e]
        of = small
    return _Lane(of, np.array(single, bool))


def _pass(text: np.ndarray, rise: np.ndarray, wanted: bool, lane: _Lane, waiting: Lanes, fixed: Callable, out: Callable) -> None:
    """One induction without common prefixes: falling suffixes in ascending order of lanes, or rising ones (``wanted``) in descending order.

    ``fixed`` gives a lane's suffixes of the other type in the order of work; ``out`` takes those of the wanted type.
    """

    def push(at: np.ndarray, here: int = -1) -> None:
        before = at - 1
        before = before[before >= 0]
        before = before[rise[before] == wanted]
        to = lane.of[text[before]]
        if here >= 0:
            before, to = before[to != here], to[to != here]
        order = np.argsort(to, kind="stable")
        before, to = before[order], to[order]
        cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)) if len(to) else np.zeros(1, int)
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            waiting.put(int(to[s]), before[s:e])

    sign = -1 if wanted else 1
    if not wanted:  # the place behind the text is smaller than all
        push(np.array([len(text)]))
    for b in range(lane.n)[::sign]:
        if lane.single[b]:
            for at in waiting.pop(b):
                out(b, at)
                push(at)
            for at in fixed(b):
                push(at)
            continue
        own, other = (np.concatenate([*parts, np.empty(0, np.int64)]) for parts in (list(waiting.pop(b)), list(fixed(b))))
        at = np.append(own, other)
        if not len(at):
            continue
        kind, tie, parent = np.repeat([0, 2], (len(own), len(other))), np.append(np.arange(len(own)), np.arange(len(other))), np.full(len(at), -1)
        start, generations = 0, 0
        while True:  # predecessors that come into this lane too
            before = at[start:] - 1
            ok = before >= 0
            ok[ok] = (rise[before[ok]] == wanted) & (lane.of[text[before[ok]]] == b)
            if not ok.any():
                break
            child = np.flatnonzero(ok) + start
            start, generations = len(at), generations + 1
            at, kind, tie, parent = np.append(at, at[child] - 1), np.append(kind, np.ones(len(child), int)), np.append(tie, tie[child]), np.append(parent, child)
        char = sign * text[at].astype(np.int64)
        rank, young = np.empty(len(at), np.int64), np.flatnonzero(parent >= 0)
        for _ in range(generations + 1):  # a suffix stands as its successor does
            order = np.lexsort((tie, kind, char))
            rank[order] = np.arange(len(order))
            tie[young] = rank[parent[young]]
        at, kind = at[order], kind[order]
        out(b, at[kind < 2])
        push(at, b)


def _of_lanes(at: np.ndarray, text: np.ndarray, lane: _Lane, budget: int) -> Lanes:
    """Positions in their order, each in the lane of its character."""
    found = Lanes(budget, _AT)
    for s, e in blocks(len(at)):
        here = at[s:e]
        to = lane.of[text[here]]
        order = np.argsort(to, kind="stable")
        to, here = to[order], here[order]
        cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            found.put(int(to[a]), here[a:b])
    return found


def _both_passes(text, rise, lane: _Lane, seeds: Lanes, budget: int, rising_out: Callable) -> Lanes:
    """Falling suffixes from the seeds' order, kept; rising ones from these, handed to ``rising_out``."""
    falling, waiting = Lanes(budget, _AT), Lanes(budget, _AT)
    _pass(text, rise, False, lane, waiting, seeds.read, falling.put)
    waiting.close()
    waiting = Lanes(budget, _AT)
    _pass(text, rise, True, lane, waiting, lambda b: falling.read(b, backwards=True), rising_out)
    waiting.close()
    return falling


def _seed_order(text: np.ndarray, rise: np.ndarray, seeds: np.ndarray, lane: _Lane, cap: int, budget: int) -> np.ndarray:
    """Seeds in order of their suffixes, as far as ``cap`` characters tell: by their substrings, then by recursion on names."""
    m = len(seeds)
    found = Spool(np.int64, budget)  # largest first

    def take(_, at: np.ndarray) -> None:
        at = at[at > 0]
        found.put(at[~rise[at - 1]])

    waiting = _of_lanes(seeds, text, lane, budget)
    _both_passes(text, rise, lane, waiting, budget, take).close()
    waiting.close()
    by_part = found.array()  # seeds by their substrings, largest first
    number = room(len(text), np.int32 if m < 1 << 31 else np.int64, budget)
    for s, e in blocks(m):
        number[seeds[s:e]] = np.arange(s, e)
    names, kinds, last = room(m, np.int64, budget), 0, None
    for e, s in ((m - a, max(0, m - a - BLOCK)) for a in range(0, m, BLOCK)):
        here = by_part[s:e][::-1]
        index = number[here].astype(np.int64)
        before = np.append(index[:1] if last is None else last, index[:-1])
        new = ~_same_part(text, seeds, before, index, cap)
        new[0] |= last is None
        name = kinds - 1 + np.cumsum(new)
        names[index] = name
        kinds, last = int(name[-1]) + 1, index[-1]
    if kinds == m:
        out = Spool(np.int64, budget)
        for e, s in ((m - a, max(0, m - a - BLOCK)) for a in range(0, m, BLOCK)):
            out.put(by_part[s:e][::-1])
        return out.array()
    return _by_index(seeds, _name_order(names, kinds, cap // 2 + 1, budget), budget)


def _by_index(values: np.ndarray, index: np.ndarray, budget: int) -> np.ndarray:
    out = room(len(index), np.int64, budget)
    for s, e in blocks(len(index)):
        out[s:e] = values[index[s:e]]
    return out


def _same_part(text: np.ndarray, seeds: np.ndarray, i: np.ndarray, j: np.ndarray, cap: int) -> np.ndarray:
    """Whether the substrings of two seeds (by index) are equal, or agree in their first ``cap`` characters; the last seed's equals none."""
    m, a, b = len(seeds), seeds[i], seeds[j]
    inner = (i < m - 1) & (j < m - 1)
    size_a, size_b = seeds[np.minimum(i + 1, m - 1)] - a, seeds[np.minimum(j + 1, m - 1)] - b
    same = inner & ((size_a == size_b) | (np.minimum(size_a, size_b) >= cap))
    live, k = np.flatnonzero(same), 0
    if text.dtype == np.uint8:  # eight at a time, but for what is near the end
        words = _words(text)
        near = np.maximum(a[live], b[live]) + np.minimum(size_a[live] + 1, cap) + 8 > len(text)
        rest, live = live[near], live[~near]
        while len(live):
            left = np.minimum(size_a[live] + 1, cap) - k
            gap = (words[a[live] + k] ^ words[b[live] + k]) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
            same[live[gap != 0]] = False
            k += 8
            live = live[(gap == 0) & (left > 8)]
        live, k = rest, 0
    while len(live):
        equal = text[a[live] + k] == text[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal & (size_a[live] >= k) & (k < cap)]
    return same


def _name_order(names: np.ndarray, kinds: int, cap: int, budget: int) -> np.ndarray:
    """Places of a string of names in order of its suffixes, as far as ``cap`` names tell."""
    m = len(names)
    if m * NAME_BYTES <= 2 * budget:
        return _doubled(np.array(names, np.int64), cap)
    lane = _name_lanes(names, kinds, budget)
    out = Spool(np.int64, budget)
    if cap <= 1:
        all_of = Lanes(budget, _AT)
        for s, e in blocks(m):
            part = _of_lanes(np.arange(s, e), names, lane, budget)
            for b in sorted(part.lanes):
                for at in part.read(b):
                    all_of.put(b, at)
            part.close()
        for b in range(lane.n):
            parts = list(all_of.read(b))
            if lane.single[b]:
                for x in parts:
                    out.put(x)
            elif parts:
                at = np.concatenate(parts)
                out.put(at[np.argsort(names[at], kind="stable")])
        all_of.close()
        return out.array()
    rise = _types(names, budget)
    seeds = _seeds(rise, budget)
    order = _seed_order(names, rise, seeds, lane, cap, budget) if len(seeds) > 1 else seeds
    waiting, rising = _of_lanes(order, names, lane, budget), Lanes(budget, _AT)
    falling = _both_passes(names, rise, lane, waiting, budget, rising.put)
    waiting.close()
    for b in range(lane.n):
        parts = list(falling.read(b)), list(rising.read(b, backwards=True))
        if lane.single[b]:
            for x in (*parts[0], *parts[1]):
                out.put(x)
        elif parts[0] or parts[1]:
            at = np.concatenate([*parts[0], *parts[1]])
            out.put(at[np.argsort(names[at], kind="stable")])  # falling ones of a name stand before rising ones
    falling.close()
    rising.close()
    return out.array()


def suffix_array(text: np.ndarray, depth: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (suffixes in order, common prefix with the one before), for any text of bytes, in memory or mapped."""
    n = len(text)
    if not n:
        return
    rise = _types(text, budget)
    seeds = _seeds(rise, budget)
    if len(seeds) > 1:
        seeds = _seed_order(text, rise, seeds, _byte_lanes(), depth, budget)
    firsts = np.zeros(257, np.int64)
    prefix = room(len(seeds), np.uint8, budget)
    for s, e in blocks(len(seeds)):
        firsts[1:] += np.bincount(text[seeds[s:e]], minlength=256)
        before = seeds[max(0, s - 1) : e - 1]
        prefix[e - len(before) : e] = _common(text, before, seeds[e - len(before) : e], depth)
    bounds = np.cumsum(firsts).tolist()

    def run(i: int) -> int:
        """Equal bytes from a place on, up to depth."""
        here = text[i : i + depth]
        differs = np.flatnonzero(here != here[0])
        return int(differs[0]) if len(differs) else len(here)

    queue, falling = Lanes(budget), Lanes(budget)
    down = _Induction(text, rise, False, queue, depth)
    queue.put(int(text[-1]), np.array([n - 1]), np.array([0]))
    down.since[text[-1]] = 255
    last_fall: dict[int, int] = {}
    for c in range(256):
        for b in queue.pop(c):
            falling.put(c, b["at"], b["lcp"])
            last_fall[c] = int(b["at"][-1])
            down.process(b["at"], b["lcp"])
        for s in range(bounds[c], bounds[c + 1], BLOCK):
            e = min(s + BLOCK, bounds[c + 1])
            at, lcp = np.array(seeds[s:e]), prefix[s:e].copy()
            if s == bounds[c]:
                lcp[0] = min(run(last_fall[c]), run(int(at[0]))) if c in last_fall else 0
            down.process(at, lcp)

    queue.close()
    queue, rising = Lanes(budget), Lanes(budget)
    up = _Induction(text, rise, True, queue, depth)
    least_rise: dict[int, int] = {}
    for c in range(255, -1, -1):
        for b in queue.pop(c):
            rising.put(c, b["at"], b["lcp"])
            least_rise[c] = int(b["at"][-1])
            up.process(b["at"], b["lcp"])
        follows = min(run(last_fall[c]), run(least_rise[c])) if c in last_fall and c in least_rise else 0
        for b in falling.read(c, backwards=True):
            up.process(b["at"], np.append(follows, b["lcp"][:-1]))
            follows = b["lcp"][-1]
    queue.close()

    for c in range(256):
        for b in falling.read(c):
            yield b["at"], b["lcp"]
        pending = None  # the prefix of a block's last suffix stands in the next block
        for b in rising.read(c, backwards=True):
            if pending is not None:
                yield pending[0], np.append(carry, pending[1])
                carry = pending[2]
            else:
                carry = min(run(last_fall[c]), run(least_rise[c])) if c in last_fall else 0
            pending = b["at"], b["lcp"][:-1], b["lcp"][-1]
        if pending is not None:
            yield pending[0], np.append(carry, pending[1])
    falling.close()
    rising.close()
