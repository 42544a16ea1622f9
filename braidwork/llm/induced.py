"""External induced sorting of suffixes with their common-prefix values.

The order of all suffixes follows from that of the S*-suffixes (local minima of the symbol order): one ascending
scan induces the L-suffixes, one descending scan the S-suffixes. Induced suffixes go into disk-backed queues, one
for each first symbol; taken symbol by symbol they are a priority queue whose entries are tuples of a position and
the common prefix with the entry before. A tuple's common prefix is one more than the least in the scan between
the two suffixes that induced them, so prefix values travel with the tuples and the text is never compared again.
S*-suffixes are ordered on the reduced text of their substrings' names, where ranks of doubled length are sorted
until they cover `cap` symbols; that recursion hands up their common prefixes as well.

Prefix values are exact up to `cap`; suffixes equal over `cap` symbols come in any order. Entries beyond `memory`
bytes are written to the local temporary folder and removed as they are read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Symbols of a text: 0 separates its parts, bytes are 1 to 256.
SEPARATOR, SYMBOLS, PER_WORD, PAD = 0, 257, 6, 511


class Queue:
    """First-in first-out entries (position, common prefix), written to disk once the store's memory is used up."""

    def __init__(self, store: Store):
        self.store, self.parts, self.n = store, [], 0

    def put(self, at: np.ndarray, lcp: np.ndarray) -> None:
        if len(at):
            self.parts.append(self.store.keep(at, lcp))
            self.n += len(at)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.n = [self.store.give(p) for p in self.parts], [], 0
        if not parts:
            return np.empty(0, np.int32), np.empty(0, np.int32)
        return parts[0] if len(parts) == 1 else (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


class Store:
    """Memory of all queues of one text, with the file behind it."""

    def __init__(self, memory: int):
        self.left, self.file = memory, None

    def keep(self, at: np.ndarray, lcp: np.ndarray):
        size = at.nbytes + lcp.nbytes
        if size <= self.left:
            self.left -= size
            return at, lcp
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115  closed with the store
        where = self.file.seek(0, 2)
        at.tofile(self.file)
        lcp.tofile(self.file)
        return where, len(at), at.dtype, lcp.dtype

    def give(self, part) -> tuple[np.ndarray, np.ndarray]:
        if len(part) == 2:
            self.left += part[0].nbytes + part[1].nbytes
            return part
        where, n, a, b = part
        self.file.seek(where)
        return np.fromfile(self.file, a, n), np.fromfile(self.file, b, n)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(text: np.ndarray) -> np.ndarray:
    """True for S-suffixes (smaller than the next); the last one is L."""
    step = np.zeros(len(text), np.int8)
    step[:-1] = np.sign(np.diff(text.astype(np.int16)))
    step[-1] = -1
    moves = np.flatnonzero(step)
    return np.repeat(step[moves] > 0, np.diff(moves, prepend=-1))


def _dense(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks (equal rows alike) of rows of non-negative numbers, and how many there are."""
    n = len(columns[0])
    if not n:
        return np.empty(0, np.int64), 0
    bits = [max(1, int(c.max()).bit_length()) for c in columns] + [n.bit_length()]
    if sum(bits) <= 63:  # rows and their places in one word, which sorts fastest
        word = np.zeros(n, np.int64)
        for c, b in zip(columns, bits):
            word = (word << b) | c.astype(np.int64)
        word = np.sort((word << bits[-1]) | np.arange(n))
        order, value = word & ((1 << bits[-1]) - 1), word >> bits[-1]
        new = np.concatenate(([False], value[1:] != value[:-1]))
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(n, bool)
        for c in columns:
            new[1:] |= c[order[1:]] != c[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = ranks = np.cumsum(new)
    return rank, int(ranks[-1]) + 1


def _words(text: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """PER_WORD symbols from each position as one number; past `end` the pad, above any symbol, or, at the end of the text, 0, below any."""
    out = np.zeros(len(at), np.int64)
    for k in range(PER_WORD):
        p = at + k
        symbol = text[np.minimum(p, len(text) - 1)].astype(np.int64) + 1
        out = out * 512 + np.where(p < end, symbol, np.where(end < len(text), PAD, 0))
    return out


def _names(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the S*-substrings (to the next S*'s first symbol; the last one to the end)."""
    end = np.append(at[1:] + 1, len(text))
    name, n = _dense(_words(text, at, end))
    k = PER_WORD
    while len(more := np.flatnonzero(end - at > k)):
        sub = np.full(len(at), len(at))  # a substring that ends here goes on with pads, above all others
        sub[more] = _dense(_words(text, at[more] + k, end[more]))[0]
        name, n = _dense(name, sub)
        k += PER_WORD
    return name, n


def _prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, so_far: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffixes a and b that agree over `so_far` symbols, by comparison on from there."""
    out, live, n = np.minimum(so_far, cap).astype(np.int64), np.arange(len(a)), len(text)
    while len(live):
        p, q = a[live] + out[live], b[live] + out[live]
        same = (out[live] < cap) & (p < n) & (q < n)
        same[same] = text[p[same]] == text[q[same]]
        live = live[same]
        out[live] += 1
    return out


def sorted_minima(text: np.ndarray, at: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The S*-suffixes `at` (ascending positions) in order, and each one's common prefix with the one before."""
    m = len(at)
    name, n = _names(text, at)
    levels, span = [name], 1
    while n < m and span * 2 < 2 * cap:  # a name covers two symbols at least
        after = np.zeros(m, np.int64)
        after[:-span] = levels[-1][span:] + 1
        rank, n = _dense(levels[-1], after)
        levels.append(rank)
        span *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):  # descend: jump over what two suffixes share
        fits = (a < m) & (b < m)
        fits[fits] = levels[k][a[fits]] == levels[k][b[fits]]
        a[fits] += 1 << k
        b[fits] += 1 << k
    edge = np.append(at, len(text))
    shared = np.minimum(edge[np.minimum(a, m)] - at[order[:-1]], edge[np.minimum(b, m)] - at[order[1:]])
    lcp = np.zeros(m, np.int64)
    lcp[1:] = _prefix(text, at[order[:-1]], at[order[1:]], shared, cap)
    return at[order], lcp


def _runs(text: np.ndarray) -> np.ndarray:
    """How long the run of one symbol goes on from each position."""
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    return np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(text)) + 1


def _pushes(before: np.ndarray, lcp: np.ndarray, wanted: np.ndarray, cap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By target symbol: places in the scan that induce into it, and the prefixes their entries share.

    before: the symbol in front of each scanned suffix. An entry's first value is 1 (the symbol alone).
    """
    own = np.flatnonzero(wanted)
    order = np.argsort(before[own], kind="stable")
    place, symbol = own[order], before[own][order]
    cuts = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1], [True]))) if len(symbol) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        p = place[lo:hi]
        shared = np.ones(len(p), np.int32)
        if len(p) > 1:
            shared[1:] = np.minimum(np.minimum.reduceat(lcp[: p[-1] + 1], p[:-1] + 1) + 1, cap)
        yield int(symbol[lo]), p, shared


def suffixes(text: np.ndarray, cap: int, memory: int = 64 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffix positions by first symbol in descending order of suffixes, with the prefix shared with the one before in it.

    text: uint16 symbols, the last one SEPARATOR. A run that starts with value 0 has nothing before it.
    """
    n = len(text)
    s_type, run = _types(text), _runs(text)
    minima = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    star, star_lcp = sorted_minima(text, minima, cap) if len(minima) else (minima, minima)
    star_at = np.searchsorted(text[star], np.arange(SYMBOLS + 1))
    before = np.empty(n, np.uint16)
    before[1:], before[0] = text[:-1], 0
    store = Store(memory)
    queues, done = [Queue(store) for _ in range(SYMBOLS)], [Queue(store) for _ in range(SYMBOLS)]

    def rounds(c: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The queue of c, with the suffixes that c itself induces: round k begins with k + 1 times c."""
        at, lcp = queues[c].take()
        all_at, all_lcp, k = [at], [lcp], 1
        while len(at):
            more = np.flatnonzero((at > 0) & (before[at] == c))
            if not len(more):
                break
            shared = np.full(len(more), min(k, cap), np.int32)
            if len(more) > 1:
                shared[1:] = np.minimum(np.minimum.reduceat(lcp[: more[-1] + 1], more[:-1] + 1) + 1, cap)
            at, lcp, k = at[more] - 1, shared, k + 1
            all_at.append(at)
            all_lcp.append(lcp)
        return all_at, all_lcp

    def spread(at: np.ndarray, lcp: np.ndarray, upwards: bool, c: int) -> None:
        ahead = before[at]
        for d, p, shared in _pushes(ahead, lcp, (at > 0) & ((ahead > c) if upwards else (ahead < c)), cap):
            if not queues[d].n:
                shared[0] = 0
            queues[d].put((at[p] - 1).astype(np.int32), shared)

    try:
        queues[int(text[-1])].put(np.array([n - 1], np.int32), np.zeros(1, np.int32))  # induced by the end of the text
        for c in range(SYMBOLS):
            at, lcp = map(np.concatenate, rounds(c))
            done[c].put(at, lcp)
            own = star[star_at[c] : star_at[c + 1]]
            if len(own):
                own_lcp = star_lcp[star_at[c] : star_at[c + 1]].copy()
                own_lcp[0] = min(run[at[-1]], run[own[0]], cap) if len(at) else 0
                at, lcp = np.concatenate((at, own)), np.concatenate((lcp, own_lcp))
            if len(at):
                spread(at, lcp, True, c)
        for c in range(SYMBOLS - 1, -1, -1):
            at, lcp = map(np.concatenate, rounds(c))
            low, low_lcp = done[c].take()
            if len(low):
                low, below = low[::-1], np.empty(len(low), np.int32)
                below[1:] = low_lcp[::-1][:-1]
                below[0] = min(run[at[-1]], run[low[0]], cap) if len(at) else 0
                at, lcp = np.concatenate((at, low)), np.concatenate((lcp, below))
            if len(at):
                yield at, lcp
                spread(at, lcp, False, c)
    finally:
        store.close()
