"""Periodic runs of words by branching tandem repeats in a suffix tree.

A run's last square, the rightmost stretch of two periods, can't be moved a word to the right: it is a branching tandem
repeat. So each run shows once in the suffix tree, at the node whose label is the square's half, and the two
suffixes that begin its halves lie under different children of that node. For each node the leaf list of all but the largest
child is walked (smaller half: n log n leaves in all), and a leaf j asks whether j + depth or j - depth lies under another
child. The repeats found are rotated to the left as far as words agree, which gives whole runs; repeats of one run (its
period and multiples of it) merge to the smallest period.

The tree is the suffix array of a batch of documents with its common prefixes: boundaries of the array are the binary form of
inner nodes. Everything is numpy over some hundred thousand words; documents meet in a batch only to share the arrays, since a
word's first rank has its document in it. Nothing is shuffled: a document is searched where it is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from braidwork.llm.common import extended

LEAST, EXPONENT = 6, 4
#: Words of whole documents that one suffix tree holds, and leaves that one walk takes at once; longer documents have a tree of their own.
PIECE, LEAVES = 1 << 18, 1 << 21

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_ranks(first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of numbers whose documents share none of them, and each level's ranks.

    Level k's ranks are equal where 2**k numbers agree (a suffix that its document cuts short agrees with none); they have one place
    more, so that a document's end may be asked for. Only groups that are still tied are sorted again.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    ranks = np.full(n + 1, -1, np.int64)
    head = _heads(first[order])
    ranks[order] = head
    levels, active, width = [ranks.astype(np.int32)], np.flatnonzero(_tied(head)), 1
    while len(active):
        at = order[active]
        follow = at + width
        # Where a document ends, the next one's ranks follow: of the tied suffixes one alone, so that it parts from the rest.
        key = ranks[at] * (n + 2) + ranks[np.minimum(follow, n)] + 1
        sort = np.argsort(key, kind="stable")
        at, head = at[sort], active[_heads(key[sort])]
        order[active] = at
        ranks[at] = head
        levels.append(ranks.astype(np.int32))
        active, width = active[_tied(head)], 2 * width
    return order, levels


def _heads(keys: np.ndarray) -> np.ndarray:
    """For each of sorted keys the place of its first equal."""
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)


def _tied(heads: np.ndarray) -> np.ndarray:
    same = heads[1:] == heads[:-1]
    return np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(heads) else np.zeros(0, bool)


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Of each suffix and the one before it in the array, with -1 before the first and after the last."""
    n = len(order)
    depth = np.zeros(n + 1, np.int64)
    depth[0] = depth[n] = -1
    a, b = order[:-1], order[1:]
    agree = [np.flatnonzero(levels[0][a] == levels[0][b])]
    for ranks in levels[1:]:
        own = agree[-1]
        agree.append(own[ranks[a[own]] == ranks[b[own]]])
    for k in range(len(levels) - 1, -1, -1):
        own = agree[k]
        far = depth[own + 1]
        depth[own + 1] = far + (levels[k][a[own] + far] == levels[k][b[own] + far]) * (1 << k)
    return depth


def _nearest(depth: np.ndarray, of: np.ndarray, step: int, ties: bool) -> np.ndarray:
    """For boundaries `of`, the nearest one in a direction that is shallower, with ties also one as deep. Pointers jump."""
    to = np.arange(len(depth)) + step
    left = of
    while len(left):
        there = depth[to[left]]
        left = left[there > depth[left] if ties else there >= depth[left]]
        to[left] = to[to[left]]
    return to[of]


def branching_repeats(order: np.ndarray, depth: np.ndarray, most: np.ndarray, leaves: int = EXPONENT, room: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of branching tandem repeats below nodes of at least so many leaves; most: by word, the longest period of use."""
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    deep = np.flatnonzero(depth > 0)
    right, outer = _nearest(depth, deep, 1, False), _nearest(depth, deep, -1, False)
    use = (right - outer >= leaves) & (depth[deep] <= most[order[deep]])
    deep, right, left = deep[use], right[use], _nearest(depth, deep, -1, True)[use]
    small = deep - left <= right - deep
    lo, hi = np.where(small, left, deep), np.where(small, deep, right)
    other_lo, other_hi = np.where(small, deep, left), np.where(small, right, deep)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    ends = np.cumsum(hi - lo)
    at = 0
    while at < len(deep):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room, "right")))
        size = (hi - lo)[at:to]
        before = np.cumsum(size) - size
        leaf = order[np.repeat(lo[at:to] - before, size) + np.arange(size.sum())]
        period, olo, ohi = (np.repeat(x[at:to], size) for x in (depth[deep], other_lo, other_hi))
        for partner in (leaf + period, leaf - period):
            inside = (partner >= 0) & (partner < n)
            r = rank[np.where(inside, partner, 0)]
            hit = np.flatnonzero(inside & (r >= olo) & (r < ohi))
            found.append((np.minimum(leaf[hit], partner[hit]), period[hit]))
        at = to
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def maximal_runs(first: np.ndarray, begins: np.ndarray, lengths: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """(start, end, period) of the runs of all documents, by start, then period; first: the words' numbers, of which no two documents share one."""
    if not len(first):
        return np.zeros((0, 3), np.int64)
    order, levels = suffix_ranks(first)
    at, period = branching_repeats(order, common_prefixes(order, levels), np.repeat(lengths // exponent, lengths), exponent)
    begin = np.repeat(begins, lengths)[at]
    moved = np.zeros(len(at), np.int64)  # rotations to the left
    for k in range(len(levels) - 1, -1, -1):
        back = at - moved - (1 << k)
        inside = back >= begin
        back = np.where(inside, back, 0)
        moved += (inside & (levels[k][back] == levels[k][np.minimum(back + period, len(first))])) * (1 << k)
    start, end = at - moved, at + 2 * period
    long = end - start >= np.maximum(least, exponent * period)
    found = np.stack([start[long], end[long], period[long]], 1)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    merged = np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(1))) if len(found) else np.zeros(0, bool)
    found = found[merged]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _searched(texts: list[list[bytes]], least: int, exponent: int) -> Iterator[tuple[int, list[dict], bytes]]:
    """Of each document its number of words, its runs, and its words without those that repeat a run's first period."""
    lengths = np.array([len(w) for w in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in texts for w in words), np.int64, int(lengths.sum()))
    runs = maximal_runs(np.repeat(np.arange(len(texts)), lengths) * max(1, len(numbers)) + ids, begins, lengths, least, exponent)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    stays = np.cumsum(change)[:-1] == 0
    edges = np.searchsorted(runs[:, 0], np.append(begins, len(ids)))
    for i, words in enumerate(texts):
        own = runs[edges[i] : edges[i + 1]] if len(words) else runs[:0]
        kept = compress(words, stays[begins[i] : begins[i] + len(words)].tolist()) if len(own) else words
        yield len(words), [{"start": int(s - begins[i]), "length": int(e - s), "period": int(q)} for s, e, q in own], b" ".join(kept)


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, least: int = LEAST, exponent: int = EXPONENT, piece: int = PIECE) -> DataFrame:
    """docs without its text column, with `n_words`, `runs` (by start, then period) and `collapsed`, the words without what repeats a run's first period.

    Words are what ASCII white space parts. A run is a stretch of consecutive words of smallest period q and at least max(least, exponent * q) words
    (exponent at least 2) that no neighbouring word extends. rewrite(key, words), if given, has the words that are searched.

    A null text is one without words: no runs and an empty collapsed text, as for an empty one. Rows are searched each for itself, repeated ones with like results;
    a null key is given to rewrite as None. A text of any length is searched whole, in memory of about four hundred bytes a word. An empty table
    gives no rows. Extra columns pass; those of the result's names are replaced.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    keep = [c for c in docs.columns if c not in (text, "n_words", "runs", "collapsed")]
    schema, at_key = extended(docs.select(*keep).schema, f"n_words bigint, runs {RUNS}, collapsed string"), keep.index(key) if key in keep else None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys, results, held, size = b.column(len(keep)).cast(pa.binary()), None if at_key is None else b.column(at_key).to_pylist(), [], [], 0
            for i in range(b.num_rows):
                words = (texts[i].as_py() or b"").split()
                held.append(rewrite(None if keys is None else keys[i], words) if rewrite else words)
                size += len(words)
                if size >= piece or i == b.num_rows - 1:
                    results += _searched(held, least, exponent)
                    held, size = [], 0
            n, runs, kept = zip(*results) if results else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(runs, _ARROW), pa.array(kept, pa.binary()).cast(pa.string())], [*keep, "n_words", "runs", "collapsed"])

    return docs.select(*keep, text).mapInArrow(search, schema)
