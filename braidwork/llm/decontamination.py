"""Benchmark decontamination on a stored, distributed positional inverted index.

The index holds the postings of every token of the training documents. It is partitioned by document, so that a common
word's postings are dealt over all of it: a task gathers documents into shards of bounded size and stores each as one
row, the sorted hashes of its terms, how many positions each has, the positions, and which documents stand where. Equal
texts of a task are indexed once. An index serves any number of searches; it stays in the shared folder for the cluster to
expire, since a lazy result may still read what was found in it.

A search takes the benchmark, a stated query set, in blocks of bounded size, of which tasks hold one at a time. A task looks a block's terms up in the
shards it reads, so nothing is shuffled and of a shard only these terms' positions are unpacked. Each phrase is found by
intersecting posting lists adjusted by their offset in the phrase, from the rarest term on, so that common words
are only asked about where the rarer ones already agree. Proximity search asks the same lists, in the same pass, for all words of a phrase
within a distance. Matches name documents by the hash of their text; what goes back to the documents is the
list of texts with a match, broadcast while it is small and joined beyond that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.llm.common import materialise, set_aside

#: Words of a window, characters of a block of benchmark texts, characters of the documents of one index shard, bytes of matches that tasks hold.
WINDOW, BLOCK_CHARS, SHARD_BYTES, HELD_BYTES = 13, 16 << 20, 1 << 20, 32 << 20
#: Words that an interval with all words of a window may have to be a proximity match.
DISTANCE = 26

# Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: ASCII letters and digits, and all above ASCII.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@F.arrow_udf(T.LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """The number of words of each text; none in a null."""
    return pa.array([len(words(t.as_py())) for t in texts], pa.int64())


def term_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def text_hashes() -> list[Column]:
    """Two independent 64-bit hashes (by another seed) that name a text."""
    return [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]


# Index


def _documents(keys: list[tuple[int, int]], begin: np.ndarray) -> bytes:
    """Two hashes and the first position of each document; zeros and where the last one ends."""
    return np.array([[*h, 0] for h in zip(*keys)] + [begin], "<i8").tobytes()


SHARD = pa.schema([("documents", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()), ("at", pa.binary())])
SHARD_DDL = "documents binary, terms binary, counts binary, at binary"


def shard_row(texts: list[str], keys: list[tuple[int, int]]) -> pa.RecordBatch:
    """A shard: its documents' hashes and first positions; the terms' hashes in order; the number of each one's positions; the steps between
    these, the first of a term from zero, in three bytes each (four in a shard of over 2**24 positions)."""
    tokens = [words(t) for t in texts]
    # One empty position after each document, so that no phrase crosses it.
    begin = np.concatenate(([0], np.cumsum([len(d) + 1 for d in tokens]))).astype(np.int64)
    named = pa.array([w for d in tokens for w in d], pa.binary()).dictionary_encode()
    hashes = np.array([term_hash(w) for w in named.dictionary.to_pylist()], np.uint64).view(np.int64)
    rank = np.argsort(hashes, kind="stable")
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    codes = place[named.indices.to_numpy()] if len(rank) else np.empty(0, np.int64)
    at = np.arange(len(codes)) + np.repeat(np.arange(len(tokens)), [len(d) for d in tokens])
    del tokens, named
    both = np.sort((codes << 32) | at)
    codes, at = both >> 32, both & 0xFFFFFFFF
    counts = np.bincount(codes, minlength=len(rank))
    first = np.cumsum(counts) - counts
    steps = np.diff(at, prepend=0)
    steps[first] = at[first]
    width = 3 if begin[-1] < 1 << 24 else 4
    packed = steps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (_documents(keys, begin), hashes[rank].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), packed)], schema=SHARD)


def positional_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs' whole texts (column text) as shards, a row each (see shard_row), stored in the shared folder.

    Null and empty texts have no words. A repeated text is indexed once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, keys, seen, size = [], [], set(), 0
        for b in batches:
            for t, key in zip(b.column(0), zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if key in seen or not (t := t.as_py()):
                    continue
                if len(seen) < 1 << 17:
                    seen.add(key)
                texts.append(t)
                keys.append(key)
                size += len(t)
                if size >= shard_bytes:
                    yield shard_row(texts, keys)
                    texts, keys, size = [], [], 0
        if texts:
            yield shard_row(texts, keys)

    h1, h2 = text_hashes()
    return materialise(docs.select("text", h1, h2).mapInArrow(run, SHARD_DDL), "postings")


class Postings:
    """Postings of the terms 0..n_terms-1 of one shard, as sorted term * length + position, and where its documents begin."""

    def __init__(self, keys: np.ndarray, begin: np.ndarray, length: int, n_terms: int):
        self.keys, self.begin, self.length = keys, begin, length
        self.first = np.searchsorted(keys, np.arange(n_terms + 1, dtype=np.int64) * length)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def holds(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each term stands at its position."""
        keys = terms * self.length + at
        found = np.searchsorted(self.keys, keys)
        return (at >= 0) & (at < self.length) & (self.keys[np.minimum(found, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def _from_rarest(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of each phrase's offsets (rarest term first, padding last); each posting of a rarest term, with its phrase."""
        df = np.where(phrases >= 0, self.counts()[np.maximum(phrases, 0)], np.iinfo(np.int64).max)
        order = np.argsort(df, axis=1, kind="stable")
        each, rarest = np.arange(len(phrases)), order[:, 0]
        n = df[each, rarest]
        which = np.repeat(each, n)
        within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        term = phrases[which, rarest[which]].astype(np.int64)
        return order, which, self.keys[self.first[term] + within] - term * self.length

    def phrases(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence (phrase number, start) of the phrases, rows of terms padded with -1."""
        order, which, at = self._from_rarest(phrases)
        start = at - order[which, 0]
        for k in range(1, phrases.shape[1]):
            if not len(which):
                break
            offset = order[which, k]
            term = phrases[which, offset].astype(np.int64)
            ok = (term < 0) | self.holds(np.maximum(term, 0), start + offset)
            which, start = which[ok], start[ok]
        inside = (start >= 0) & (start + lengths[which] <= self.length)
        return which[inside], start[inside]

    def near(self, phrases: np.ndarray, distance: int, known: set[tuple[int, int]] = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase number, first, last) of the shortest interval of at most `distance` words around each posting of a phrase's
        rarest term that holds all its words in any order, inside one document (of several the first; each interval once).
        Pairs of a phrase and a document that are `known` aren't looked at."""
        order, which, at = self._from_rarest(phrases)
        doc = np.searchsorted(self.begin, at, side="right") - 1
        lo = np.maximum(at - distance + 1, self.begin[doc])
        hi = np.minimum(at + distance - 1, np.append(self.begin[1:], self.length)[doc] - 1)
        for k in range(1, phrases.shape[1]):
            if not len(which):
                break
            term = phrases[which, order[which, k]].astype(np.int64)
            base = np.maximum(term, 0) * self.length
            ok = (term < 0) | (np.searchsorted(self.keys, base + lo) < np.searchsorted(self.keys, base + hi, side="right"))
            which, at, lo, hi, doc = which[ok], at[ok], lo[ok], hi[ok], doc[ok]
        out = set()
        for w, a, x, y, d in zip(which.tolist(), at.tolist(), lo.tolist(), hi.tolist(), doc.tolist()):
            if (w, d) in known:
                continue
            terms = {t for t in phrases[w].tolist() if t >= 0}
            own = sorted((int(k) - t * self.length, t) for t in terms for k in self.keys[np.searchsorted(self.keys, t * self.length + x) : np.searchsorted(self.keys, t * self.length + y, side="right")])
            best, last = None, {}
            for p, t in own:  # the shortest interval that ends here: from the least of the terms' last places
                last[t] = p
                if len(last) == len(terms) and (first := min(last.values())) <= a <= p and p - first < distance and (best is None or p - first < best[1] - best[0]):
                    best = (first, p)
            if best:
                out.add((w, *best))
        return tuple(np.array(sorted(out), np.int64).reshape(-1, 3).T)


# Search


class TestPhrases:
    """The distinct windows of a block of benchmark items, with the items that have each."""

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        terms: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, tokens in items:
            ids = [terms.setdefault(w, len(terms)) for w in tokens]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1) if size else ():
                found.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.hashes = np.array([term_hash(w) for w in terms], np.uint64).view(np.int64)
        self.lengths = np.array([len(k) for k in found], np.int64)
        self.phrases = np.full((len(found), window), -1, np.int32)
        for row, k in enumerate(found):
            self.phrases[row, : len(k)] = k
        self.items = [sorted(v) for v in found.values()]

    def postings(self, documents: bytes, terms: bytes, counts: bytes, at: bytes) -> tuple[np.ndarray, Postings] | None:
        """Of a shard: its documents' hashes (2 x documents) and the postings of the phrases' terms; None if it has no such term."""
        hashes, counts = np.frombuffer(terms, "<i8"), np.frombuffer(counts, "<u4").astype(np.int64)
        found = np.searchsorted(hashes, self.hashes)
        own = np.flatnonzero(hashes[np.minimum(found, len(hashes) - 1)] == self.hashes) if len(hashes) else np.zeros(0, np.int64)
        if not len(own):
            return None
        documents = np.frombuffer(documents, "<i8").reshape(3, -1)
        documents, end = documents[:, :-1], int(documents[2, -1])
        n, first = counts[found[own]], (np.cumsum(counts) - counts)[found[own]]
        place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        packed = np.frombuffer(at, np.uint8).reshape(-1, 3 if end < 1 << 24 else 4)
        steps = sum(packed[place, k].astype(np.int64) << 8 * k for k in range(packed.shape[1]))
        far, begin = np.cumsum(steps), np.cumsum(n) - n
        keys = np.sort(np.repeat(own * end - (far[begin] - steps[begin]), n) + far)
        return documents, Postings(keys, documents[2], end, len(self.hashes))


def _spans(lo: np.ndarray, hi: np.ndarray) -> list[dict]:
    """Sorted ranges with those that touch or overlap as one."""
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate(([True], lo[1:] > top[:-1])))
    return [{"lo": a, "hi": b} for a, b in zip(lo[first].tolist(), [*top[first[1:] - 1].tolist(), int(top[-1])])]


def _exact(distance: int) -> Callable:
    """Finds (hash, hash, words, hit spans, items, items near) of the documents with a phrase; distance 0: no proximity."""

    def find(phrases: TestPhrases, documents: np.ndarray, index: Postings) -> Iterator[tuple]:
        which, start = index.phrases(phrases.phrases, phrases.lengths)
        doc = np.searchsorted(index.begin, start, side="right") - 1
        order = np.argsort(doc, kind="stable")
        which, start, doc = which[order], start[order], doc[order]
        near: dict[int, set[str]] = {}
        if distance:
            known = set(zip(which.tolist(), doc.tolist())) if distance >= phrases.phrases.shape[1] else set()
            for w, d in known:
                near.setdefault(d, set()).update(phrases.items[w])
            more, first, _ = index.near(phrases.phrases, distance, known)
            for w, d in zip(more.tolist(), (np.searchsorted(index.begin, first, side="right") - 1).tolist()):
                near.setdefault(d, set()).update(phrases.items[w])
        cuts = np.flatnonzero(np.diff(doc, prepend=-1, append=-1)) if len(doc) else np.empty(0, np.int64)
        hit = {int(doc[lo]): (lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:])}
        for d in sorted({*hit, *near}):
            lo, hi = hit.get(d, (0, 0))
            own, begin = which[lo:hi], start[lo:hi] - index.begin[d]
            n_words = (index.begin[d + 1] if d + 1 < len(index.begin) else index.length) - index.begin[d] - 1
            yield int(documents[0, d]), int(documents[1, d]), int(n_words), _spans(begin, begin + phrases.lengths[own]) if hi > lo else [], sorted({i for w in set(own.tolist()) for i in phrases.items[w]}), sorted(near.get(d, ()))

    return find


def _near(distance: int) -> Callable:
    def find(phrases: TestPhrases, documents: np.ndarray, index: Postings) -> Iterator[tuple]:
        found: dict[tuple[int, str], tuple[int, int]] = {}
        for w, first, last in zip(*(x.tolist() for x in index.near(phrases.phrases, distance))):
            d = int(np.searchsorted(index.begin, first, side="right")) - 1
            for item in phrases.items[w]:
                best = (last - first + 1, first - int(index.begin[d]))
                found[d, item] = min(found.get((d, item), best), best)
        for (d, item), (n, first) in sorted(found.items()):
            yield int(documents[0, d]), int(documents[1, d]), item, first, n

    return find


_KINDS = {"bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<struct<lo:bigint,hi:bigint>>": pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))}


def _blocks(benchmark: DataFrame, window: int, block_chars: int) -> Iterator[TestPhrases]:
    items, size = [], 0
    for r in benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        items.append((r.i, words(r.text)))
        size += len(r.text)
        if size >= block_chars:
            yield TestPhrases(items, window)
            items, size = [], 0
    if items:
        yield TestPhrases(items, window)


def search(index: DataFrame, benchmark: DataFrame, find: Callable, columns: list[tuple[str, str]], window: int, block_chars: int) -> DataFrame:
    """The rows (columns) that find gives for each shard of the index, block of the benchmark by block.

    One block is broadcast at a time: its matches are stored before the next one is built.
    """
    spark = index.sparkSession
    schema = ", ".join(f"{n} {t}" for n, t in columns)
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, window, block_chars):
        if not len(block.hashes):
            continue
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    own = held.value.postings(*(c[i].as_py() for c in b.columns))  # noqa: B023  the block's matches are stored within the loop
                    if own and (rows := list(find(held.value, *own))):  # noqa: B023
                        yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, (_, t) in zip(zip(*rows), columns)], [n for n, _ in columns])

        out = out.unionByName(materialise(index.mapInArrow(run, schema), "matches"))
        held.destroy()
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, held_bytes: int = HELD_BYTES, distance: int = DISTANCE) -> DataFrame:
    """docs with n_words long, n_hit long, items array<string> (sorted), contaminated boolean and near array<string> (sorted).

    A document word is hit if it lies inside an occurrence of `window` consecutive words of an item (all of a
    shorter item). near has the items of which `distance` consecutive words of the document hold, in any order, all words of a window, exact matches
    among them if the distance is no less than the window; it doesn't bear on contamination, and is empty with distance 0. Null and empty texts have no words; items with a null id or text are passed over; repeated
    documents are each judged, repeated items count once; extra columns pass, those of these names are replaced.
    """
    docs, back = set_aside(docs.drop("n_words", "n_hit", "items", "contaminated", "near"), "_h1", "_h2", "_n")
    found = _matched(positional_index(docs.select("text")), benchmark, window, block_chars, distance)
    h1, h2 = text_hashes()
    rows = docs.withColumns({"_h1": h1, "_h2": h2}).join(_held(found.select("_h1", "_h2", "n_hit", "items", "near"), held_bytes), ["_h1", "_h2"], "left")
    none = F.array().cast("array<string>")
    out = rows.select(*docs.columns, word_count("text").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).withColumnsRenamed(back)


def _held(found: DataFrame, held_bytes: int) -> DataFrame:
    """found (stored) to be broadcast while it is small."""
    items = F.octet_length(F.concat(F.array_join("items", ","), F.array_join("near", ","))) if "items" in found.columns else F.lit(0)
    return F.broadcast(found) if (found.agg(F.sum(items + 64)).first()[0] or 0) <= held_bytes else found


def _matched(index: DataFrame, benchmark: DataFrame, window: int, block_chars: int, distance: int = 0) -> DataFrame:
    """(_h1, _h2, _n, n_hit, items, near) of the texts with a match, a row a text: its words, how many are hit, by what, what is near."""
    columns = [("_h1", "bigint"), ("_h2", "bigint"), ("_n", "bigint"), ("spans", "array<struct<lo:bigint,hi:bigint>>"), ("items", "array<string>"), ("near", "array<string>")]
    found = search(index, benchmark, _exact(distance), columns, window, block_chars)
    # Copies of a text in several shards say the same; blocks add up.
    listed = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    merged = found.groupBy("_h1", "_h2").agg(F.max("_n").alias("_n"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("s"), listed("items"), listed("near"))
    # Spans in order: each adds what goes beyond those before it.
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    n_hit = F.aggregate("s", start, lambda a, s: F.struct((a.n + F.greatest(s.hi - F.greatest(s.lo, a.to), F.lit(0))).alias("n"), F.greatest(a.to, s.hi).alias("to")), lambda a: a.n)
    return materialise(merged.select("_h1", "_h2", "_n", n_hit.alias("n_hit"), "items", "near"), "found")


def near_benchmark(docs: DataFrame, benchmark: DataFrame, distance: int = DISTANCE, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Proximity matches (doc_id, item, first, n): documents in which some `distance` consecutive words hold, in any order, all
    words of a window of an item; `first` is where the shortest such interval begins and n its words (of several the first).

    Exact matches are among them if `distance` is at least `window`. Nulls, empty texts and repeated rows as in find_benchmark.
    """
    columns = [("_h1", "bigint"), ("_h2", "bigint"), ("item", "string"), ("first", "bigint"), ("n", "bigint")]
    found = search(positional_index(docs.select("text")), benchmark, _near(distance), columns, window, block_chars)
    best = found.groupBy("_h1", "_h2", "item").agg(F.min(F.struct("n", "first")).alias("b"))
    h1, h2 = text_hashes()
    return docs.select("doc_id", h1.alias("_h1"), h2.alias("_h2")).join(best, ["_h1", "_h2"]).select("doc_id", "item", F.col("b.first").alias("first"), F.col("b.n").alias("n"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The documents without contamination (as find_benchmark judges it); columns as they are."""
    aside, back = set_aside(docs, "_h1", "_h2")
    found = _matched(positional_index(docs.select("text")), benchmark, WINDOW, BLOCK_CHARS)
    gone = materialise(found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("_n"))).select("_h1", "_h2"), "gone")
    h1, h2 = text_hashes()
    return aside.withColumns({"_h1": h1, "_h2": h2}).join(_held(gone, held_bytes), ["_h1", "_h2"], "left_anti").drop("_h1", "_h2").withColumnsRenamed(back).select(*docs.columns)
