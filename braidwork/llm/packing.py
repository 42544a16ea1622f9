"""Vector best-fit packing of token sequences.

A piece asks for three things: tokens, one document place and its attention cost (length squared). A bin offers
a sequence's tokens, documents and cost; of the bins that hold a piece under every constraint, the one left with
the least weighted residual norm takes it, longest pieces first.

Pieces of one length are alike, so the packing is planned on the histogram of lengths, in one place, for the
whole corpus: bins in the same state form ranges, and a placement moves a range, not a bin. The plan's size
depends on the capacity and not on the number of documents, and no sequence is lost at the edges of partitions.
Pieces then look up their place by their rank among the pieces of their length. Ranks come from counts by
(length, bucket), so a length that a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.common import extended, materialise, set_aside

CAPACITY, END_ID = 1024, 2
#: Weights of tokens, document places and attention cost in the residual norm.
WEIGHTS = (1.0, 0.01, 0.01)
ROWS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 65_536, 32, 4_096

# Fixed value: the pattern that a byte-level pre-tokenizer with use_regex splits by.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: UTF-8 bytes that begin code points from U+0540 on, where libraries' Unicode tables may differ.
_FAR = bytes(range(0xD5, 0x100))


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids of the tokenizer file as `tokenizers` gives them: an added token's string in a text is that token.

    A byte-level BPE whose ids follow its merges is run by the faster of two libraries, which gives the same ids;
    texts with an added token's string or letters beyond Latin, Greek and Cyrillic, and any other tokenizer, are run by `tokenizers`.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    by_slow = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, special = spec["model"], spec.get("pre_tokenizer") or {}, {t["content"] for t in spec.get("added_tokens", [])}
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = {t: i for t, i in model.get("vocab", {}).items() if t not in special} if isinstance(model.get("vocab"), dict) else {}
    merged = ["".join(m if isinstance(m, list) else m.split(" ", 1)) for m in model.get("merges", [])]
    usable = model.get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and [vocab.get(m) for m in merged] == list(range(256, 256 + len(merged))) and all(c in letters for t in vocab for c in t)
    if not usable:
        return by_slow
    import tiktoken

    fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks={bytes(letters[c] for c in t): i for t, i in vocab.items()}, special_tokens={})

    def encode(text: str) -> np.ndarray:
        raw = text.encode("utf-8", "surrogatepass")
        return by_slow(text) if any(s in text for s in special) or len(raw.translate(None, _FAR)) != len(raw) else np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids_crc32 long[, ids array<int>]): documents cut to the capacity.

    A document is its ids and then end_id, so null and empty texts are one token. Documents over the capacity
    have pieces of full length but for the first. Repeated rows give their pieces again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            rows = []
            for n, (i, t) in enumerate(zip(b.column(0), b.column(1)), 1):
                ids = np.append(encode(t.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(i.as_py(), k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), ids[lo:hi].astype(np.int32) if with_ids else None) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))]
                if n % 256 == 0 or n == b.num_rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
                    rows = []

    names, types = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    if with_ids:
        names, types = [*names, "ids"], [*types, pa.list_(pa.int32())]
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def plan(lengths: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, int]:
    """lengths: how many pieces have each length. Gives rows (length, first rank, count, first bin, offset) and the number of bins."""
    size = np.array([capacity, max_docs or capacity, max_cost or capacity * capacity], np.int64)
    state, ranges, live = np.empty((64, 3), np.int64), [], 0  # residual capacities by open state; its ranges of bins
    index: dict[tuple[int, int, int], int] = {}
    scale = np.array(weights) / size
    out, n_bins = [], 0

    def put(residual: tuple[int, int, int], bins: tuple[int, int]) -> None:
        nonlocal live, state
        if residual not in index:
            if live == len(state):
                state = np.concatenate((state, np.empty_like(state)))
            index[residual] = live
            state[live] = residual
            ranges.append([])
            live += 1
        ranges[index[residual]].append(bins)

    for length in sorted(lengths, reverse=True):
        need, left, rank = np.array([length, 1, length * length], np.int64), lengths[length], 0
        if (need > size).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            rest = state[:live] - need
            norm = np.where((rest >= 0).all(1) & np.fromiter(map(bool, ranges), bool, live), ((rest * scale) ** 2).sum(1), np.inf)
            best = int(norm.argmin()) if live else 0
            if live and norm[best] < np.inf:
                first, count = ranges[best].pop()
                k = min(left, count)
                if k < count:
                    ranges[best].append((first + k, count - k))
                out.append((length, rank, k, first, capacity - int(state[best, 0])))
                put(tuple(int(x) for x in state[best] - need), (first, k))
            else:  # new bins take as many pieces of this length as fit, as one by one they would
                per = int((size // need).min())
                per, k = (per, left // per) if left >= per else (left, 1)
                for j in range(per):
                    out.append((length, rank + j * k, k, n_bins, j * length))
                put(tuple(int(x) for x in size - per * need), (n_bins, k))
                n_bins += k
                k *= per
            rank += k
            left -= k
        if live > 4096 and sum(map(bool, ranges)) < live // 2:  # forget states without bins
            old = [(tuple(int(x) for x in state[i]), r) for i, r in enumerate(ranges) if r]
            index, ranges, live = {}, [], 0
            for residual, own in old:
                for bins in own:
                    put(residual, bins)
    return np.array(out, np.int64).reshape(-1, 5), n_bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id long and offset long, places gapless from 0 in each sequence.

    max_docs and max_cost default to what full sequences can hold at most, so that tokens alone bind. Every
    constraint holds in every sequence. No pieces give no rows; equal pieces are placed each for itself; columns
    sequence_id and offset are replaced. `pieces` should be stored: it is read for the counts and for the places.
    """
    pieces, back = set_aside(pieces.drop("sequence_id", "offset"), "_bucket", "_rank", "_before", "_key")
    spark, names = pieces.sparkSession, [*pieces.columns, "sequence_id", "offset"]
    n_buckets = 1 << (min(MOST_BUCKETS, max(LEAST_BUCKETS, pieces.count() // ROWS_PER_BUCKET)) - 1).bit_length()
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    # One row a length, `capacity` rows at most.
    found = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    rows, _ = plan(found, capacity, max_docs, max_cost, weights)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    top = int(max(found.values(), default=0)) + 1
    held = spark.sparkContext.broadcast((rows[:, 0] * top + rows[:, 1], rows))

    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("_rank", place).join(before, ["length", "_bucket"]).withColumn("_key", F.col("length") * top + F.col("_before") + F.col("_rank")).select(*pieces.columns, "_key")
    n = len(pieces.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, of = held.value
        for b in batches:
            key = b.column(n).to_numpy()
            run_ = of[np.searchsorted(keys, key, side="right") - 1]
            seq = run_[:, 3] + (key - run_[:, 0] * top - run_[:, 1])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(seq), pa.array(run_[:, 4])], names)

    return ranked.mapInArrow(run, extended(pieces.schema, "sequence_id bigint, offset bigint")).withColumnsRenamed(back)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: token_pieces' columns with sequence_id and offset."""
    return pack(materialise(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)


def assembled(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the sequences' tokens in order, from packed pieces with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
