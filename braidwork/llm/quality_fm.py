"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so all pairwise interactions cost time linear in a document's features. Fitting takes a bounded sample of the
labelled rows (`max_train`, by hash of doc_id); scoring is one pass over whole texts, with the model, whose
size is fixed by its parameters, on every task. Texts are never shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import extended, set_aside

#: Hashed word slots, rank of the interactions, labelled rows to fit on at most.
SLOTS, RANK, MAX_TRAIN = 1 << 14, 8, 6_000
THRESHOLD = 0.7

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _MARK, _HIGH = b"ULDSPMH"
_CLASS = bytes(_UPPER if 65 <= c <= 90 else _LOWER if 97 <= c <= 122 else _DIGIT if 48 <= c <= 57 else _SPACE if c in b" \t\n\r\x0b\x0c" else _STOP if c in b".,;:?'\"()-" else _HIGH if c >= 128 else _MARK for c in range(256))
N_STRUCTURE = 16


def structure(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Statistics of a text's form, each of the order of one; raw: whole text, words: its words in lower case."""
    kinds = raw.translate(_CLASS)
    n, n_words = max(len(raw), 1), max(len(words), 1)
    upper, lower, digit, space, stop, mark, high = (kinds.count(bytes([c])) / n for c in (_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _MARK, _HIGH))
    lines = raw.split(b"\n")
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)
    odd = sum(c for w, c in counts.items() if w[-1] in b"#$%&*!|<>{}=~^_+/\\@") / n_words
    alone = sum(c for w, c in counts.items() if len(w) == 1 and not w.isalnum()) / n_words
    top = max(counts.values(), default=0) / n_words
    return [4 * upper, lower, 8 * digit, 2 * space, 8 * stop, 8 * mark, high, ends, 2 * odd, 4 * alone, 4 * top, len(counts) / n_words, np.log1p(len(words)) / 6, np.log1p(n / len(lines)) / 6, 1 - len(set(lines)) / len(lines), min(n / n_words / 8, 4)]


def features(text: str | None, meta: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words with damped counts of unit norm, then structure, then metadata (log, null flag)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    counts = Counter(words)
    at = np.array([zlib.crc32(w) for w in counts], np.int64) & (SLOTS - 1)
    x = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    x /= max(np.sqrt((x * x).sum()), 1e-9)
    dense = [1.0, *structure(raw, words, counts)]
    for m in meta:
        dense += [0.0, 1.0] if m is None or m != m else [np.log1p(abs(m)) / 8, 0.0]
    return np.concatenate((at, SLOTS + np.arange(len(dense)))).astype(np.int32), np.concatenate((x, dense)).astype(np.float32)


@dataclass
class FactorisationMachine:
    w: np.ndarray  # linear weights
    v: np.ndarray  # n x rank

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid of documents that begin at `starts`, and their sums by factor."""
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return np.add.reduceat(self.w[at] * x, starts) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(at, x, starts)[0].astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int, rank: int = RANK, epochs: int = 12, rate: float = 0.02, decay: float = 1e-5, seed: int = 5) -> FactorisationMachine:
    """Logistic loss, Adam on batches, in numpy. With no rows, or one class alone, the scores lean to what there is."""
    rng = np.random.default_rng(seed)
    m = FactorisationMachine(np.zeros(n), rng.normal(0, 0.01, (n, rank)))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (m.w, m.v)]
    step = 0
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), 256):
            own = order[lo : lo + 256]
            sizes = np.array([len(rows[i][0]) for i in own])
            at, x = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own]).astype(np.float64)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            raw, sums = m.raw(at, x, starts)
            err = np.repeat((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[own]) / len(own), sizes) * x
            each = np.repeat(sums, sizes, axis=0) - m.v[at] * x[:, None]
            touched, back = np.unique(at, return_inverse=True)
            grads = (np.bincount(back, err, len(touched)), np.stack([np.bincount(back, err * each[:, f], len(touched)) for f in range(rank)], 1))
            step += 1
            for p, g, (first, second) in zip((m.w, m.v), grads, moments):
                g = g + decay * p[touched]
                first[touched] = 0.9 * first[touched] + 0.1 * g
                second[touched] = 0.999 * second[touched] + 0.001 * g * g
                p[touched] -= rate * (first[touched] / (1 - 0.9**step)) / (np.sqrt(second[touched] / (1 - 0.999**step)) + 1e-8)
    return FactorisationMachine(m.w.astype(np.float32), m.v.astype(np.float32))


def held_out(key: str = "doc_id"):
    """Rows that no model learns from; a null key is none of them, and has no label either."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", meta: tuple[str, ...] = ("n_chars",), max_train: int = MAX_TRAIN) -> FactorisationMachine:
    """Fit on at most `max_train` labelled documents that aren't held out, chosen by the hash of doc_id.

    Labels that are null or name no document are passed over; of repeated rows of a document one counts, always the same.
    """
    chosen = labels.where(~held_out() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    n_meta = len(meta)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(2, 3 + n_meta)]
            found = [features(t, list(m)) for t, *m in zip(*columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], ["doc_id", "_y", "at", "x"])

    # At most max_train rows of two numbers: a size that is known, so safe to hold on every task.
    own = docs.select("doc_id", "text", *[F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(meta)]).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("_y").cast("int"), "text", *[f"_m{i}" for i in range(n_meta)])
    rows = own.mapInArrow(extract, "doc_id bigint, _y int, at array<int>, x array<float>").groupBy("doc_id").agg(F.min(F.struct("_y", "at", "x")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    pairs = [(a.values.to_numpy(), x.values.to_numpy()) for a, x in zip(rows.column("at"), rows.column("x"))]
    return fit(pairs, np.array(rows.column("_y").to_pylist(), np.float64), SLOTS + 1 + N_STRUCTURE + 2 * n_meta)


def score_quality(docs: DataFrame, model: FactorisationMachine, meta: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """docs with `score` double in 0..1, higher where label 1 is likelier.

    Null texts count as empty, and empty texts get a score from their structure; null metadata has a feature of
    its own; repeated rows score alike; extra columns pass, a column named score is replaced.
    """
    docs = docs.drop("score")
    held = docs.sparkSession.sparkContext.broadcast((model.w, model.v))
    at_text, at_meta, names = docs.columns.index("text"), [docs.columns.index(c) for c in meta], docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = FactorisationMachine(*held.value)
        for b in batches:
            texts, metas, scores = b.column(at_text), list(zip(*[b.column(i).to_pylist() for i in at_meta])) or [()] * b.num_rows, []
            for lo in range(0, b.num_rows, 64):
                found = [features(texts[i].as_py(), [None if v is None else float(v) for v in metas[i]]) for i in range(lo, min(lo + 64, b.num_rows))]
                starts = np.concatenate(([0], np.cumsum([len(f[0]) for f in found])[:-1])).astype(np.int64)
                scores.append(m.score(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), starts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, extended(docs.schema, "score double"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score `threshold` or more under a model fitted on these labels; columns as they are, one named score too.

    Null and empty texts are scored by their structure; repeated rows stay or go together; an empty docs gives no rows.
    """
    aside, back = set_aside(docs, "score")
    return score_quality(aside, train(docs, labels)).where(F.col("score") >= threshold).drop("score").withColumnsRenamed(back)
