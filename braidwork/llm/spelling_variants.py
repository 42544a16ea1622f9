"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so words of the same letters have one key, and one letter more, fewer or
exchanged changes it by that letter's power or the difference of two. Each word offers its key less each of its letters: two words that
differ by an exchange meet in such a value, and a word meets the key of one that is a letter shorter. That is the same as trying
all differences of two powers, with a row for each letter of a word instead of one for each pair of letters of the alphabet.

Values are compared first, as numbers: what meets no other word goes. What is left is joined with the order of letters in the join's keys, so that a
value that very many words share (anagrams of one another) gives true links alone and no pairs to look through: words that agree but for
the letter at one place are as many as the alphabet has letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import materialise

LEAST_LENGTH, LEAST_COUNT, RATIO, POWER = 6, 5, 5, 5
RUN = re.compile("[a-zA-ZÀ-ÿ]+")
#: Different words that a task adds up before it hands them on.
HELD = 1 << 20
#: Rounds of jumping that follow any chain of forms: each is RATIO times as frequent as the one before, counts are 64 bits, a round doubles what is followed.
MOST_ROUNDS = 8


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", rewrite: Callable[[object, str], str] | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): maximal runs of Latin letters, A-Z in lower case, of least_length code points and least_count occurrences in all texts.

    rewrite(key, run), if given, has the word that a document's run counts as. Null and empty texts have no words; repeated rows count each; a null key is given
    to rewrite as None; an empty table gives no rows; other columns are passed over. Tasks add up before the shuffle, so a word that stands everywhere is a row a task.
    """
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return rows

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary())
            for i, k in enumerate(keys):
                found = Counter(RUN.findall((texts[i].as_py() or b"").lower().decode()))  # bytes have A-Z lowered alone
                for w, n in found.items():
                    if len(w) >= least_length and len(w := rewrite(k, w) if rewrite else w) >= least_length:
                        total[w] += n
                if len(total) > HELD:
                    yield out()
        yield out()

    return own.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def anagram_key(word: str) -> int:
    """Sum of the letters' powers, as a signed 64-bit number."""
    return _signed(sum(ord(c) ** POWER for c in word))


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _shortened(words: DataFrame) -> DataFrame:
    """words (id, word) by each of its letters: the place, the key less that letter, what is left, and whether it is the first of a row of like letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, places, values, rests, firsts = [], [], [], [], []
            for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key = anagram_key(w)
                for p, c in enumerate(w):
                    ids.append(i)
                    places.append(p)
                    values.append(_signed(key - ord(c) ** POWER))
                    rests.append(w[:p] + w[p + 1 :])
                    firsts.append(not p or w[p - 1] != c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(values, pa.int64()), pa.array(rests, pa.string()), pa.array(firsts, pa.bool_())], ["id", "place", "value", "rest", "first"])

    return words.select("id", "word").mapInArrow(run, "id bigint, place int, value bigint, rest string, first boolean")


def _keyed(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([anagram_key(w) for w in b.column(1).to_pylist()], pa.int64())], ["id", "word", "value"])

    return words.select("id", "word").mapInArrow(run, "id bigint, word string, value bigint")


def near_words(words: DataFrame) -> DataFrame:
    """words (id long, word), both unique. Gives links (id, other), each both ways: the words differ by one letter added, removed or exchanged."""
    short, whole = materialise(_shortened(words), "shortened"), _keyed(words)
    met = (
        short.select("value", "id").unionByName(whole.select("value", "id")).groupBy("value").agg(F.min("id").alias("a"), F.max("id").alias("b"))
        .where(F.col("a") != F.col("b")).select("value")
    )
    met = materialise(met, "met")
    short, whole = short.join(met, "value", "left_semi"), whole.join(met, "value", "left_semi")
    a, b = short.alias("a"), short.alias("b")
    exchanged = a.join(b, (F.col("a.value") == F.col("b.value")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.id") != F.col("b.id"))).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))
    removed = short.where("first").alias("a").join(whole.alias("b"), (F.col("a.value") == F.col("b.value")) & (F.col("a.rest") == F.col("b.word"))).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))
    return exchanged.unionByName(removed).unionByName(removed.select(F.col("other").alias("id"), F.col("id").alias("other")))


def spelling_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """counts (word, n), words unique. Gives (word, form, root, n, n_near, form_n).

    n_near counts the words that differ by exactly one letter added, removed or exchanged. form is the one of them with the largest n (ties: least in
    code-point order) if that is `ratio` times the word's own or more, else null, as form_n then is; root follows forms to the last. Rows whose word or n is null
    are passed over, an empty word is no one's neighbour but of one-letter words; no words give no rows; other columns are left out.
    """
    counts = counts.where(F.col("word").isNotNull() & F.col("n").isNotNull()).select("word", "n")
    words = materialise(counts.withColumn("id", F.monotonically_increasing_id()), "words")
    links = near_words(words)
    best = links.join(words.select(F.col("id").alias("other"), F.col("word").alias("w"), F.col("n").alias("m")), "other").groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("least"), "w", "other")).alias("s"))
    best = best.select("id", "n_near", (-F.col("s.least")).alias("m"), F.col("s.w").alias("w"), F.col("s.other").alias("to"))
    taken = F.col("m") >= ratio * F.col("n")
    formed = materialise(words.join(best, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(taken, F.col("w")).alias("form"), F.when(taken, F.col("m")).alias("form_n"), F.when(taken, F.col("to")).alias("to")), "formed")
    ends = formed.where(F.col("to").isNotNull()).select("id", "to")
    for _ in range(MOST_ROUNDS):
        step = ends.select(F.col("id").alias("to"), F.col("to").alias("further"))
        jumped = materialise(ends.join(step, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "ends")
        ends = jumped.select("id", "to")
        if jumped.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("forms go round in a circle, or counts are not what they were")
    roots = ends.join(words.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
    return formed.join(roots, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
