"""Quality rules with n-gram perplexity.

Base rules count words, symbols, repeated lines and repeated three-word windows. What passes them is judged by a language model: modified Kneser-Ney
over the n-grams of characters of all documents of a language, counted by Spark. Characters, because words made of typing errors, markup or
another alphabet are as new to a model of words as any rare name is, and because the table stays small: it ends growing with the corpus long before the
counts do. A text is read in stretches of some words, each by the language that makes it likeliest, so one in two languages, or under a wrong name, is as
likely as any; it is judged as the language that most of it is in. A language's band of log perplexity ends two interquartile ranges beyond the quartiles of its texts that pass the base rules; texts below it (repetition,
shouting) and above it (markup, tables, noise) are rejected.

The model is a table of hash, probability and back-off weight, by language and order. Tasks hold it as sorted arrays of hashes, probed by binary search, as
long as it has at most `held` rows, which is counted first; beyond that documents hand their distinct n-grams to a join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.common import extended, materialise, set_aside

ORDER = 3
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Fences stand this many interquartile ranges of the log perplexity beyond the quartiles; a narrower range than LEAST_RANGE counts as that.
FENCE, LEAST_RANGE = 2.0, 0.01
#: Log perplexities are put into steps this wide before quartiles are taken, so that a language's histogram is small whatever the corpus.
STEP = 1 / 1024
#: Characters of a stretch that is read in one language.
STRETCH = 128
#: Rows of a model that a task may hold (17 bytes each, twice while they are sorted), and characters that are looked at together.
HELD, PIECE = 1 << 21, 1 << 21
#: Different n-grams of a language that a task adds up before it hands them on.
PENDING = 1 << 20

# The symbols that n_symbols counts, and ASCII white space.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
#: What stands before a text's first character and after its last, in the model alone.
BEGIN, END = "\x02", "\x03"
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(0x110000, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_SYMBOL = np.zeros(0x110000, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True

Docs = list[tuple[str, str]]  # language, text


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams, one a row of code points."""
    h = np.full(len(grams), grams.shape[1], np.uint64)
    for column in grams.T:
        h = (h + column.astype(np.uint64) + np.uint64(1)) * _PRIME
        h ^= h >> np.uint64(29)
    return h


class Grams:
    """The n-grams of a run of texts of one language: the different ones, and which stands where."""

    def __init__(self, texts: list[str], order: int):
        padded = [np.concatenate((np.full(order - 1, ord(BEGIN), np.uint32), _points(t), np.full(1, ord(END), np.uint32))) for t in texts]
        points = np.concatenate(padded)
        self.sizes = np.array([len(p) - order + 1 for p in padded])
        # n-grams that reach over the edge of two texts are no one's.
        ends = np.cumsum([len(p) for p in padded])
        inside = np.concatenate([np.arange(e - len(p), e - order + 1) for e, p in zip(ends, padded)])
        alphabet = np.flatnonzero(np.bincount(points))
        size = len(alphabet) ** order
        if size <= max(1 << 16, 4 * len(points)):  # few letters: n-grams are counted by number
            number = np.zeros(int(alphabet[-1]) + 1, np.int64)
            number[alphabet] = np.arange(len(alphabet))
            small, key = number[points], np.zeros(len(inside), np.int64)
            for k in range(order):
                key = key * len(alphabet) + small[inside + k]
            count = np.bincount(key, minlength=size)
            there = np.flatnonzero(count)
            number = np.zeros(size, np.int64)
            number[there] = np.arange(len(there))
            self.which, self.counts = number[key], count[there]
            first = np.zeros(len(there), np.int64)
            first[self.which] = inside
        else:
            _, at, self.which, self.counts = np.unique(hashed(points[inside[:, None] + np.arange(order)]), return_index=True, return_inverse=True, return_counts=True)
            first = inside[at]
        self.grams = points[first[:, None] + np.arange(order)]


def _strings(grams: np.ndarray) -> list[str]:
    order = grams.shape[1]
    text = np.ascontiguousarray(grams.astype("<u4")).tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + order] for i in range(0, len(text), order)]


def _by_language(docs: Docs, room: int) -> Iterator[tuple[str, list[int]]]:
    """Places of documents of one language, in pieces of about `room` characters."""
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    for lang, places in groupby(order, key=lambda i: docs[i][0]):
        held, size = [], 0
        for i in places:
            held.append(i)
            size += len(docs[i][1])
            if size >= room:
                yield lang, held
                held, size = [], 0
        if held:
            yield lang, held


def _documents(b: pa.RecordBatch, at_lang: int, at_text: int, lo: int, hi: int) -> Docs:
    part = b.slice(lo, hi - lo)
    return list(zip((x or "" for x in part.column(at_lang).to_pylist()), (x or "" for x in part.column(at_text).to_pylist())))


def gram_counts(docs: DataFrame, order: int = ORDER, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) of all texts, whole. A null language is '', a null text has the edges of an empty one; repeated rows count each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))

        def out(own: str) -> pa.RecordBatch:
            grams = held.pop(own)
            return pa.RecordBatch.from_arrays([pa.array([own] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                found = _documents(b, 0, 1, lo, min(lo + 1024, b.num_rows))
                for own, places in _by_language(found, PIECE):
                    g, grams = Grams([found[i][1] for i in places], order), held[own]
                    for s, n in zip(_strings(g.grams), g.counts.tolist()):
                        grams[s] += n
                    if len(grams) > PENDING:
                        yield out(own)
        for own in list(held):
            yield out(own)

    return docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counted: DataFrame) -> DataFrame:
    """By language the discounts of n-grams counted once, twice and more; where a corpus is too small to tell, 1/2, 1 and 3/2."""
    n = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    sure = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    bound = lambda x, i: F.when(sure, F.least(F.greatest(x, F.lit(0.0)), F.lit(float(i)))).otherwise(F.lit(i / 2))
    by = counted.groupBy("lang").agg(*n)
    return by.select("lang", *[bound(i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)), i).alias(f"d{i}") for i in (1, 2, 3)])


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """counts (lang, gram, n) as (lang, gram, logp, back): grams of 1 to `order` characters.

    logp: log of the interpolated probability of the last character after the others; back: log of the weight that the shorter context gets where
    the gram is a context (null where it is none; what only begins texts is a context alone and has no logp). The gram '' holds the log of the uniform probability over a language's characters and one unknown one.
    """
    level, model, tables = counts, None, []
    for k in range(order, 0, -1):  # lower orders count the different characters before a gram
        tables.append((k, level))
        level = level.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    lower = tables[-1][1].groupBy("lang").agg(F.count(F.lit(1)).alias("v")).select("lang", F.lit("").alias("gram"), (-F.log(F.col("v") + 1.0)).alias("logp"))
    for k, counted in reversed(tables):
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = counted.join(_discounts(counted), "lang").withColumns({"d": d, "context": F.substring("gram", 1, k - 1)})
        around = own.groupBy("lang", "context").agg(F.sum("n").alias("all"), (F.sum("d") / F.sum("n")).alias("weight"))
        found = own.join(around, ["lang", "context"]).withColumn("shorter", F.substring("gram", 2, k - 1)).join(lower.select("lang", F.col("gram").alias("shorter"), F.col("logp").alias("low")), ["lang", "shorter"])
        found = found.select("lang", "gram", F.log((F.col("n") - F.col("d")) / F.col("all") + F.col("weight") * F.exp("low")).alias("logp"))
        backs = around.select("lang", F.col("context").alias("gram"), F.log("weight").alias("back"))
        level = materialise(lower.join(backs, ["lang", "gram"], "full_outer").select("lang", "gram", "logp", "back"), "model")
        model = level if model is None else model.unionByName(level)
        lower = materialise(found, "level")
    return model.unionByName(lower.select("lang", "gram", "logp", F.lit(None).cast("double").alias("back")))


class Model:
    """A model of several languages as sorted arrays of hashes."""

    def __init__(self, rows: pa.Table, order: int):
        self.order, self.languages = order, sorted(set(rows.column("lang").to_pylist()))
        self.tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        langs, grams = np.array(rows.column("lang").to_pylist(), object), rows.column("gram").to_pylist()
        logp, back = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("logp", "back"))
        sizes = np.array([len(g) for g in grams], np.int64)
        for lang in self.languages:
            for k in range(order + 1):
                at = np.flatnonzero((langs == lang) & (sizes == k))
                h = hashed(np.stack([_points(grams[i]) for i in at]).reshape(len(at), k)) if len(at) else np.zeros(0, np.uint64)
                s = np.argsort(h, kind="stable")
                self.tables[lang, k] = h[s], logp[at][s], np.nan_to_num(back[at][s])

    def log_probability(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """Of the last character of each gram, by the longest context known; a language that the model hasn't got knows nothing and gives 0."""
        k = grams.shape[1]
        at, there = self._find(lang, k, grams)
        there[there] = ~np.isnan(self.tables[lang, k][1][at[there]]) if there.any() else False
        values = np.zeros(len(grams))
        values[there] = self.tables[lang, k][1][at[there]] if there.any() else 0
        if k and not there.all():
            less = np.flatnonzero(~there)
            context, known = self._find(lang, k - 1, grams[less, :-1])
            weight = np.zeros(len(less))
            weight[known] = self.tables[lang, k - 1][2][context[known]] if known.any() else 0
            values[less] = weight + self.log_probability(lang, grams[less, 1:])
        return values

    def _find(self, lang: str, k: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = self.tables[lang, k][0] if (lang, k) in self.tables else np.zeros(0, np.uint64)
        if not len(hashes):
            return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        h = hashed(grams)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return at, hashes[at] == h


def rule_counts(texts: list[str]) -> np.ndarray:
    """Of each text: words, their code points, symbols, lines with a word that are equal to an earlier one, words in a three-word window that stands twice."""
    numbers: dict[bytes, int] = {}
    out, ids, lengths = np.zeros((len(texts), 5), np.int64), [], []
    for i, t in enumerate(texts):
        points = _points(t)
        words = t.encode("utf-8", "surrogatepass").split()
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
        lengths.append(len(words))
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        out[i, :4] = len(words), len(points) - np.count_nonzero(_SPACE[points]), np.count_nonzero(_SYMBOL[points]), len(lines) - len(set(lines))
    a, begins = np.array(ids, np.int64), np.cumsum(lengths) - lengths
    if len(a) >= 3:
        # A window's number: its first two words', then the third's with the text's; windows over an edge of texts stand alone.
        text, size = np.repeat(np.arange(len(texts)), lengths), len(numbers)
        two = np.unique(a[:-2] * size + a[1:-1], return_inverse=True)[1]
        three = np.unique(two * size + a[2:], return_inverse=True)[1] * len(texts) + text[:-2]
        _, which, count = np.unique(three, return_inverse=True, return_counts=True)
        twice = np.flatnonzero((text[:-2] == text[2:]) & (_inside_counts(which, count, text) >= 2))
        hit = np.zeros(len(a), bool)
        for k in range(3):
            hit[twice + k] = True
        sums = np.concatenate(([0], np.cumsum(hit)))
        out[:, 4] = sums[begins + lengths] - sums[begins]
    return out


def _inside_counts(which: np.ndarray, count: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each window stands in its text, without those that reach into the next."""
    over = np.flatnonzero(text[:-2] != text[2:])
    count = count - np.bincount(which[over], minlength=len(count))
    return count[which]


_COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_NAMES = [c.split()[0] for c in _COUNTS.split(", ")]
RESULT = (*_NAMES, "base_failed", "log_perplexity", "read_as", "kept")


def base_failed(least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def bands(scored: DataFrame, fence: float = FENCE, step: float = STEP, least: float = LEAST_RANGE) -> DataFrame:
    """(lang, low, high): fences beyond the quartiles of the log perplexity of each language's different texts that pass the base rules.

    Texts count as different by their counts and perplexity, so a group of copies counts once. Quartiles are those of a histogram in steps of `step`.
    """
    different = scored.where(~F.col("base_failed")).select("lang", *_NAMES, "log_perplexity").distinct()
    bins = different.groupBy("lang", F.floor(F.col("log_perplexity") / step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy("lang")  # a language's bins: some thousands at most, as perplexities span a few powers of e
    ranked = bins.select("lang", "bin", F.sum("n").over(window).alias("all"), F.sum("n").over(window.orderBy("bin")).alias("upto"))
    middle = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) + 0.5) * step
    span = F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
    return ranked.groupBy("lang").agg(middle(0.25).alias("q1"), middle(0.75).alias("q3")).select("lang", (F.col("q1") - fence * span).alias("low"), (F.col("q3") + fence * span).alias("high"))


def _stretches(sizes: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch of texts of these sizes begins, and the text it is of."""
    n = -(-sizes // stretch)
    text = np.repeat(np.arange(len(sizes)), n)
    within = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.cumsum(sizes) - sizes, n) + within * stretch, text


def read_by_language(model: Model, texts: list[str], stretch: int = STRETCH) -> tuple[np.ndarray, list[str]]:
    """Of each text the log perplexity, each stretch by the language that gives the most (of several the first), and the language of most of its characters."""
    g = Grams(texts, model.order)
    begin, text = _stretches(g.sizes, stretch)
    sums = np.stack([np.add.reduceat(model.log_probability(lang, g.grams)[g.which], begin) for lang in model.languages])
    best = sums.argmax(0)
    total = np.bincount(text, sums[best, np.arange(len(text))], len(texts))
    length = np.diff(np.append(begin, g.sizes.sum()))
    shares = np.bincount(text * len(sums) + best, length, len(texts) * len(sums)).reshape(len(texts), -1)
    return -total / g.sizes, [model.languages[i] for i in shares.argmax(1)]


def _measured(docs: DataFrame, model: Model | None, order: int, stretch: int = STRETCH) -> DataFrame:
    """docs (its last column the text) with the rules' counts, the log perplexity and the language; without a model, with the different n-grams of each stretch."""
    names, n = docs.columns[:-1], len(docs.columns) - 1
    held = docs.sparkSession.sparkContext.broadcast(model) if model else None
    more = "log_perplexity double, _lang string" if model else "n_grams bigint, grams array<struct<s:int,gram:string,c:bigint>>"
    kind = pa.list_(pa.struct([("s", pa.int32()), ("gram", pa.string()), ("c", pa.int64())]))

    def by_stretch(t: str) -> tuple[int, list[dict]]:
        g = Grams([t], order)
        begin, _ = _stretches(g.sizes, stretch)
        strings, out = _strings(g.grams), []
        for i, own in enumerate(np.split(g.which, begin[1:])):
            which, c = np.unique(own, return_counts=True)
            out += [{"s": i, "gram": strings[w], "c": k} for w, k in zip(which.tolist(), c.tolist())]
        return int(g.sizes[0]), out

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                texts, size, hi = [], 0, lo
                while hi < b.num_rows and (not texts or size < PIECE and len(texts) < 1024):
                    texts.append(b.column(n)[hi].as_py() or "")
                    size, hi = size + len(texts[-1]), hi + 1
                counts = rule_counts(texts)
                if held:
                    scores, langs = read_by_language(held.value, texts, stretch)
                    last = [pa.array(scores, pa.float64()), pa.array(langs, pa.string())]
                else:
                    sizes, grams = zip(*map(by_stretch, texts))
                    last = [pa.array(sizes, pa.int64()), pa.array(grams, kind)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(n)), *(pa.array(counts[:, i], pa.int64()) for i in range(5)), *last], [*names, *_NAMES, *(["log_perplexity", "_lang"] if held else ["n_grams", "grams"])])
                lo = hi

    return docs.mapInArrow(measure, extended(docs.select(*names).schema, f"{_COUNTS}, {more}"))


def _read_by_join(grams: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """grams (gram), all of `order` characters: (lang, gram, logp) by every language of the model, by the longest context each knows."""
    languages = [r[0] for r in model.where("gram = ''").select("lang").collect()]  # a row a language
    found = grams.distinct().select("gram", F.explode(F.lit(languages)).alias("lang"), F.lit(None).cast("double").alias("logp"), F.lit(0.0).alias("weight"))
    for k in range(order, -1, -1):
        own = model.select("lang", F.col("gram").alias("_g"), F.col("logp").alias("_p"))
        found = found.withColumn("_g", F.substring("gram", order - k + 1, k)).join(own, ["lang", "_g"], "left").withColumn("logp", F.coalesce("logp", F.col("weight") + F.col("_p"))).drop("_g", "_p")
        if k:
            back = model.select("lang", F.col("gram").alias("_g"), F.col("back").alias("_b"))
            found = found.withColumn("_g", F.substring("gram", order - k + 1, k - 1)).join(back, ["lang", "_g"], "left").withColumn("weight", F.col("weight") + F.coalesce("_b", F.lit(0.0))).drop("_g", "_b")
    return found.select("lang", "gram", "logp")


def _by_join(docs: DataFrame, model: DataFrame, order: int, stretch: int = STRETCH) -> DataFrame:
    """_measured for a model of any size: the different n-grams of documents' stretches meet the model's rows."""
    rows = materialise(_measured(docs, None, order, stretch).withColumn("_row", F.monotonically_increasing_id()), "grams")
    flat = rows.select("_row", F.explode("grams").alias("g")).select("_row", "g.s", "g.gram", "g.c")
    read = materialise(_read_by_join(flat.select("gram"), model, order), "read")
    sums = flat.join(read, "gram").groupBy("_row", "s", "lang").agg(F.sum(F.col("c") * F.col("logp")).alias("p"), F.sum("c").alias("n"))
    best = sums.groupBy("_row", "s").agg(F.min(F.struct((-F.col("p")).alias("p"), "lang", "n")).alias("b")).select("_row", "b.*")
    whole = best.groupBy("_row", "lang").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).groupBy("_row").agg(F.sum("p").alias("_sum"), F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("l"))
    return rows.join(whole, "_row").withColumns({"log_perplexity": F.col("_sum") / F.col("n_grams"), "_lang": F.col("l.lang")}).drop("_row", "_sum", "l", "grams", "n_grams")


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, held: int = HELD, fence: float = FENCE) -> DataFrame:
    """docs without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_perplexity (nats a character), read_as and kept.

    Words are what ASCII white space parts. kept: the base rules pass, and the log perplexity under the languages' models, each of all documents that the column lang says are in it, lies in the
    band of the language that most of the text reads as (read_as).
    A null text counts as empty and fails the base rules, as an empty one does. A null language is one of its own to learn from. The time of reading grows with the number of languages. Repeated rows are judged alike; very long texts are looked at
    whole; an empty table gives no rows. A language in which no text passes the base rules has no band, and none of its texts is kept. Extra columns pass; those of the result's names are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c in RESULT])
    docs, back = set_aside(docs, "_lang", "_row", "_sum", "_low", "_high", "_band", "grams", "n_grams")
    lang, text = ({v: k for k, v in back.items()}.get(c, c) for c in (lang, text))
    model = materialise(kneser_ney(materialise(gram_counts(docs, order, text, lang), "counts"), order), "ngrams")
    own = docs.select(*[c for c in docs.columns if c != text], F.col(text))
    rows = model.count()
    found = _measured(own, Model(model.toArrow(), order), order) if rows <= held else _by_join(own, model, order)
    scored = materialise(found.withColumn("base_failed", base_failed()), "scored")
    band = bands(scored.select("base_failed", *_NAMES, "log_perplexity", F.col("_lang").alias("lang")), fence).select(F.col("lang").alias("_band"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    judged = scored.join(F.broadcast(band) if rows <= held else band, F.col("_lang") == F.col("_band"), "left")  # a language has rows in the model, so they bound the bands' number
    inside = F.coalesce(F.col("log_perplexity").between(F.col("_low"), F.col("_high")), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & inside).drop("_band", "_low", "_high").withColumnRenamed("_lang", "read_as").withColumnsRenamed(back)
