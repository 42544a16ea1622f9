"""The corpus operators against brute force, on small rows full of edge cases and on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from braidwork.llm import common, decontamination, html_wrapper, induced, itq, line_dedup, packing, quality_fm, queries, simhash, suffix_dedup
from braidwork.llm.components import connected_components
from braidwork.llm.credential_links import credential_findings, link
from braidwork.llm.sharding import hypergeometric, hypergeometric_shards
from tests.conftest import DATA

EXTRA = "shard string, score string, kept string, items string, text_ string"
COPY = "the same long line that stands in very many documents of this small corpus\n"
LONG = "".join(f"word{i % 977} is here; " for i in range(12_000))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names results use as well."""
    texts = [None, "", " ", "a", COPY * 3 + "own", *[COPY.upper() + f"text {i} and more" for i in range(5)], LONG, LONG, "é" * 50 + "\n" + COPY, "x" * 1500, "\n\n"]
    rows = [(i, t, 1, "s") for i, t in enumerate(texts)] + [(2, " ", 1, "s"), (None, COPY + "nobody", None, "t")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, source string").withColumns({c.split()[0]: F.lit("clash") for c in EXTRA.split(", ")}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def real(spark):
    return common.table(spark, DATA, "documents")


# 1 sharding


def test_shards_are_exact_gapless_and_repeatable(spark, docs, none):
    n = docs.count()
    rows = hypergeometric_shards(docs, 4).collect()
    assert len(rows) == n and Counter(Counter(r.shard for r in rows).values()).keys() <= {n // 4, n // 4 + 1}
    for s in range(4):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    key = lambda rs: sorted((str(r.doc_id), str(r.text), r.source) for r in rs)
    assert key(rows) == key(docs.collect())
    ids = spark.range(500).withColumnRenamed("id", "doc_id")
    place = lambda df, **k: {r.doc_id: (r.shard, r.slot) for r in hypergeometric_shards(df, 7, **k).collect()}
    assert place(ids) == place(ids.repartition(9)) != place(ids, seed=1)
    assert hypergeometric_shards(none, 4).collect() == []


def test_a_key_of_most_rows_is_spread(spark):
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 > 0 THEN 7 WHEN id % 9 > 0 THEN null ELSE id END AS doc_id", "id AS v")
    rows = hypergeometric_shards(df, 6).collect()
    assert len({r.v for r in rows}) == 30_000 and set(Counter(r.shard for r in rows).values()) == {5000}
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(5000)) for s in range(6))


def test_hypergeometric_draws_follow_their_law(spark):
    good, bad, sample, n = 30, 50, 24, 4000
    c = lambda v: F.lit(v).cast("bigint")
    got = Counter(r[0] for r in spark.range(n).select(hypergeometric(c(good), c(bad), c(sample), F.col("id"))).collect())
    law = {k: math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample) for k in range(sample + 1)}
    chi = sum((got[k] - n * p) ** 2 / (n * p) for k, p in law.items() if n * p >= 5)
    assert chi < 3 * sum(n * p >= 5 for p in law.values()) and set(got) <= {k for k, p in law.items() if p}
    edge = spark.range(1).select(hypergeometric(c(0), c(5), c(3)), hypergeometric(c(4), c(0), c(3)), hypergeometric(c(4), c(5), c(9)), hypergeometric(c(10**12), c(23 * 10**12), c(10**10))).first()
    assert tuple(edge)[:3] == (0, 3, 4) and abs(edge[3] - 10**10 / 24) < 10**6


def test_shards_mix_as_a_uniform_shuffle(spark):
    """Neighbours of the input fall together no more often than chance has it."""
    rows = {r.doc_id: r.shard for r in hypergeometric_shards(spark.range(6000).withColumnRenamed("id", "doc_id"), 6).collect()}
    together = sum(rows[i] == rows[i + 1] for i in range(5999)) / 5999
    assert abs(together - 1 / 6) < 0.025


# 2 secrets


def test_base_spans_are_the_patterns(docs, none, real):
    def base(t):
        a = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        b = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        return sorted(a + b + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24], key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))

    for df in (docs, real):
        for r, t in zip(credential_findings(df).collect(), df.collect()):
            assert [(f.kind, f.start, f.end) for f in r.findings if f.kind in ("assign", "access", "hex")] == base(t.text or "")
    assert credential_findings(none).collect() == []


def test_weak_parts_need_their_complement():
    kinds = lambda t: [f["kind"] for f in link(t, 400)]
    bare = "Zk9" + "Qw7LmN2pXr5T" * 3 + "a"
    assert kinds(f"user: bob {bare}") == ["identifier", "bare"] and kinds(bare) == [] and kinds("user: bob at https://x.io/") == []
    assert kinds("password = hunter22 https://db.x.io/a") == ["assign", "endpoint"]
    assert kinds("password = hunter22\n\nhttps://db.x.io/a") == ["assign"]  # another scope
    assert kinds("password = hunter22 " + "z " * 300 + "https://db.x.io/a") == ["assign"]  # out of reach
    assert kinds("paßwordſ to\u212aen=abcdef ſecret=abcdefg AKIA123") == []  # look-alikes of letters don't count
    assert kinds('API_KEY="abc" secret : x1y2z3 AKIA' + "A" * 16) == ["assign", "access"]


# 3 lines


def lines_brute(rows, least=40, docs_=5):
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held.setdefault(k, []).append(i)
    holder = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= docs_}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if holder.get(key(x)) in (None, i)]
        out.append((str(i), None if t is None else "\n".join(kept), len(ls), len(ls) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("room", [64 << 20, 0])
def test_lines_by_held_and_by_sent_probes(docs, none, real, room):
    """room 0: the shards are too large for a task, and probes travel."""
    for df in (docs, real):
        got = sorted(((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df, broadcast_bytes=room).collect()), key=str)
        assert got == lines_brute([(r.doc_id, r.text) for r in df.collect()])
    assert line_dedup.dedup_lines(none, broadcast_bytes=room).collect() == []


def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    keys[1] = keys[0]  # two lines of one key
    prints, holders = rng.integers(0, 2**63, len(keys)).astype(np.uint64), np.arange(len(keys))
    counts = rng.integers(1, 99, len(keys))
    shard = line_dedup.Shard.load(line_dedup.Shard.build(keys, prints, counts, holders).dump())
    count, holder = shard.look_up(keys, prints)
    assert (count == counts).all() and (holder == holders).all() and sorted(shard.hash(np.unique(keys))) == list(range(len(np.unique(keys))))
    assert not shard.look_up(rng.integers(0, 2**63, 5000).astype(np.uint64), prints[:5000])[0].any()


# 4 quality


def test_quality_on_held_out_rows(spark, docs, none):
    d = common.table(spark, DATA.replace("0.001", "0.1"), "documents").where("doc_id < 3000")
    labels = common.table(spark, DATA.replace("0.001", "0.1"), "labels").where("doc_id < 3000")
    model = quality_fm.train(d, labels)
    scored = quality_fm.score_quality(d, model).join(labels, "doc_id").where(quality_fm.held_out()).select("score", "quality").collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in scored]) > 0.97
    edge = quality_fm.score_quality(docs, model).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 for r in edge) and len({r.score for r in edge if r.text == LONG}) == 1
    assert quality_fm.score_quality(none, model).collect() == []
    flipped = labels.withColumn("quality", F.when(quality_fm.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality_fm.train(d, flipped).w, model.w)  # nothing is learned from held-out rows
    empty = quality_fm.train(d, labels.limit(0))
    assert quality_fm.score_quality(docs, empty).count() == docs.count()


def test_factorisation_identity():
    rng = np.random.default_rng(2)
    m = quality_fm.FactorisationMachine(rng.normal(size=9), rng.normal(size=(9, 3)))
    at, x = np.array([1, 4, 7]), rng.normal(size=3)
    pairs = sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert np.isclose(m.raw(at, x, np.array([0]))[0][0], m.w[at] @ x + pairs)


# 5 simhash


def components_brute(n, linked):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_against_all_pairs(docs, none, real):
    def print_(t):
        w = re.findall(rb"[^ \t-\r]+", (t or "").encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in (zip(w, w[1:], w[2:]) if len(w) > 2 else [w] if w else [])]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for df in (docs.where("doc_id IS NOT NULL AND length(text) < 10000 OR text IS NULL"), real):
        rows = sorted(((r.doc_id, print_(r.text)) for r in df.select("doc_id", "text").collect()), key=lambda x: x[0])
        root = components_brute(len(rows), lambda i, j: (rows[i][1] ^ rows[j][1]).bit_count() <= 2)
        want = sorted((i, p, rows[r][0]) for (i, p), r in zip(rows, root))
        assert sorted((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(none).collect() == []


def test_bit_sliced_comparison_and_forests():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (3, 2)).astype(np.uint64)
    f = np.concatenate([base[i % 3] ^ (np.uint64(1) << rng.integers(0, 63, 2).astype(np.uint64)) for i in range(200)]).reshape(-1, 2)
    far = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    for radius in (1, 2, 3, 5, 31):
        q, r, d = simhash.within(f[:50], simhash.planes(f), radius)
        ok = r < len(f)
        assert set(zip(q[ok].tolist(), r[ok].tolist(), d[ok].tolist())) == {(i, j, int(far[i, j])) for i, j in zip(*np.nonzero(far[:50] <= radius))}
    for key in (np.zeros(200, np.int64), np.arange(200) // 10):  # one long run; short ones
        u, v = simhash.compare(f, key, 2)
        got = components_brute(200, lambda i, j, s={(int(a), int(b)) for a, b in zip(u, v)}: (i, j) in s or (j, i) in s)
        assert got == components_brute(200, lambda i, j: key[i] == key[j] and far[i, j] <= 2)


def test_hot_keys_are_dealt_in_pairs_of_blocks(spark):
    rng = np.random.default_rng(15)
    prints = sorted({int(x) for x in (np.int64(7 << 40) ^ (np.int64(1) << rng.integers(0, 34, (300, 4))).sum(1))} | set(rng.integers(0, 2**62, 50).tolist()))
    df = spark.createDataFrame([(x,) for x in prints], "fingerprint bigint")
    want = components_brute(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    for most in (1 << 16, 20):
        roots = {r.node: r.root for r in connected_components(simhash.fingerprint_links(df, hot_rows=most)).collect()}
        assert [prints.index(roots.get(x, x)) for x in prints] == want
    rows = df.select(F.lit(1).cast("bigint").alias("key"), F.col("fingerprint").alias("id"))
    cells = Counter(r.key for r in simhash.dealt(rows, simhash.hot_keys(rows, 20)).collect())
    assert max(cells.values()) < 100 and len(cells) > 100
    words = [f"w{x}" for x in range(120)]
    texts = [" ".join([*words[:k], f"own{k}", *words[k:]]) for k in range(0, 120, 2)] + ["some other text that has words of its own"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.component_id for r in simhash.similar_documents(docs, hot_rows=8).collect()} == {0, 60}


def test_components_of_long_chains_and_stars(spark, tmp_path):
    pairs = [(i, i + 1) for i in range(100)] + [(200, x) for x in range(201, 240)] + [(5, 5), (None, 3), (5, 6)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 200 for i in range(200, 240)}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_similar_documents_by_sets(spark):
    rng = np.random.default_rng(7)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 400, 300)) for _ in range(20)]

    def edited(t, n):
        w = t.split()
        for k in rng.choice(len(w), n, replace=False):
            w[k] = f"new{rng.integers(0, 10**6)}"
        return " ".join(w)

    texts = [t for b in base for t in (b, edited(b, 3), edited(b, 5), edited(b, 40))] + [base[0], "", None, "short one"]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in ((t or "").split() for t in texts)]
    similar = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) if sets[i] or sets[j] else True
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == components_brute(len(texts), similar)
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == ["doc_id", "text"]


def test_similar_pairs_behind_nearer_fingerprints_and_of_small_sets(spark):
    rng = np.random.default_rng(11)
    fresh = iter(range(10**6))

    def edited(w, n):
        w = list(w)
        for k in rng.choice(len(w) // 5 - 1, n, replace=False):
            w[5 * k + 4] = f"new{next(fresh)}"
        return w

    # A family whose members are candidates of each other, but only thirty pairs are similar.
    base = [f"w{x}" for x in range(300)]
    family = [edited(base, 5) for _ in range(80)]
    texts = family + [edited(t, 6) for t in family[:30]]
    # Four shingles of five.
    for _ in range(200):
        w = [f"s{next(fresh)}" for _ in range(9)]
        texts += [w, w[:8]]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = components_brute(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert len(set(want[:110])) == 80 and len(set(want[110:])) == 200
    found = [got[i] for i in range(len(texts))]
    assert found[:110] == want[:110]
    assert found[110:] == want[110:]


# 6 packing


def test_pieces_are_the_tokens_and_bins_hold(docs, none, real):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    for df in (docs, real.limit(60)):
        rows = packing.pack_documents(df, path, with_ids=True).collect()
        want = []
        for d in df.collect():
            ids = [*tk.encode(d.text or "", add_special_tokens=False).ids, 2]
            cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
            want += [(str(d.doc_id), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in rows) == sorted(want)
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1024
    assert packing.pack_documents(none, path).collect() == []


def test_sequences_hold_their_pieces_in_order(docs):
    import public_tokenizers

    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    rows, want = packed.collect(), {}
    for r in sorted(rows, key=lambda r: r.offset):
        ids, names = want.setdefault(r.sequence_id, ([], []))
        ids += r.ids
        names.append(r.doc_id)
    assert {r.sequence_id: (r.ids, r.doc_ids) for r in packing.assembled(packed).collect()} == want


def test_columns_named_as_inner_ones_stay(spark, docs):
    """Columns that operators use inside are the caller's when the caller has them."""
    import public_tokenizers

    inner = ("_bucket", "_rank", "_ends", "_cell", "_t", "blob", "_before", "_key", "_own_blob", "n_lines", "n_dropped")
    df = docs.where("length(text) < 5000").withColumns({c: F.concat(F.lit(c), "doc_id") for c in inner})
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    import corpus_pipeline as P

    found = {
        "shards": hypergeometric_shards(df, 3), "substrings": suffix_dedup.dedup_substrings(df), "quality": quality_fm.keep_quality(df, labels, 0.0), "lines": P.lines(spark, df, ""),
        "packed": packing.pack(df.select(*inner, "doc_id", F.lit(0).alias("piece"), F.lit(5).cast("bigint").alias("length"))),
    }
    n = df.count()
    for name, out in found.items():
        rows = out.collect()
        assert len(rows) == n and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in inner), name
    assert found["quality"].columns == df.columns and found["lines"].columns == df.columns


def test_repeated_rows_leave_the_same_one(spark):
    rows = [(1, f"text {k} of one id with some words more", k) for k in (3, 1, 2)] + [(2, "another text of other words entirely here", 0)]
    for order in (rows, rows[::-1]):
        kept = simhash.keep_one(spark.createDataFrame(order, "doc_id bigint, text string, n int")).collect()
        assert sorted((r.doc_id, r.n) for r in kept) == [(1, 1), (2, 0)]


def test_fast_ids_equal_the_tokenizers_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    encode = packing.encoder(path)
    for t in ["", " ", "\n\n a", "it's  HERE'S\t x\u0085y", "<|endoftext|>x", "a <|endoftext|> b", "<|endoftext", "naïve Ærø ñ 12³½ ٣", "日本語テスト 🤖👩‍👩‍👧", "a​b﻿", "x" * 3000, "֐힣", "Ωμέγα ЖЙ  \r\n"]:
        assert encode(t).tolist() == tk.encode(t, add_special_tokens=False).ids, t
    # Every letter that the faster library is asked about, and every token of the vocabulary.
    for c in map(chr, range(0x540)):
        for t in (f"a{c}b", f" {c} 1", f"{c}{c}\n", f"é{c}'s"):
            assert encode(t).tolist() == tk.encode(t, add_special_tokens=False).ids, t
    for i in range(tk.get_vocab_size()):
        t = tk.decode([i], skip_special_tokens=False)
        assert encode(t).tolist() == tk.encode(t, add_special_tokens=False).ids, t


def test_plan_keeps_every_constraint_and_wastes_little():
    rng = np.random.default_rng(3)
    lengths = Counter(int(x) for x in rng.integers(1, 1025, 5000))
    for limits in ({}, {"max_docs": 3}, {"max_cost": 400_000}):
        items = {k: v for k, v in lengths.items() if k * k <= limits.get("max_cost", 1 << 40)}
        rows, n = packing.plan(items, **limits)
        bins, placed = {}, Counter()
        for length, rank, count, first, offset in rows.tolist():
            placed[length] += count
            for k in range(count):
                bins.setdefault(first + k, []).append((offset, length))
        assert placed == Counter(items) and len(bins) == n
        for b in bins.values():
            b.sort()
            assert all(b[k][0] == sum(x for _, x in b[:k]) for k in range(len(b))) and sum(x for _, x in b) <= 1024
            assert len(b) <= limits.get("max_docs", 1024) and sum(x * x for _, x in b) <= limits.get("max_cost", 1 << 40)
        if not limits:
            assert n <= 1.01 * -(-sum(k * v for k, v in items.items()) // 1024) + 1


# 7 html

PAGE = '<html><head><title>T</title><script>x("</p>")</script></head><body><header>Site</header><nav><ul>{nav}</ul></nav><div class="cookie-notice">We use</div><main><article><h1>{h}</h1>{p}<form>mail</form></article></main><aside>Side</aside><section id="comments"><p>Nice!</p></section><footer>F</footer></body></html>'


def page(h, ps, nav=3):
    return PAGE.format(h=h, p="".join(f"<p>{x}</p>" for x in ps), nav="".join(f"<li><a href='/{i}'>n{i}</a></li>" for i in range(nav)))


def test_pages(spark):
    rows = [
        (1, "http://a.io/1", page("One &amp; only", ["a  b\n c", "d<b>e</b>f<br>g&nbsp;h"])),
        (2, "http://a.io/2", page("Two", ["x"], nav=5)),
        (3, "http://a.io/3", page("Three", [])),
        (4, "http://b.io/", "<p>loose<p>blocks<div class='ad'>buy</div>"),
        (5, "http://a.io/5", page("Cut", ["kept", "also"])[:330]),
        (6, None, None),
        (7, "", ""),
        (7, "", ""),
        (8, "http://a.io/8", "<article><h2>Odd &lt;layout&gt;</h2><table><tr><td>c1<td>c2</table><ul><li>i<li>j</ul></article>"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    want = {1: "One & only a b c def g h", 2: "Two x", 3: "Three", 4: "loose blocks", 6: "", 7: "", 8: "Odd <layout> c1 c2 i j"}
    for room in (32 << 20, 0):  # wrappers held, and joined
        got = html_wrapper.extract_pages(df, held_bytes=room).collect()
        assert len(got) == len(rows)
        assert {r.page_id: r.text for r in got if r.page_id != 5} == want
        assert {r.text for r in got if r.page_id == 5}.pop().startswith("Cut")
    assert html_wrapper.extract_pages(df.limit(0)).collect() == []


def test_wrappers_are_union_free_expressions():
    w = html_wrapper.Wrapper.infer([page("A", ["x", "y"]), page("B", ["z"], nav=1), page("C", [])])
    form = html_wrapper.expression(w.tree)
    assert "|" not in form and "(?:<li>#</>)+" in form and "(?:<p>#</>)*" in form
    assert all(w.matches(html_wrapper.stream(html_wrapper.parse(page("Q", ["1"] * k, nav=n)))) for k in (0, 3) for n in (1, 4))
    assert not w.matches(html_wrapper.stream(html_wrapper.parse("<div>other</div>")))


def test_copies_of_one_page_make_no_template(spark):
    form = "<html><body><div class=top>Site</div><div><p>{}</p></div></body></html>"
    rows = [(i, "http://copies.org/a", form.format("The same text")) for i in range(20)]
    rows += [(20 + i, f"http://copies.org/{i}", form.format(f"Text {i}")) for i in range(6)]
    # A host of copies alone, one of copies that differ in an attribute that says nothing, and an element that one page has.
    rows += [(30 + i, "http://alone.org/", form.format("Lonely")) for i in range(4)]
    rows += [(40 + i, f"http://nonce.org/{i}", form.format("Nonce").replace("<div>", f"<div data-n={i}>")) for i in range(4)]
    rows += [(50 + i, f"http://once.org/{i}", form.format(f"Text {i}") + ("<h2>Once</h2>" if i == 2 else "")) for i in range(12)]
    got = {r.page_id: r.text for r in html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    want = {i: "The same text" for i in range(20)} | {20 + i: f"Text {i}" for i in range(6)}
    want |= {30 + i: "Site Lonely" for i in range(4)} | {40 + i: "Site Nonce" for i in range(4)} | {50 + i: f"Text {i}" + (" Once" if i == 2 else "") for i in range(12)}
    assert got == want


def test_main_text_of_the_real_pages(spark):
    import html as H

    pages = common.table(spark, DATA, "pages")
    for r in html_wrapper.extract_pages(pages.select("page_id", "html")
                                        .join(pages.select("page_id", "url"), "page_id")).join(pages.select("page_id", F.col("html").alias("h")), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.h, re.S)[1]
        assert r.text == " ".join(H.unescape(re.sub(r"<br>|</?(?:p|h1)>", " ", inner).replace("<b>", "")).split())


def plain_host(n, seed, pool=6):
    """Pages without telling tags or names: a menu of links, a notice from a pool, the article, an imprint. (pages, their articles)"""
    rng = np.random.default_rng(seed)
    sentence = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, rng.integers(8, 20))) + "."
    notices, out, want = [f"Notice {k} of the house for everybody who reads." for k in range(pool)], [], []
    for i in range(n):
        ps = [sentence() for _ in range(rng.integers(1, 9))]
        links = "".join(f"<div><a href='/{x}'>Go {x}</a></div>" for x in rng.integers(0, 30, rng.integers(2, 7)))
        head = f"Headline {i} {rng.integers(10**6)}"
        body = "".join(f"<p>{p}</p>" for p in ps)
        out.append(f"<html><body><div class=zq>{links}</div><div class=kx>{notices[rng.integers(pool)]}</div><div class=vv><h1>{head}</h1>{body}</div><div class=pp>All rights by the house.</div></body></html>")
        want.append(" ".join([head, *ps]))
    return out, want


def test_the_wrapper_finds_the_article_where_names_say_nothing(spark):
    pages, want = plain_host(40, 1)
    w = html_wrapper.Wrapper.infer(pages)
    assert [html_wrapper.extract(p, w) for p in pages] == want
    alone = html_wrapper.Wrapper(["root", [], False, False], 0)
    without = [html_wrapper.extract(p, alone) for p in pages]
    assert sum(a != b for a, b in zip(without, want)) > 30  # a page by itself shows neither its template nor its notices
    rows = [(i, f"http://plain.org/{i}", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()}
    assert [got[i] for i in range(len(pages))] == want
    # The order in which pages are merged says nothing about the result.
    turned = html_wrapper.Wrapper.infer(pages[::-1])
    assert [html_wrapper.extract(p, turned) for p in pages] == want


def test_the_wrapper_overrules_tags_and_names():
    """Teasers in article elements beside the text; names of widgets on blocks of prose, telling names on others."""
    pages, want = [], []
    for i in range(12):
        text = f"The long text number {i} has a sentence of its own, and then it goes on for quite a while with others. " * 3
        pages.append(f"<body><article class=box>Read on {i % 2}</article><div class=main-text><h2>Title {i}</h2><p>{text}</p></div></body>")
        want.append(f"Title {i} {' '.join(text.split())}")
    w = html_wrapper.Wrapper.infer(pages)
    assert [html_wrapper.extract(p, w) for p in pages] == want
    inside = "<article><h1>On the market</h1><div class='social-science'>It is a science of its own.</div><div class='share price'>The price of the share rose by a tenth within the week.</div><div class='share-bar'>Share Post</div><ol class='comment-list'><li>I like it, and I read it twice today.</li></ol><p>End.</p></article>"
    assert html_wrapper.extract(inside, html_wrapper.Wrapper.infer([inside])) == "On the market It is a science of its own. The price of the share rose by a tenth within the week. End."


def test_deep_and_broken_nesting():
    deep = "<div>" * 130 + "<nav>MENU <ul><li>deep</li></ul></nav><p>tail</p>" + "</div>" * 130 + "<p>after</p>"
    assert html_wrapper.extract(deep, html_wrapper.Wrapper.infer([deep])) == "tail after"
    deeper = "<article>" + "<div>" * 5000 + "kept" + "</div>" * 5000 + "<p>also</p></article><footer>F</footer>"
    assert html_wrapper.extract(deeper, html_wrapper.Wrapper.infer([deeper])) == "kept also"
    broken = "<article><p>a</div></section><p>b<nav>x</article>c"
    assert html_wrapper.extract(broken, html_wrapper.Wrapper.infer([broken])) == "a b"


def test_long_mixed_runs_cost_no_squares():
    import time

    rng = np.random.default_rng(3)
    kinds = ["<p>{}</p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<div class=note-{}>{}</div>", "<pre>{}</pre>"]
    pages = ["<article>" + "".join(kinds[k].replace("{}", f"t{i}x{j}", 2) for j, k in enumerate(rng.integers(0, 5, 3000))) + "</article>" for i in range(6)]
    pages.append("<article>" + "".join(f"<div class={chr(97 + j % 26)}{chr(97 + j // 26 % 26)}>u{j}</div>" for j in range(600)) + "</article>")
    began = time.time()
    w = html_wrapper.Wrapper.infer(pages)
    texts = [html_wrapper.extract(p, w) for p in pages]
    assert time.time() - began < 20
    assert [len(t.split()) for t in texts] == [3000] * 6 + [600]
    small = html_wrapper.Wrapper.infer(["<p>a</p><h2>b</h2><pre>c</pre>" * 2 + "<p>x</p><pre>y</pre>" for _ in range(2)])
    assert small.matches(html_wrapper.stream(html_wrapper.parse("<p>a</p><h2>b</h2><pre>c</pre>" * 2 + "<p>x</p><pre>y</pre>")))


# 8 benchmark


def contamination_brute(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(13, len(w))
        for s in range(len(w) - k + 1) if k and i is not None else ():
            windows.setdefault(tuple(w[s : s + k]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s : s + k])) in windows:
                    hit |= set(range(s, s + k))
                    found |= windows[x]
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_contamination(spark, docs, none, real, block):
    """block 40: the benchmark comes in many blocks."""
    items = [(1, COPY + "text 3 AND more"), (2, "Text, 4"), (3, None), (4, ""), (5, "ééé! " * 9), (None, "a"), (6, "word976 is here word0 is here word1 is here word2 is here word3 is"), (6, "Text 4")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for df, b, its in ((docs, bench, items), (real, common.table(spark, DATA, "benchmark"), None)):
        its = its or [(r.item_id, r.text) for r in b.collect()]
        rows = decontamination.find_benchmark(df, b, block_chars=block).collect()
        assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows] == contamination_brute([r.text for r in rows], its)
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() and kept.where("items = 'clash'").count() == kept.count()
    assert decontamination.find_benchmark(none, bench).collect() == [] and decontamination.find_benchmark(docs, bench.limit(0)).where("contaminated").count() == 0


def near_brute(texts, items, distance, window=13):
    """(text, item, first, n) of the shortest interval of at most `distance` words with all words of a window."""
    words, out = decontamination.words, set()
    for d, t in enumerate(texts):
        w = words(t)
        for item, x in items:
            x, best = words(x), None
            k = min(window, len(x))
            for s in range(len(x) - k + 1) if k and item is not None else ():
                need = set(x[s : s + k])
                for n in range(len(need), distance + 1):
                    for first in range(len(w) - n + 1):
                        if need <= set(w[first : first + n]):
                            best = min(best or (n, first), (n, first))
            if best:
                out.add((d, str(item), best[1], best[0]))
    return out


def test_proximity_matches(spark):
    rng = np.random.default_rng(21)
    vocabulary = [f"w{x}" for x in range(30)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(40)] + [None, "", "w1 w2 w3"]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 7)))) for k in range(12)] + [(None, "w1"), (20, None)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for window, distance, block in ((4, 9, 8 << 20), (5, 5, 20)):
        got = {(r.doc_id, r["item"], r.first, r.n) for r in decontamination.near_benchmark(df, bench, distance, window, block).collect()}
        assert got == near_brute(texts, items, distance, window) and got
        exact = decontamination.find_benchmark(df, bench, window).select("doc_id", F.explode("items").alias("item")).collect()
        assert {(r.doc_id, r["item"]) for r in exact} <= {(d, i) for d, i, _, _ in got}
        near = decontamination.find_benchmark(df, bench, window, block, distance=distance).select("doc_id", F.explode("near").alias("item")).collect()
        assert sorted((r.doc_id, r["item"]) for r in near) == sorted({(d, i) for d, i, _, _ in got})


def test_stored_postings_are_the_tokens(spark, docs):
    """Every token of every text can be read back from the index."""
    shards = decontamination.positional_index(docs.select("text"), shard_bytes=300).collect()
    got = set()
    for r in shards:
        h1, h2, begin = np.frombuffer(bytes(r.documents), "<i8").reshape(3, -1)
        terms, counts, steps = np.frombuffer(bytes(r.terms), "<i8"), np.frombuffer(bytes(r.counts), "<u4"), np.frombuffer(bytes(r["at"]), np.uint8).reshape(-1, 3)
        steps = steps.astype(np.int64) @ np.array([1, 256, 65536])
        places = sorted((int(p), int(t)) for t, own in zip(terms, np.split(steps, np.cumsum(counts)[:-1])) for p in np.cumsum(own))
        for k in range(len(begin) - 1):
            own = [(p - int(begin[k]), t) for p, t in places if begin[k] <= p < begin[k + 1]]
            assert [p for p, _ in own] == list(range(len(own)))
            got.add((int(h1[k]), int(h2[k]), tuple(t for _, t in own)))
    a, b = decontamination.text_hashes()
    hashed = lambda t: tuple(int(np.uint64(decontamination.term_hash(w)).astype(np.int64)) for w in decontamination.words(t))
    assert len(shards) > 3 and got == {(r[1], r[2], hashed(r[0])) for r in docs.where("text <> ''").select("text", a, b).collect()}


@pytest.mark.parametrize("room", [32 << 20, 0])
def test_matches_go_back_held_and_joined(spark, docs, room):
    bench = spark.createDataFrame([(1, COPY + "text 3 AND more"), (2, "Text, 4")], "item_id bigint, text string")
    rows = decontamination.find_benchmark(docs.withColumn("_h1", F.lit("own")), bench, held_bytes=room).collect()
    assert len(rows) == docs.count() and {r["_h1"] for r in rows} == {"own"}
    kept = decontamination.drop_contaminated(docs, bench, room).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(r.doc_id), str(r.text)) for r in rows if not r.contaminated) and 0 < len(kept) < len(rows)
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows] == contamination_brute([r.text for r in rows], [(1, COPY + "text 3 AND more"), (2, "Text, 4")])


# 9 embeddings


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(30, 16))
    vectors = [(c + rng.normal(size=16) * s).astype(np.float32).tolist() for c in centre for s in (0.0, 0.0, 0.1, 0.25, 0.3)]
    rows = [(i, v, i % 2 if i % 11 else None) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, [], 0), (905, vectors[0][:8], 0), (905, vectors[0][:8], 0), (906, [float("inf")] + [1.0] * 15, 0), (907, [2 * x for x in vectors[4]], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("n_links", F.lit("clash")).repartition(3)
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        (_, a, x), (_, b, y) = rows[i], rows[j]
        if x is None or x != y or not ok(a) or not ok(b) or len(a) != len(b):
            return False
        a, b = np.array(a, float), np.array(b, float)
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93

    n = [sum(i != j and linked(i, j) for j in range(len(rows))) for i in range(len(rows))]
    root = components_brute(len(rows), linked)
    got = itq.near_vectors(df).collect()
    assert len(got) == len(rows) and sum(r.n_links for r in got) >= 0.9 * sum(n) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    want = {rows[i][0]: (n[i], rows[root[i]][0]) for i in range(len(rows))}
    assert all(r.n_links <= want[r.vec_id][0] for r in got) and np.mean([want[r.vec_id] == (r.n_links, r.component_id) for r in got]) > 0.97
    assert itq.near_vectors(df.limit(0)).collect() == []


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is only just enough are found with the chance that the tables are made for."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(600, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.9301 * a + math.sqrt(1 - 0.9301**2) * b
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate((a, near)))]
    got = itq.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).where("n_links > 0").count()
    assert got >= 0.9 * 1200


def test_rows_with_company_in_their_bucket(monkeypatch):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(itq, "BLOCK", 50)
    code = rng.integers(0, 2**63, 400).astype(np.uint64)
    code[rng.integers(0, 400, 150)] = code[0] ^ (np.uint64(1) << rng.integers(0, 63, 150).astype(np.uint64))
    for sizes in ([1] * 50 + [2] * 25 + [7] * 10 + [230], [400], [33, 32, 1, 334]):
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        got = itq.accompanied(code, starts, 2)
        for lo, n in zip(starts, sizes):
            far = np.bitwise_count(code[lo : lo + n, None] ^ code[None, lo : lo + n]) + 64 * np.eye(n, dtype=int)
            assert (got[lo : lo + n] == (far <= 2).any(1)).all()


def test_a_dense_cluster_and_its_links(spark):
    """A third of all vectors near one another, at cosines around the threshold."""
    rng = np.random.default_rng(14)
    centre = rng.normal(size=32)
    x = np.concatenate((centre + rng.normal(size=(300, 32)) * 0.32 * rng.random((300, 1)), rng.normal(size=(600, 32)))).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r.n_links for r in itq.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")).collect()}
    links = np.array([got[i] for i in range(len(x))])
    assert near.sum() > 10_000 and (links <= near.sum(1)).all() and links.sum() >= 0.95 * near.sum()


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    rows = [(i, [1.0, i / 1e6], 0) for i in range(150)]
    monkeypatch.setattr(itq, "BLOCK", 40)
    got = itq.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(149, 0)}


# 10 substrings


def substrings_brute(texts, least):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + least] for r in raws for k in range(len(r) - least + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - least + 1):
            if seen[r[k : k + least]] > 1:
                gone[k : k + least] = True
        kept = np.frombuffer(r, np.uint8)[~gone[:-1]].tobytes()
        out.append((len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("room", [32 << 20, 0])
def test_substrings(spark, docs, none, real, room):
    """room 0: what goes back to the documents is joined to them, and no minimiser is hot; else nearly all are."""
    digest = lambda df, **k: sorted((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.dedup_substrings(df, held_bytes=room, hot=1 if room else 1 << 30, **k).collect())
    small = docs.where("text IS NULL OR length(text) < 5000")
    assert digest(small, least=40, gram=10) == substrings_brute([r.text for r in small.collect()], 40)
    assert digest(real.limit(120)) == substrings_brute([r.text for r in real.limit(120).collect()], 400)
    assert digest(none) == []


@pytest.mark.parametrize("hot", [0, 3, 1 << 30])
def test_substrings_of_random_texts(spark, hot):
    rng = np.random.default_rng(8)
    part = ["".join(rng.choice(list("ab"), 30)) for _ in range(12)]
    texts = ["".join(rng.choice(part, rng.integers(0, 8))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.dedup_substrings(df, least=24, gram=8, shard_bytes=64, hot=hot).collect())
    assert got == substrings_brute(texts, 24)


def test_a_hot_passage_in_many_contexts(spark, monkeypatch):
    """A passage of nearly all documents, whole and cut at either end, in contexts of their own, with a periodic stretch in it."""
    rng = np.random.default_rng(18)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = word(150) + "xy" * 40 + word(120)
    texts = [word(int(rng.integers(0, 60))) + passage[int(rng.integers(0, 90)) if k % 9 == 1 else 0 : -int(rng.integers(1, 90)) if k % 9 == 2 else None] + word(int(rng.integers(0, 60))) for k in range(90)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "STARTS", 7)
    for held in (1 << 20, 0):
        monkeypatch.setattr(suffix_dedup, "HELD_CORES", held)
        got = sorted((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.dedup_substrings(df, least=60, gram=20, hot=8).collect())
        assert got == substrings_brute(texts, 60)
    # What meets in a shard is few different strings.
    wide = suffix_dedup._regions(df, suffix_dedup._repeated_anchors(suffix_dedup._anchors(df, 60, 20), 8), 60, 20, 1 << 20).where("hot").drop("hot")
    most = lambda df: df.select("h", "region").distinct().groupBy("h").count().agg(F.max("count")).first()[0]
    assert most(suffix_dedup._cut(wide, 60, 20, 7)[0]) < 0.1 * most(wide)


@pytest.mark.parametrize("texts", [["x" * 1000], ["ab" * 600, "other"], ["x" * 400], ["".join(f"{i:03d}" for i in range(100)) * 5]])
def test_substrings_of_one_region(spark, texts):
    """The only region of its shard repeats itself (or, at exactly 400 bytes, doesn't)."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.dedup_substrings(df).collect())
    assert got == substrings_brute(texts, 400)


@pytest.mark.parametrize("memory", [0, 1 << 20])
def test_induced_order_and_prefixes(memory):
    """memory 0: every queue goes to disk."""
    rng = np.random.default_rng(6)
    for size in range(300):
        n, k = int(rng.integers(1, 50)), int(rng.choice([1, 2, 3, 200]))
        block = rng.integers(0, k + 1, int(rng.integers(1, 9)))
        t = (np.tile(block, n)[:n] if size % 2 else rng.integers(0, k + 1, n)).astype(np.uint16)
        t = np.append(t, 0).astype(np.uint16)
        got = [(int(a), int(x)) for at, lcp in induced.suffixes(t, 1000, memory) for a, x in zip(at, lcp)]
        order = sorted(range(len(t)), key=lambda i: [*t[i:].tolist(), -1], reverse=True)
        assert [a for a, _ in got] == order
        for (a, _), (b, x) in zip(got, got[1:]):
            same = next((m for m in range(len(t)) if max(a, b) + m >= len(t) or t[a + m] != t[b + m]), 0)
            assert x == same


# queries and pipeline


def test_queries_give_their_columns(spark):
    want = {
        "op1_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op2_credential_links": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}, "op3_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
        "op4_quality": {"doc_id", "held_out", "score", "predicted"}, "op5_simhash": {"doc_id", "fingerprint", "component_id"}, "op6_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}, "op7_html_wrapper": {"page_id", "url", "text", "n_chars"},
        "op8_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}, "op9_itq": {"vec_id", "n_links", "component_id", "kept"}, "op10_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    }
    for name, columns in want.items():
        df = queries.queries()[name](spark, DATA)
        assert columns <= set(df.columns), name
        assert df.count() >= (500 if name == "op9_itq" else 50 if name == "op7_html_wrapper" else 200)


def test_pipeline_stages_in_turn(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "decontaminate", "pack"]
    docs = common.table(spark, DATA, "documents")
    for name, stage in P.STAGES:
        out = common.materialise(stage(spark, docs, DATA), name)
        rows, before = out.collect(), docs.collect()
        if name == "quality":
            labels = {r.doc_id: r.quality for r in common.table(spark, DATA, "labels").collect()}
            kept = {r.doc_id for r in rows}
            assert np.mean([(r.doc_id in kept) == (labels[r.doc_id] == 1) for r in before if r.doc_id in labels]) > 0.95
        if name == "lines":
            cut = {i: t for i, t, _, _ in lines_brute([(r.doc_id, r.text) for r in before])}
            assert all(cut[str(r.doc_id)] == r.text for r in rows) and len(rows) == len(before)
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "near_duplicates":
            sets = [simhash.shingle_set(r.text) for r in sorted(before, key=lambda r: r.doc_id)]
            sets = [{tuple(x) for x in s.tolist()} for s in sets]
            root = components_brute(len(sets), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) if sets[i] or sets[j] else True)
            ids = sorted(r.doc_id for r in before)
            assert sorted(r.doc_id for r in rows) == sorted({ids[r] for r in root})
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in common.table(spark, DATA, "benchmark").collect()]
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r, c in zip(before, contamination_brute([r.text for r in before], items)) if not c[3])
        if name != "pack":
            assert out.columns == docs.columns
            docs = out
        else:
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
