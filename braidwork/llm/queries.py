"""The registered queries of the corpus operators: thin digests over each operator's own output."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import table
from braidwork.llm.credential_links import credential_findings, listed
from braidwork.llm.decontamination import find_benchmark
from braidwork.llm.html_wrapper import extract_pages
from braidwork.llm.itq import near_vectors
from braidwork.llm.line_dedup import dedup_lines
from braidwork.llm.ngram_perplexity import judge_quality
from braidwork.llm.packing import pack_documents
from braidwork.llm.periodic_runs import periodic_runs
from braidwork.llm.quality_fm import THRESHOLD, held_out, score_quality, train
from braidwork.llm.sharding import hypergeometric_shards
from braidwork.llm.simhash import near_duplicates
from braidwork.llm.spelling_variants import spelling_variants, word_counts
from braidwork.llm.suffix_dedup import dedup_substrings


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0..23 by the `rows` law."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return hypergeometric_shards(docs, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of secrets, and the weak parts that complementary parts confirm."""
    found = credential_findings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("findings", lambda f: f.kind == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed("findings", ("assign", "access", "hex")), 256).alias("base_sha256"), listed("findings").alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 or more code points in 5 or more documents stay in the largest doc_id alone."""
    cut = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    found = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 benchmark words in all documents."""
    found = find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near").cast("bigint").alias("n_near"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components within 2 bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings at a cosine of 0.93 and their components."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents outside strings of 400 bytes that also start elsewhere.

    Besides the digest it shows what stays: n_kept bytes and, as text, these bytes (a character that a cut splits becomes U+FFFD).
    """
    found = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    left = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), left.alias("text"))


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of op11's contract: those of every tenth document, by crc32, go round from some word on."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods and more in the words of all documents."""
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=made_periodic)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("shorter"), r.start.alias("start"), r.period.alias("period"))))
    best = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), top.alias("top"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "top.start", (-F.col("top.shorter")).alias("length"), "top.period", F.expr("-1000 * top.shorter div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def one_less(doc_id: int | None, word: str) -> str:
    """The word of op12's contract: of one in 199, by crc32 of document and word, a letter goes."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % 199 else word[: h % len(word)] + word[h % len(word) + 1 :]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the far more frequent words that they may be variants of."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=one_less))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and bands of perplexity over all documents."""
    found = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "read_as", F.exp("log_perplexity").alias("perplexity"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_sharding, op2_credential_links, op3_line_dedup, op4_quality, op5_simhash, op6_packing, op7_html_wrapper, op8_decontamination, op9_itq, op10_suffix_dedup, op11_periodic_runs, op12_spelling_variants, op13_quality_rules, pipeline)}


OP3_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
x AS (SELECT k.doc_id, i, line, g.holder IS NOT NULL AND g.holder <> k.doc_id AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""


OP8_SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bs AS (SELECT item_id, w, least(13, len(w)) AS k FROM bw WHERE len(w) > 0),
bi AS (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM bs),
bwin AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bi),
ks AS (SELECT DISTINCT k FROM bs),
di AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
dwin AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM di),
m AS (SELECT doc_id, item_id, k, i FROM dwin JOIN bwin USING (k, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
win AS (SELECT row_number() OVER (ORDER BY s) AS win, s FROM (SELECT DISTINCT s FROM bwin)),
wt AS (SELECT DISTINCT win, unnest(string_split(s, ' ')) AS t FROM win),
nt AS (SELECT win, count(*) AS n FROM wt GROUP BY win),
dp AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM dw),
df AS (SELECT t, count(*) AS c FROM dp GROUP BY t),
rare AS (SELECT win, arg_min(t, c) AS t FROM wt LEFT JOIN df USING (t) GROUP BY win HAVING count(c) = count(*)),
anchor AS (SELECT doc_id, win, p AS a FROM rare JOIN dp USING (t)),
around AS (SELECT doc_id, win, a, unnest(range(lo, hi)) AS p, unnest(w[lo + 1:hi]) AS t FROM (SELECT doc_id, win, a, w, greatest(a - 25, 0) AS lo, least(a + 26, len(w)) AS hi FROM anchor JOIN dw USING (doc_id))),
nb AS (SELECT doc_id, win, a, p, t FROM around JOIN wt USING (win, t)),
could AS (SELECT doc_id, win, a, n FROM nb JOIN nt USING (win) GROUP BY doc_id, win, a, n HAVING count(DISTINCT t) = n),
ends AS (SELECT DISTINCT doc_id, win, a, n, p AS e FROM nb JOIN could USING (doc_id, win, a) WHERE p >= a),
close AS (SELECT DISTINCT doc_id, win FROM (SELECT x.doc_id, x.win FROM ends x JOIN nb y ON x.doc_id = y.doc_id AND x.win = y.win AND x.a = y.a AND y.p <= e AND y.p > e - 26 GROUP BY x.doc_id, x.win, x.a, x.n, e HAVING count(DISTINCT y.t) = x.n)),
nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close JOIN win USING (win) JOIN bwin USING (s) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nr USING (doc_id)
"""



#: DuckDB has no CRC-32: by its table, over a list of bytes.
CRC_TABLE = "tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc(octets: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


OP11_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  {_crc("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)")} AS h FROM documents, tab),
a AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
i AS (SELECT *, unnest(range(n)) AS i FROM p),
x AS (SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM i),
eq AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM x JOIN x y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM eq),
st AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM isl GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, s, l, min(q) AS q FROM st GROUP BY doc_id, s, l),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
agg AS (SELECT doc_id, count(*) AS n_runs, first(s ORDER BY l DESC, s, q) AS s, max(l) AS l, first(q ORDER BY l DESC, s, q) AS q,
  string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN agg USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
f AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS c, hex(encode(doc_id || ':' || run)) AS o FROM f GROUP BY doc_id, run HAVING length(run) >= 6),
h AS (SELECT run, c, {_crc("list_transform(range(len(o) // 2), lambda j: 16 * (instr('0123456789ABCDEF', o[2 * j + 1]) - 1) + instr('0123456789ABCDEF', o[2 * j + 2]) - 1)")} AS h FROM k, tab),
e AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
x AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
v AS (SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM x),
one AS (SELECT DISTINCT v.word, v.n, w.word AS other, w.n AS m FROM v JOIN w ON v.rest = w.word),
near AS (SELECT word, other, m FROM one UNION ALL SELECT other, word, n FROM one UNION ALL SELECT a.word, b.word, b.n FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS b, max(m) AS m FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN b END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
path(word, place) AS (SELECT word, word FROM formed UNION ALL SELECT path.word, formed.form FROM path JOIN formed ON path.place = formed.word WHERE formed.form IS NOT NULL)
SELECT a.word, a.form, path.place AS root, a.n, a.n_near, a.form_n FROM formed a JOIN path ON a.word = path.word JOIN formed z ON path.place = z.word AND z.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op8_decontamination": OP8_SQL, "op11_periodic_runs": OP11_SQL, "op12_spelling_variants": OP12_SQL}
