import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from braidwork.functions import code
from braidwork.functions import text as X
from braidwork.operators import claims as C
from braidwork.operators import expand, hashing, ledger, report


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_forecasts(spark):
    runs = spark.createDataFrame([("a", 1, 100.0, False), ("a", 2, 200.0, True), ("a", 3, 300.0, False), ("b", 1, 50.0, True), ("b", 2, 50.0, True), ("c", 1, 10.0, True), ("c", 2, 1000.0, True)], "task_id string, seq int, duration_ms double, hit boolean")
    f = {r.task_id: r for r in ledger.forecast(runs).collect()}
    assert f["a"].mean_ms == 200 and abs(f["a"].miss_probability - 2 / 3) < 1e-12
    assert f["b"].score == 0 and f["c"].score > f["a"].score
    assert ledger.forecast(runs, 1).where("task_id = 'a'").first().mean_ms == 300
    unknown = ledger.forecast_for(spark.createDataFrame([("z",)], "task_id string"), ledger.forecast(runs)).first()
    assert tuple(unknown) == ("z", 1000.0, 0.0, 0.5, 0.5)


def test_telemetry_of_empty_and_known_rows(spark):
    kind = "task_id string, duration_ms double, metadata string"
    tax = ledger.json_number("metadata", "$.isolation.tax_recovered_ms")
    hit = F.get_json_object("metadata", "$.isolation.hit_type")
    jitter = ledger.json_number("metadata", "$.telemetry.io_wait_ms")
    got = ledger.tax_saved(spark.createDataFrame([], kind), hit, tax, F.col("duration_ms"), jitter).first()
    assert tuple(got) == (0.0, 0.0, 0, 0.0, 0.0)
    assert tuple(ledger.bottleneck(spark.createDataFrame([], kind), "task_id", "duration_ms").first()) == ("(none)", 0.0)
    doc = '{"isolation": {"hit_type": "%s", "tax_recovered_ms": %d}, "telemetry": {"io_wait_ms": %d}}'
    rows = spark.createDataFrame([("a", 1000.0, doc % ("LOGICAL_HIT", 990, 12)), ("build", 2000.0, doc % ("MISS", 0, 8)), ("c", 5.0, doc % ("CONTENT_HIT", 0, 3))], kind)
    got = ledger.tax_saved(rows, hit, tax, F.col("duration_ms"), jitter).first()
    assert (got.tax_ms, got.ratio, got.jitter_ms) == (990.0, 0.99, 23.0)
    assert tuple(ledger.bottleneck(rows, "task_id", "duration_ms").first()) == ("build", 2000.0)
    assert tuple(ledger.hit_stats(rows, hit, F.col("duration_ms")).first()) == (3, 1, 1, 1, 3005.0)


def test_upsert_takes_whole_rows_and_the_last(spark):
    kind = "logic_hash string, timestamp int, action string"
    old = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], kind)
    new = spark.createDataFrame([("a", 2, "first"), ("a", 3, None), ("c", 1, "new")], kind)
    assert sorted(ledger.upsert(old, new).collect()) == [("a", 3, None), ("b", 1, "old"), ("c", 1, "new")]


@pytest.mark.parametrize(
    ("source", "language", "bare"),
    [
        ('int a; // x\n/* b /* nested */ c */ char *s = "// no";', "c", 'int a; char *s = "// no";'),
        ("x = 1  # note\n'''doc\nmore'''\ny = '#'", "python", "x = 1 y = '#'"),
        ("a\n\n  b", "cobol", "a b"),
        ("=begin\nz\n=end\nputs 1 # y", "ruby", "puts 1"),
        ("const a = `//`; // z", "typescript", "const a = `//`;"),
        ("f() /* open", "go", "f()"),
    ],
)
def test_comment_stripper(source, language, bare):
    assert code.strip_comments(source, language) == bare


def test_python_functions(spark):
    df = spark.createDataFrame([("k", "m", '{"b": 1, "a": [2]}', "function f(a, b) {\n if (a) { b() }\n}\n")], "k string, m string, j string, s string")
    r = df.select(code.hmac_sha256("k", "m"), code.canonical_json("j"), code.functions_of("s")).first()
    assert r[0] == hmac.new(b"k", b"m", hashlib.sha256).hexdigest()
    assert r[1] == '{"a":[2],"b":1}'
    assert [tuple(x) for x in r[2]] == [("f", 3, 2, 1)]  # braces that a line closes again do not count


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: X.folded_path(F.lit("a/./b/../c//d")), "a/c/d"),
        (lambda: X.folded_path(F.lit("../a/..")), ".."),
        (lambda: X.folded_path(F.lit("/../a")), "/a"),
        (lambda: X.normalise_fs_path(F.lit("fs:./a\\b//")), "a/b"),
        (lambda: X.dirname(F.lit("/a")), "/"),
        (lambda: X.extension(F.lit("a/.env")), ""),
        (lambda: X.language(F.lit("x/Y.TS")), "typescript"),
        (lambda: X.caller_name(F.lit("a-v1-v2.0")), "a-v1"),
        (lambda: X.caller_version(F.lit("a-v1-v2.0")), "v2.0"),
        (lambda: X.caller_version(F.lit("plain")), "unknown"),
        (lambda: X.caller_version(F.lit("x-v")), "v"),
        (lambda: X.caller_name(F.lit(None).cast("string")), "unknown"),
        (lambda: X.slug(F.lit("--a  b!c--")), "a--b-c"),
        (lambda: X.slug(F.lit("@scope/thing.b:c")), "scope-thing-b-c"),
        (lambda: C.write_covers(F.lit("dist/"), F.lit("fs:./dist/x")), True),
        (lambda: C.write_covers(F.lit("./a\\b"), F.lit("a/b/")), True),
        (lambda: C.write_covers(F.lit("dist"), F.lit("dist2/x")), False),
        (lambda: C.write_covers(F.lit("./"), F.lit("x")), False),
        (lambda: X.slug(F.lit("!!")), "task"),
        (lambda: X.branch_matches(F.lit("release/1"), F.lit("release/*")), True),
        (lambda: X.branch_matches(F.lit("main"), F.lit("release/*")), False),
        (lambda: X.branch_matches(F.lit(None).cast("string"), F.lit("x")), True),
        (lambda: X.duration_text(F.lit(0.5)), "500μs"),
        (lambda: X.duration_text(F.lit(0.0004)), "0μs"),
        (lambda: X.duration_text(F.lit(2500.0)), "2.50s"),
        (lambda: X.bar(F.lit(5.0), F.lit(10.0), 4), "██░░"),
        (lambda: X.template_variables(F.lit("a ${{ values.my-x }} ${{values.my.x.y}} ${{ values.-n }}"), "V"), "a ${V_MY_X} ${V_MY_X_Y} ${{ values.-n }}"),
        (lambda: X.is_composite(F.lit("a > b < c\nd & e")), False),
        (lambda: F.to_json(X.shell_command(F.lit("a && b"))), '["sh","-c","a && b"]'),
        (lambda: F.to_json(X.shell_command(F.lit(" go  test "))), '["go","test"]'),
        (lambda: X.iso_time(F.lit(0)), "1970-01-01T00:00:00.000Z"),
        (lambda: report.grade(F.lit(80.0)), "A"),
        (lambda: report.repository_grade(F.lit(True), F.lit(2), F.lit(1)), "YELLOW"),
        (lambda: report.is_placeholder(F.array(F.lit("echo"), F.lit("No command found for x"))), True),
        (lambda: hashing.sha(F.lit(None).cast("string")) == hashing.sha(F.lit("")), False),
    ],
)
def test_scalars(spark, column, want):
    assert one(spark, column()) == want


def test_unsafe_paths_fail(spark):
    assert one(spark, X.sanitised_path(F.lit("a\\b"))) == "a/b"
    with pytest.raises(Exception, match="unsafe path"):
        one(spark, X.sanitised_path(F.lit("../x")))


def test_matrix_rows_and_limits(spark):
    kind = "id string, matrix map<string,array<string>>"
    got = expand.matrix_rows(spark.createDataFrame([("t", {"os": ["b", "a"], "n": ["1"]}), ("plain", None)], kind)).collect()
    assert sorted((r.id, r.env) for r in got) == [("plain", {}), ("t-n=1-os=a", {"MATRIX_N": "1", "MATRIX_OS": "a"}), ("t-n=1-os=b", {"MATRIX_N": "1", "MATRIX_OS": "b"})]
    large = spark.createDataFrame([("t", {"a": [str(i) for i in range(257)]})], kind)
    assert [tuple(r) for r in expand.matrix_violations(large).collect()] == [("t", 1, 257)]
    for matrix, rule in (({"a": [str(i) for i in range(257)]}, "matrix-rows"), ({c: ["1"] for c in "abcde"}, "matrix-axes"), ({"a": []}, "matrix-empty"), ({"a b": ["1"]}, "matrix-axis"), ({"a": ["1", "x/y"]}, "matrix-value")):
        df = spark.createDataFrame([("t", matrix)], kind)
        assert [r.rule for r in expand.matrix_faults(df).collect()] == [rule]
        with pytest.raises(Exception, match=rule):
            expand.matrix_rows(df).collect()


def test_unique_ids_differ_even_beside_natural_suffixes(spark):
    rng = random.Random(5)
    names = ["a", "a", "a-2", "a b", "!", "task", "-"] + [rng.choice(["a", "a-2", "a-2-2", "a-3", "a-1", "a-02", "b:2", "b"]) for _ in range(80)]
    taken, want = set(), []
    for name in names:  # one after another: the first number that is free
        slug = re.sub("[^a-zA-Z0-9_-]", "-", name).strip("-") or "task"
        own, n = slug, 2
        while own in taken:
            own, n = f"{slug}-{n}", n + 1
        taken.add(own)
        want.append(own)
    df = spark.createDataFrame(list(enumerate(names)), "seq int, name string").repartition(3)
    assert [r.id for r in expand.unique_ids(df).orderBy("seq").collect()] == want


def test_imports_go_suffix_by_suffix_and_stay_inside(spark):
    files = spark.createDataFrame([("src/a/index.ts",), ("src/a.tsx",), ("src/__init__.ts",), ("b.ts",), ("src/b.ts",), ("index.ts",)], "id string")
    wanted = [("src/m.ts", "./a"), ("src/m.ts", "."), ("src/m.ts", "b"), ("src/m.ts", "../.."), ("src/m.ts", "../../b"), ("src/m.ts", "/b"), ("src/m.ts", ".."), ("m.ts", "./b")]
    got = {(r.source, r.target): r.resolved for r in expand.resolve_imports(files, spark.createDataFrame([(*w, "static") for w in wanted], "source string, target string, kind string"), (".ts", ".tsx")).collect()}
    assert got == {("src/m.ts", "./a"): "src/a/index.ts", ("src/m.ts", "."): "src/__init__.ts", ("src/m.ts", "b"): "src/b.ts", ("src/m.ts", ".."): "index.ts", ("m.ts", "./b"): "b.ts"}


def test_cache_keys_tell_unset_from_empty_and_order_doesnt_matter(spark):
    tasks = spark.createDataFrame([("t", ["x"], None, ["E"])], "id string, cmd array<string>, writes array<string>, env_reads array<string>")
    files = spark.createDataFrame([("a", "1", "1"), ("b", "2", "2")], "path string, content_hash string, logic_hash string")
    env = lambda rows: spark.createDataFrame(rows, "name string, value string")
    key = lambda inputs, e: hashing.cache_keys(tasks, spark.createDataFrame(inputs, "id string, path string"), files, env(e)).first().key
    a, b = [("t", "a"), ("t", "b")], [("t", "b"), ("t", "a"), ("t", "a")]
    assert key(a, [("E", "")]) == key(b, [("E", "")]) != key(a, [("F", "")])
    assert key(a, []) != key([("t", "missing")], [])


def test_merkle_changes_with_any_byte_and_nothing_else(spark):
    files = [("a/b/x", "1"), ("a/y", "2"), ("z", "3")]
    tree = lambda rows: {r.path: r.hash for r in hashing.merkle(spark.createDataFrame(rows, "path string, hash string")).collect()}
    base = tree(files)
    assert set(base) == {"a/b", "a", "."} and base == tree(files[::-1])
    other = tree([("a/b/x", "1"), ("a/y", "9"), ("z", "3")])
    assert base["a/b"] == other["a/b"] and base["a"] != other["a"] and base["."] != other["."]


def test_snapshot_diff(spark):
    kind = "path string, content string"
    before = hashing.snapshot(spark.createDataFrame([("a.py", "x = 1"), ("b.py", "y"), ("c.py", "z"), ("same.py", "s")], kind))
    after = hashing.snapshot(spark.createDataFrame([("a.py", "x = 1  # note"), ("b.py", "w"), ("new.py", "n"), ("same.py", "s")], kind))
    got = {r.path: r.change for r in hashing.snapshot_diff(before, after).collect()}
    assert got == {"a.py": "logically-unchanged", "b.py": "changed", "c.py": "changed", "new.py": "changed"}


def test_order_statistics_take_the_floor(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 101)], "g string, v double")
    assert tuple(ledger.order_statistics(df, ["g"], "v").first()) == ("g", 50.5, 100.0, 1.0, 100.0)
