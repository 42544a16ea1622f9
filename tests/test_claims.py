import itertools

import pytest
from pyspark.sql import functions as F

from braidwork.operators import claims as C
from braidwork.operators import graph


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("a", "b", "segments", "contained"),
    [
        ("fs:dist", "fs:dist/main.js", True, None),  # whole segments, but no trailing slash
        ("fs:dist/", "fs:dist/main.js", True, "fs:dist/main.js"),
        ("fs:src/", "fs:src/utils/", True, "fs:src/utils/"),
        ("fs:src/db", "fs:src/db_backup", False, None),
        ("env:PORT", "env:PORTSET", False, None),
        ("db:main", "db:main", True, "db:main"),
        ("fs:x", "env:x", False, None),
        ("fs:a", "a", True, None),
    ],
)
def test_two_predicates_of_overlap(spark, a, b, segments, contained):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    for x, y in (("a", "b"), ("b", "a")):
        assert df.select(C.segments_overlap(F.col(x), F.col(y)), C.directory_contains(F.col(x), F.col(y))).first() == (segments, contained)


def claim_rows(spark, items):
    """items: (wave, task, proto, path, mode); a trailing slash makes a directory."""
    return spark.createDataFrame([(w, t, p, x.rstrip("/"), x.endswith("/"), m) for w, t, p, x, m in items], "wave int, task_id string, proto string, path string, is_dir boolean, mode string")


@pytest.mark.parametrize(
    ("one", "other", "conflict"),
    [
        (("fs", "out.txt", "write"), ("fs", "out.txt", "write"), True),
        (("fs", "in.txt", "read"), ("fs", "in.txt", "read"), False),
        (("fs", "src/", "write"), ("fs", "src/main.ts", "read"), True),
        (("fs", "src/", "write"), ("fs", "src/utils/", "read"), True),
        (("fs", "src/", "read"), ("fs", "tests/", "write"), False),
        (("env", "DATABASE_URL", "write"), ("env", "DATABASE_URL", "read"), True),
        (("env", "DATABASE_URL", "read"), ("env", "DATABASE_URL", "read"), False),
        (("port", "80", "read"), ("port", "80", "read"), True),
    ],
)
def test_wave_conflicts(spark, one, other, conflict):
    c = claim_rows(spark, [(0, "a", *one), (0, "b", *other), (1, "c", *one)])
    assert rows(C.wave_conflicts(c).select("wave", "task_a", "task_b")) == ([(0, "a", "b")] if conflict else [])


def audit(spark, items, edges):
    up = spark.createDataFrame(edges, "src string, dst string")
    return [tuple(r) for r in C.shadow_audit(claim_rows(spark, [(0, *i) for i in items]).drop("wave", "proto"), up).collect()]


def test_shadow_audit(spark):
    w = lambda t, p: (t, "fs", p, "write")
    assert audit(spark, [w("a", "dist/x"), w("b", "dist/x")], [("a", "b")]) == [("a", "b", "dist/x", "declared", "shadow")]
    assert audit(spark, [w("a", "dist/"), w("c", "dist/main.js")], [("a", "b"), ("b", "c")]) == [("a", "c", "dist/main.js", "declared", "shadow")]
    assert audit(spark, [w("a", "o"), w("b", "o")], [("x", "y")]) == [("a", "b", "o", "implicit", "shadow")]
    assert audit(spark, [("a", "fs", "o", "read"), w("b", "o")], [("x", "y")]) == [("b", "a", "o", "implicit", "implicit-dependency")]
    assert audit(spark, [("a", "fs", "o", "read"), w("b", "o")], [("b", "a")]) == []
    # At most one finding a pair, and the shadow comes first.
    assert audit(spark, [w("a", "o"), w("b", "o"), ("b", "fs", "q", "read"), w("a", "q")], [("x", "y")]) == [("a", "b", "o", "implicit", "shadow")]


def test_containment_join_equals_the_nested_loop(spark):
    paths = ["a", "a/b", "a/bc", "a/b/c", "b", "ab/c", "a/b/c/d"]
    df = spark.createDataFrame(list(enumerate(paths)), "task_id int, path string")
    want = sorted((x, y) for x, y in itertools.product(paths, paths) if x == y or x.startswith(y + "/"))
    assert rows(C.containment_join(df, df).select("inner_path", "outer_path")) == want
    assert "NestedLoop" not in C.containment_join(df, df)._jdf.queryExecution().executedPlan().toString()


def test_claims_parse_and_normalise(spark):
    df = spark.createDataFrame([("fs:./src/../lib//x/",), ("ENV:Home",), ("plain/a",)], "c string")
    got = [tuple(r[0]) for r in df.select(C.normalised_claim(F.col("c"))).collect()]
    assert got == [("fs", "lib/x", True), ("env", "Home", False), ("fs", "plain/a", False)]


def test_colouring_is_first_fit_and_waves_keep_conflicts_apart(spark):
    tasks = spark.createDataFrame([(0, x) for x in "abcd"] + [(1, "e")], "depth int, id string")
    conflicts = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "task_a string, task_b string")
    coloured = graph.wave_colours(tasks, conflicts)
    assert rows(coloured) == [(0, "a", 0), (0, "b", 1), (0, "c", 0), (0, "d", 0), (1, "e", 0)]
    waves = graph.waves(coloured)
    assert rows(waves) == [("a", 0), ("b", 1), ("c", 0), ("d", 0), ("e", 2)]
    assert rows(graph.injected_edges(waves, conflicts)) == [("a", "b"), ("c", "b"), ("d", "e")]


def test_many_writers_of_one_path(spark):
    """k tasks that write one path conflict pairwise, and that many edges are the answer."""
    k = 60
    c = claim_rows(spark, [(0, f"t{i:03}", "fs", "out", "write") for i in range(k)])
    assert C.wave_conflicts(c).count() == k * (k - 1) // 2


def test_crowded_directories_collapse(spark):
    c = spark.createDataFrame([("t", f"d/{i}") for i in range(6)] + [("t", "e/1"), ("t", "top")], "task_id string, path string")
    assert rows(C.collapsed(c)) == [("t", "d/"), ("t", "e/1"), ("t", "top")]


def test_projects_are_checked_from_their_files(spark, tmp_path):
    """Every kind of finding; no wave has two tasks that the verification would refuse."""
    import json

    from braidwork.plans.check import check

    task = lambda **k: {"cmd": ["x"], **k}
    projects = {
        "good": {"a": task(outputs=["o/x"]), "b": task(inputs=["o/x"]), "c": task(outputs=["o/x"], dependencies=["a"]), "m": task(matrix={"v": ["1", "2"]}, outputs=["dist/"]), "d": task(claims=["port:80"]), "e": task(claims=["port:80"])},
        "env": {"p": task(providesEnv=["K"]), "q": task(needsEnv=["K"])},
        "cyclic": {"a": task(dependencies=["b"]), "b": task(dependencies=["a"]), "z": task(outputs=["o"])},
        "late": {"m": task(matrix={"v": ["1"]}), "n": task(dependencies=["m"])},
        "empty": {"a": {"cmd": []}},
    }
    for name, tasks in projects.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name, "tasks": tasks}))
    (tmp_path / "bad.json").write_text("{nope")
    found = check(spark, str(tmp_path))
    got = sorted((r.project.rpartition("/")[2], r.severity, r.kind, r.task_a or "", r.task_b or "", r.resource or "") for r in found.findings.collect())
    assert got == sorted([
        ("bad.json", "error", "not-json", "", "", ""), ("cyclic", "error", "cycle", "cyclic__a", "", ""), ("cyclic", "error", "cycle", "cyclic__b", "", ""), ("empty", "error", "cmd", "empty__a", "", ""), ("late", "error", "unresolved-dependency", "late__n", "", ""),
        ("env", "error", "collision", "env__p", "env__q", "K"), ("good", "warning", "shadow", "good__a", "good__c", "o/x"), ("good", "warning", "implicit-dependency", "good__a", "good__b", "o/x"), ("good", "warning", "implicit-dependency", "good__c", "good__b", "o/x"),
        ("good", "warning", "shadow", "good__m-v=1", "good__m-v=2", "dist"),
    ])
    waves = {r.id: r.wave for r in found.waves.collect()}
    assert set(waves) == {f"good__{x}" for x in ("a", "b", "c", "d", "e", "m-v=1", "m-v=2")} | {"env__p", "env__q"}
    assert len({waves["good__a"], waves["good__b"], waves["good__c"]}) == 3 and waves["good__d"] != waves["good__e"] and waves["good__m-v=1"] != waves["good__m-v=2"] and waves["env__p"] == waves["env__q"]
