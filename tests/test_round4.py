"""What round 4's findings named: each test failed before its finding was mended."""

import itertools
import random

from braidwork.operators import claims as C
from braidwork.operators import graph


def test_pairs_of_tasks_of_two_claims_are_told_by_plain_columns(spark):
    """Every match of a task of two claims ran interpreted lambdas over both tasks' lists."""
    rng = random.Random(4)
    kinds = {("write", "write"): 1, ("read", "write"): 2, ("write", "read"): 3}
    claim = lambda: (rng.choice(["fs", "fs", "fs", "env", "port"]), rng.choice(["a", "a/b", "a/b/c", "ab", "d"]), rng.random() < 0.5, rng.choice(["read", "write"]))
    rows = sorted({(t, *claim()) for t in range(50) for _ in range(rng.choice([1, 1, 2, 2, 3]))})
    want: dict = {}
    for (s, p, x, dx, m), (t, q, y, dy, n) in itertools.product(rows, rows):
        if s < t and p == q and (p not in ("fs", "env") or "write" in (m, n)) and (x == y or p == "fs" and (dy and x.startswith(y + "/") or dx and y.startswith(x + "/"))):
            own, at = want.setdefault((s, t), [None] * 4), max(x, y)
            for k in {0, kinds.get((m, n), 0)}:
                own[k] = min(own[k] or at, at)
    schema = "task_id int, proto string, path string, is_dir boolean, mode string"
    df = spark.createDataFrame([(t, p, x, d and p == "fs", m) for t, p, x, d, m in rows], schema)
    for slim, block, matches in ((2, 7, 10), (3, 2048, 1 << 20), (1, 7, 10)):
        got = [(tuple(r[:2]), list(r[2:])) for r in C.conflicts(df, slim=slim, block=block, matches=matches).select("a", "b", "resource", "both_write", "b_writes", "a_writes").collect()]
        assert len(got) == len(want) and dict(got) == want
    few = C.conflicts(spark.createDataFrame([r for r in rows if sum(r[0] == o[0] for o in rows) < 3], schema))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "inline(" not in plan


def test_a_declared_order_of_trees_is_asked_without_python(spark):
    """every pair went through a Python worker to be told its order."""
    rng = random.Random(2)
    claims = spark.createDataFrame([(t, rng.choice(["o", "o/x", "p"]), rng.random() < 0.5, rng.choice(["read", "write"])) for t in range(30)], "task_id int, path string, is_dir boolean, mode string")
    up = {t: rng.randrange(t) for t in range(1, 26) if t % 7}
    edges = spark.createDataFrame([(u, v) for v, u in up.items()] + [(3, 3)], "src int, dst int")
    got = C.shadow_audit(claims, edges)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    # One edge more, between a task without claims and another: no trees, so the other way is gone.
    assert graph.forest_intervals(more := edges.unionByName(spark.createDataFrame([(90, 91), (92, 91)], "src int, dst int"))) is None
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C.shadow_audit(claims, more).collect()))
    above = lambda t: {t, *above(up[t])} if t in up else {t}
    for small in (None, 8):
        own = {r.id: (r.piece, r.begin, r.rank) for r in graph.forest_intervals(edges.where("dst < 9"), small).collect()}
        for u, v in itertools.permutations(own, 2):
            (p, begin, rank), (q, _, other) = own[u], own[v]
            assert (p == q and begin <= other < rank) == (u in above(v))
    assert graph.forest_intervals(edges, 0) is None
    assert graph.forest_intervals(spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "src int, dst int")) is None
