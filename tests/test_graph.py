import random

import pytest

from braidwork.operators import claims as C
from braidwork.operators import graph


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


def nodes(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "id int")


def test_depths_cycles_and_components(spark):
    e = frame(spark, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 3), (4, 5)])
    got = {r.id: r.depth for r in graph.depths(nodes(spark, 7), e).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: None, 4: None, 5: None, 6: 0}
    assert sorted(r.id for r in graph.cyclic(nodes(spark, 7), e).collect()) == [3, 4, 5]
    assert sorted(tuple(r) for r in graph.strong_components(e).collect()) == [(3, 3), (4, 3)]
    assert sorted(r.id for r in graph.orphans(nodes(spark, 7), e).collect()) == [6]


def test_closure_against_a_search(spark):
    random.seed(3)
    pairs = [(random.randrange(12), random.randrange(12)) for _ in range(20)]
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    want = set()
    for s in after:
        todo = list(after[s])
        while todo:
            x = todo.pop()
            if (s, x) not in want:
                want.add((s, x))
                todo += after.get(x, ())
    assert {tuple(r) for r in graph.closure(frame(spark, pairs)).collect()} == want


def test_failures_skip_what_waits(spark):
    e = frame(spark, [(0, 1), (1, 2), (3, 4)])
    assert sorted(r.id for r in graph.skipped(e, nodes(spark, 1)).collect()) == [1, 2]


def test_pruned_edges_leave_no_cycle_and_keep_the_first(spark):
    df = spark.createDataFrame([(1, 0, 1), (2, 1, 2), (3, 2, 0), (4, 0, 9), (5, 1, 1), (6, 2, 3)], "seq int, src int, dst int")
    kept, dropped = graph.without_cycles(nodes(spark, 4), df)
    assert sorted(r.seq for r in kept.collect()) == [1, 2, 6]
    assert sorted(r.seq for r in dropped.collect()) == [3, 4, 5]
    assert graph.cyclic(nodes(spark, 4), kept.select("src", "dst")).count() == 0


def test_proposals(spark):
    n = spark.createDataFrame([("a/x",), ("a/y",), ("b/z",), ("lone",)], "id string")
    e = spark.createDataFrame([("a/x", "a/y"), ("a/y", "a/x"), ("a/x", "b/z")], "src string, dst string")
    n = n.union(spark.createDataFrame([("c/d/single.ts",)], "id string"))
    got = sorted(tuple(r) for r in graph.proposals(n, e).collect())
    assert got == [
        ("combined-a", "combined", ["a/x", "a/y"], ["fs:a"], 0.6), ("isolated-b", "isolated", ["b/z"], ["fs:b"], 0.9),
        ("orphan-lone", "orphan", ["lone"], ["fs:lone"], 0.8), ("orphan-single", "orphan", ["c/d/single.ts"], ["fs:c/d/single.ts"], 0.8),
    ]


def test_claims_go_down_chains(spark):
    n = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 2)], "pid int, ppid int")
    c = spark.createDataFrame([(1, "a", "read"), (2, "b", "write"), (4, "c", "read")], "pid int, path string, mode string")
    assert sorted(tuple(r) for r in graph.push_down(n, c).collect()) == [(3, "a", "read"), (3, "b", "write"), (4, "a", "read"), (4, "b", "write"), (4, "c", "read")]


def queue_brute(n, pairs, slots):
    """A first-in first-out ready queue, step by step."""
    pairs = {(a, b) for a, b in pairs if a < n and b < n}
    waits = {v: sum(b == v for _, b in pairs) for v in range(n)}
    queue, steps, step = [v for v in range(n) if not waits[v]], {}, 0
    while queue:
        now, queue = queue[:slots], queue[slots:]
        for v in now:
            steps[v] = step
            for w in sorted(b for a, b in pairs if a == v):
                waits[w] -= 1
                if not waits[w]:
                    queue.append(w)
        step += 1
    return steps


@pytest.mark.parametrize("small", [1 << 18, 0])
def test_walks_in_numpy_and_by_joins_agree(spark, monkeypatch, small):
    """small 0: every graph is large."""
    monkeypatch.setattr(graph, "SMALL", small)
    random.seed(4)
    dag = [(a, b) for a, b in ((random.randrange(30), random.randrange(34)) for _ in range(45)) if a < b] + [(31, 31)]
    for slots in (1, 3, 50):
        assert {r.id: r.step for r in graph.schedule(nodes(spark, 32), frame(spark, dag), slots).collect()} == queue_brute(32, dag, slots)
    loops = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5), (4, 6), (7, 0), (6, 8), (8, 9), (9, 6), (9, 3)]
    assert {r.id: r.component for r in graph.strong_components(frame(spark, loops)).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 6: 3, 8: 3, 9: 3}
    got = {r.id: r.depth for r in graph.depths(nodes(spark, 12), frame(spark, [*loops, (10, 11), (7, 11)])).collect()}
    assert got == {**{i: None for i in range(10)}, 7: 0, 10: 0, 11: 1}
    words = spark.createDataFrame([("b", "a"), ("a", "é"), ("é", "b"), ("x", "b")], "src string, dst string")
    assert sorted(tuple(r) for r in graph.closure(words, spark.createDataFrame([("x",), ("nowhere",)], "id string")).collect()) == [("x", "a"), ("x", "b"), ("x", "é")]
    assert graph.closure(frame(spark, [])).collect() == [] and graph.strong_components(frame(spark, [])).collect() == []
    assert [tuple(r) for r in graph.schedule(nodes(spark, 2), frame(spark, []), 1).orderBy("id").collect()] == [(0, 0), (1, 1)]


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_chains_have_any_depth(spark, monkeypatch, small):
    """Chains, rings, and both behind and before other things; by joins a chain takes a few rounds, not one a level."""
    monkeypatch.setattr(graph, "SMALL", small)
    chain, ring = [(i, i + 1) for i in range(600)], [(700, 701), (701, 702), (702, 700)]
    tail = [(600, 800), (3, 800), (800, 801), (801, 802), (900, 901), (901, 900), (901, 902), (902, 903), (903, 904)]
    e = frame(spark, [*chain, *ring, *tail])
    got = {r.id: r.depth for r in graph.depths(nodes(spark, 910), e).collect()}
    assert [got[i] for i in range(601)] == list(range(601)) and [got[i] for i in (800, 801, 802)] == [601, 602, 603]
    assert [got[i] for i in (700, 701, 702, 900, 901, 902, 903, 904)] == [None] * 8 and got[905] == 0 and len(got) == 910


def colours_brute(tasks, claims):
    """First fit by depth in id order against every earlier task."""
    under = lambda a, b: a == b or a.startswith(b + "/")
    clash = lambda x, y: (x[3] == "write" or y[3] == "write") and (x[1] == y[1] or x[2] and under(y[1], x[1]) or y[2] and under(x[1], y[1]))
    found = {}
    for depth, i in sorted(tasks):
        own = [c for c in claims if c[0] == i]
        taken = {found[j][1] for j, (d, _) in found.items() if d == depth and any(clash(x, y) for x in own for y in claims if y[0] == j)}
        found[i] = (depth, next(c for c in range(len(taken) + 1) if c not in taken))
    return sorted((d, i, c) for i, (d, c) in found.items())


def test_colours_with_and_without_pairs(spark):
    random.seed(6)
    for _ in range(4):
        tasks = [(random.randrange(2), i) for i in range(24)]
        claims = {(random.randrange(24), "/".join(random.choice("ab") for _ in range(random.randint(1, 4))), random.random() < 0.3, random.choice(["read", "write"])) for _ in range(40)}
        t = spark.createDataFrame(tasks, "depth int, id int")
        c = spark.createDataFrame(sorted(claims), "task_id int, path string, is_dir boolean, mode string")
        want = colours_brute(tasks, claims)
        assert sorted(tuple(r) for r in graph.claim_colours(t, c).collect()) == want
        pairs = C.overlaps(c).where("mode = 'write' OR o_mode = 'write'").selectExpr("least(task_id, o_id) AS task_a", "greatest(task_id, o_id) AS task_b").distinct()
        for small in (None, 0):  # by components, by rounds
            assert sorted(tuple(r) for r in graph.wave_colours(t, pairs, small).collect()) == want


def test_many_writers_make_no_pairs(spark):
    t = spark.range(2000).selectExpr("0 AS depth", "id")
    c = t.selectExpr("id AS task_id", "'out' AS path", "false AS is_dir", "'write' AS mode")
    assert [r.colour for r in graph.claim_colours(t, c).orderBy("id").collect()] == list(range(2000))


def order_brute(pairs):
    """Edges kept, each searched for by itself."""
    after, kept = {}, []
    for i, (a, b) in enumerate(pairs):
        todo, seen = [b], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        if a not in seen:
            after.setdefault(a, []).append(b)
            kept.append(i)
    return kept


def test_edges_in_order_past_a_growing_order():
    rng = random.Random(8)
    for n, m in ((4, 12), (9, 40), (30, 200), (80, 300)):
        for _ in range(20):
            pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
            order = graph.GrowingOrder()
            assert [i for i, (a, b) in enumerate(pairs) if order.add(a, b)] == order_brute(pairs)
            assert all(order.place[u] < order.place[v] for u, vs in enumerate(order.after) for v in vs)


def test_a_large_component_is_pruned_in_bounded_time():
    """200,000 edges between 50,000 nodes, nearly all in one component."""
    import time

    rng = random.Random(9)
    pairs = [(rng.randrange(50_000), rng.randrange(50_000)) for _ in range(200_000)]
    began, order = time.perf_counter(), graph.GrowingOrder()
    kept = [p for p in pairs if order.add(*p)]
    assert time.perf_counter() - began < 60 and 100_000 < len(kept) < 200_000
    assert all(order.place[order.number[a]] < order.place[order.number[b]] for a, b in kept)


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_which_leads_to_which(spark, monkeypatch, small):
    """By labels and by joins, on graphs with cycles, against the closure."""
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(10)
    for n, m in ((14, 18), (20, 40)):
        e = frame(spark, [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(n, n + 1)])
        pairs = spark.createDataFrame([(a, b) for a in range(n + 3) for b in range(n + 3)] * 2, "a int, b int")
        want = {tuple(r) for r in graph.closure(e).collect()}
        got = [tuple(r) for r in graph.leads_to(e, pairs).collect()]
        assert sorted(got) == sorted(want)
        assert sorted(r.id for r in graph.reached(e, nodes(spark, 3)).collect()) == sorted({b for a, b in want if a < 3})
    words = spark.createDataFrame([("b", "a"), ("a", "é")], "src string, dst string")
    assert [tuple(r) for r in graph.leads_to(words, spark.createDataFrame([("b", "é"), ("é", "b"), ("x", "y")], "a string, b string")).collect()] == [("b", "é")]
    assert graph.leads_to(frame(spark, []), spark.createDataFrame([(1, 2)], "a int, b int")).collect() == []


def claims_of(rng, tasks, n):
    return sorted({(rng.randrange(tasks), "/".join(rng.choice("ab") for _ in range(rng.randint(1, 4))), rng.random() < 0.3, rng.choice(["read", "write"])) for _ in range(n)})


def test_failures_follow_injected_edges_by_hubs(spark):
    rng = random.Random(11)
    for _ in range(5):
        c = spark.createDataFrame(claims_of(rng, 24, 40), "task_id int, path string, is_dir boolean, mode string")
        order = spark.createDataFrame([(i, rng.randrange(6)) for i in range(24)], "id int, wave int")
        e = frame(spark, [(a, b) for a, b in ((rng.randrange(24), rng.randrange(24)) for _ in range(8)) if a != b])
        pairs = C.overlaps(c).where("mode = 'write' OR o_mode = 'write'").selectExpr("least(task_id, o_id) AS task_a", "greatest(task_id, o_id) AS task_b").distinct()
        failed = spark.createDataFrame([(rng.randrange(24),) for _ in range(2)], "id int").distinct()
        want = graph.skipped(e.unionByName(graph.injected_edges(order, pairs)), failed)
        assert sorted(r.id for r in graph.skipped_by_claims(e, order, c, failed).collect()) == sorted(r.id for r in want.collect())


def test_many_writers_of_one_path_fail_in_one_step(spark):
    """3,000 writers, each in a wave of its own, would be 4.5 million injected edges."""
    order = spark.range(3000).selectExpr("id", "CAST(id AS INT) AS wave")
    c = order.selectExpr("id AS task_id", "'out' AS path", "false AS is_dir", "'write' AS mode")
    none = spark.createDataFrame([], "src bigint, dst bigint")
    assert sorted(r.id for r in graph.skipped_by_claims(none, order, c, spark.createDataFrame([(7,)], "id bigint")).collect()) == list(range(8, 3000))


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_components_of_shared_hubs(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rows = [(i, f"h{i // 2}") for i in range(40)] + [(i, f"g{(i + 1) // 2}") for i in range(30)] + [(50, "x"), (51, "x"), (60, "y")]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(rows, "id int, hub string")).collect()}
    assert got == {**{i: 0 for i in range(30)}, **{i: i - i % 2 for i in range(30, 40)}, 50: 50, 51: 50, 60: 60}
