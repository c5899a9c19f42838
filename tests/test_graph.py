import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from latticework.model import ALL_EDGES, CODE_EDGES, SERVICE_EDGES, EdgeKind, NodeKind, in_mask, kinds_of, mask_of
from latticework.operators import graph, traverse

EDGES = "src bigint, dst bigint, kind int, confidence int, flags int"
NODES = "id bigint, kind int, name string, file string, line int, parent bigint, repo int"
A, B, C, D, E, F_, G = range(7)
G7 = [(A, B), (B, C), (C, D), (A, E), (E, F_), (B, G)]


def edges(spark, pairs, kind=1):
    return spark.createDataFrame([(p[0], p[1], p[2] if len(p) > 2 else kind, 255, 0) for p in pairs], EDGES)


def nodes(spark, rows):
    return spark.createDataFrame([(i, k, f"n{i}", None, 0, parent, 0) for i, k, parent in rows], NODES)


def reached(spark, pairs, seeds, **more):
    return {r.node: r.depth for r in traverse.reach(edges(spark, pairs), traverse.seeds_of(spark, seeds), **more).collect()}


def test_reach_down_up_and_depth(spark):
    assert reached(spark, G7, [A]) == {A: 0, B: 1, E: 1, C: 2, F_: 2, G: 2, D: 3}
    assert set(reached(spark, G7, [D], direction="up")) == {A, B, C, D}
    assert set(reached(spark, [(0, 1), (1, 2), (2, 3), (3, 4)], [0], max_depth=3)) == {0, 1, 2, 3}
    assert reached(spark, G7, [A, D], max_depth=0) == {A: 0, D: 0}
    assert set(reached(spark, G7, [E, C])) == {E, F_, C, D}
    assert reached(spark, [(0, 1), (1, 0)], [0]) == {0: 0, 1: 1}
    assert reached(spark, [], [5]) == {5: 0}


def test_masks(spark):
    pairs = [(A, B, 1), (A, C, 3), (B, D, 1)]
    assert set(reached(spark, pairs, [A], mask=CODE_EDGES)) == {A, B, D}
    assert set(reached(spark, pairs, [A], mask=SERVICE_EDGES)) == {A, C}
    assert kinds_of(mask_of(EdgeKind.CALLS, EdgeKind.CONNECTS)) == [1, 8]
    assert {r.node for r in traverse.depends(edges(spark, pairs), A).collect()} == {B, C, D}


def queue_paths(pairs, start, max_depth):
    out, parent, depth = {}, {start: None}, {start: 0}
    adjacent = {}
    for s, d, k in sorted(set(pairs), key=lambda e: (e[0], e[2], e[1])):
        adjacent.setdefault(s, []).append((k, d))
    queue = deque([start])
    while queue:
        n = queue.popleft()
        if depth[n] == max_depth:
            continue
        for k, d in adjacent.get(n, []):
            if d not in parent:
                parent[d], depth[d] = (n, k), depth[n] + 1
                queue.append(d)
    for n in parent:
        path, at = [], n
        while parent[at]:
            path.append((parent[at][1], at))
            at = parent[at][0]
        out[n] = path[::-1]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_are_those_of_a_queue(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60), rng.choice([1, 2, 4])) for _ in range(200)]
    tree = traverse.path_tree(edges(spark, pairs), traverse.seeds_of(spark, [0]), max_depth=5)
    assert {r.node: [(s.kind, s.node) for s in r.path] for r in tree.collect()} == queue_paths(pairs, 0, 5)


def test_find_path(spark):
    chain = edges(spark, [(k, k + 1) for k in range(10)])
    assert [(r.node, r.kind_to_next) for r in traverse.find_path(chain, 0, 5).collect()] == [(k, 1) for k in range(5)] + [(5, None)]
    assert traverse.find_path(chain, 0, 99).count() == 0
    assert traverse.find_path(chain, 0, 10, max_depth=3).count() == 0
    assert traverse.find_path(chain, 0, 10, max_depth=10).count() == 11
    assert [r.node for r in traverse.find_path(chain, 4, 4).collect()] == [4]


def test_terminals_and_upstream(spark):
    assert {r.node for r in traverse.terminals(edges(spark, G7), A).collect()} == {D, F_, G}
    assert {r.node for r in traverse.terminals(edges(spark, G7), A, max_depth=1).collect()} == set()
    known = nodes(spark, [(k, 3, None) for k in range(7)])
    assert {r.node for r in traverse.upstream_sources(known, edges(spark, G7), D).collect()} == {A}
    assert [r.nodes for r in traverse.upstream_paths(known, edges(spark, G7), D).collect()] == [[A, B, C, D]]
    ring = edges(spark, [(0, 1), (1, 2), (2, 0)])
    assert {r.node for r in traverse.upstream_sources(nodes(spark, [(k, 3, None) for k in range(3)]), ring, 0).collect()} == {1, 2}


def test_summary_of_three_services(spark):
    rows = [(k, int(NodeKind.DEPLOYABLE), None) for k in range(3)] + [(10 + 100 * s + k, int(NodeKind.SYMBOL), s) for s in range(3) for k in range(100)]
    calls = [(10 + 100 * s + k, 10 + 100 * (s + 1) + k, 1) for s in range(2) for k in range(100)]
    n, e = nodes(spark, rows), edges(spark, calls)
    assert graph.summary_nodes(n).count() == 3
    assert {(r.src, r.dst) for r in graph.summary_edges(n, e).collect()} == {(0, 1), (1, 2)}
    assert {r.node for r in traverse.depends(graph.summary_edges(n, e), 0).collect()} == {1, 2}


def test_ancestors_end_in_cycles(spark):
    n = nodes(spark, [(1, 3, 2), (2, 3, 1), (3, 3, 3), (4, 1, None), (5, 3, 4), (6, 3, 5), (7, 3, 6)])
    assert {(r.id, r.ancestor) for r in graph.nearest_ancestor(n, [1], 64).collect()} == {(4, 4), (5, 4), (6, 4), (7, 4)}
    assert {(r.id, r.hops, r.ancestor) for r in graph.ancestors(n, 3).collect() if r.id > 3} == {(5, 1, 4), (6, 1, 5), (6, 2, 4), (7, 1, 6), (7, 2, 5), (7, 3, 4)}


def test_dedup_moves_edges(spark):
    rows = [(1, 3, "f", "a.py", 1, None, 0), (2, 3, "f", "a.py", 9, 5, 0), (3, 4, "/x", "a.py", 1, None, 0), (4, 4, "/x", "a.py", 2, None, 1), (5, 2, "m", "a", 1, None, 0), (6, 2, "m", "b", 1, None, 0), (7, 2, "m", "b", 1, None, 1), (8, 7, "R", None, 0, None, 0), (9, 7, "R", None, 0, 6, 3)]
    n = spark.createDataFrame(rows, NODES)
    e = spark.createDataFrame([(1, 4, 4, 200, 1), (1, 3, 4, 100, 2), (2, 9, 8, 255, 0)], EDGES)
    kept, moved = graph.dedup_nodes(n, e)
    assert {r.id for r in kept.collect()} == {1, 2, 3, 5, 7, 8}
    assert {tuple(r) for r in moved.select("src", "dst", "kind", "confidence", "flags").collect()} == {(1, 3, 4, 200, 3), (2, 8, 8, 255, 0)}
    again, _ = graph.dedup_nodes(kept, moved)
    assert again.count() == kept.count()


def test_merge_and_completeness(spark):
    one = (nodes(spark, [(0, 3, None), (1, 3, 0)]), edges(spark, [(0, 1)]))
    n, e = graph.merge_graphs([one, one, (one[0].limit(0), one[1].limit(0))])
    assert sorted((r.id, r.parent) for r in n.collect() if r.parent is not None) == [(1, 0), (3, 2)]
    assert {(r.src, r.dst) for r in e.collect()} == {(0, 1), (2, 3)}
    row = graph.completeness(e, e.limit(1)).first()
    assert (row.resolved, row.dangling, round(row.completeness, 3)) == (2, 1, 0.667)


def test_resolves_passes(spark):
    # 1 connects to 100; 2 calls 1; 3 calls 2 and reads 200; 4 reads 201 and calls 1; 1 reads 202
    e = edges(spark, [(1, 100, 8), (2, 1, 1), (3, 2, 1), (3, 200, 6), (4, 201, 6), (4, 1, 1), (1, 202, 6)])
    variables = spark.createDataFrame([(200,), (201,), (202,)], "node bigint")
    pairs = lambda df: {(r.src, r.dst) for r in df.collect()}
    assert pairs(traverse.resolves_same_function(e, variables)) == {(100, 202)}
    assert pairs(traverse.resolves_backward(e, variables)) == {(100, 200), (100, 201)}
    assert pairs(traverse.resolves_backward(e, variables, 1)) == {(100, 201)}
    assert pairs(traverse.resolves_forward(e, variables)) == {(100, 200), (100, 201)}
    assert {r.caller for r in traverse.callers(e, 1).collect()} == {2, 4}
    assert ALL_EDGES == 0x7FF


def test_masks_reach_the_scan(spark, tmp_path):
    edges(spark, [(0, 1, 1), (1, 2, 3)]).write.parquet(f"{tmp_path}/e")
    plan = spark.read.parquet(f"{tmp_path}/e").where(in_mask(F.col("kind"), SERVICE_EDGES)).select("src", "dst")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(kind, [3,4,5])]" in plan and "ReadSchema: struct<src:bigint,dst:bigint,kind:int>" in plan
