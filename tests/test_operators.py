import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.operators import closure as C
from kinweave.operators import compose, kinship, linalg, quality, structure, walk
from kinweave.operators.einsum import einsum, parse
from kinweave.operators.graph import CycleError, DensificationError, Graph, cells_to_wide, from_dense, violations, wide_to_cells
from kinweave.plans.scratch import Scratch

from . import model as M


def matrix(spark, a):
    return from_dense(a, spark)


def vertices(spark, a):
    return spark.createDataFrame([(i, a[i][i]) for i in range(len(a))], "vertex_id long, color int")


def edges(spark, a):
    return matrix(spark, a).where("i <> j")


STRATEGIES = {"doubling": C.doubling, "squaring": C.squaring, "semi_naive": C.semi_naive, "levelwise": C.levelwise, "auto": C.transitive_closure}


@pytest.mark.parametrize("name", STRATEGIES)
def test_golden_closures(spark, name):
    for a, closed in ((M.N5, M.N5_CLOSED), (M.D4, M.D4_CLOSED)):
        done = STRATEGIES[name](edges(spark, a))
        assert M.collected(done.paths) == {k: v for k, v in M.cells(closed).items() if k[0] != k[1]}
    assert STRATEGIES[name](edges(spark, M.N5)).diameter == 3


def test_complete_tree(spark):
    done = C.squaring(spark.createDataFrame(M.T7_EDGES, "i long, j long, v long"))
    assert {j: v for (i, j), v in M.collected(done.paths).items() if i == 0} == M.T7_ROW
    assert done.diameter == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_strategies_agree_on_random_graphs(spark, seed):
    a = M.random_graph(random.Random(seed), 14)
    want = {k: v for k, v in M.cells(M.close(a)).items() if k[0] != k[1]}
    for name, run in STRATEGIES.items():
        assert M.collected(run(edges(spark, a)).paths) == want, name


def test_cycles_are_refused_by_every_strategy(spark):
    a = [row[:] for row in M.N5]
    a[3][4] = 3
    for name, run in STRATEGIES.items():
        with pytest.raises(CycleError, match="cycle detected") as caught:
            run(edges(spark, a))
        assert caught.value.vertex in range(5), name
    with pytest.raises(DensificationError):
        C.transitive_closure(edges(spark, a), sparse_only=True)


def test_levels_name_a_vertex_on_the_cycle(spark):
    # 0 leads to the cycle 3, 4, 5, which leads to 1.
    e = spark.createDataFrame([(0, 3, 2), (3, 4, 3), (4, 5, 2), (5, 3, 3), (5, 1, 2)], "i long, j long, v long")
    with pytest.raises(CycleError) as caught:
        C.levels(e)
    assert caught.value.vertex in (3, 4, 5)


def test_shortest_path_methods(spark):
    a = M.random_graph(random.Random(3), 12)
    e = edges(spark, a)
    off = {k: v for k, v in M.cells(a).items() if k[0] != k[1]}
    closed = {k: v for k, v in M.cells(M.close(a)).items() if k[0] != k[1]}
    got = lambda *args, **more: {(r["i"], r["j"]): r["d"] for r in C.shortest_path(e, *args, **more).collect()}
    assert got() == got("FW") == got("D") == closed

    def plain(weights):
        best = dict(weights)
        for k in range(12):
            for i in range(12):
                for j in range(12):
                    if i != j and (i, k) in best and (k, j) in best:
                        best[i, j] = min(best.get((i, j), 10**9), best[i, k] + best[k, j])
        return best

    assert got("BF") == got("J") == plain(off)
    assert got("FW", unweighted=True) == plain({k: 1 for k in off})
    one = spark.createDataFrame([(11,)], "i long")
    assert got("auto", one) == {k: v for k, v in closed.items() if k[0] == 11}
    with pytest.raises(ValueError):
        C.shortest_path(e, "A")


def test_distances_along_predecessors(spark):
    chain = spark.range(9).selectExpr("id as i", "id + 1 as j", "2 + id % 2 as v")
    tree = C.predecessors(C.transitive_closure(chain).paths, chain)
    got = {(r["i"], r["j"]): r["d"] for r in C.distances(chain, tree).collect()}
    assert got == {(i, j): sum(2 + k % 2 for k in range(i, j)) for i in range(10) for j in range(i + 1, 10)}
    # A chain that breaks off gives no row, an empty tree none, a circle an error.
    broken = spark.createDataFrame([(0, 2, 1)], "i long, j long, pred long")
    assert C.distances(chain, broken).count() == 0 == C.distances(chain, broken.limit(0)).count()
    ring = spark.createDataFrame([(1, 2, 2), (2, 1, 2)], "i long, j long, v long")
    with pytest.raises(CycleError):
        C.distances(ring, spark.createDataFrame([(0, 1, 2), (0, 2, 1)], "i long, j long, pred long"))


def test_distance_matrix_in_blocks_of_sources(spark, monkeypatch):
    chain = spark.range(6).selectExpr("id as i", "id + 1 as j", "2 + id % 2 as v")
    paths = C.doubling(chain).paths
    monkeypatch.setattr(C, "PART_ROWS", 9)
    got = C.distance_matrix(paths, chain)
    want = {(i, j): sum(2 + k % 2 for k in range(i, j)) for i in range(7) for j in range(i + 1, 7)}
    assert got.count() == len(want) and {(r["i"], r["j"]): r["d"] for r in got.collect()} == want


def _random_steps(seed, n, back=3):
    """Edges of one step to earlier vertices, parallel ones and some twice, under keys that are far apart."""
    rng = random.Random(seed)
    steps = [(k * 10**15 - 7, rng.randrange(max(0, k - back), k) * 10**15 - 7, v) for k in range(1, n) for v in (2, 3) if rng.random() < 0.9]
    return steps + steps[::5]


@pytest.mark.parametrize("seed", [1, 2])
def test_walked_paths_and_distances(spark, monkeypatch, seed):
    graph = spark.createDataFrame(_random_steps(seed, 30), "i long, j long, v long")
    want = C.semi_naive(graph).paths
    summed = {tuple(r) for r in C.distances(graph, C.predecessors(want, graph)).collect()}
    # Neither a round nor a block is written.
    monkeypatch.setattr(Scratch, "keep", lambda *a: pytest.fail("a table was written"))
    paths = walk.paths(graph)
    assert paths.count() == want.count() and M.collected(paths) == M.collected(want)
    got = C.distance_matrix(paths, graph)
    assert got.dtypes == [("i", "bigint"), ("j", "bigint"), ("d", "bigint")]
    assert got.count() == len(summed) and {tuple(r) for r in got.collect()} == summed


def test_walked_blocks_are_halved(monkeypatch):
    steps = _random_steps(3, 40, back=9)
    graph = walk._packed(pa.table(dict(zip("ijv", map(list, zip(*steps))))))
    rows = lambda: sorted(tuple(r.values()) for b in walk._walked(graph, np.arange(len(graph[0]))) for r in b.to_pylist())
    want = rows()
    assert len({r[:2] for r in want}) == len(want) > 300
    for name, most in (("MAX_PAIRS", 40), ("BLOCK", 7), ("BATCH", 5)):
        monkeypatch.setattr(walk, name, most)
        assert rows() == want


def test_walked_paths_at_the_limits(spark, monkeypatch):
    chain = lambda n: spark.range(n).selectExpr("id as i", "id + 1 as j", "2 + id % 2 as v")
    full = C.distance_matrix(walk.paths(chain(62)), chain(62))
    assert {(r["i"], r["j"]): r["d"] for r in full.collect()} == {(i, j): sum(2 + k % 2 for k in range(i, j)) for i in range(63) for j in range(i + 1, 63)}
    more = lambda *rows: chain(5).unionByName(spark.createDataFrame(list(rows), "i long, j long, v long"))
    assert walk.paths(chain(5).limit(0)).count() == 0
    assert M.collected(walk.paths(more((2, 2, -1), (3, 0, 0)))) == M.collected(walk.paths(chain(5)))
    # Other graphs are left to the rounds.
    assert [walk.paths(g) for g in (chain(63), more((5, 1, 2)), more((4, 4, 3)), more((9, 8, 4)), more((9, None, 2)))] == [None] * 5
    monkeypatch.setattr(walk, "MAX_EDGES", 4)
    assert walk.paths(chain(5)) is None and walk.paths(chain(4)).count() == 10


def test_distance_matrix_of_longer_edges_in_blocks_of_sources(spark, monkeypatch):
    chain = spark.range(6).selectExpr("id as i", "id + 1 as j", "2 + id % 2 as v")
    graph = chain.unionByName(spark.createDataFrame([(20, 21, 5)], "i long, j long, v long"))
    paths = C.squaring(graph).paths
    monkeypatch.setattr(C, "PART_ROWS", 9)
    # An edge of several steps is no predecessor's.
    want = {(i, j): sum(2 + k % 2 for k in range(i, j)) for i in range(7) for j in range(i + 1, 7)}
    got = C.distance_matrix(paths, graph)
    assert got.count() == len(want) and {(r["i"], r["j"]): r["d"] for r in got.collect()} == want


@pytest.mark.parametrize("run", [C.squaring, C.doubling])
def test_rounds_in_parts_by_length_and_source(spark, monkeypatch, run):
    rng = random.Random(5)
    steps = {(k, rng.randrange(max(0, k - 3), k), v) for k in range(1, 14) for v in (2, 3)}
    graph = spark.createDataFrame(sorted(steps), "i long, j long, v long")
    whole = run(graph)
    monkeypatch.setattr(C, "PART_ROWS", 12)
    parts = run(graph)
    assert M.collected(parts.paths) == M.collected(whole.paths) == M.collected(C.semi_naive(graph).paths)
    assert parts.paths.count() == whole.paths.count() and parts.diameter == whole.diameter


def test_deep_chains_raise_instead_of_wrapping(spark):
    chain = spark.range(70).selectExpr("id as i", "id + 1 as j", "2L as v")
    for run in (C.squaring, C.doubling):
        with pytest.raises(OverflowError):
            run(chain)
    done = C.doubling(chain.where("i < 37"))
    assert done.diameter == 37 and done.paths.count() == 37 * 38 // 2


def test_empty_graph(spark):
    none = spark.createDataFrame([], "i long, j long, v long")
    assert C.transitive_closure(none).paths.count() == 0 and C.transitive_closure(none).diameter == 0


def test_sources_limits_and_reverse(spark):
    e = edges(spark, M.N5)
    start = spark.createDataFrame([(4,)], "i long")
    assert M.collected(C.semi_naive(e, start).paths) == {(4, 0): 2, (4, 1): 4, (4, 2): 5, (4, 3): 8}
    assert M.collected(C.semi_naive(e, start, limit=4).paths) == {(4, 0): 2, (4, 1): 4}
    assert M.collected(C.semi_naive(e, spark.createDataFrame([(3,)], "j long"), reverse=True).paths) == {(1, 3): 2, (0, 3): 4, (4, 3): 8}
    assert {r["j"]: r["v"] for r in C.multi_source_min(e, spark.createDataFrame([(4,), (1,)], "i long")).collect()} == {0: 2, 1: 4, 2: 5, 3: 2}


def test_predecessors_and_paths(spark):
    e = edges(spark, M.N5)
    paths = C.squaring(e).paths
    assert {(r["i"], r["j"]): r["pred"] for r in C.predecessors(paths, e).collect()}[(4, 3)] == 1
    walked = {(r["i"], r["j"]): list(r["path"]) for r in C.path_vertices(e, paths).collect()}
    assert walked[(4, 3)] == [4, 0, 1, 3] and walked[(0, 2)] == [0, 2] and len(walked) == paths.count()


def test_weighted_paths(spark):
    e = spark.createDataFrame([(0, 1, 4), (1, 2, -2), (0, 2, 5), (2, 3, 1)], "i long, j long, w long")
    got = {(r["i"], r["j"]): (r["d"], r["pred"]) for r in C.weighted_paths(e).collect()}
    assert got[(0, 2)] == (2, 1) and got[(0, 3)] == (3, 2)
    loop = e.unionByName(spark.createDataFrame([(3, 1, 0)], "i long, j long, w long"))
    with pytest.raises(CycleError, match="negative"):
        C.weighted_paths(loop)
    assert {(r["i"], r["j"]): r["d"] for r in C.weighted_paths(e.withColumn("w", F.lit(1)), directed=False).collect()}[(3, 0)] == 2


def test_products_match_the_model(spark):
    rng = random.Random(3)
    a, b = ([[rng.choice((0, 0, -1, 1, 2, 3, 6)) for _ in range(6)] for _ in range(6)] for _ in range(2))
    got = M.collected(linalg.matmul(matrix(spark, a), matrix(spark, b)))
    assert got == M.cells(M.matmul(a, b))
    assert M.collected(linalg.matmul(matrix(spark, a), matrix(spark, b), upper=True)) == {k: v for k, v in got.items() if k[1] >= k[0]}
    with pytest.raises(ValueError, match="inner dimensions"):
        linalg.matmul(matrix(spark, a), matrix(spark, b), inner=(6, 5))
    u, v = ([rng.choice((0, 2, 3)) for _ in range(6)] for _ in range(2))
    row = spark.createDataFrame([(k, x) for k, x in enumerate(u) if x], "k long, v long")
    column = spark.createDataFrame([(k, x) for k, x in enumerate(v) if x], "k long, v long")
    assert {r["k"]: r["v"] for r in linalg.row_times(row, matrix(spark, a)).collect()} == {j: x for j, x in enumerate(M.matmul([u], a)[0]) if x}
    assert {r["k"]: r["v"] for r in linalg.times_column(matrix(spark, a), column).collect()} == {i: x[0] for i, x in enumerate(M.matmul(a, [[x] for x in v])) if x[0]}
    assert linalg.dot(row, column).first()["v"] == M.matmul([u], [[x] for x in v])[0][0]
    assert linalg.equal(matrix(spark, a), matrix(spark, a)) and not linalg.equal(matrix(spark, a), matrix(spark, b))


def test_notebook_powers(spark):
    a = matrix(spark, M.N5)
    square = linalg.matmul(a, a)
    assert {j: v for (i, j), v in M.collected(square).items() if i == 4} == {0: 2, 1: 4, 2: 5, 4: 1, **({} if M.matmul(M.N5, M.N5)[4][3] == 0 else {3: M.matmul(M.N5, M.N5)[4][3]})}
    assert M.collected(linalg.matmul(square, a)) == M.cells(M.N5_CLOSED)


def test_einsum_left_to_right(spark):
    rng = random.Random(5)
    a, b, c = ([[rng.choice((0, -1, 1, 2, 3)) for _ in range(4)] for _ in range(4)] for _ in range(3))
    want = {}
    for i in range(4):
        for l in range(4):
            s = 0
            for j in range(4):
                for k in range(4):
                    s = M.plus(s, M.times(M.times(a[i][j], b[j][k]), c[k][l]))
            if s:
                want[(i, l)] = s
    got = einsum("ij,jk,kl->il", *(matrix(spark, x) for x in (a, b, c)))
    assert {(r["i"], r["l"]): r["v"] for r in got.collect()} == want
    assert einsum("ii", matrix(spark, M.N5)).first()["v"] == -1
    assert {r["i"]: r["v"] for r in einsum("ii->i", matrix(spark, M.N5)).collect()} == {i: M.N5[i][i] for i in range(5)}


def test_einsum_subscripts():
    assert parse("ij,jk", [2, 2]) == ([["i", "j"], ["j", "k"]], ["i", "k"])
    assert parse("...j,j->...", [3, 1]) == ([["_0", "_1", "j"], ["j"]], ["_0", "_1"])
    for bad, ranks in (("ij", [3]), ("ij,jk", [2]), ("ij->ii", [2]), ("ij->k", [2]), ("i1", [2])):
        with pytest.raises(ValueError):
            parse(bad, ranks)


def test_components_and_orders(spark):
    m, v = matrix(spark, M.C7), vertices(spark, M.C7)
    labels = {r["vertex_id"]: r["component"] for r in structure.connected_components(m, v).collect()}
    assert [labels[k] for k in range(7)] == M.C7_COMPONENTS
    order = structure.canonical_ordering(matrix(spark, M.close(M.C7)), v)
    assert [r["old"] for r in order.permutation.orderBy("new").collect()] == M.C7_CANONICAL
    assert order.matrix.agg(structure.is_upper_triangular(None).alias("u")).first()["u"]
    paths = C.squaring(edges(spark, M.C7)).paths
    topological = structure.topological_ordering(m, paths, v)
    assert topological.matrix.agg(structure.is_upper_triangular(None).alias("u")).first()["u"]
    sub, ids = structure.submatrix(m, v.where("vertex_id in (0, 3, 5)"))
    assert M.collected(sub) == {(0, 0): -1, (0, 1): 2, (0, 2): 3, (1, 1): -1, (2, 2): 1}
    assert M.collected(structure.merge_components([(sub, ids)])) == {(0, 0): -1, (0, 3): 2, (0, 5): 3, (3, 3): -1, (5, 5): 1}


def test_canonical_order_is_not_always_triangular(spark):
    # u, v, w, x, y1, y2, y3: the later generations of w weigh more on v than on u.
    pairs = [(0, 1, 2), (0, 2, 3), (1, 3, 2), (3, 2, 3), (2, 4, 2), (4, 5, 2), (5, 6, 2)]
    e = spark.createDataFrame(pairs, "i long, j long, v long")
    v = spark.createDataFrame([(0, 1), (1, -1), (2, 1), (3, -1), (4, -1), (5, -1), (6, -1)], "vertex_id long, color int")
    closed = C.squaring(e).paths.unionByName(structure.identity(v))
    place = {r["old"]: r["new"] for r in structure.canonical_ordering(closed, v).permutation.collect()}
    assert place[1] < place[0]


def test_long_chains_of_components(spark):
    chain = spark.range(300).selectExpr("id as i", "id + 1 as j", "2L as v")
    assert structure.roots(chain).select("root").distinct().count() == 1


def test_levels(spark):
    got = {r["vertex_id"]: r["level"] for r in C.levels(edges(spark, M.N5)).collect()}
    assert got == {3: 0, 2: 0, 1: 1, 0: 2, 4: 3}


def test_vertex_and_edge_composition(spark):
    rng = random.Random(9)
    a = M.random_graph(rng, 9)
    n = len(a)
    big = [row + [0] for row in a] + [[0] * n + [1]]
    red, black = ([j for j in range(3) if a[j][j] == c] for c in (-1, 1))
    row = ([(red[0], 2)] if red else []) + ([(black[0], 3)] if black else [])
    for j, v in row:
        big[n][j] = v
    big[n - 1][n] = 3
    closed = matrix(spark, M.close(a))
    got = compose.add_vertex(closed, spark.createDataFrame(row, "k long, v long"), spark.createDataFrame([(n - 1, 3)], "k long, v long"), n, 1)
    assert M.collected(got) == M.cells(M.close(big))
    before = [r[:] for r in M.N5]
    before[0][1] = 0
    assert M.collected(compose.add_edge(matrix(spark, M.close(before)), 0, 1, 2)) == M.cells(M.N5_CLOSED)


def test_compositions_that_close_a_cycle(spark):
    closed = matrix(spark, M.N5_CLOSED)
    up, down = spark.createDataFrame([(4, 3)], "k long, v long"), spark.createDataFrame([(3, 3)], "k long, v long")
    with pytest.raises(CycleError, match="Idx: 0, u_i: 6, v_i: 9") as caught:
        compose.add_vertex(closed, up, down, 5, 1)
    assert caught.value.vertex == 0
    with pytest.raises(CycleError):
        compose.add_edge(closed, 3, 4, 3)


def test_kinship(spark):
    rows = spark.createDataFrame([(0, 0, -1), (0, 2, 4), (1, 1, -1), (1, 2, 8), (2, 2, -1), (3, 3, 1)], "i long, j long, v long")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 0)], "a long, b long")
    got = {(r["a"], r["b"]): (r["common_ancestor"], r["relationship"]) for r in kinship.kinship(rows, pairs).collect()}
    assert got == {(0, 1): (2, "1st cousin 1 removed"), (0, 2): (2, "grandparent"), (0, 3): (-1, "No Relationship"), (0, 0): (0, "-2th great grandparent")}


def test_siblings_and_consanguinity(spark):
    e = spark.createDataFrame([(5, 1, 2), (5, 2, 3), (6, 1, 2), (6, 2, 3), (7, 1, 2), (8, 5, 2)], "i long, j long, v long")
    assert {(r["a"], r["b"]): r["shared"] for r in kinship.siblings(e).collect()} == {(5, 6): 2, (5, 7): 1, (6, 7): 1}
    pairs = spark.createDataFrame([(6, 8), (2, 7), (1, 8)], "a long, b long")
    near = kinship.related_within(C.squaring(e).paths, pairs, 2)
    assert {(r["a"], r["b"]) for r in near.collect()} == {(6, 8), (1, 8)}


def test_violations(spark):
    v = spark.createDataFrame([(0, -1), (1, 1), (2, 1), (2, 1), (3, 5)], "vertex_id long, color int")
    e = spark.createDataFrame([(2, 0, 2), (2, 1, 2), (1, 1, 3), (1, 9, 3), (8, 0, 4)], "i long, j long, v long")
    got = {r["rule"] for r in violations(Graph(v, e), ordered=True).collect()}
    assert got == {"color", "duplicate_vertex", "self_loop", "unknown_child", "unknown_parent", "edge_value", "parent_color", "parents_of_one_color", "parent_order"}
    with pytest.raises(ValueError):
        Graph(v, e).check()
    good = Graph(vertices(spark, M.C7), edges(spark, M.C7))
    assert good.check() is good


def test_dense_and_back(spark):
    wide = cells_to_wide(matrix(spark, M.N5), 5)
    assert [tuple(r)[1:] for r in wide.orderBy("i").collect()] == [tuple(row) for row in M.N5]
    assert M.collected(wide_to_cells(wide, "i", {f"c{k}": k for k in range(5)})) == M.cells(M.N5)


def test_density_monitor(spark):
    monitor = structure.DensityMonitor()
    assert monitor.check(matrix(spark, M.N5), 5, "a").nnz == 9 and monitor.warnings
    with pytest.raises(DensificationError):
        monitor.check(matrix(spark, M.N5_CLOSED), 4, "b")


def test_descriptive_statistics(spark):
    row = structure.described(spark.createDataFrame([(x,) for x in (1, 2, 2, 9)], "x long"), "x").first()
    assert row["n"] == 4 and row["largest"] == 9 and row["mean"] == 3.5
    assert abs(row["variance"] - 41 / 3) < 1e-9 and abs(row["skewness"] - 36 / 10.25**1.5) < 1e-9


def test_cycles_and_breaking(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 2), (4, 1), (5, 5)], "i long, j long")
    assert quality.shortest_cycle(e, 1) == [1, 2, 3, 1] and quality.shortest_cycle(e, 4) is None
    assert sorted(list(r["cycle"]) for r in quality.simple_cycles(e).collect()) == [[1, 2, 3], [2, 3], [5]]
    assert {r["vertex_id"] for r in quality.cycle_participants(e).collect()} == {1, 2, 3, 5}
    typed = spark.createDataFrame([(1, 2, "BiologicalParent"), (2, 3, "StepParent"), (3, 1, "UntypedParent"), (3, 2, "Other")], "source long, destination long, type string")
    cycles = quality.simple_cycles(e.where("i <> j"))
    weakest = {(r["source"], r["destination"]) for r in quality.break_cycles(cycles, typed).collect()}
    assert weakest == {(2, 3)}
    assert quality.break_cycles(cycles, typed, "manual").count() == 0
    assert {(r["source"], r["destination"]) for r in quality.break_cycles(cycles, typed, "untyped").collect()} == {(3, 1)}
    scores = quality.edge_reliability(typed.select("source", "destination"), typed)
    assert {(r["source"], r["destination"]): r["score"] for r in scores.collect()} == {(1, 2): 100, (2, 3): 20, (3, 1): 50, (3, 2): 30}


def test_long_cycles(spark):
    ring = [(k, (k + 1) % 11) for k in range(11)] + [(3, 20), (20, 21), (30, 31), (31, 0)]
    e = spark.createDataFrame(ring, "i long, j long")
    assert [list(r["cycle"]) for r in quality.simple_cycles(e).collect()] == [list(range(11))]
    with pytest.warns(UserWarning, match="more than 8 edges"):
        assert quality.simple_cycles(e, 8).count() == 0
    with pytest.warns(UserWarning, match="up to 5 edges"):
        assert quality.shortest_cycle(e, 2, 5) is None
    long = spark.createDataFrame([(k, (k + 1) % 66) for k in range(66)], "i long, j long")
    assert quality.shortest_cycle(long, 0) == [*range(66), 0]


def test_mutual_exclusions(spark):
    v = spark.createDataFrame([("a", "A", "x", 0), ("b", "B", "x", 2), ("c", "C", "x", 2)], "id string, given_name string, surname string, iteration long")
    e = spark.createDataFrame([("a", "b", "t"), ("b", "a", "t"), ("b", "c", "t"), ("c", "b", "t")], "source string, destination string, type string")
    got = {(r["from_id"], r["to_id"]) for r in quality.mutual_exclusions(e, v).collect()}
    assert got == {("b", "a"), ("b", "c")}


def test_ten_vertices(spark):
    e = spark.createDataFrame(M.C10_EDGES, "i long, j long, v long")
    v = spark.createDataFrame(list(enumerate(M.C10_COLORS)), "vertex_id long, color int")
    want = {(i, j): x for i, j, x in M.C10_EDGES} | M.C10_ADDED
    for name, run in STRATEGIES.items():
        assert M.collected(run(e).paths) == want, name
    labels = {r["vertex_id"]: r["component"] for r in structure.connected_components(e, v).collect()}
    assert [labels[k] for k in range(10)] == M.C10_COMPONENTS
    assert {r["component"]: r["size"] for r in structure.component_sizes(structure.connected_components(e, v)).collect()} == {0: 7, 1: 3}


def test_sibling_and_great_grandmother(spark):
    none = spark.createDataFrame([], "k long, v long")
    one = compose.add_vertex(matrix(spark, M.N5_CLOSED), spark.createDataFrame([(0, 2)], "k long, v long"), none, 5, -1)
    first = M.cells(M.N5_CLOSED) | M.RC5_SIBLING
    assert M.collected(one) == first
    two = compose.add_vertex(one, none, spark.createDataFrame([(1, 3)], "k long, v long"), 6, 1)
    assert M.collected(two) == first | M.RC5_MOTHER
    with pytest.raises(ValueError, match="colour"):
        compose.add_vertex(one, none, none, 7, 0)


# --- scratch tables -----------------------------------------------------------


def folders(spark, label):
    """Tables that the operators of this name have left behind."""
    from kinweave.plans.scratch import shared_dir

    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{label}-*/*")
    return len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


@pytest.mark.parametrize(
    ("label", "most", "run"),
    [
        ("semi-naive", 6, lambda e, p: C.semi_naive(e).paths.count()), ("squaring", 1, lambda e, p: C.squaring(e).paths.count()), ("levels", 6, lambda e, p: C.levels(e).count()),
        ("weighted", 1, lambda e, p: C.weighted_paths(e.withColumn("w", F.lit(1))).count()), ("components", 1, lambda e, p: structure.roots(e).count()),
        ("walk", 6, lambda e, p: C.path_vertices(e, p).count()), ("cycle", 0, lambda e, p: quality.shortest_cycle(e, 5)),
    ],
)
def test_rounds_leave_only_what_is_read(spark, label, most, run):
    chain = spark.createDataFrame([(k, k - 1, 2) for k in range(1, 6)], "i long, j long, v long")
    pairs = spark.createDataFrame([(5, 0, 32), (3, 1, 4)], "i long, j long, v long")
    before = folders(spark, label)
    run(chain, pairs)
    assert folders(spark, label) - before <= most


def test_scratch_needs_a_shared_folder_off_local_mode():
    from types import SimpleNamespace

    from kinweave.plans.scratch import shared_dir

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), master="spark://host:7077")
    with pytest.raises(RuntimeError, match="share"):
        shared_dir(SimpleNamespace(sparkContext=context))


@pytest.mark.parametrize("seed", range(3))
def test_cycle_participants_against_reachability(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(22)})
    reach = {a: {b for x, b in edges if x == a} for a in range(14)}
    for _ in range(14):
        reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
    got = {r[0] for r in quality.cycle_participants(spark.createDataFrame(edges, "i long, j long")).collect()}
    assert got == {a for a, r in reach.items() if a in r}
