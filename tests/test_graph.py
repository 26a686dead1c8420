"""The six-vertex graph's known results, and properties on small graphs."""

import math

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import hashing
from loomgraph.operators import edge_map as em
from loomgraph.operators import partition, prep, rank, traversal
from loomgraph.operators.graph import Graph

EDGES = [(0, 1), (0, 2), (1, 2), (1, 4), (2, 1), (2, 4), (2, 5), (3, 0), (3, 2), (3, 4), (4, 0), (4, 1), (4, 2), (4, 5), (5, 1)]
WEIGHTS = [11, 2, 16, 4, 1, 18, 8, 12, 12, 17, 4, 19, 9, 12, 8]


def graph(spark, edges=EDGES, weights=None, n=6):
    rows = [(s, d, (weights or [1] * len(edges))[i], i) for i, (s, d) in enumerate(edges)]
    return Graph(spark.createDataFrame(rows, "src long, dst long, weight long, pos long"), spark.range(n).select("id"))


@pytest.fixture(scope="module")
def six(spark):
    return graph(spark)


@pytest.fixture(scope="module")
def weighted(spark):
    return graph(spark, weights=WEIGHTS)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def close(got, want):
    return all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))


def test_degrees(six):
    d = six.degrees()
    assert column(d, "out_degree") == [2, 2, 3, 3, 4, 1] and column(d, "in_degree") == [2, 4, 4, 0, 3, 2]


def test_first_vertex_without_in_edges_keeps_in_degree_zero(spark):
    assert column(graph(spark, [(0, 1), (0, 2)], n=3).degrees(), "in_degree") == [0, 1, 1]


@pytest.mark.parametrize(("source", "dist", "parent"), [(0, [0, 1, 1, None, 2, 2], [0, 0, 0, None, 1, 2]), (3, [1, 2, 1, 0, 1, 2], [3, 0, 3, 3, 3, 2])])
def test_bfs(six, source, dist, parent):
    got = traversal.bfs(six, source).cache()
    assert column(got, "dist") == dist and column(got, "parent") == parent


def test_bfs_sentinels_and_unknown_source(six):
    assert column(traversal.bfs(six, 0, sentinels=True), "parent")[3] == -1
    with pytest.raises(ValueError):
        traversal.bfs(six, 100)


def test_components(six, spark):
    assert column(traversal.components(six), "component") == [0, 0, 0, 3, 0, 0]
    assert column(traversal.components(six, directed=False), "component") == [0] * 6
    apart = graph(spark, [(5, 4), (4, 3), (1, 0), (7, 7)], n=9)
    assert column(traversal.components(apart, directed=False), "component") == [0, 0, 2, 3, 3, 3, 6, 7, 8]


@pytest.mark.parametrize(("source", "sigma", "dependency"), [(0, [1, 1, 1, None, 2, 1], [4, 0.5, 1.5, None, 0, 0]), (3, [1, 3, 1, 1, 1, 2], [1 / 3, 0, 5 / 6, 5, 5 / 6, 0])])
def test_betweenness(six, source, sigma, dependency):
    got = traversal.betweenness(six, source).cache()
    assert close(column(got, "sigma"), sigma) and close(column(got, "dependency"), dependency)


def test_betweenness_nan(six):
    assert math.isnan(column(traversal.betweenness(six, 0, nan=True), "dependency")[3])


def test_pagerank(six):
    assert close([round(x, 10) for x in column(rank.pagerank(six), "rank")], [0.0796681053, 0.2930509580, 0.2381609397, 0.0250000000, 0.2241072596, 0.1400127373])


def test_pagerank_shrinking(six):
    assert close([round(x, 10) for x in column(rank.pagerank_shrinking(six), "rank")], [0.0673171861, 0.2645482677, 0.2093613847, 0.0250000000, 0.1979267415, 0.1269921541])


def test_pagerank_converge(six):
    got = column(rank.pagerank_converge(six), "rank")
    assert close([round(x, 10) for x in got], [0.0797009897, 0.2930245842, 0.2381093597, 0.0250000000, 0.2240830949, 0.1400819716])


def test_pagerank_delta(six):
    assert close([round(x, 10) for x in column(rank.pagerank_delta(six), "rank")], [0.0790283635, 0.2902389088, 0.2372984599, 0.0250000000, 0.2234668998, 0.1389625788])


def test_weights_by_position(six):
    got = hashing.add_weights(six.edges).orderBy("pos").collect()
    assert [r["weight"] for r in got] == WEIGHTS


def test_shortest_paths(weighted):
    assert column(traversal.shortest_paths(weighted, 0), "dist") == [0, 3, 2, None, 7, 10]
    assert column(traversal.shortest_paths(weighted, 0, sentinels=True), "dist")[3] == 1073741823
    assert column(traversal.shortest_paths(weighted, 3), "dist") == [12, 13, 12, 0, 17, 20]


def test_negative_cycle(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 1)], [1, -3, 1], n=4)
    assert column(traversal.shortest_paths(g, 0, sentinels=True), "dist") == [-1073741823] * 4


def test_negative_edge_without_cycle(spark):
    g = graph(spark, [(0, 1), (1, 2), (0, 2)], [4, -3, 2], n=3)
    assert column(traversal.shortest_paths(g, 0), "dist") == [0, 4, 1]


def test_spmv(weighted):
    assert close(column(rank.spmv(weighted), "y"), [16 / 6, 39 / 6, 39 / 6, 0, 39 / 6, 20 / 6])


def test_belief_propagation(spark):
    edges = spark.createDataFrame([(0, 1, 0.5, 0.25, 1.0, 0.5), (2, 1, 1.0, 1.0, 0.5, 0.5)], "src long, dst long, e00 double, e01 double, e10 double, e11 double")
    potentials = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 4.0), (2, 1.0, 1.0)], "id long, v0 double, v1 double")
    got = rank.belief_propagation(Graph(edges), potentials, rounds=1).orderBy("id").collect()
    assert [(r["p0"], r["p1"]) for r in got] == [(1.0, 1.0), (12.0, 12.0), (1.0, 1.0)]


def test_symmetrise(spark):
    edges = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (1, 2)], "src long, dst long")
    assert sorted(map(tuple, prep.symmetrise(edges).collect())) == [(0, 1), (1, 0), (1, 2), (2, 1)]


def test_transpose_twice(six):
    assert sorted(map(tuple, six.transpose().transpose().edges.select("src", "dst").collect())) == sorted(EDGES)


def test_rows_round_trip(six):
    rows = prep.to_rows(six.edges, six.vertices)
    assert column(rows, "start") == [0, 2, 4, 7, 10, 14]
    assert sorted(map(tuple, prep.from_rows(rows).select("src", "dst").collect())) == EDGES


def test_check(six):
    assert tuple(prep.check(six.edges, 6).first()) == (True, 15, 6) and prep.check(six.edges, 5).first()["inside"] is False


def test_vebo(six):
    got = partition.vebo(six.degrees().select("id", F.col("in_degree").alias("degree")), 2).orderBy("old_id").collect()
    assert [r["new_id"] for r in got] == [4, 0, 3, 2, 1, 5] and [r["part_id"] for r in got] == [1, 0, 1, 0, 0, 1]


def test_balance_plan_is_the_greedy_rule():
    histogram = {9: 3, 4: 7, 1: 50, 0: 30}
    for parts in (1, 3, 8):
        edges, sizes = [0] * parts, [0] * parts
        for degree in sorted(histogram, reverse=True):
            for _ in range(histogram[degree]):
                loads = edges if degree else sizes
                j = loads.index(min(loads))
                edges[j] += degree
                sizes[j] += 1
        plan = partition.balance_plan(histogram, parts)
        starts = sorted((d, r, p) for d, p, r, _ in plan)
        got = [0] * parts
        for i, (d, r, p) in enumerate(starts):
            end = starts[i + 1][1] if i + 1 < len(starts) and starts[i + 1][0] == d else histogram[d]
            got[p] += (end - r) * d
        assert got == edges


def test_hilbert_keys(six):
    got = {(r["src"], r["dst"]): r["hkey"] for r in partition.hilbert_order(six.edges, 15).collect()}
    assert [got[e] for e in EDGES] == [3, 4, 7, 57, 13, 54, 55, 15, 11, 53, 16, 17, 30, 33, 18]


def test_greedy_ranges(spark):
    degrees = [3, 1, 1, 5, 0, 2, 2, 2, 4, 1]
    got = column(partition.greedy_ranges(spark.createDataFrame(list(enumerate(degrees)), "id long, degree long"), 3), "part")
    part, held, want, mean = 0, 0, [], sum(degrees) // 3
    for i, d in enumerate(degrees):
        want.append(part)
        held += d
        following = degrees[i + 1] if i + 1 < len(degrees) else 0
        if part < 2 and (held >= mean or following + held > 1.1 * mean):
            part, held = part + 1, 0
    assert got == want


def test_random_mapping_is_a_permutation(six):
    assert sorted(r["new_id"] for r in prep.random_mapping(six.vertices, 3).collect()) == list(range(6))


def test_edge_map_reports_changed_vertices(six):
    state = em.seed(six, 0).withColumn("low", F.lit(None).cast("long"))
    done = em.edge_map(six, state, em.EdgeProgram(F.col("src"), "min", {"low": F.col("msg")}))
    assert column(em.to_sparse(done), "id") == [1, 2]


def test_subset_round_trip_and_stats(six):
    subset = six.vertices.where("id in (1, 4)")
    dense = em.to_dense(em.seed(six), subset)
    assert column(em.to_sparse(dense), "id") == [1, 4]
    assert tuple(em.subset_stats(dense).first()) == (2, 6)
    assert tuple(em.subset_stats(em.seed(six, none=True)).first()) == (0, 0)


def test_hilbert_point_is_the_inverse_of_the_key(spark):
    grid = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    back = grid.select("x", "y", partition.hilbert_key(F.col("x"), F.col("y"), 4).alias("d")).select("x", "y", "d", partition.hilbert_point(F.col("d"), 4).alias("p")).collect()
    assert sorted(r.d for r in back) == list(range(256)) and all((r.p.x, r.p.y) == (r.x, r.y) for r in back)


def test_hubs_edges_are_dealt_evenly_and_results_stay(spark):
    edges = [(0, d) for d in range(1, 400)] + [(d, 400 + d % 50) for d in range(1, 400)] + [(0, 1), (0, 0)]
    rows = [(s, d, 1 + d % 7, i) for i, (s, d) in enumerate(edges)]
    table = spark.createDataFrame(rows, "src long, dst long, weight long, pos long")
    plain, split = Graph(table, spark.range(450).select("id")), Graph(table, spark.range(450).select("id"), hub_edges=100)
    assert plain.hubs is None and [r.src for r in split.hubs.collect()] == [0]
    sizes = [len(part) for part in split.heavy.rdd.glom().collect()]
    assert sum(sizes) == 401 and max(sizes) < 200 and split.light.count() == 399 and split.m == len(edges)
    for algorithm in (lambda g: traversal.bfs(g, 0), lambda g: traversal.shortest_paths(g, 0), rank.spmv, rank.pagerank_shrinking, lambda g: traversal.betweenness(g, 0)):
        got, want = (sorted(algorithm(g).collect()) for g in (split, plain))
        assert len(got) == 450 and all(close([float(v) if v is not None else None for v in a], [float(v) if v is not None else None for v in b]) for a, b in zip(got, want, strict=True))


def test_a_round_deals_only_its_messages(spark):
    table = spark.range(2000).select(F.col("id").alias("src"), ((F.col("id") * 7 + 1) % 2000).alias("dst"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = Graph(table)
        program = em.EdgeProgram(F.col("src"), "min", {"dist": F.lit(1)}, cond=F.col("dist").isNull())
        state = em.seed(g, 0).select("id", F.when(F.col("id") == 0, 0).alias("dist"), "active")
        state, rounds = em.run_rounds(state, lambda state, _: em.edge_map(g, state, program), 3)
        plan = em.edge_map(g, state, program)._jdf.queryExecution().executedPlan().toString()
        assert rounds == 3 and plan.count("Exchange ") == 1 and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_rounds_end_on_an_empty_graph(spark):
    g = Graph(spark.createDataFrame([], "src long, dst long"))
    assert traversal.components(g).count() == 0 and g.m == 0
