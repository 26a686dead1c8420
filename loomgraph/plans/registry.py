"""The graph engine's registered queries and their DuckDB SQL.

Queries run over graphs derived from the relational tables; doubles are rounded on both sides, as the order of a sum
differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, reducers, sequence
from ..operators import edge_map as em
from ..operators import partition, prep, rank, traversal
from ..operators.graph import Graph
from ..sources import tables
from ..streaming import degrees as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PARTS = 8

_CHAIN = """e AS MATERIALIZED (SELECT a AS src, b AS dst, CAST(sum(q) AS BIGINT) AS weight FROM (
  SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS b,
         CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_returnflag = 'R'{more}) WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2)"""
#: Edge tables as the start of a WITH clause; v has the vertices.
SPARSE = _CHAIN.format(more=" AND l_quantity > 25") + ", v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"
DENSE = _CHAIN.format(more="") + ", v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"
NATIONS = """e AS MATERIALIZED (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, count(*) AS weight FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
  v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"""
SOURCE = "s AS MATERIALIZED (SELECT src AS id FROM (SELECT src, count(*) AS d FROM e GROUP BY src) ORDER BY d DESC, src LIMIT 1)"
OUT = "o AS MATERIALIZED (SELECT src AS id, count(*) AS od FROM e GROUP BY src)"
NUMBERED = "p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS pos FROM e)"


def register(name: str, sql: str | None = None):
    def held(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return held


def sparse(spark: SparkSession, d: str) -> Graph:
    return Graph(tables.part_chain_sparse(spark, d))


def dense(spark: SparkSession, d: str) -> Graph:
    return Graph(tables.part_chain(spark, d))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """The sparse chain with positions in (src, dst) order."""
    return sequence.with_position(tables.part_chain_sparse(spark, d), ["src", "dst"])


def in_degrees(g: Graph) -> DataFrame:
    return g.degrees().select("id", F.col("in_degree").alias("degree"))


# --- tables and edge-table preparation

@register("degrees", f"WITH {SPARSE} SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS in_degree, (SELECT count(*) FROM e WHERE src = id) AS out_degree FROM v")
def degrees(spark, d):
    return sparse(spark, d).degrees()


@register("edges_dedup", "SELECT DISTINCT l_suppkey AS src, -1 - l_partkey AS dst FROM lineitem")
def edges_dedup(spark, d):
    lines = tables.table(spark, d, "lineitem")
    return prep.remove_duplicates(lines.select(F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst")))


@register("symmetrize", f"WITH {SPARSE} SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def symmetrize(spark, d):
    return prep.symmetrise(tables.part_chain_sparse(spark, d))


@register("transpose", f"WITH {SPARSE} SELECT dst AS src, src AS dst, weight FROM e")
def transpose(spark, d):
    return prep.transpose(tables.part_chain_sparse(spark, d))


@register("remove_self_loops", "SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_custkey <> o_orderkey")
def remove_self_loops(spark, d):
    return prep.remove_self_loops(tables.table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")))


@register("graph_check", f"WITH {SPARSE}, n AS (SELECT max(id) + 1 AS n FROM v) SELECT bool_and(src >= 0 AND src < n AND dst >= 0 AND dst < n) AS inside, count(*) AS m, count(DISTINCT src) AS n_sources FROM e, n")
def graph_check(spark, d):
    g = sparse(spark, d)
    return prep.check(g.edges, (g.vertices.agg(F.max("id")).first()[0] or 0) + 1)


@register("coo_to_csr", f"WITH {SPARSE}, r AS (SELECT id, count(dst) AS degree FROM v LEFT JOIN e ON src = id GROUP BY id) SELECT id, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, degree FROM r")
def coo_to_csr(spark, d):
    g = sparse(spark, d)
    return prep.to_rows(g.edges, g.vertices).select("id", "start", "degree")


@register("csr_to_coo", f"WITH {SPARSE} SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS INTEGER) AS place, dst, weight, row_number() OVER (ORDER BY src, dst) - 1 AS pos FROM e")
def csr_to_coo(spark, d):
    g = sparse(spark, d)
    return prep.from_rows(prep.to_rows(g.edges, g.vertices))


@register("neighbours", f"WITH {SPARSE} SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS INTEGER) AS place, dst, weight FROM e")
def neighbours(spark, d):
    return sparse(spark, d).neighbours()


@register("matrix_entries", f"WITH {SPARSE} SELECT src AS row, dst AS col, CAST(weight AS DOUBLE) AS val FROM e WHERE weight <> 0")
def matrix_entries(spark, d):
    return prep.matrix_entries(tables.part_chain_sparse(spark, d))


def _hash_sql(x: str) -> str:
    """The 32-bit mixer as nested SQL over unsigned arithmetic."""
    out = f"(({x}) & {hashing.M32})"
    for k, (p, c, q, s) in enumerate(hashing.STEPS_32):
        first = f"((a + {c}) & {hashing.M32})" if p == "+" else f"xor(a, {c})"
        other = f"((a << {s}) & {hashing.M32})" if s > 0 else f"(a >> {-s})"
        step = f"(({first} + {other}) & {hashing.M32})" if q == "+" else f"xor({first}, {other})"
        out = f"list_transform([{out}], lambda a: {step})[1]"
    return out


@register("add_weights", f"WITH {SPARSE}, {NUMBERED} SELECT src, dst, pos, CAST(({_hash_sql('pos')} & {hashing.M31}) % 20 AS BIGINT) AS weight FROM p")
def add_weights(spark, d):
    return hashing.add_weights(placed(spark, d)).select("src", "dst", "pos", "weight")


@register("hash_functions", f"WITH {SPARSE}, {NUMBERED} SELECT pos, CAST({_hash_sql('pos')} AS BIGINT) AS h32, CAST({_hash_sql('pos')} & {hashing.M31} AS BIGINT) AS h31, CAST((1103515245::HUGEINT * pos + 12345) % 4294967296 % {hashing.M32} AS BIGINT) AS linear FROM p")
def hash_functions(spark, d):
    return placed(spark, d).select("pos", hashing.hash32(F.col("pos")).alias("h32"), hashing.hash31(F.col("pos")).alias("h31"), hashing.linear32(F.col("pos")).alias("linear"))


@register("graph_reorder", f"WITH {SPARSE}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM v) SELECT a.new AS src, b.new AS dst, weight FROM e JOIN r a ON a.id = src JOIN r b ON b.id = dst")
def graph_reorder(spark, d):
    g = sparse(spark, d)
    return prep.relabel(g.edges.select("src", "dst", "weight"), prep.dense_ids(g.vertices))


@register("user_next", "WITH x AS (SELECT lag(user_id) OVER (ORDER BY ts, event_id) AS src, user_id AS dst FROM events) SELECT src, dst, count(*) AS weight FROM x WHERE src IS NOT NULL AND src <> dst GROUP BY 1, 2")
def user_next(spark, d):
    return tables.user_next(spark, d)


@register("nation_trade", f"WITH {NATIONS} SELECT * FROM e")
def nation_trade(spark, d):
    return tables.nation_trade(spark, d)


# --- vertex subsets and edge maps

@register("edge_map_min", f"WITH {SPARSE} SELECT id, min(src) AS low FROM v LEFT JOIN e ON dst = id AND src % 2 = 1 GROUP BY id")
def edge_map_min(spark, d):
    g = sparse(spark, d)
    state = em.seed(g).withColumn("active", F.col("id") % 2 == 1).withColumn("low", F.lit(None).cast("long"))
    return em.edge_map(g, state, em.EdgeProgram(F.col("src"), "min", {"low": F.col("msg")})).select("id", "low")


@register("edge_map_sum", f"WITH {SPARSE} SELECT id, CAST(coalesce(sum(weight), 0) AS BIGINT) AS total FROM v LEFT JOIN e ON dst = id GROUP BY id")
def edge_map_sum(spark, d):
    g = sparse(spark, d)
    state = em.seed(g).withColumn("total", F.lit(0).cast("long"))
    return em.edge_map(g, state, em.EdgeProgram(F.col("weight"), "sum", {"total": F.col("msg")}), everyone=True).select("id", "total")


@register("edge_map_or", f"WITH {SPARSE} SELECT id, coalesce(bool_or(src % 3 = 0), false) AS fed FROM v LEFT JOIN e ON dst = id AND id % 2 = 0 GROUP BY id")
def edge_map_or(spark, d):
    g = sparse(spark, d)
    state = em.seed(g).withColumn("fed", F.lit(False))
    program = em.EdgeProgram(F.col("src") % 3 == 0, "or", {"fed": F.col("msg")}, cond=F.col("id") % 2 == 0, changed=F.col("msg"))
    return em.edge_map(g, state, program).select("id", "fed")


@register("vertex_map", f"WITH {SPARSE} SELECT id, CASE WHEN id % 2 = 0 THEN id * 2 ELSE id END AS value FROM v")
def vertex_map(spark, d):
    state = em.seed(sparse(spark, d)).withColumn("active", F.col("id") % 2 == 0).withColumn("value", F.col("id"))
    return em.vertex_map(state, {"value": F.col("value") * 2}).select("id", "value")


@register("vertex_filter", f"WITH {SPARSE} SELECT id FROM v WHERE (SELECT count(*) FROM e WHERE src = id) >= 2")
def vertex_filter(spark, d):
    return em.to_sparse(em.vertex_filter(em.seed(sparse(spark, d)), F.col("out_degree") >= 2))


@register("frontier_stats", f"WITH {SPARSE} SELECT (SELECT count(*) FROM v WHERE id % 5 = 0) AS n_active, (SELECT count(*) FROM e WHERE src % 5 = 0) AS n_out_edges")
def frontier_stats(spark, d):
    g = sparse(spark, d)
    return em.subset_stats(em.to_dense(em.seed(g), g.vertices.where("id % 5 = 0")))


@register("frontier_dedup", f"WITH {SPARSE} SELECT DISTINCT dst AS id FROM e")
def frontier_dedup(spark, d):
    return sparse(spark, d).edges.select(F.col("dst").alias("id")).dropDuplicates(["id"])


# --- algorithms

_BFS = f"WITH RECURSIVE {SPARSE}, {SOURCE}, r(id, d) USING KEY (id) AS (SELECT id, 0 FROM s UNION SELECT e.dst, min(r.d + 1) FROM r JOIN e ON r.id = e.src LEFT JOIN recurring.r p ON p.id = e.dst WHERE p.id IS NULL GROUP BY e.dst)"


@register("bfs", f"{_BFS}, q AS (SELECT b.id, min(a.id) AS parent FROM r a JOIN e ON a.id = e.src JOIN r b ON b.id = e.dst AND b.d = a.d + 1 GROUP BY b.id) SELECT v.id, CASE WHEN r.d = 0 THEN v.id ELSE q.parent END AS parent, r.d AS dist FROM v LEFT JOIN r USING (id) LEFT JOIN q USING (id)")
def bfs(spark, d):
    g = sparse(spark, d)
    return traversal.bfs(g, tables.widest(g.edges))


@register("bfs_levels", f"{_BFS} SELECT d AS dist, count(*) AS n FROM r GROUP BY d")
def bfs_levels(spark, d):
    return bfs(spark, d).where("dist is not null").groupBy("dist").agg(F.count("*").alias("n"))


@register("components_directed", f"WITH RECURSIVE {SPARSE}, r(id, l) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT e.dst, min(r.l) FROM r JOIN e ON r.id = e.src JOIN recurring.r p ON p.id = e.dst WHERE r.l < p.l GROUP BY e.dst) SELECT id, l AS component FROM r")
def components_directed(spark, d):
    return traversal.components(sparse(spark, d))


@register("components_weak", f"WITH RECURSIVE {SPARSE}, u AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, l) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT u.dst, min(r.l) FROM r JOIN u ON r.id = u.src JOIN recurring.r p ON p.id = u.dst WHERE r.l < p.l GROUP BY u.dst) SELECT id, l AS component FROM r")
def components_weak(spark, d):
    return traversal.components(sparse(spark, d), directed=False)


@register("bellman_ford", f"WITH RECURSIVE {SPARSE}, {SOURCE}, r(id, d) USING KEY (id) AS (SELECT id, 0::BIGINT FROM s UNION SELECT e.dst, CAST(min(r.d + e.weight) AS BIGINT) FROM r JOIN e ON r.id = e.src LEFT JOIN recurring.r p ON p.id = e.dst WHERE p.id IS NULL OR p.d > r.d + e.weight GROUP BY e.dst) SELECT v.id, r.d AS dist FROM v LEFT JOIN r USING (id)")
def bellman_ford(spark, d):
    g = sparse(spark, d)
    return traversal.shortest_paths(g, tables.widest(g.edges))


def _chain(first: str, step: Callable[[int], str], rounds: int) -> str:
    """r0, r1, ... as CTEs."""
    return ", ".join([f"r0 AS MATERIALIZED ({first})", *(f"r{k} AS MATERIALIZED ({step(k)})" for k in range(1, rounds + 1))])


_N = "n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v)"
_ROUNDED = "round(CAST({} AS DOUBLE), 10)"


def _pagerank_sql(rounds: int = 10) -> str:
    step = lambda k: f"SELECT v.id, 0.85 * coalesce(g, 0) + 0.15 / n.n AS r FROM v CROSS JOIN n LEFT JOIN (SELECT dst, sum(r / od) AS g FROM r{k - 1} JOIN e ON src = r{k - 1}.id JOIN o ON o.id = src GROUP BY dst) ON dst = v.id"
    return f"WITH {DENSE}, {OUT}, {_N}, {_chain('SELECT id, 1 / n AS r FROM v, n', step, rounds)} SELECT id, {_ROUNDED.format('r')} AS rank FROM r{rounds}"


@register("pagerank", _pagerank_sql())
def pagerank(spark, d):
    return _round(rank.pagerank(dense(spark, d)), "rank")


def _round(df: DataFrame, *columns: str, digits: int = 10) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns))


def _shrinking_sql(rounds: int = 10) -> str:
    def step(k: int) -> str:
        x = "(CASE WHEN a THEN 0.85 * (x + coalesce(g, 0)) + 0.15 / n ELSE x + coalesce(g, 0) END)"
        return f"SELECT p.id, {x} AS c, CASE WHEN a THEN 0 ELSE abs(c - {x}) END AS x, g IS NOT NULL AS a FROM r{k - 1} p CROSS JOIN n LEFT JOIN (SELECT dst, sum(c / od) AS g FROM r{k - 1} q JOIN e ON src = q.id JOIN o ON o.id = src WHERE a GROUP BY dst) ON dst = p.id"

    return f"WITH {DENSE}, {OUT}, {_N}, {_chain('SELECT id, 1 / n AS c, 0::DOUBLE AS x, true AS a FROM v, n', step, rounds)} SELECT id, {_ROUNDED.format('c')} AS rank FROM r{rounds}"


@register("pagerank_shrinking", _shrinking_sql())
def pagerank_shrinking(spark, d):
    return _round(rank.pagerank_shrinking(dense(spark, d)), "rank")


# these two stop where they have settled, which a fixed chain of steps can't follow: held against brute force
@register("pagerank_converge")
def pagerank_converge(spark, d):
    return _round(rank.pagerank_converge(dense(spark, d)), "rank")


@register("pagerank_delta")
def pagerank_delta(spark, d):
    return _round(rank.pagerank_delta(dense(spark, d)), "rank")


def _bc_sql(depth: int) -> str:
    forward = ", ".join(["f0 AS MATERIALIZED (SELECT id, 1::DOUBLE AS g FROM s)", *(f"f{k} AS MATERIALIZED (SELECT r.id, sum(g) AS g FROM f{k - 1} p JOIN e ON e.src = p.id JOIN r ON r.id = e.dst AND r.d = {k} GROUP BY r.id)" for k in range(1, depth + 1))])
    back = ", ".join([f"b{depth} AS MATERIALIZED (SELECT id, g, 0::DOUBLE AS x FROM f{depth})", *(f"b{k} AS MATERIALIZED (SELECT f.id, any_value(f.g) AS g, coalesce(sum(f.g / b.g * (1 + b.x)), 0) AS x FROM f{k} f LEFT JOIN (e JOIN b{k + 1} b ON b.id = e.dst) ON e.src = f.id GROUP BY f.id)" for k in reversed(range(depth)))])
    every = " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(depth + 1))
    return f"{_BFS}, {forward}, {back}, b AS ({every}) SELECT v.id, b.g AS sigma, round(b.x, 8) AS dependency FROM v LEFT JOIN b USING (id)"


@register("bc", _bc_sql(36))
def bc(spark, d):
    g = sparse(spark, d)
    return _round(traversal.betweenness(g, tables.widest(g.edges)), "dependency", digits=8)


@register("spmv", f"WITH {SPARSE}, {_N} SELECT id, round(coalesce(sum(weight / n), 0), 10) AS y FROM v CROSS JOIN n LEFT JOIN e ON dst = id GROUP BY id, n")
def spmv(spark, d):
    return _round(rank.spmv(sparse(spark, d)), "y")


_E = ("0.5 + (src + dst) % 3 / 10.0", "0.5 - (src + dst) % 3 / 10.0", "0.3 + (src * 3 + dst) % 5 / 10.0", "0.7 - (src * 3 + dst) % 5 / 10.0")


# products of ten rounds leave the range of doubles, where engines differ: held against brute force
@register("bp")
def bp(spark, d):
    edges = tables.part_chain_sparse(spark, d)
    g = Graph(edges.select("*", *(F.expr(f"CAST({x} AS DOUBLE)").alias(n) for x, n in zip(_E, ("e00", "e01", "e10", "e11"), strict=True))))
    potentials = g.vertices.select("id", F.expr("0.9D + id % 3 / 10.0D").alias("v0"), F.expr("1.1D - id % 3 / 10.0D").alias("v1"))
    return _round(rank.belief_propagation(g, potentials), "p0", "p1", digits=8)


# --- partitions and orders

_IN = "i AS MATERIALIZED (SELECT id, count(src) AS degree FROM v LEFT JOIN e ON dst = id GROUP BY id)"


@register("part_vertex_balanced", f"WITH {SPARSE}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM v) SELECT k AS id, CAST(least(k // (n // {PARTS}), {PARTS - 1}) AS INTEGER) AS part FROM r")
def part_vertex_balanced(spark, d):
    g = sparse(spark, d)
    ids = prep.dense_ids(g.vertices).select(F.col("new_id").alias("id"))
    return partition.vertex_balanced(ids, g.n, PARTS)


@register("part_edge_balanced", f"WITH {SPARSE}, {_IN}, c AS (SELECT id, coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(degree) OVER () AS m FROM i) SELECT id, CAST(least((b * {PARTS}) // m, {PARTS - 1}) AS INTEGER) AS part FROM c")
def part_edge_balanced(spark, d):
    return partition.edge_balanced(in_degrees(sparse(spark, d)), PARTS)


#: A range closes at the mean, or where the next vertex would lift it over 1.1 times the mean.
_GREEDY = f"""k AS MATERIALIZED (SELECT id, row_number() OVER w AS rn, CAST(sum(degree) OVER w AS BIGINT) AS upto, CAST(sum(degree) OVER () AS BIGINT) // {PARTS} AS mean FROM i WINDOW w AS (ORDER BY id)),
  n AS MATERIALIZED (SELECT *, lead(upto) OVER (ORDER BY rn) AS next_upto FROM k),
  g(rn, id, part, base) AS (SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), 0, CAST(0 AS BIGINT) UNION ALL
    SELECT n.rn, n.id, CASE WHEN h.shut THEN h.part + 1 ELSE h.part END, CASE WHEN h.shut THEN h.upto ELSE h.base END
    FROM (SELECT g.rn, part, base, upto, coalesce(part < {PARTS - 1} AND (upto - base >= mean OR next_upto - base > CAST(1.1 AS DOUBLE) * mean), false) AS shut
          FROM g LEFT JOIN n ON n.rn = g.rn) h JOIN n ON n.rn = h.rn + 1)"""


@register("part_greedy", f"WITH RECURSIVE {SPARSE}, {_IN}, {_GREEDY} SELECT id, CAST(part AS INTEGER) AS part FROM g WHERE rn > 0")
def part_greedy(spark, d):
    return partition.greedy_ranges(in_degrees(sparse(spark, d)), PARTS)


@register("part_relabelled", f"WITH {SPARSE}, {_IN}, c AS (SELECT id, CASE WHEN degree > lag(degree) OVER (ORDER BY id) THEN 1 ELSE 0 END AS up FROM i) SELECT id, CAST(least(sum(up) OVER (ORDER BY id), {PARTS - 1}) AS INTEGER) AS part FROM c")
def part_relabelled(spark, d):
    return partition.rising_ranges(in_degrees(sparse(spark, d)), PARTS)


_RANGES = f"t AS (SELECT id, coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(degree) OVER () AS m FROM i), u AS (SELECT id, CAST(least((b * {PARTS}) // m, {PARTS - 1}) AS INTEGER) AS part FROM t)"


@register("coo_by_destination", f"WITH {SPARSE}, {_IN}, {_RANGES} SELECT part, count(*) AS edges, count(DISTINCT dst) AS destinations FROM e JOIN u ON id = dst GROUP BY part")
def coo_by_destination(spark, d):
    g = sparse(spark, d)
    dealt = partition.edges_by(g.edges, partition.edge_balanced(in_degrees(g), PARTS), "dst")
    return dealt.groupBy("part").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("destinations"))


@register("coo_by_source", f"WITH {SPARSE}, {_IN}, {_RANGES} SELECT part, count(*) AS edges, count(DISTINCT src) AS sources FROM e JOIN u ON id = src GROUP BY part")
def coo_by_source(spark, d):
    g = sparse(spark, d)
    dealt = partition.edges_by(g.edges, partition.edge_balanced(in_degrees(g), PARTS), "src")
    return dealt.groupBy("part").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


@register("sub_graph", f"WITH {SPARSE} SELECT src, dst, weight FROM e WHERE dst >= 100 AND dst < 400")
def sub_graph(spark, d):
    return partition.sub_graph(tables.part_chain_sparse(spark, d), 100, 400)


#: One step a bit, from the highest; coordinates keep to the bits of the grid.
_HILBERT = """z AS (SELECT CASE WHEN count(*) > 1 THEN length(bin(count(*) - 1)) ELSE 0 END AS bits FROM e),
  h(src, dst, x, y, d, k) AS (SELECT src, dst, src, dst, CAST(0 AS BIGINT), bits FROM e, z UNION ALL
    SELECT src, dst, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN xor(y, mask) ELSE y END ELSE x END,
           CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN xor(x, mask) ELSE x END ELSE y END, d * 4 + xor(3 * rx, ry), k - 1
    FROM (SELECT *, (x >> (k - 1)) & 1 AS rx, (y >> (k - 1)) & 1 AS ry, (CAST(1 AS BIGINT) << 40) - 1 AS mask FROM h WHERE k > 0))"""


@register("hilbert_order", f"WITH RECURSIVE {SPARSE}, {_HILBERT} SELECT src, dst, CAST(d AS BIGINT) AS hkey, row_number() OVER (ORDER BY d, src, dst) - 1 AS place FROM h WHERE k = 0")
def hilbert_order(spark, d):
    g = sparse(spark, d)
    ordered = partition.hilbert_order(g.edges.select("src", "dst"), g.m)
    return sequence.prefix_scan(ordered, ["hkey", "src", "dst"], F.lit(1).cast("long"), "place", inclusive=False)


@register("csr_order", f"WITH {SPARSE} SELECT src, dst, weight FROM e")
def csr_order(spark, d):
    return prep.csr_order(tables.part_chain_sparse(spark, d))


#: Vertices go one by one to the least load; within a degree the ids are then dealt to the parts in order.
VEBO = f"""r AS MATERIALIZED (SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) AS rn, row_number() OVER (PARTITION BY degree ORDER BY id) AS nth FROM i),
  q(rn, part, edges, sizes) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), [CAST(0 AS BIGINT) FOR x IN range({PARTS})], [CAST(0 AS BIGINT) FOR x IN range({PARTS})] UNION ALL
    SELECT rn, pick, [CASE WHEN j = pick THEN edges[j] + degree ELSE edges[j] END FOR j IN range(1, {PARTS + 1})], [CASE WHEN j = pick THEN sizes[j] + 1 ELSE sizes[j] END FOR j IN range(1, {PARTS + 1})]
    FROM (SELECT r.rn, degree, edges, sizes, CAST(CASE WHEN degree > 0 THEN list_position(edges, list_min(edges)) ELSE list_position(sizes, list_min(sizes)) END AS BIGINT) AS pick FROM q JOIN r ON r.rn = q.rn + 1)),
  dealt AS (SELECT degree, part, row_number() OVER (PARTITION BY degree ORDER BY part) AS nth FROM q JOIN r USING (rn)),
  z AS MATERIALIZED (SELECT r.id AS old_id, row_number() OVER (ORDER BY part, r.degree DESC, r.id) - 1 AS new_id, CAST(part - 1 AS INTEGER) AS part_id FROM r JOIN dealt USING (degree, nth))"""


@register("vebo", f"WITH RECURSIVE {SPARSE}, {_IN}, {VEBO} SELECT old_id, new_id, part_id FROM z")
def vebo(spark, d):
    return partition.vebo(in_degrees(sparse(spark, d)), PARTS)


@register("random_reorder", f"WITH {SPARSE} SELECT id AS old_id, row_number() OVER (ORDER BY {_hash_sql(f'xor(id, {_hash_sql(chr(55))})')}, id) - 1 AS new_id FROM v")
def random_reorder(spark, d):
    return prep.random_mapping(sparse(spark, d).vertices, 7)


# --- sequences

@register("scan_exclusive", f"WITH {SPARSE}, {NUMBERED} SELECT pos, CAST(coalesce(sum(weight) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM p")
def scan_exclusive(spark, d):
    return sequence.prefix_scan(placed(spark, d), ["pos"], F.col("weight"), inclusive=False).select("pos", "scan")


@register("scan_inclusive", f"WITH {SPARSE}, {NUMBERED} SELECT pos, CAST(sum(weight) OVER (ORDER BY pos) AS BIGINT) AS scan FROM p")
def scan_inclusive(spark, d):
    return sequence.prefix_scan(placed(spark, d), ["pos"], F.col("weight")).select("pos", "scan")


@register("scan_back_min", f"WITH {SPARSE}, {NUMBERED} SELECT pos, min(weight) OVER (ORDER BY pos DESC) AS scan FROM p")
def scan_back_min(spark, d):
    return sequence.prefix_scan(placed(spark, d), ["pos"], F.col("weight"), fold="min", backward=True).select("pos", "scan")


@register("scan_back_exclusive", f"WITH {SPARSE}, {NUMBERED} SELECT pos, max(weight) OVER (ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS scan FROM p")
def scan_back_exclusive(spark, d):
    return sequence.prefix_scan(placed(spark, d), ["pos"], F.col("weight"), fold="max", inclusive=False, backward=True).select("pos", "scan")


@register("enumerate", f"WITH {SPARSE}, {NUMBERED} SELECT pos, CAST(coalesce(sum(weight % 2) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS number FROM p")
def enumerate_(spark, d):
    return sequence.enumerate_flags(placed(spark, d), ["pos"], F.col("weight") % 2 == 1).select("pos", "number")


@register("pack_index", f"WITH {SPARSE}, {NUMBERED} SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS number FROM p WHERE weight > 40")
def pack_index(spark, d):
    return sequence.pack_index(placed(spark, d), ["pos"], F.col("weight") > 40).select("pos", "number")


@register("pack2", f"WITH {SPARSE}, {NUMBERED} SELECT pos, CASE WHEN weight > 40 THEN 1 ELSE 0 END AS side FROM p")
def pack2(spark, d):
    yes, no = sequence.pack_two(placed(spark, d), F.col("weight") > 40)
    return yes.select("pos", F.lit(1).alias("side")).unionByName(no.select("pos", F.lit(0).alias("side")))


@register("argmax", f"WITH {SPARSE}, {NUMBERED} SELECT pos AS index, weight AS value FROM p ORDER BY weight DESC, pos LIMIT 1")
def argmax(spark, d):
    return sequence.argmax(placed(spark, d), "pos", F.col("weight"))


@register("l1_norm", f"WITH {SPARSE} SELECT CAST(sum(abs(src - dst)) AS BIGINT) AS l1 FROM e")
def l1_norm(spark, d):
    return sequence.l1_distance(tables.part_chain_sparse(spark, d), F.col("src"), F.col("dst"))


@register("reduce_pair", f"WITH {SPARSE} SELECT count(*) AS n, CAST(sum(weight) AS BIGINT) AS total FROM e")
def reduce_pair(spark, d):
    return sequence.reduce_pair(tables.part_chain_sparse(spark, d), F.col("weight"))


@register("cum_count", f"WITH {SPARSE}, c AS (SELECT weight, count(*) AS n FROM e GROUP BY weight) SELECT weight, n, CAST(coalesce(sum(n) OVER (ORDER BY weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c")
def cum_count(spark, d):
    return sequence.bucket_offsets(tables.part_chain_sparse(spark, d), "weight")


@register("bucket_offsets", f"WITH {SPARSE}, c AS (SELECT src, count(*) AS n FROM e GROUP BY src) SELECT src, n, CAST(coalesce(sum(n) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c")
def bucket_offsets(spark, d):
    return sequence.bucket_offsets(tables.part_chain_sparse(spark, d), "src")


@register("is_sorted", f"WITH {SPARSE}, {NUMBERED}, q AS (SELECT weight, lag(weight) OVER (ORDER BY pos) AS b FROM p) SELECT bool_and(coalesce(b <= weight, true)) AS sorted FROM q")
def is_sorted(spark, d):
    return sequence.is_sorted(placed(spark, d), ["pos"], "weight")


@register("round_up_pow2", f"WITH {SPARSE} SELECT DISTINCT weight, CASE WHEN weight <= 1 THEN 0 ELSE CAST(length(ltrim(bin(weight - 1), '0')) AS INTEGER) END AS log2, CASE WHEN weight <= 1 THEN 1::BIGINT ELSE 1::BIGINT << length(ltrim(bin(weight - 1), '0')) END AS pow2 FROM e")
def round_up_pow2(spark, d):
    return tables.part_chain_sparse(spark, d).select("weight").distinct().select("weight", sequence.log2_up(F.col("weight")).alias("log2"), sequence.round_up_pow2(F.col("weight")).alias("pow2"))


@register("keyed_insert", "SELECT l_orderkey AS key, max(l_partkey) AS value FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey")
def keyed_insert(spark, d):
    rows = lambda flag: tables.table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("value"))
    return sequence.insert(rows("R"), rows("A"), "key", "value")


@register("keyed_find_delete", "SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def keyed_find_delete(spark, d):
    keys = lambda cond: tables.table(spark, d, "lineitem").where(cond).select(F.col("l_orderkey").alias("key"))
    held = sequence.find(keys("l_returnflag = 'R'").distinct(), keys("l_returnflag = 'A'"), "key")
    return sequence.delete(held, keys("l_linestatus = 'O'"), "key")


@register("reducers", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS total, bit_and(l_partkey) AS all_bits, bit_or(l_partkey) AS any_bits, bit_xor(l_partkey) AS odd_bits, max(l_partkey) AS most, min(l_partkey) AS least FROM lineitem GROUP BY l_returnflag")
def reducers_(spark, d):
    lines = tables.table(spark, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return reducers.reduce_by(lines, ["l_returnflag"], total=("add", "l_linenumber"), all_bits=("and", "l_partkey"), any_bits=("or", "l_partkey"), odd_bits=("xor", "l_partkey"), most=("max", "l_partkey"), least=("min", "l_partkey"))


@register("reducer_index", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey")
def reducer_index(spark, d):
    return reducers.index_of(tables.table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


@register("reducer_text", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def reducer_text(spark, d):
    return reducers.joined_text(tables.table(spark, d, "nation"), ["n_regionkey"], "n_nationkey", "n_name", ",")


@register("running_degrees", f"WITH {SPARSE} SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS in_degree, (SELECT count(*) FROM e WHERE src = id) AS out_degree FROM v")
def running_degrees(spark, d):
    return stream.running_degrees(tables.part_chain_sparse(spark, d))
