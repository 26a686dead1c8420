"""PageRank in four forms, sparse matrix-vector product and two-state belief propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.state import cut_dealt
from .edge_map import EdgeProgram, messages
from .graph import Graph

#: Fixed values of the rank recurrences.
DAMPING, EPSILON, DELTA_SHARE = 0.85, 1e-7, 0.01


def _pull(graph: Graph, state: DataFrame, value: Column, everyone: bool = True) -> DataFrame:
    """``state`` with the sum of ``value`` (over the source's columns) of all in-neighbours as ``got``; 0 without any."""
    sent = messages(graph, state, EdgeProgram(value, "sum"), everyone)
    return state.join(sent, F.col("id") == F.col("dst"), "left").withColumn("got", F.coalesce("msg", F.lit(0.0))).drop("dst", "msg")



def pagerank(graph: Graph, max_rounds: int = 10, epsilon: float = EPSILON) -> DataFrame:
    """id, rank: r'(v) = 0.85 * sum r(u) / out(u) + 0.15 / n, all vertices active; mass of sinks leaks."""
    n = graph.n
    state = graph.ids.select("id", "out_degree", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("moved"))
    for _ in range(max_rounds):
        new = F.lit(DAMPING) * F.col("got") + F.lit((1 - DAMPING) / n)
        state = cut_dealt(_pull(graph, state, F.col("s_rank") / F.col("s_out_degree")).select("id", "out_degree", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")))
        if l1(state) < epsilon:
            break
    return state.select("id", "rank")


def l1(state: DataFrame, column: str = "moved") -> float:
    return state.agg(F.sum(F.abs(F.col(column)))).first()[0] or 0.0


def pagerank_shrinking(graph: Graph, max_rounds: int = 10, epsilon: float = EPSILON) -> DataFrame:
    """id, rank of the two-buffer procedure whose active set shrinks to vertices with an active in-neighbour."""
    n = graph.n
    state = graph.ids.select("id", "out_degree", F.lit(1.0 / n).alias("c"), F.lit(0.0).alias("x"), F.lit(True).alias("active"), F.lit(0.0).alias("moved"))
    for _ in range(max_rounds):
        sent = messages(graph, state, EdgeProgram(F.col("s_c") / F.col("s_out_degree"), "sum")).withColumnRenamed("msg", "got")
        met = state.join(sent, F.col("id") == F.col("dst"), "left")
        added = F.col("x") + F.coalesce("got", F.lit(0.0))
        x = F.when(F.col("active"), DAMPING * added + (1 - DAMPING) / n).otherwise(added)
        moved = F.abs(F.col("c") - x)
        state = cut_dealt(met.select("id", "out_degree", x.alias("c"), F.when(F.col("active"), 0.0).otherwise(moved).alias("x"), F.col("got").isNotNull().alias("active"), moved.alias("moved")))
        if l1(state) < epsilon:
            break
    return state.select("id", F.col("c").alias("rank"))


def pagerank_converge(graph: Graph, max_rounds: int = 100, epsilon: float = EPSILON) -> DataFrame:
    """id, rank with the mass of sinks spread evenly and ranks normalised each round, until the L1 step is small."""
    n = graph.n
    state = graph.ids.select("id", "out_degree", F.lit(1.0 / n).alias("rank"))
    for _ in range(max_rounds):
        got = cut_dealt(_pull(graph, state, F.lit(DAMPING) / F.col("s_out_degree") * F.col("s_rank")))
        lost = (1 - (got.agg(F.sum("got")).first()[0] or 0.0)) / n
        step, total = got.agg(F.sum(F.abs(F.col("rank") - (F.col("got") + lost))), F.sum(F.col("got") + lost)).first()
        state = got.select("id", "out_degree", ((F.col("got") + lost) / total).alias("rank"))
        if step <= epsilon:
            break
    return state.select("id", "rank")


def pagerank_delta(graph: Graph, max_rounds: int | None = None, epsilon: float = EPSILON) -> DataFrame:
    """id, rank by passing on changes; only vertices whose change exceeds a hundredth of their rank send."""
    n = graph.n
    state = graph.ids.select("id", "out_degree", F.lit(0.0).alias("p"), F.lit(1.0 / n).alias("delta"), F.lit(True).alias("active"))
    number = 0
    while max_rounds is None or number < max_rounds:
        number += 1
        got = _pull(graph, state, F.col("s_delta") / F.col("s_out_degree"), everyone=False)
        if number == 1:
            first = DAMPING * (F.col("p") + F.col("got")) + (1 - DAMPING) / n - F.col("p")
            delta, p = first - 1.0 / n, F.col("p") + first
        else:
            delta, p = DAMPING * F.col("got"), F.col("p") + DAMPING * F.col("got")
        state = cut_dealt(got.select("id", "out_degree", p.alias("p"), delta.alias("delta"), (F.abs(delta) > DELTA_SHARE * p).alias("active")))
        if l1(state, "delta") < epsilon:
            break
    return state.select("id", F.col("p").alias("rank"))


def spmv(graph: Graph, x: DataFrame | None = None) -> DataFrame:
    """id, y with y(d) = sum of x(s) * weight over in-edges; ``x`` (id, x) is 1 / n by default."""
    state = graph.ids.join(x, "id") if x is not None else graph.ids.withColumn("x", F.lit(1.0 / graph.n))
    done = _pull(graph, state.select("id", "x"), F.col("s_x") * F.col("weight"))
    return done.select("id", F.col("got").alias("y"))


def belief_propagation(graph: Graph, vertex_potentials: DataFrame, rounds: int = 10, message: str = "destination") -> DataFrame:
    """id, p0, p1 after ``rounds`` of two-state products, not normalised.

    ``graph.edges`` has potential columns e00, e01, e10, e11; ``vertex_potentials`` is (id, v0, v1). An in-edge of v sends
    b[i] = sum_j v_j * e_ij * product_j with the destination's own state (``message="source"``: the source's), and the
    new product of v is the product of its edges' b[i], 1 without in-edges.
    """
    state = cut_dealt(graph.ids.join(vertex_potentials, "id").select("id", "v0", "v1", F.lit(1.0).alias("p0"), F.lit(1.0).alias("p1")).repartition(graph.parts, "id"))
    end = {"destination": "dst", "source": "src"}[message]
    edges = cut_dealt(graph.edges.repartition(graph.parts, end).sortWithinPartitions(end))
    for _ in range(rounds):
        held = edges.join(state.withColumnRenamed("id", end), end)
        belief = lambda i: F.col("v0") * F.col(f"e{i}0") * F.col("p0") + F.col("v1") * F.col(f"e{i}1") * F.col("p1")
        sent = held.select("dst", belief(0).alias("b0"), belief(1).alias("b1")).groupBy("dst").agg(F.product("b0").alias("b0"), F.product("b1").alias("b1"))
        met = state.join(sent, F.col("id") == F.col("dst"), "left")
        state = cut_dealt(met.select("id", "v0", "v1", F.coalesce("b0", F.lit(1.0)).alias("p0"), F.coalesce("b1", F.lit(1.0)).alias("p1")))
    return state.select("id", "p0", "p1")
