"""Frontier algorithms: breadth-first search, betweenness from one source, components, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.state import cut_counting, cut_dealt
from .edge_map import EdgeProgram, edge_map, messages, run_rounds, seed
from .graph import Graph
from .stars import star_components

#: The integers that stand for "not reached" where sentinels are asked for.
UNVISITED = -1
UNREACHED = (2**31 - 1) // 2


def bfs(graph: Graph, source: int, sentinels: bool = False) -> DataFrame:
    """id, parent, dist. The parent is the least id of the level before; the source is its own parent.

    Vertices out of reach have nulls, or -1 with ``sentinels``.
    """
    graph.check_source(source)
    start = F.when(F.col("id") == source, F.lit(source).cast("long"))
    state = seed(graph, source).select("id", start.alias("parent"), F.when(F.col("id") == source, 0).alias("dist"), "active")

    def step(state: DataFrame, level: int) -> DataFrame:
        program = EdgeProgram(F.col("src"), "min", {"parent": F.col("msg"), "dist": F.lit(level)}, cond=F.col("parent").isNull())
        return edge_map(graph, state, program)

    done, _ = run_rounds(state, step)
    if sentinels:
        return done.select("id", F.coalesce("parent", F.lit(UNVISITED)).alias("parent"), F.coalesce("dist", F.lit(UNVISITED)).alias("dist"))
    return done.select("id", "parent", "dist")


def betweenness(graph: Graph, source: int, nan: bool = False) -> DataFrame:
    """id, sigma (shortest paths from the source) and dependency (Brandes); the source's is the others it reaches.

    Out of reach both are null, with ``nan`` the dependency is NaN.
    """
    graph.check_source(source)
    first = F.col("id") == source
    state = seed(graph, source).select("id", F.when(first, 0).alias("level"), F.when(first, 1.0).alias("sigma"), F.lit(0.0).alias("dependency"), "active")

    def forward(state: DataFrame, level: int) -> DataFrame:
        return edge_map(graph, state, EdgeProgram(F.col("s_sigma"), "sum", {"level": F.lit(level), "sigma": F.col("msg")}, cond=F.col("level").isNull()))

    state, rounds = run_rounds(state, forward)
    back = graph.transpose()
    for level in range(rounds - 1, 0, -1):
        # vertices of one level send (1 + dependency) / sigma to those of the level before
        sending = state.withColumn("active", F.coalesce(F.col("level") == level, F.lit(False)))
        sent = messages(back, sending, EdgeProgram((1 + F.col("s_dependency")) / F.col("s_sigma"), "sum"))
        met = state.join(sent, F.col("id") == F.col("dst"), "left")
        takes = (F.col("level") == level - 1) & F.col("msg").isNotNull()
        state = cut_dealt(met.select("id", "level", "sigma", F.when(takes, F.col("sigma") * F.col("msg")).otherwise(F.col("dependency")).alias("dependency"), "active"))
    lost = F.lit(float("nan")) if nan else F.lit(None).cast("double")
    return state.select("id", "sigma", F.when(F.col("level").isNull(), lost).otherwise(F.col("dependency")).alias("dependency"))


def components(graph: Graph, directed: bool = True) -> DataFrame:
    """id, component. Directed: the least id that reaches the vertex; otherwise the least id of its weak component.

    Directed labels have to follow the edges, a round per step; weak components contract in logarithmic rounds.
    """
    if not directed:
        linked = star_components(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        return graph.vertices.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    state = seed(graph).select("id", F.col("id").alias("component"), "active")
    program = EdgeProgram(F.col("s_component"), "min", {"component": F.col("msg")}, changed=F.col("msg") < F.col("component"))
    done, _ = run_rounds(state, lambda state, _: edge_map(graph, state, program))
    return done.select("id", "component")


def shortest_paths(graph: Graph, source: int, sentinels: bool = False, max_rounds: int | None = None) -> DataFrame:
    """id, dist: least sums of integer weights from the source.

    A negative cycle in reach shows by relaxations that go on for n rounds, or by a distance below the sum of all
    negative weights; then every vertex has -1073741823. Out of reach: null, or 1073741823 with ``sentinels``.
    """
    graph.check_source(source)
    floor = graph.edges.agg(F.coalesce(F.sum(F.least("weight", F.lit(0))), F.lit(0))).first()[0]
    state = seed(graph, source).select("id", F.when(F.col("id") == source, F.lit(0)).cast("long").alias("dist"), "active")
    closer = F.col("dist").isNull() | (F.col("msg") < F.col("dist"))
    program = EdgeProgram(F.col("s_dist") + F.col("weight"), "min", {"dist": F.col("msg")}, changed=closer)
    most = min(graph.n, max_rounds or graph.n)
    number, endless, active = 0, False, 1
    while active:
        if number == most or floor < 0 and not state.where(F.col("dist") < floor).isEmpty():
            endless = max_rounds is None or most == graph.n or number < most
            break
        number += 1
        state, active = cut_counting(edge_map(graph, state, program), F.col("active"))
    if endless:
        return state.select("id", F.lit(-UNREACHED).cast("long").alias("dist"))
    return state.select("id", F.coalesce("dist", F.lit(UNREACHED)).alias("dist") if sentinels else F.col("dist"))
