"""The vertex and edge operators every algorithm is made of.

A vertex subset is a boolean column ``active`` on the state table (dense) or a table of ids (sparse). State is dealt by
id and edges by src in the same number of partitions, so a round joins in place and shuffles only the messages, which
are folded per destination before they move.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.state import cut_counting
from .graph import Graph

#: Commutative, associative folds of messages.
COMBINE: dict[str, Callable[[Column], Column]] = {
    "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "product": F.product,
    "or": F.bool_or, "and": F.bool_and, "bit_or": F.bit_or, "bit_and": F.bit_and, "bit_xor": F.bit_xor,
}


@dataclass(frozen=True)
class EdgeProgram:
    """What travels over an edge and what it does to the destination.

    ``message`` reads the source's columns as ``s_<name>`` with ``src``, ``dst``, ``weight`` and ``pos``; ``cond``,
    ``update`` and ``changed`` read the destination's own columns and the folded message ``msg``.
    """

    message: Column
    combine: str
    update: dict[str, Column] = field(default_factory=dict)
    cond: Column | None = None
    changed: Column | None = None


def messages(graph: Graph, state: DataFrame, program: EdgeProgram, everyone: bool = False) -> DataFrame:
    """(dst, msg): the folded messages of active sources; ``everyone`` leaves the test for ``active`` out of the plan."""
    senders = state if everyone or "active" not in state.columns else state.where("active")
    source = senders.select(F.col("id").alias("src"), *(F.col(c).alias(f"s_{c}") for c in state.columns if c not in {"id", "active"}))
    return graph.along(source).groupBy("dst").agg(COMBINE[program.combine](program.message).alias("msg"))


def edge_map(graph: Graph, state: DataFrame, program: EdgeProgram, everyone: bool = False) -> DataFrame:
    """The state after one round; ``active`` marks destinations whose update took effect."""
    met = state.join(messages(graph, state, program, everyone), F.col("id") == F.col("dst"), "left").drop("dst")
    hit = F.col("msg").isNotNull()
    if program.cond is not None:
        hit = hit & program.cond
    changed = hit & program.changed if program.changed is not None else hit
    changed = F.coalesce(changed, F.lit(False))
    kept = [c for c in state.columns if c != "active"]
    return met.select(*(F.when(changed, program.update[c]).otherwise(F.col(c)).alias(c) if c in program.update else F.col(c) for c in kept), changed.alias("active"))


def vertex_map(state: DataFrame, update: dict[str, Column]) -> DataFrame:
    """New values for the active vertices; the others keep theirs."""
    return state.select(*(F.when(F.col("active"), update[c]).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in state.columns))


def vertex_filter(state: DataFrame, keep: Column, update: dict[str, Column] | None = None) -> DataFrame:
    """``vertex_map``, and of the active vertices only those for which ``keep`` holds stay active."""
    done = vertex_map(state, update or {})
    return done.withColumn("active", F.col("active") & F.coalesce(keep, F.lit(False)))


def map_vertices(state: DataFrame, update: dict[str, Column]) -> DataFrame:
    return state.withColumns(update)


def to_sparse(state: DataFrame) -> DataFrame:
    return state.where("active").select("id")


def to_dense(state: DataFrame, subset: DataFrame) -> DataFrame:
    marked = subset.select("id").distinct().withColumn("_in", F.lit(True))
    return state.drop("active").join(marked, "id", "left").withColumn("active", F.col("_in").isNotNull()).drop("_in")


def subset_stats(state: DataFrame) -> DataFrame:
    """One row: active vertices and the sum of their out-degrees."""
    return state.where("active").agg(F.count("*").alias("n_active"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("n_out_edges"))


def seed(graph: Graph, source: int | None = None, none: bool = False) -> DataFrame:
    """id, out_degree, active: one vertex, no vertex, or all of them."""
    active = F.lit(False) if none else F.lit(True) if source is None else F.col("id") == source
    return graph.ids.withColumn("active", active)


def run_rounds(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], max_rounds: int | None = None) -> tuple[DataFrame, int]:
    """Apply ``step`` until no vertex is active; (state, rounds). One job per round: the write counts who is active."""
    number, active = 0, not state.where("active").isEmpty()
    while (max_rounds is None or number < max_rounds) and active:
        number += 1
        state, active = cut_counting(step(state, number), F.col("active"))
    return state, number
