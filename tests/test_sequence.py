"""Scans, packs and folds against plain Python."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import hashing, reducers, sequence
from loomgraph.streaming import degrees

_RNG = random.Random(5)
VALUES = [_RNG.randrange(-50, 50) for _ in range(500)]


@pytest.fixture(scope="module")
def table(spark):
    rows = list(enumerate(VALUES))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "pos long, v long").repartition(7).cache()


def ordered(df, name):
    return [r[name] for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize(("fold", "op", "start"), [("sum", lambda a, b: a + b, 0), ("min", min, None), ("max", max, None), ("last", lambda a, b: b, None)])
def test_prefix_scan(table, fold, op, start, inclusive, backward):
    got = ordered(sequence.prefix_scan(table, ["pos"], F.col("v"), fold=fold, inclusive=inclusive, backward=backward), "scan")
    values = VALUES[::-1] if backward else VALUES
    want = list(itertools.accumulate(values, op))
    want = want if inclusive else [start, *want[:-1]]
    assert got == (want[::-1] if backward else want)


def test_pack_and_enumerate(table):
    odd = F.col("v") % 2 != 0
    got = sequence.pack_index(table, ["pos"], odd).orderBy("number").collect()
    assert [r["v"] for r in got] == [v for v in VALUES if v % 2] and [r["number"] for r in got] == list(range(len(got)))
    yes, no = sequence.pack_two(table, odd)
    assert yes.count() + no.count() == len(VALUES) and sequence.pack(table, odd).count() == yes.count()


def test_reductions(table):
    assert sequence.reduce_column(table, F.col("v")).first()["value"] == sum(VALUES)
    assert tuple(sequence.reduce_pair(table, F.col("v")).first()) == (len(VALUES), sum(VALUES))
    assert tuple(sequence.argmax(table, "pos", F.col("v")).first()) == (VALUES.index(max(VALUES)), max(VALUES))
    assert sequence.median(table, F.col("v")).first()["median"] == (sorted(VALUES)[249] + sorted(VALUES)[250]) / 2


def test_order(table, spark):
    assert sequence.is_sorted(table, ["pos"], "v").first()["sorted"] is False
    assert sequence.is_sorted(table, ["pos"], "pos").first()["sorted"] is True
    assert sequence.is_sorted(table.where("false"), ["pos"], "v").first()["sorted"] is True
    offsets = sequence.bucket_offsets(table, "v").orderBy("v").collect()
    assert [r["start"] for r in offsets] == [sum(v < r["v"] for v in VALUES) for r in offsets]


def test_powers(spark):
    got = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 5, 1023, 1024, 1025)], "x long").select(sequence.log2_up(F.col("x")).alias("k"), sequence.round_up_pow2(F.col("x")).alias("p")).collect()
    assert [tuple(r) for r in got] == [(0, 1), (0, 1), (1, 2), (2, 4), (2, 4), (3, 8), (10, 1024), (10, 1024), (11, 2048)]


def mix(a, steps, bits):
    m = (1 << bits) - 1
    for p, c, q, s in steps:
        first = a + c if p == "+" else a ^ c
        other = (a << s) & m if s > 0 else a >> -s
        a = (first + other if q == "+" else (first & m) ^ other) & m
    return a


def test_hashes(spark):
    xs = [0, 1, 2, 19, 12345, 2**31, 2**32 - 1]
    got = spark.createDataFrame([(x,) for x in xs], "x long").select("x", hashing.hash32(F.col("x")).alias("a"), hashing.hash64(F.col("x")).alias("b"), hashing.linear32(F.col("x")).alias("c"), hashing.unit(F.col("x")).alias("u")).collect()
    for r in got:
        assert r["a"] == mix(r["x"], hashing.STEPS_32, 32)
        assert r["b"] % (1 << 64) == mix(r["x"], hashing.STEPS_64, 64)
        assert r["c"] == (1103515245 * r["x"] + 12345) % 2**32 % (2**32 - 1)
        assert 0 <= r["u"] <= 1


def test_keyed_table(spark):
    a, b = (spark.createDataFrame(x, "key string, value long") for x in ([("a", 1), ("b", 5)], [("b", 2), ("c", 3)]))
    assert sorted(map(tuple, sequence.insert(a, b, "key", "value").collect())) == [("a", 1), ("b", 5), ("c", 3)]
    assert [r["key"] for r in sequence.find(a, b, "key").collect()] == ["b"] and [r["key"] for r in sequence.delete(a, b, "key").collect()] == ["a"]


def test_reducers(spark):
    df = spark.createDataFrame([("x", 1, 3.0), ("x", 2, 4.0), ("y", 3, 0.5)], "k string, o long, v double")
    folded = {r["k"]: r for r in reducers.reduce_by(df, ["k"], p=("mul", "v"), m=("max", "v")).collect()}
    assert folded["x"]["p"] == 12.0 and folded["y"]["m"] == 0.5
    assert {r["k"]: r["values"] for r in reducers.append(df, ["k"], "o", "v", prepend=True).collect()} == {"x": [4.0, 3.0], "y": [0.5]}
    assert {r["k"]: r["text"] for r in reducers.joined_text(df, ["k"], "o", "o", "-").collect()} == {"x": "1-2", "y": "3"}
    assert {r["k"]: r["v"] for r in reducers.stable_sum(df, ["k"], "v").collect()} == {"x": 7.0, "y": 0.5}
    assert {r["k"]: r["v"] for r in reducers.custom(df, ["k"], _spread, "v").collect()} == {"x": 1.0, "y": 0.0}
    assert {r["k"]: r["o"] for r in reducers.index_of(df, ["k"], "o", "v", greatest=False).collect()} == {"x": 1, "y": 3}
    points = spark.createDataFrame([("q", 1, 8.0), ("q", 1, 12.0), ("q", 8, 2.0)], "benchmark string, workers int, seconds double")
    assert {r["workers"]: r["speed_up"] for r in reducers.performance_summary(points).collect()} == {1: 1.0, 8: 5.0}



def _spread(v: pd.Series) -> float:
    return float(v.max() - v.min())


def test_streaming_degrees(spark, tmp_path):
    spark.createDataFrame([(0, 1), (0, 2), (2, 1)], "src long, dst long").write.parquet(str(tmp_path / "in"))
    edges = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    query = degrees.start(edges, "seen_degrees", str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("seen_degrees").collect())) == [(0, 0, 2), (1, 2, 0), (2, 1, 1)]
