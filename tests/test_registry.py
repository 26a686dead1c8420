"""Registered queries against their DuckDB SQL at the smallest scale, and the entry point."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: One query per kind; the full set runs at the driver.
NAMES = ["degrees", "symmetrize", "bfs", "components_weak", "spmv", "coo_to_csr", "add_weights", "part_edge_balanced", "part_relabelled", "scan_back_min", "edge_map_min", "nation_trade"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in os.listdir(SF):
        db.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return db


def normal(frame):
    names = sorted(frame.columns)
    clean = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) else v
    return [tuple(clean(v) for v in row) for row in frame[names].astype(object).itertuples(index=False)], names


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, names = normal(entry.queries()[name](spark, SF).toPandas())
    want, wanted = normal(duck.sql(entry.oracle_sql()[name]).df())
    key = lambda rows: sorted(rows, key=repr)
    assert names == wanted and key(got) == key(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_queries_without_the_training_data_operators(monkeypatch):
    find = entry.importlib.import_module

    def lacking(name):
        if name == "loomgraph.llm.queries":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return find(name)

    monkeypatch.setattr(entry.importlib, "import_module", lacking)
    with pytest.warns(UserWarning, match="left out"):
        assert "bfs" in entry.queries()


def test_cli(spark, tmp_path):
    from loomgraph.cli import main

    (tmp_path / "g").write_text("AdjacencyGraph 3 2 0 1 2 1 2")
    main(["bfs", str(tmp_path / "g"), "-r", "0", "--out", str(tmp_path / "out")])
    assert sorted(r["dist"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]
