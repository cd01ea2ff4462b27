from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from twinspan.operators.components import connected_components
from twinspan.operators.numbering import numbered
from twinspan.params import Params
from twinspan.plans import catalogue, evaluation

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: x if x is None or isinstance(x, (bool, str)) else float(x) if isinstance(x, float) else int(x)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_matches_sql(spark, tables, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    found = tables.sql(catalogue.ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(found.columns)
    assert _rows(frame.columns, frame.collect()) == _rows(found.columns, found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 39
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(catalogue.ORACLE_SQL) == set(catalogue.QUERIES)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 6), (7, 7), (None, 4), (20, 19), (19, 18), (18, 17), (17, 16), (16, 15), (15, 14)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, **dict.fromkeys(range(14, 21), 14)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_numbers_are_dense_and_ordered(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 as k")
    assert [r.n for r in numbered(rows, ["k"], "n", 1).orderBy("k").collect()] == list(range(1, 1001))


def test_simulated_copies_are_found(spark, tmp_path):
    truth = evaluation.simulate(str(tmp_path / "sim.fa"), {f"chr{i}": 200_000 for i in range(1, 6)}, 12, ortholog_rate=0.3, seed=3)
    assert len(truth.pairs) >= 10
    row = evaluation.timed_run(spark, truth, Params())
    assert row["Recall_frag"] >= 0.95 and row["Recall_bp"] >= 0.95 and row["Memory(MB)"] > 0
    thirds = [b for _, b in truth.pairs]
    # An ortholog's flanks make its region longer than its pair; pairs within a chromosome are compared in the order of the file.
    plain = [b for a, b in truth.pairs if thirds.count(b) == 1 and (a[0] != b[0] or a[1] < b[1])]
    assert row["Recall_pair"] * len(truth.pairs) >= len(plain) - 1e-9 and len(plain) >= 5


def test_sweep_and_report(spark, tmp_path):
    found = evaluation.sweep(spark, "k", [15, 17], [100_000], 1, copies=3, out_csv=str(tmp_path / "s.csv"))
    assert sorted(r.kmer for r in found.collect()) == [15, 17]
    means = evaluation.group_means(found, ["kmer"], ["F1_bp", "F1_pair"]).collect()
    assert len(means) == 2
    long = evaluation.melted(found, ["Tool"], {"Recall_bp": "Recall", "Precision_bp": "Precision"})
    assert {r.Metric for r in long.collect()} == {"Recall", "Precision"} and long.count() == 4
    (tmp_path / "a.bed").write_text("chr1 0 100\n")
    (tmp_path / "b.bed").write_text("chr1 50 150\n")
    text = evaluation.report("a", "b", *evaluation.compare(spark, str(tmp_path / "a.bed"), str(tmp_path / "b.bed")))
    assert "33.33" not in text and "0.333333" in text
