"""Nearest vectors in blocks against the SQL of the query, with what is odd about vectors."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from fairvane.operators import vectors as V


@pytest.mark.parametrize("rows", [3, 700])
def test_blocks_match_sql(spark, tmp_path, monkeypatch, rows):
    """Copies tie by id, zero vectors are no number and come first, unknown ones come last."""
    monkeypatch.setattr(V, "PIECE", 90)
    monkeypatch.setattr(V, "CHUNK", 3)
    monkeypatch.setattr(V, "TILE", 2)
    made = np.random.default_rng(2).normal(size=(rows, 4)).round(2)
    made[200:260] = made[100:160]
    made[100:107] = made[300:301]
    table = [(i, [float(x) for x in e]) for i, e in enumerate(made)]
    for i, e in ((1, [0.0] * 4), (400, [0.0] * 4), (2, None), (500, None)):
        if i < rows:
            table[i] = (i, e)
    table.append((None, [1.0] * 4))
    spark.createDataFrame(table, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    ours = entry.queries()["EMB01_vector_top_k"](spark, str(tmp_path))
    theirs = con.execute(f"select {', '.join(ours.columns)} from ({entry.oracle_sql()['EMB01_vector_top_k']})").fetchall()
    assert sorted(map(tuple, ours.collect())) == sorted(theirs)
