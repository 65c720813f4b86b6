"""Queries against their SQL on single events that larger tables hold."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry

NOON = datetime.datetime(2024, 1, 5, 12)


@pytest.mark.parametrize(
    "name, rows",
    [
        ("MDL15_fusion", [(154833, NOON)]),
        ("MDL16_root_cause", [(154833, NOON)]),
        ("MDL16_root_cause", [(154833, NOON), (154833, NOON), (5, NOON)]),
        ("ST02_deduplication", [(3, NOON.replace(microsecond=1)), (4, NOON.replace(microsecond=2)), (5, NOON.replace(microsecond=2)), (6, NOON)]),
    ],
)
def test_matches_sql(spark, tmp_path, name, rows):
    events = [(i, ts, 7, "click", 1.0) for i, ts in rows]
    table = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    table.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    out = entry.queries()[name](spark, str(tmp_path))
    theirs = con.execute(f"select {', '.join(out.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(theirs)
