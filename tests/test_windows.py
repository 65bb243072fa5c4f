import duckdb
import pytest

from quillgraph.plans import registry


@pytest.mark.parametrize("micros", [[0, 59_999_499, 60_999_499, 60_999_500, 61_000_000, 120_999_499, 120_999_500, 121_999_999], [-999_500, -999_499, -500, 0, 500, 59_999_500, 60_000_000, -61_000_500, -60_999_499]])
def test_restart_window_seconds_are_those_of_rounded_milliseconds(spark, tmp_path, micros):
    rows = ", ".join(f"({i}, make_timestamp({us}::BIGINT), {i % 2})" for i, us in enumerate([m for m in micros for _ in (0, 1)]))
    duckdb.sql(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id FROM (VALUES {rows}) t(event_id, ts, user_id)) TO '{tmp_path}/events.parquet' (FORMAT PARQUET)")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = con.sql(registry.oracle_sql()["restart_window"]).fetchall()
    got = registry.queries()["restart_window"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
