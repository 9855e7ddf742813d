"""Queries against their SQL on tables larger than the smallest, where bounds and sizes show."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("sessions", [0, 400])
def test_synthesis_of_all_sessions(spark, tmp_path, sessions):
    con = duckdb.connect()
    con.execute(f"create table conversations as select n // 2 as conv_id, (n % 2)::int as turn, case n % 2 when 0 then 'user' else 'assistant' end as role, 'text ' || n as text from range({2 * sessions}) r(n)")
    con.execute(f"copy conversations to '{tmp_path}/conversations.parquet'")
    want = con.execute(entry.oracle_sql()["synthesis"]).fetchone()[0]
    assert entry.queries()["synthesis"](spark, str(tmp_path)).first().prompt == want
    assert want is None if not sessions else want.count("\n- [") == 240
