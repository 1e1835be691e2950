"""Scores of odd values against SQL, bit by bit."""

import struct

import duckdb
import pytest

from scorenet import queries as q


@pytest.mark.parametrize("name", ["score_tau", "score_bum"])
def test_scores_bit_by_bit(spark, tmp_path, name):
    odd = "VALUES (1, '-5'), (2, '0'), (3, NULL), (4, 'NaN'), (5, 'inf'), (6, '25.00000000001'), (7, '6.955903577')"
    con = duckdb.connect()
    drawn = "SELECT 10 + range, exp(((range * 7919) % 1000003) / 1000003.0 * 1400 - 700) FROM range(400000)"
    con.execute(f"COPY (SELECT id AS event_id, v::DOUBLE AS value FROM ({odd}) t(id, v) UNION ALL {drawn}) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    bits = lambda x: None if x is None else struct.pack("<d", x)
    want = {k: bits(v) for k, v in con.execute(q.ORACLES[name]).fetchall()}
    assert {r.event_id: bits(r.score) for r in q.QUERIES[name](spark, str(tmp_path)).collect()} == want
