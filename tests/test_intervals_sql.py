"""Unions of intervals against their SQL where many intervals are equal."""

import duckdb
import pytest

from rowloom.plans import registry


@pytest.mark.parametrize("name", ["interval_union", "interval_union_adjacent"])
def test_equal_intervals(spark, tmp_path, name):
    con = duckdb.connect()
    made = "SELECT i AS event_id, i % 300 AS user_id, TIMESTAMP '2020-01-01' + INTERVAL 1 HOUR * CAST(20 * (hash(i % 150000) % 400) AS INTEGER) AS ts, CAST(10 * (i % 3) AS DOUBLE) AS value FROM range(300000) r(i)"
    con.execute(f"COPY ({made}) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    got = sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select("user_id", "n_islands", "total").collect())
    spans = {}
    for user, s, e in con.sql("SELECT DISTINCT user_id, epoch(ts) // 3600 AS s, epoch(ts) // 3600 + value // 10 AS e FROM events ORDER BY 1, 2, 3").fetchall():
        islands, gap = spans.setdefault(user, []), int(name.endswith("adjacent"))
        if islands and s <= islands[-1][1] + gap:
            islands[-1][1] = max(islands[-1][1], e)
        else:
            islands.append([s, e])
    assert got == [(u, len(x), sum(e - s + 1 for s, e in x)) for u, x in sorted(spans.items())]
    assert sorted(con.sql(f"SELECT user_id, n_islands, total FROM ({registry.ORACLES[name]})").fetchall()) == got
