"""The checking SQL puts events of one user and time into one session, in whatever order they are sorted."""

import duckdb

import __spark_entry__ as entry


def test_equal_times_are_in_one_session():
    con = duckdb.connect()
    # Two equal times an hour after the last two: every session has two events and ends 30 minutes after its start.
    con.execute("""CREATE TABLE events AS SELECT 1 + (i // 2) % 20000 AS user_id,
                     TIMESTAMP '2024-01-01' + to_hours(CAST((i // 2) // 20000 AS INTEGER)) AS ts
                   FROM range(1000000) r(i) ORDER BY hash(i)""")
    sql = entry.oracle_sql()["session_windows"]
    found = con.execute(f"SELECT count(*), min(plays), max(plays), max(session_end - session_start) = INTERVAL 30 MINUTES FROM ({sql})").fetchone()
    assert found == (500_000, 2, 2, True)
