"""Rules that the checking SQL and the queries share, on inputs where a narrower rule shows."""

import duckdb

import __spark_entry__ as entry
from earshot.operators import evaluation as E
from earshot.plans.registry import check_sql

READY = """SELECT 'u' || u AS user_id, 't' || u || '_' || n AS track_id, 'name' AS track_name, 'artist' AS artist_name,
 TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * n AS event_ts, printf('%02d', n) AS event_id
FROM range(3) a(u), range(25) b(n)"""


def test_tracks_that_only_the_holdout_has_are_evaluated(spark):
    """Without a candidate limit no track is left out, and the catalog size counts all tracks of the users."""
    assert entry.queries()
    con = duckdb.connect()
    con.execute(f"CREATE TABLE lines AS {READY}")

    def sql(view):
        text = check_sql((view,), f"SELECT count(*) FROM {view}")
        ctes = text.index("split AS (") if "split AS (" in text else text.index("cand AS (")
        return "WITH ready AS (SELECT * FROM lines), model_users AS (SELECT DISTINCT user_id FROM lines), " + text[ctes:]

    ev = spark.createDataFrame(con.execute("SELECT * FROM lines").df())
    h = E.build_holdout(ev, ev.select("user_id").distinct())
    assert h.test.count() == con.execute(sql("test")).fetchone()[0] == 15
    assert ev.select(h.total_tracks).first()[0] == con.execute(sql("cand")).fetchone()[0] == 75
