"""Queries that go through the events many times join them once."""

import __spark_entry__ as entry
from earshot.plans.fixtures import Inputs
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def test_events_are_joined_once(spark, monkeypatch):
    t, made, joins = Inputs(spark, FOLDER), Inputs.view, []
    assert rows(t.with_stored_events().listens) == rows(t.listens.drop("event_id", "source"))
    monkeypatch.setattr(Inputs, "view", lambda self, name, *a, **k: (joins.append(name), made(self, name, *a, **k))[1])
    found = entry.queries()["vibe_cascade"](spark, FOLDER)
    assert joins.count("listen_events") == 1 and found.count() > 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan
    kept = t.with_stored_events()
    assert "s_suppkey" not in kept.ready._jdf.queryExecution().optimizedPlan().toString()
