"""Stored recommendations are read for the users and the version that a query needs."""

import pytest

import __spark_entry__ as entry
from earshot.operators.serving import latest_version, recsource_counts
from earshot.plans.fixtures import Inputs
from earshot.plans.serving import recs
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def test_dense_lists_leave_stored_rows_alone(spark, monkeypatch):
    assert entry.queries()
    unread = property(lambda self: pytest.fail("the stored rows are ranked for nothing"))
    monkeypatch.setattr(Inputs, "mf_latest", unread)
    assert recs(Inputs(spark, FOLDER), mf_first=False).count() > 0


def test_newest_rows_are_those_of_the_whole_view(spark):
    t = Inputs(spark, FOLDER)
    whole = latest_version(t.view("stored_mf"))
    assert rows(t.mf_newest()) == rows(whole)
    users = whole.select("user_id").distinct().orderBy("user_id").limit(3)
    assert rows(t.mf_newest(users)) == rows(whole.join(users, "user_id", "left_semi").select(*whole.columns))


def test_counts_of_a_source_without_rows(spark):
    mf = Inputs(spark, FOLDER).mf_newest().limit(0)
    lists = mf.select("track_id")
    found = recsource_counts(mf, mf, mf, lists).filter("source IN ('hybrid', 'mf')")
    assert [r[1:] for r in rows(found)] == [(False, 0, 0, None, None)] * 2
