"""Keywords are sought as plain substrings: a pattern that is built in a row is compiled again for every row and word."""

from earshot.operators import vibes as V

NAMED = "track_id string, artist_id string, track_name string, artist_name string, plays long, unique_listeners long"
CATALOG = "source string, track_id string, artist_id string, track_name string, artist_name string, genre string"


def test_keywords_are_literal_patterns(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(V, "materialize", lambda df: seen.append(df) or df)
    named = spark.createDataFrame([("1", "a", "Love_Song", "Nora", 3, 2), ("2", "b", "ring", "Metalheads", 2, 1),
                                   ("3", "c", "Open Road", "Kai", 1, 1), ("4", "d", None, "Rocks", 9, 9)], NAMED)
    cat = spark.createDataFrame([("s", "3", None, "open road", "", "Smooth JAZZ")], CATALOG)
    out = V.vibe_named_match(named, cat, ["romantic", "energetic", "e_s", "100%"])
    assert sorted((r.vibe, r.global_rank_7d, r.track_id, r.vibe_match_score) for r in out.collect()) == [
        ("e_s", 1, "1", 2), ("energetic", 1, "4", 1), ("energetic", 2, "2", 1), ("romantic", 1, "3", 3), ("romantic", 2, "1", 2)]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan and "LIKE concat" not in plan
