"""Text and time functions against plain Python."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from earshot.functions import events as E
from earshot.functions import text as T
from earshot.functions.vibe_rules import vibe_keywords, vibe_labels
from earshot.operators.interactions import normalise_interactions
from earshot.sources import raw as R
from earshot.sources import tables as B

TEXTS = ["NaÃ¯ve", "donâ€™t", "Â 5", "null", " NaN ", "You'Re", "日本", " x\t", "CafÃƒÂ©", "Ã", None, "", "   ",
         "Motörhead â€œliveâ€\x9d", "BjÃ¶rk", "Å½ivot", "Ã‰tÃ©", "plain", "a�b", "None of it", "ÃƒÂ¯", "tab\there"]


def expected_clean(value):
    """What the cleaning must give, by bytes rather than by expressions."""
    if value is None or not value.strip() or value.strip().lower() in T.NULL_WORDS:
        return None
    marks = T.BROKEN_MARKS

    def bad(s):
        return s.count("�") + sum(s.count(m) for m in marks)
    s = value.strip()
    for broken, right in T.BROKEN_SEQUENCES.items():
        s = s.replace(broken, right)
    s = s.replace("Â ", " ").replace("Â", "")
    for _ in range(2):
        if any(m in s for m in marks):
            options = [s]
            for codec in ("latin1", "cp1252"):
                try:
                    options.append(s.encode(codec).decode("utf-8"))
                except UnicodeError:
                    pass
            s = min(options, key=bad)
    return s.strip() or None


@pytest.mark.parametrize("form", ["name", "column", "frame"])
def test_clean_text(spark, form):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(TEXTS)], "i int, v string")
    if form == "frame":
        out = T.clean_text_columns(df, ["v"]).select("i", F.col("v").alias("c"))
    else:
        out = df.select("i", T.clean_text("v" if form == "name" else F.concat("v", F.lit(""))).alias("c"))
    assert {r.i: r.c for r in out.collect()} == {i: expected_clean(v) for i, v in enumerate(TEXTS)}


def test_display_name_and_keys(spark):
    df = spark.createDataFrame([("You'Re I'M She'S O'Neil Rock'N", " Dr. Foo-Bar  9 ")], "a string, b string")
    row = df.select(T.display_text(F.col("a")).alias("d"), T.name_key(F.col("b")).alias("k")).first()
    assert row.d == "You're I'm She's O'Neil Rock'N" and row.k == "dr foo bar 9"


def test_readable(spark):
    cases = [("Song", "Band", "1", True), ("", "Band", "1", False), ("123", "Band", "1", False), ("٣٤", "Band", "1", False),
             ("Song", "__Unknown_Artist__", "1", False), ("Song", None, "1", False), ("x1", "Band", "x1", False), ("Song", "Band", None, True)]
    df = spark.createDataFrame(cases, "track_name string, artist_name string, track_id string, ok boolean")
    got = df.select("ok", T.readable(F.col("track_name"), F.col("artist_name"), F.col("track_id")).alias("r")).collect()
    assert [r.r for r in got] == [r.ok for r in got]


def test_flexible_times(spark):
    base = dt.datetime(2023, 11, 14, 22, 13, 20)
    cases = [("1700000000", base), ("1700000000123", base + dt.timedelta(milliseconds=123)),
             ("1700000000123456", base + dt.timedelta(microseconds=123456)), ("1700000000123456789", base + dt.timedelta(microseconds=123457)),
             ("2020-01-02", dt.datetime(2020, 1, 2)), ("2020-01-02T03:04:05+02:00", dt.datetime(2020, 1, 2, 1, 4, 5)),
             ("x", None), ("nan", None), ("1e30", None), (None, None), ("-5", dt.datetime(1969, 12, 31, 23, 59, 55))]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v string")
    got = {r.i: r.t for r in df.select("i", E.flexible_event_ts(F.col("v")).cast("timestamp_ntz").alias("t")).collect()}
    for i, (_, want) in enumerate(cases):
        assert (got[i] is None) == (want is None), cases[i]
        assert want is None or abs((got[i] - want).total_seconds()) < 2e-6, cases[i]


def test_hash_covers_every_field_and_blank_parts(spark):
    import hashlib
    df = spark.sql("SELECT 's' source, 'u' user_id, CAST(NULL AS STRING) track_id, 'a' artist_id, TIMESTAMP_NTZ '2020-01-02 03:04:05.6' event_ts, "
                   "'play' event_type, 'n' track_name, '' artist_name")
    want = hashlib.md5("\x1f".join(["s", "u", "", "a", "2020-01-02T03:04:05.600000+00:00", "play", "n", ""]).encode()).hexdigest()
    assert df.select(E.stored_event_hash()).first()[0] == want


def test_requests_use_the_first_known_mood():
    assert vibe_labels(" Happy Hour ") == ["happy", "party"] and vibe_labels("study") == ["focus", "chill"]
    assert vibe_keywords("Polka") == ["polka"]


def test_column_inference():
    assert B.infer_event_columns(["UserId", "song-id", "Played At"])["event_ts"] == "Played At"
    assert B.infer_event_columns(["my_user_id", "track"])["user_id"] == "my_user_id"
    assert B.infer_event_columns(["audio_embedding", "c1", "c2"]) | {} == {**dict.fromkeys(B.COLUMN_NAMES), "user_id": "c1", "track_id": "c2"}
    assert B.infer_event_columns(["only"]) is None
    assert B.table_kind("a/b.csv.gz") == "csv" and B.table_kind("x.pq") == "parquet" and B.table_kind("x.bin") is None


def test_separator_is_counted_over_all_lines(spark):
    def sniffed(lines):
        return B.sniff_separator(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sniffed(["a|b|c,", "1|2|3"]) == "|"
    assert sniffed(["a,b;c"] * 80 + ["1;2"]) == ";" and sniffed([]) == ","


def test_file_audit_and_its_gate(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.csv").write_text("user_id,track_id,ts\nu,t,2020-01-01T00:00:00Z\n,t,2020-01-01T00:00:00Z\nu,t,never\n")
    (root / "b.csv").write_text("user_id,track_id,ts\nu,t,\n")
    (root / "c.csv").write_text("user_id,track_id,ts\n")
    (root / "d.exe").write_text("x")
    files = B.input_files(spark, str(root))
    raw = spark.read.option("pathGlobFilter", "*.csv").csv(str(root), header=True)
    audit = B.gated_stage(raw, "s", str(tmp_path / "stage"), "2020-01-01", str(tmp_path / "audit"), files=files).collect()
    got = {r.path[-5:]: (r.rows_written, r.missing_user, r.missing_or_bad_time, r.status) for r in audit}
    assert got == {"a.csv": (1, 1, 1, "ok"), "b.csv": (0, 0, 1, "no_rows"), "c.csv": (0, 0, 0, "no_rows"), "d.exe": (0, 0, 0, "unsupported")}
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 1
    with pytest.raises(B.NoRowsError):
        B.gated_stage(raw.filter("ts IS NULL"), "s", str(tmp_path / "stage2"), "2020-01-01", str(tmp_path / "audit2"))
    assert not (tmp_path / "stage2").exists() and spark.read.parquet(str(tmp_path / "audit2")).count() == 1


def test_search_finds_what_like_finds(spark):
    from earshot.operators.serving import matching_names
    names = ["ring", "small ring", "r ng", "box", "large big box", "100% pure", "a", "", "ab", "naïve song", "back\\slash", "under_score"]
    asked = ["RING", " ring ", "r_ng", "large%box", "%", "", "_", "a", "ab", "zzz", "100\\%", "k\\\\s", "r_s", "ï", "\\q", "i%g", None]
    got = {tuple(r) for r in matching_names(spark.createDataFrame([(q,) for q in asked], "query string"),
                                            spark.createDataFrame([(n,) for n in names], "name string")).collect()}

    def matches(query, name):
        out, i = "", 0
        while i < len(query):
            if query[i] == "\\" and i + 1 < len(query):
                i += 1
                out += re.escape(query[i])
            else:
                out += {"%": ".*", "_": "."}.get(query[i], re.escape(query[i]))
            i += 1
        return re.search(out, name, re.S) is not None
    wanted = {q.strip().lower() for q in asked if q is not None}
    assert got == {(q, n) for q in wanted for n in names if matches(q, n)}


def test_play_log_drops_and_counts_bad_lines(spark):
    from pyspark.sql.observation import Observation
    lines = ["u\t2009-05-04T23:08:57Z\ta\tArt\tt\tSong", "u\t2009-05-04 23:08:57\ta\tArt\tt\tSong", "short\tline", "", "u\t2009-05-04T23:08:57Z\t\tArt\t\t"]
    seen = Observation("play_log")
    out = R.parse_play_log(spark.createDataFrame([(x,) for x in lines], "value string"), "src", seen).collect()
    assert [(r.user_id, r.artist_id, r.track_name) for r in out] == [("u", "a", "Song"), ("u", None, None)]
    assert seen.get == {"rows": 2, "bad_rows": 2}


def test_catalog_headers(spark, tmp_path):
    assert R.flatten_header([["", "track", "Unnamed: 2"], ["track_id", "title", "x"]]) == ["track_id", "track_title", "x"]
    path = tmp_path / "tracks.csv"
    path.write_text(',track,artist,track\ntrack_id,title,name,duration\n7,"Say, ""hi""",nan,12.5\n8,b,c,abc\n')
    got = R.load_catalog_csv(spark, str(path), "cat").collect()
    assert [(r.track_id, r.track_name, r.artist_name, r.duration_sec) for r in got] == [("7", 'Say, "hi"', None, 12.5), ("8", "b", "c", None)]


def test_catalog_with_one_header_and_long_records(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text('track_id,title,artist,duration\n7,"two\nlines",x,1.5\n8,b,c,2\n')
    got = R.load_catalog_csv(spark, str(path), "cat").collect()
    assert [(r.track_id, r.artist_name, r.duration_sec) for r in got] == [("7", "x", 1.5), ("8", "c", 2.0)]
    assert R.header_lines([",track", "track_id,title"]) == 2 and R.header_lines(["id,a", "3,b"]) == 1 and R.header_lines([]) == 0


def test_long_ids_stay_apart(spark):
    long = "x" * 300
    df = spark.createDataFrame([("u", long + "1", "play", None), ("u", long + "2", "play", None)],
                               "user_id string, track_id string, action string, signal_strength double")
    got = [(r.track_id, r.reject_reason) for r in normalise_interactions(df).collect()]
    assert got == [(long + "1", "track_id_too_long"), (long + "2", "track_id_too_long")]


def test_interaction_rules(spark):
    df = spark.createDataFrame(
        [("u", "t", "Thumbs Up", None), ("u", None, "liked", None), ("u", "t", "dance", None), ("u", "t", "dislike", None),
         (" ", "t", "play", None), ("u", None, "search", 0.5), ("u", "t", "play", 101.0)], "user_id string, track_id string, action string, signal_strength double")
    got = [(r.action, r.signal_strength, r.reject_reason) for r in normalise_interactions(df).collect()]
    assert got == [("like", 2.0, None), ("like", 2.0, "track_required"), ("dance", 1.0, "unsupported_action"), ("dislike", -1.5, None),
                   ("play", 1.0, "user_required"), ("search", 0.5, None), ("play", 101.0, "strength_out_of_range")]


def test_registry(tmp_path):
    path = tmp_path / "d.yaml"
    path.write_text("datasets:\n  one:\n    url: http://x/y\n    key: raw/a\n  two:\n    url: z\n")
    known = B.dataset_registry(str(path))
    assert B.dataset(known, "one") == {"url": "http://x/y", "key": "raw/a"}
    with pytest.raises(KeyError):
        B.dataset(known, "three")
