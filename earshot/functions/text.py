"""Metadata text cleaning as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Null-like words, contraction suffixes, and the broken byte sequences with
# their repairs. They decide which rows change, so they must stay as they are.
NULL_WORDS = ("nan", "none", "null")
CONTRACTIONS = ("s", "re", "ve", "ll", "d", "t", "m")
BROKEN_SEQUENCES = {
    "â€™": "’",
    "â€˜": "‘",
    "â€œ": "“",
    "â€\x9d": "”",
    "â€“": "–",
    "â€”": "—",
    "â€¦": "…",
    "â€¢": "•",
}
BROKEN_MARKS = ("Ã", "Â", *BROKEN_SEQUENCES, "�")
UNKNOWN_ARTIST = "__unknown_artist__"
UNKNOWN_TRACK = "__unknown_track__"
UNKNOWN = "__unknown__"

_MARKS = "|".join(re.escape(m) for m in BROKEN_MARKS)
# What counts as space at the ends of a text.
_SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                   0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# The printable characters that Windows-1252 puts at bytes 0x80-0x9f.
_CP1252 = {bytes([b]).decode("cp1252"): chr(b) for b in range(0x80, 0xA0)
           if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.transform(F.array(value), body).getItem(0)


def _ends_plain(text: str) -> str:
    """SQL test, by two comparisons, that a text starts and ends with an ASCII character that is no space."""
    return f"({text} >= '!' AND {text} < {_quoted(chr(0x80))} AND right({text}, 1) >= '!' AND right({text}, 1) < {_quoted(chr(0x80))})"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(_SPACES))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _quoted(text: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" if ord(c) > 126 or c in "\\'" or ord(c) < 32 else c for c in text) + "'"


def _bound(value: str, name: str, body: str) -> str:
    """SQL that evaluates `value` once and uses it as `name` in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _badness(text: str) -> str:
    return f"(regexp_count({text}, {_quoted(_MARKS)}) + regexp_count({text}, {_quoted('�')}))"


def _better(best: str, candidate: str) -> str:
    return f"if({candidate} IS NOT NULL AND {_badness(candidate)} < {_badness(best)}, {candidate}, {best})"


def _latin1_as_utf8(text: str) -> str:
    """Bytes of a latin-1 string read as UTF-8; null when either step is impossible."""
    return (f"try_validate_utf8(CAST(encode(CASE WHEN {text} RLIKE {_quoted('^[')}||{_quoted(chr(0x01))}||'-'||{_quoted(chr(0xff))}||']*$' "
            f"THEN {text} END, 'ISO-8859-1') AS STRING))")


def _cp1252_as_utf8(text: str) -> str:
    allowed = "^[" + "\x01-\x7f" + "\xa0-\xff" + "".join(_CP1252) + "]*$"
    as_bytes = f"translate({text}, {_quoted(''.join(_CP1252))}, {_quoted(''.join(_CP1252.values()))})"
    return _latin1_as_utf8(f"CASE WHEN {text} RLIKE {_quoted(allowed)} THEN {as_bytes} END")


def _redecode(text: str) -> str:
    inner = _bound(_latin1_as_utf8("t"), "l", _bound(_better("t", "l"), "b", _bound(
        _cp1252_as_utf8("t"), "c", _better("b", "c"))))
    return _bound(text, "t", f"CASE WHEN t RLIKE {_quoted(_MARKS)} THEN {inner} ELSE t END")


def _repair_sql(text: str) -> str:
    fixed = text
    for broken, right in BROKEN_SEQUENCES.items():
        fixed = f"replace({fixed}, {_quoted(broken)}, {_quoted(right)})"
    fixed = f"replace(replace({fixed}, {_quoted('Â ')}, ' '), {_quoted('Â')}, '')"
    return f"CASE WHEN {text} RLIKE {_quoted(_MARKS)} THEN {_redecode(_redecode(fixed))} ELSE {text} END"


def _sql_function(col: Column | str, body) -> Column:
    """Apply SQL text to a column. A column name is put into the text as it is; any other
    column is evaluated once and bound to a variable.

    The text is parsed in one go. Building the same expression from some 150 column calls per
    use takes longer than a small query runs.
    """
    if isinstance(col, str):
        return F.expr(body(".".join(f"`{part}`" for part in col.split("."))))
    return F.call_function("transform", F.array(col), F.expr(f"s -> {body('s')}")).getItem(0)


def repair_mojibake(col: Column | str) -> Column:
    """Undo UTF-8 text that was read as latin-1 or Windows-1252, up to two layers deep."""
    return _sql_function(col, _repair_sql)


def _clean_sql(repair: bool, trimmed: bool = False):
    already_trimmed = trimmed

    def body(text: str) -> str:
        spaces = _quoted(_SPACES)
        trimmed = text if already_trimmed else f"btrim(CAST({text} AS STRING), {spaces})"
        # Null-like words have few letters, and only texts that aren't ASCII can be broken.
        wide = f"octet_length({trimmed}) <> char_length({trimmed})"
        words = ", ".join(f"'{w}'" for w in NULL_WORDS)
        lengths = ", ".join(str(n) for n in sorted({len(w) for w in NULL_WORDS}))
        # Nearly all text is intact, so the repair sits behind a few substring tests.
        broken = " OR ".join(f"contains({trimmed}, {_quoted(m)})" for m in ("Ã", "Â", "â€", "�"))
        repaired = _bound(_bound(trimmed, "w", f"btrim({_repair_sql('w')}, {spaces})"), "r", "nullif(r, '')")
        return (f"CASE WHEN {trimmed} = '' OR (char_length({trimmed}) IN ({lengths}) AND lower({trimmed}) IN ({words})) THEN NULL "
                + (f"WHEN {wide} AND ({broken}) THEN {repaired} " if repair else "") + f"ELSE {trimmed} END")
    return body


def clean_text(col: Column | str, repair: bool = True) -> Column:
    """Trim; blank and null-like words become null; broken encodings are repaired."""
    return _sql_function(col, _clean_sql(repair))


def contraction_case(col: Column) -> Column:
    """You'Re -> You're, for the known suffixes only."""
    fixed = col
    for suffix in CONTRACTIONS:
        fixed = F.regexp_replace(fixed, rf"(?U)\b([A-Za-z]+)'(?i:{suffix})\b", f"$1'{suffix}")
    return F.when(col.contains("'"), fixed).otherwise(col)


def display_text(col: Column) -> Column:
    return contraction_case(clean_text(col))


def with_clean_text(df: DataFrame, columns: dict[str, Column], repair: bool = True) -> DataFrame:
    """Add or replace cleaned columns. Trimming is a projection of its own, so that the generated
    code for the tests on the trimmed text stays small enough to be compiled."""
    texts = df.withColumns({name: col.cast("string") for name, col in columns.items()})
    trimmed = texts.withColumns({name: F.when(F.expr(_ends_plain(f"`{name}`")), F.col(name)).otherwise(strip(F.col(name))) for name in columns})
    return trimmed.withColumns({name: F.expr(_clean_sql(repair, trimmed=True)(f"`{name}`")) for name in columns})


def clean_text_columns(df: DataFrame, columns: list[str], repair: bool = True) -> DataFrame:
    return with_clean_text(df, {c: F.col(c) for c in columns}, repair)


def clean_display_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Display form of each column; a value that cleans to nothing keeps its old text."""
    return df.withColumns({c: F.coalesce(display_text(F.col(c)), F.col(c)) for c in columns})


def readable(track_name: Column, artist_name: Column, track_id: Column) -> Column:
    """A track a person can recognise: a real name, not digits or its own id, and a known artist."""
    name = strip(F.coalesce(track_name, F.lit("")))
    artist = F.lower(strip(F.coalesce(artist_name, F.lit(""))))
    ident = strip(F.coalesce(track_id, F.lit("")))
    return ((name != "") & ~name.rlike(r"^\p{Nd}+$") & ~artist.isin("", UNKNOWN_ARTIST)
            & ((ident == "") | (name != ident)))


def name_key(col: Column) -> Column:
    """Lower-case letters, digits and single spaces only; '' when nothing is left."""
    lowered = F.lower(F.coalesce(clean_text(col), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9 ]+", " "), r"\s+", " "))


def track_key(track_id: Column, track_name: Column, artist_name: Column) -> Column:
    """Identity of a served item: its id, else name::artist."""
    def norm(c: Column) -> Column:
        return F.lower(strip(F.coalesce(c, F.lit(""))))
    ident = norm(track_id)
    named = F.concat(norm(track_name), F.lit("::"), norm(artist_name))
    return F.when(ident != "", ident).otherwise(named)
