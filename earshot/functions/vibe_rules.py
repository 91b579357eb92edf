"""Keyword rules that give a track its mood label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.text import let

# Label keywords, their order of precedence, and the request tables.
VIBE_RULES = {
    "chill": ["chill", "ambient", "downtempo", "trip-hop", "lofi", "lounge", "new age"],
    "focus": ["instrumental", "classical", "minimal", "soundtrack", "piano", "jazz"],
    "energetic": ["rock", "metal", "punk", "edm", "electro", "techno", "drum"],
    "party": ["dance", "house", "club", "hip-hop", "rap", "disco", "reggaeton"],
    "happy": ["pop", "funk", "soul", "indie pop"],
    "sad": ["blues", "acoustic", "emo", "sadcore", "singer-songwriter"],
    "romantic": ["rnb", "soul", "love", "ballad", "smooth jazz"],
}
VIBES = tuple(VIBE_RULES)
REQUEST_KEYWORDS = {
    "chill": ["chill", "ambient", "downtempo", "lofi", "trip-hop"],
    "focus": ["instrumental", "classical", "ambient", "minimal"],
    "happy": ["pop", "dance", "funk", "disco"],
    "sad": ["sad", "melancholy", "heartbreak", "breakup", "blues", "ballad", "emo"],
    "party": ["dance", "electronic", "house", "hip-hop"],
    "energetic": ["rock", "edm", "electronic", "metal", "drum"],
    "romantic": ["soul", "rnb", "jazz", "love"],
}
REQUEST_LABELS = {
    "chill": ["chill"],
    "focus": ["focus", "chill"],
    "happy": ["happy", "party"],
    "sad": ["sad", "romantic"],
    "party": ["party", "energetic"],
    "energetic": ["energetic", "party"],
    "romantic": ["romantic", "chill"],
    "study": ["focus", "chill"],
    "calm": ["chill"],
}


def _requested(vibe: str, table: dict[str, list[str]]) -> list[str]:
    base = vibe.strip().lower()
    return next((values for key, values in table.items() if key in base), [base])


def vibe_keywords(vibe: str) -> list[str]:
    """Keywords of a requested mood: those of the first known mood its text contains."""
    return _requested(vibe, REQUEST_KEYWORDS)


def vibe_labels(vibe: str) -> list[str]:
    return _requested(vibe, REQUEST_LABELS)


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def best_vibe(text: Column) -> Column:
    """Struct (hits, precedence, vibe, keywords) of the label with most keyword hits; null if none."""
    def labels(lowered: Column) -> Column:
        options = [
            F.struct(F.size(hit).alias("hits"), F.lit(-place).alias("precedence"), F.lit(vibe).alias("vibe"),
                     hit.alias("keywords"))
            for place, (vibe, words) in enumerate(VIBE_RULES.items())
            for hit in [F.filter(strings(words), lambda w: F.contains(lowered, w))]]
        return F.array_max(F.filter(F.array(*options), lambda o: o.hits > 0))
    return let(F.lower(text), labels)


def confidence(hits: Column, plays: Column, listeners: Column, source: Column) -> Column:
    """Rule strength plus small bonuses for plays and listeners, at most 0.95; 0.15 without a rule."""
    base = F.when(source == "genre_rule", 0.45).otherwise(0.32)
    score = (base + F.least(hits * F.lit(0.12), F.lit(0.30))
             + F.when(plays >= 50, 0.08).when(plays >= 10, 0.04).otherwise(0.0)
             + F.when(listeners >= 20, 0.08).when(listeners >= 5, 0.04).otherwise(0.0))
    return F.round(F.when(hits > 0, F.least(score, F.lit(0.95))).otherwise(0.15), 3).cast("decimal(4,3)")
