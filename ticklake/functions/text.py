"""Column expressions over headlines and payloads."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: word lists, weights and patterns
POSITIVE = (
    "beat", "beats", "surge", "surges", "rally", "gain", "gains", "up", "record", "growth", "strong", "optimism", "soar", "soars", "improve",
    "improves", "bullish", "expand", "expands",
)
NEGATIVE = (
    "fall", "falls", "drop", "drops", "down", "slump", "loss", "losses", "warning", "weak", "decline", "declines", "plunge", "plunges", "miss",
    "misses", "bearish", "shrink", "shrinks",
)
POSITIVE_PARTS = ("beat", "beats", "surge", "rally", "gain", "up")
NEGATIVE_PARTS = ("fall", "drops", "miss", "down", "loss", "warning")
IMPORTANCE_NAMES = {"high": "red", "medium": "orange", "low": "yellow"}
IMPORTANCE_WEIGHTS = {"red": 1.0, "high": 1.0, "orange": 0.7, "medium": 0.6, "yellow": 0.4, "low": 0.3}
STRUCTURAL = (
    "merger", "acquisition", "buyback", "dividend", "split", "spinoff", "spin-off", "guidance", "outlook", "forecast", "long-term", "multi-year",
    "contract", "partnership", "expansion", "investment", "regulation", "approval", "sanction", "tariff", "ban", "lawsuit", "investigation",
    "antitrust", "settlement", "bankruptcy", "restructuring", "stimulus",
)
MEDIUM_TERM = (
    "earnings", "results", "quarter", "guidance", "target", "downgrade", "upgrade", "rating", "estimate", "outlook", "forecast", "revenue", "sales",
    "production", "supply", "demand", "margin", "profit", "loss", "ipo", "backlog", "pipeline",
)
SHORT_LIVED = (
    "preview", "recap", "brief", "tweet", "rumor", "rumour", "commentary", "opinion", "note", "watch", "blog", "snippet", "update", "headline",
)
STOP_WORDS = (
    "the", "and", "for", "that", "with", "from", "this", "have", "will", "into", "their", "after", "over", "amid", "amidst", "company", "companies",
    "month", "year", "years", "today", "week", "ahead", "firm", "firms",
)
TOPICS = {
    "earnings": (
        "earnings", "profit", "profits", "forecast", "forecasts", "beats", "beat", "eps", "revenue",
    ),
    "markets": (
        "stocks", "shares", "surge", "rally", "selloff", "markets", "equities", "index", "indexes", "futures",
    ),
    "economy": (
        "inflation", "gdp", "growth", "employment", "jobs", "economy", "output", "recession",
    ),
    "policy": (
        "fed", "federal", "bank", "rates", "policy", "interest", "reserve", "hike", "cut",
    ),
    "crypto": (
        "bitcoin", "crypto", "ethereum", "blockchain", "token",
    ),
}
STRIPPED = ".,!?;:'()[]{}<>\n\r"
QUOTE_SUFFIXES = ("USD", "USDT", "USDC", "PERP")


def _list(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def words(text: Column) -> Column:
    """Whitespace-separated words, no empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def headline_sentiment(text: Column) -> Column:
    """X13 (positive - negative) / (positive + negative) over stripped lower-case words."""
    toks = F.transform(words(text), lambda w: F.lower(F.btrim(w, F.lit(STRIPPED))))
    pos = F.size(F.filter(toks, lambda w: w.isin(*POSITIVE)))
    neg = F.size(F.filter(toks, lambda w: w.isin(*NEGATIVE)))
    return F.coalesce((pos - neg) / F.nullif(pos + neg, F.lit(0)), F.lit(0.0))


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """True where any of the parts occurs in the lower-cased text."""
    import re

    return F.coalesce(F.lower(text).rlike("|".join(re.escape(p) for p in parts)), F.lit(False))


def flag_sentiment(text: Column) -> Column:
    """X14 one for a positive part minus one for a negative part."""
    return contains_any(text, POSITIVE_PARTS).cast("double") - contains_any(text, NEGATIVE_PARTS).cast("double")


def importance_name(x: Column) -> Column:
    """X15 colour name of an importance."""
    v = F.lower(F.trim(x))
    out = v
    for k, name in IMPORTANCE_NAMES.items():
        out = F.when(v == k, name).otherwise(out)
    return F.when(x == "", x).otherwise(out)


def importance_weight(x: Column) -> Column:
    """X15 weight of an importance given as a name or a number."""
    v = F.lower(F.trim(x))
    out = F.lit(0.5)
    for k, w in IMPORTANCE_WEIGHTS.items():
        out = F.when(v == k, w).otherwise(out)
    return out


def effect_length(text: Column, magnitude: Column, importance: Column | None = None, risk: float | Column = 1.0) -> dict[str, Column]:
    """X16 how long a headline moves prices: minutes, half-life, score, importance.  The numbers are fixed values."""
    mag = F.coalesce(clamp(F.abs(magnitude), 0.0, 1.0), F.lit(0.0))
    long_, medium, short = (contains_any(text, w) for w in (STRUCTURAL, MEDIUM_TERM, SHORT_LIVED))
    pick = lambda a, b, d: F.when(long_, a).otherwise(0.0) + F.when(medium, b).otherwise(0.0) - F.when(short, d).otherwise(0.0)
    hint = clamp(0.3 + pick(0.4, 0.2, 0.2), 0.05, 1.0)
    bias = clamp(pick(0.6, 0.25, 0.35), -0.6, 1.0)
    used = hint if importance is None else F.greatest(clamp(F.coalesce(importance, F.lit(0.0)), 0.0, 1.0), hint)
    r = clamp(risk if isinstance(risk, Column) else F.lit(float(risk)), 0.3, 1.7)
    minutes = (45 + 110 * used + 180 * mag) * clamp(1 + 0.35 * bias, 0.6, 1.8) * clamp(0.85 + 0.3 * r, 0.7, 1.4)
    minutes = clamp(minutes, 15.0, 720.0)
    half = clamp(minutes * (0.35 + 0.45 * used + 0.2 * mag), 10.0, 720.0)
    return {
        "effect_minutes": minutes,
        "effect_half_life": half,
        "length_score": F.tanh(minutes / 180),
        "importance_score": used,
    }


def severity(sentiment: Column, length_score: Column, importance: Column, risk: float = 1.0) -> Column:
    """X17 size of the sentiment weighted by persistence and importance."""
    return clamp(F.abs(sentiment) * (0.55 + 0.25 * length_score + 0.2 * importance) * risk, 0.0, 1.0)


def word_count(text: Column) -> Column:
    """X17 number of words."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("double")


LETTERS = "[A-Za-z]{3,}"


def tokens(text: Column) -> Column:
    """X18 runs of three or more letters in lower case without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({LETTERS})"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def topics(text: Column) -> Column:
    """X18 topics one of whose words occurs."""
    toks = tokens(text)
    hits = F.array(*[F.when(F.arrays_overlap(toks, _list(ws)), F.lit(t)) for t, ws in TOPICS.items()])
    return F.filter(hits, lambda t: t.isNotNull())


def summary(text: Column, max_length: int = 120) -> Column:
    """X19 first sentence, shortened with an ellipsis."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    first = F.split(clean, r"(?<=[.!?])\s+")[0]
    cut = F.concat(F.rtrim(F.substring(first, 1, max_length - 1)), F.lit("…"))
    return F.when(clean == "", None).otherwise(F.when(F.length(first) > max_length, cut).otherwise(first))


def symbol_variants(symbol: Column) -> Column:
    """X20 spellings of a symbol: separators dropped, quote currency dropped."""
    s = F.upper(symbol)
    forms = [s, F.replace(s, F.lit("/"), F.lit("")), F.replace(s, F.lit("-"), F.lit(""))]
    for x in QUOTE_SUFFIXES:
        forms.append(F.when(F.endswith(s, F.lit(x)) & (F.length(s) > len(x)), F.substring(s, F.lit(1), F.length(s) - len(x))))
    return F.array_distinct(F.filter(F.array(*forms), lambda v: v.isNotNull() & (v != "")))


def records_at(payload: Column, path: str, item_schema: str) -> Column:
    """X22 array of records under a path of a JSON text (``a.b``, ``[1]``, or empty for the whole); a lone record is a list of one."""
    node = payload if not path else F.get_json_object(payload, "$" + (path if path.startswith("[") else "." + path))
    node = F.when(F.ltrim(node).startswith("{"), F.concat(F.lit("["), node, F.lit("]"))).otherwise(node)
    return F.from_json(node, f"array<{item_schema}>")


def observation_map(payload: Column, path: str) -> Column:
    """X22 observations keyed by index (``{"0": [value, ...]}``) as a map of number lists."""
    return F.from_json(F.get_json_object(payload, "$." + path), "map<string, array<double>>")


def word_slot(word: Column, dim: int = 32) -> Column:
    """Slot of a word: its MD5 modulo ``dim`` (a power of two up to 256)."""
    return (F.conv(F.substring(F.md5(F.lower(word)), 31, 2), 16, 10).cast("int") % dim).cast("int")
