"""Scalar expressions over memory data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Origin prefixes with their recall tier and confidence ceiling; anything else is tier 4.
ORIGIN_RULES = (("cli:", 1, 1.0), ("user:", 1, 1.0), ("code:", 1, 1.0), ("unknown", 1, 0.3), ("hook:", 4, 1.0), ("structured:", 4, 1.0))
#: Prompts that never trigger recall.
TRIVIAL = ("yes", "no", "ok", "sure", "y", "n", "k", "yep", "nope", "yeah")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def strip(text: Column) -> Column:
    """Outer white space of any kind removed, not only spaces."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def workspace_id(path: Column) -> Column:
    return F.concat(F.lit("ws_"), F.substring(F.sha1(path), 1, 12))


def entity_id(name: Column, kind: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lower(name), F.lower(kind)).cast("binary"), 256), 1, 16)


def canonical_key(name: Column, kind: Column) -> Column:
    return F.concat_ws("::", F.lower(name), F.lower(kind))


def body_key(content: Column, n: int = 120) -> Column:
    return F.lower(F.substring(content, 1, n))


def origin_tier(origin: Column) -> Column:
    out = F.lit(4)
    for prefix, tier, _ in sorted(ORIGIN_RULES, key=lambda r: len(r[0])):
        out = F.when(origin.startswith(prefix), F.lit(tier)).otherwise(out)
    return F.when(origin.isNull() | (origin == ""), F.lit(1)).otherwise(out)


def confidence_ceiling(origin: Column) -> Column:
    out = F.lit(1.0)
    for prefix, _, ceiling in ORIGIN_RULES:
        out = F.when(origin.startswith(prefix), F.lit(ceiling)).otherwise(out)
    return F.when(origin.isNull() | (origin == ""), F.lit(0.3)).otherwise(out)


def markers(stale: Column, confidence: Column, below: float = 0.5) -> Column:
    low = F.coalesce(confidence.try_cast("double") < below, F.lit(False))
    return F.concat(F.when(F.coalesce(stale, F.lit(False)), "⚠").otherwise(""), F.when(low, "~").otherwise(""))


def decay(confidence: Column, age: Column, half_life: float) -> Column:
    return confidence * F.pow(F.lit(0.5), age / F.lit(half_life))


def session_key(raw: Column) -> Column:
    """Letters, digits, `-` and `_` only; `unknown` where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[^\p{L}\p{N}_-]", ""), F.lit("")), F.lit("unknown"))


def fresh(at: Column, now: Column, days: int = 7) -> Column:
    """Whole days since an ISO-8601 string at most `days`; fresh where the string says nothing."""
    return F.coalesce(F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(at))) / 86400) <= days, F.lit(True))


def never_recalls(prompt: Column) -> Column:
    """Blank, trivial or command-like prompts."""
    text = strip(prompt)
    trivial = (F.size(F.split(text, r"\s+")) <= 3) & F.lower(text).isin(*TRIVIAL)
    return (text == "") | trivial | text.startswith("/")


def tool_text(name: Column, given: Column, result: Column) -> Column:
    """What an observed tool call reads like; `given` is JSON, empty where nothing was given."""
    return F.concat(F.lit("Tool `"), name, F.lit("` called. Input: "), F.substring(F.coalesce(given, F.lit("")), 1, 200), F.lit(". Result: "), F.substring(F.coalesce(result, F.lit("")), 1, 300))


def error_text(name: Column, error: Column) -> Column:
    return F.concat(F.lit("Error in `"), name, F.lit("`: "), F.substring(error, 1, 500))


def summary_text(turns: Column, observations: Column, last: Column) -> Column:
    return F.concat(F.lit("Session summary (turns="), turns.cast("string"), F.lit(", observations="), observations.cast("string"), F.lit("): "), F.substring(last, 1, 1000))


def pattern_query(folder: Column) -> Column:
    """Search text for a folder's patterns."""
    return F.concat(F.lit("patterns conventions decisions for "), F.element_at(F.split(folder, "/"), -1))


def embed(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for a model: word pairs hashed to signed places, scaled to length one (zeros for no words)."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")
    grams = F.concat(words, F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(words, i), w)))
    places = F.transform(grams, lambda g: F.xxhash64(g))
    summed = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(places, lambda p: F.pmod(p, F.lit(dims)) == d), F.lit(0.0), lambda a, p: a + F.when(F.pmod(F.shiftright(p, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)))
    norm = F.sqrt(F.aggregate(summed, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(summed, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x / norm))
