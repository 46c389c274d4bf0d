"""Classes of requests: status, latency, content type, cache and security results, bot scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latency bands with their upper bounds in milliseconds.
LATENCY_BANDS = [("<=50ms", 50), ("51-100ms", 100), ("101-250ms", 250), ("251-500ms", 500), ("501-1000ms", 1000), ("1001-2500ms", 2500), ("2501-5000ms", 5000), (">5000ms", None)]
#: Security actions of one class each, letters only.
SECURITY_ACTIONS = {
    "blocking": ["block", "connectionclose", "forceconnectionclose"],
    "challenge": ["challenge", "jschallenge", "managedchallenge", "precursorinterstitialpageissued"],
    "challenge-solved-or-bypassed": [
        "challengesolved", "challengebypassed", "jschallengesolved", "jschallengebypassed", "managedchallengenoninteractivesolved", "managedchallengeinteractivesolved", "managedchallengebypassed",
        "precursorinterstitialpagebypassed", "precursorinterstitialpagesolved",
    ],
    "allow-bypass-or-skip": ["allow", "bypass", "skip"],
}
#: Cache results that are told apart; others are Other.
CACHE_RESULTS = ["Hit", "RefreshHit", "Miss", "LimitExceeded", "CapacityExceeded", "Error"]


def status_class(status: Column) -> Column:
    """2xx, 3xx, 4xx, 5xx or other; null counts as other."""
    return F.when(status.between(200, 299), "2xx").when(status.between(300, 399), "3xx").when(status.between(400, 499), "4xx").when(status.between(500, 599), "5xx").otherwise("other")


def latency_band(millis: Column) -> Column:
    """Number of the latency band, from 0; null for null and negative values."""
    out = F.lit(len(LATENCY_BANDS) - 1)
    for k in reversed(range(len(LATENCY_BANDS) - 1)):
        out = F.when(millis <= LATENCY_BANDS[k][1], k).otherwise(out)
    return F.when(millis >= 0, out)


def band_name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n, _ in LATENCY_BANDS]), number)


def duration_ms(text: Column, unit: float = 1.0) -> Column:
    """A plain decimal number times the unit's milliseconds, up to one day; else null."""
    value = F.when(F.trim(text).rlike(r"^(?:\d+\.?\d*|\.\d+)$"), F.trim(text).try_cast("double")) * unit
    return F.when(value <= 86_400_000, value)


def media_type(content_type: Column) -> Column:
    """The media type in lower case without parameters; null unless it is one of up to 127 characters."""
    plain = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.when((F.length(plain) <= 127) & plain.rlike(r"^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+$"), plain)


def cache_result(value: Column) -> Column:
    """A cache result in its usual spelling, Other for unknown ones; null for '-', '' and null."""
    low = F.lower(F.trim(value))
    out = F.lit("Other")
    for name in CACHE_RESULTS:
        out = F.when(low == name.lower(), name).otherwise(out)
    return F.when(~low.isin("", "-"), out)


def security_action(value: Column) -> Column:
    """The class of a firewall action; other for unknown ones, null if it has no letters."""
    low = F.regexp_replace(F.lower(value), "[^a-z]", "")
    out = F.lit("other")
    for name, words in SECURITY_ACTIONS.items():
        out = F.when(low.isin(words), name).otherwise(out)
    return F.when(low != "", out)


def bot_score_group(score: Column) -> Column:
    """not-computed (0), automated (1), likely-automated (2-29), likely-human (30-99); null for other values."""
    return F.when(score == 0, "not-computed").when(score == 1, "automated").when(score.between(2, 29), "likely-automated").when(score.between(30, 99), "likely-human")


def token_pattern(tokens: list[str]) -> str:
    """A pattern that finds catalog tokens as whole words in a lower-case agent, longer tokens before shorter ones."""
    import re

    ordered = sorted({t.lower() for t in tokens}, key=lambda t: (-len(t), t))
    return r"(?<![a-z0-9])(" + "|".join(re.escape(t).replace(r"\-", "-") for t in ordered) + r")(?![a-z0-9])"


def crawler_token(agent: Column, tokens: list[str]) -> Column:
    """The longest catalog token that the agent holds as a whole word, in lower case; null if it holds none."""
    if not tokens:
        return F.lit(None).cast("string")
    found = F.regexp_extract_all(F.lower(agent), F.lit(token_pattern(tokens)), F.lit(1))
    longest = F.array_sort(F.transform(found, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.get(longest, F.lit(0))["t"]
