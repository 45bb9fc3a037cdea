"""Column functions: scores, bands and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fraudlens import constants as C


def risk_label(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0))
    return F.when(s >= C.RISK_LABEL_HIGH, "High Risk").when(s >= C.RISK_LABEL_SUSPICIOUS, "Suspicious").otherwise("Safe")


def risk_level(score: Column) -> Column:
    return F.when(score < C.LEVEL_LOW_BELOW, "LOW").when(score <= C.LEVEL_HIGH_ABOVE, "MEDIUM").otherwise("HIGH")


def score_to_int(score: Column) -> Column:
    """0 to 100; a score of 1 or less is a fraction; what is no number is 0."""
    s = F.coalesce(score.try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.when(s <= 1, s * 100).otherwise(s)).cast("int")))


def reputation(trust: Column) -> Column:
    return F.when(trust < C.REPUTATION_SUSPICIOUS_FROM, "UNKNOWN").when(trust <= C.REPUTATION_CONFIRMED_ABOVE, "SUSPICIOUS").otherwise("CONFIRMED_SCAM")


def propagation_score(forwarded: Column, seen: Column, channels: Column, length: Column) -> Column:
    part = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(0.0))
    total = part(forwarded, 0.30) + part(seen >= C.SEEN_OFTEN, 0.20) + part(seen >= C.SEEN_VERY_OFTEN, 0.20) + part(channels >= C.CHANNELS_MANY, 0.15) + part(length < C.SHORT_TEXT_BELOW, 0.15)
    return F.round(F.least(F.lit(1.0), total), 2)


def propagation_signals(forwarded: Column, seen: Column, channels: Column, length: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(forwarded, "whatsapp_forwarded_many_times"),
            F.when(seen >= C.SEEN_OFTEN, "seen_in_3_or_more_messages"),
            F.when(seen >= C.SEEN_VERY_OFTEN, "high_repeat_volume"),
            F.when(channels >= C.CHANNELS_MANY, "cross_channel_spread"),
            F.when(length < C.SHORT_TEXT_BELOW, "short_broadcast_style_message"),
        )
    )


def cluster_risk(phones: Column, upis: Column, size: Column) -> Column:
    part = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), F.lit(0.35) + part(phones >= 2, 0.2) + part(phones >= 3, 0.15) + part(upis >= 1, 0.15) + part(size >= 6, 0.1)), 2)


def verdict_of(value: Column) -> Column:
    v = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    out = F.when(v.isin(*C.VERDICT_SCORES), v)
    for word, verdict in C.VERDICT_SYNONYMS.items():
        out = out.when(v == word, verdict)
    return out.otherwise("SUSPICIOUS")


def verdict_score(verdict: Column) -> Column:
    out = F.lit(C.DEFAULT_SCORE)
    for name, score in C.VERDICT_SCORES.items():
        out = F.when(verdict == name, F.lit(score)).otherwise(out)
    return out


def confidence_of(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(value.try_cast("double").try_cast("bigint"), F.lit(C.DEFAULT_CONFIDENCE)))).cast("int")


def score_percent(score: Column) -> Column:
    return score_to_int(score)


def reply_band(percent: Column) -> Column:
    return F.when(percent >= C.REPLY_DANGER, "DANGER").when(percent >= C.REPLY_SUSPICIOUS, "SUSPICIOUS").otherwise("LOW RISK")


def headline(level: Column, percent: Column) -> Column:
    return (
        F.when((level == "HIGH") | (percent > C.HEADLINE_HIGH_ABOVE), "KHATRA!").when((level == "MEDIUM") | (percent >= C.HEADLINE_MEDIUM), "SAAVDHAN!").otherwise("SURAKSHIT")
    )


def quality_label(width: Column, height: Column) -> Column:
    area = width.cast("long") * height
    return F.when(area >= 1_000_000, "good").when(area >= 200_000, "low").otherwise("very_low")


def heat_colour(intensity: Column) -> Column:
    return F.when(intensity > 0.7, "#ef4444").when(intensity > 0.4, "#f59e0b").otherwise("#3b82f6")
