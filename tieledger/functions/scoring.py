"""Scores of signals, decay, edge weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of a signal type, boost of a channel, type of a channel.
SIGNALS = {"calendar_small": 1.5, "calendar_large": 0.8, "whatsapp_dm": 1.2, "whatsapp_group": 0.3, "email_personal": 1.0, "email_cc": 0.5, "slack_dm": 1.0, "slack_channel": 0.2, "linear": 0.4}
BOOSTS = {"calendar": 1.3, "meeting": 1.3, "whatsapp": 1.1, "email": 1.0, "slack": 1.0, "linear": 0.8}
CHANNELS = {
    "meeting": "calendar_small", "calendar": "calendar_small", "whatsapp_dm": "whatsapp_dm", "telegram": "whatsapp_dm", "imessage": "whatsapp_dm",
    "whatsapp": "whatsapp_group", "whatsapp_group": "whatsapp_group", "email_personal": "email_personal", "email": "email_cc", "email_cc": "email_cc",
    "slack_dm": "slack_dm", "slack": "slack_channel", "slack_channel": "slack_channel", "linear": "linear",
}


def _lookup(values: dict, key: Column, default) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a fraction."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def channel_to_signal(channel: Column) -> Column:
    return _lookup(CHANNELS, channel, "email_cc")


def signal_score(kind: Column, channel: Column, days: Column, reciprocal: Column) -> Column:
    raw = _lookup(SIGNALS, kind, 0.5) * _lookup(BOOSTS, channel, 1.0) * F.exp(-days / 90)
    return F.round(F.least(raw * F.when(reciprocal, 1.2).otherwise(1.0), F.lit(2.0)), 3)


def decay(score: Column, days: Column) -> Column:
    return F.when((score <= 1.0) | (days <= 7), score).otherwise(F.round(F.greatest(score * F.pow(F.lit(0.98), days - 7), F.lit(0.5)), 2))


def normalize_score(raw: Column, most: float = 20.0) -> Column:
    return F.when(raw <= 0, 0.0).otherwise(F.round(F.least(F.log1p(raw) / F.log1p(F.lit(float(most))) * 10, F.lit(10.0)), 2))


def knows_strength(evidence: Column, multi: Column) -> Column:
    return F.least(F.least(evidence * 0.15, F.lit(0.7)) + F.when(multi, 0.2).otherwise(0.0), F.lit(1.0))


def issue_weight(state: Column, assignee: Column, comments: Column) -> Column:
    low = F.lower(F.coalesce(state, F.lit("")))
    base = F.when(low.isin("done", "completed", "cancelled", "canceled"), 0.5).otherwise(1.0) * F.when(low.isin("backlog", "triage"), 0.3).otherwise(1.0)
    return F.when(F.coalesce(assignee, F.lit("")) == "", 0.0).otherwise(base + F.least(F.coalesce(comments, F.lit(0)) * 0.2, F.lit(1.0)))


def meeting_signal(others: Column) -> Column:
    return F.when(others <= 2, "calendar_small").otherwise("calendar_large")


def edge_weight(count: Column, last_at: Column, as_of: Column) -> Column:
    """``ln(1 + count) * exp(-days / 180)``; times to come and unknown times count as now."""
    days = F.greatest(F.lit(0.0), F.coalesce(days_between(as_of, last_at), F.lit(0.0)))
    return F.when(F.coalesce(count, F.lit(0)) <= 0, 0.0).otherwise(F.log1p(count.cast("double")) * F.exp(-days / 180))


def score_persons(interactions: DataFrame, knows: DataFrame, as_of) -> DataFrame:
    """interactions (user_id, person_id, channel, occurred_at, reciprocal), knows (user_id, person_id, strength) -> score."""
    when = F.lit(as_of).cast("timestamp")
    days = F.greatest(F.lit(0.0), days_between(when, F.col("occurred_at")))
    one = signal_score(channel_to_signal(F.col("channel")), F.col("channel"), days, F.col("reciprocal"))
    parts = interactions.select("user_id", "person_id", one.alias("worth")).unionByName(knows.select("user_id", "person_id", F.col("strength").alias("worth")))
    return parts.groupBy("user_id", "person_id").agg(F.sum("worth").alias("raw")).withColumn("score", normalize_score(F.col("raw")))
