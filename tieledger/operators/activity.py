"""Pages, recent activity, meetings and message context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieledger.functions import normalize as N
from tieledger.operators.cards import PERSON, person_observations
from tieledger.operators.numbering import numbered


def _limit(n: int, most: int) -> int:
    return max(1, min(most, n))


def observations_page(obs: DataFrame, since=None, kind: str | None = None, cursor: tuple | None = None, limit: int = 100) -> DataFrame:
    """Newest first; the cursor is the (observed_at, id) of the last row of the page before."""
    rows = obs.where(F.col("observed_at") >= F.lit(since).cast("timestamp")) if since is not None else obs
    rows = rows.where(F.col("kind") == kind) if kind else rows
    if cursor:
        rows = rows.where(F.struct("observed_at", "id") < F.struct(F.lit(cursor[0]).cast("timestamp").alias("observed_at"), F.lit(cursor[1]).alias("id")))
    return rows.orderBy(F.desc("observed_at"), F.desc("id")).limit(_limit(limit, 1000))


def raw_events_page(raw: DataFrame, source: str | None = None, cursor: tuple | None = None, limit: int = 100) -> DataFrame:
    rows = raw.where(F.col("source") == source) if source else raw
    if cursor:
        rows = rows.where(F.struct("occurred_at", "id") > F.struct(F.lit(cursor[0]).cast("timestamp").alias("occurred_at"), F.lit(cursor[1]).alias("id")))
    return rows.orderBy("occurred_at", "id").limit(_limit(limit, 1000))


def persons_page(persons: DataFrame, cursor: str | None = None, limit: int = 500) -> DataFrame:
    rows = persons.where(F.col("id") > cursor) if cursor else persons
    return rows.orderBy("id").limit(_limit(limit, 2000))


def persons_active_since(obs: DataFrame, links: DataFrame, snaps: DataFrame, since, needs_enrichment: bool, as_of) -> DataFrame:
    """Persons with observations or snapshots since then; without those whose summary is under 7 days old, if asked for."""
    start, when = F.lit(since).cast("timestamp"), F.lit(as_of).cast("timestamp")
    seen = person_observations(obs.where(F.col("observed_at") >= start), links).groupBy(*PERSON).agg(F.max("observed_at").alias("a"), F.count("*").alias("na"))
    passed = snaps.where(F.col("pass_at") >= start).groupBy(*PERSON).agg(F.max("pass_at").alias("b"), F.count("*").alias("nb"))
    both = seen.join(passed, PERSON, "full_outer")
    out = both.select(*PERSON, F.greatest("a", "b").alias("last_activity_at"), (F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0))).alias("activity_count"))
    if needs_enrichment:
        fresh = snaps.where((F.col("pass_kind") == "summary") & (F.col("pass_at") > when - F.expr("INTERVAL 7 DAYS")))
        out = out.join(fresh.select(*PERSON), PERSON, "left_anti")
    return out.orderBy(F.desc("last_activity_at"), "person_id")


def stale_persons(persons: DataFrame, obs: DataFrame, links: DataFrame, as_of, days: int = 14, most: int = 500) -> DataFrame:
    """Persons without a person observation in the last days, at most ``most`` per tenant."""
    newest = person_observations(obs.where("kind = 'person'"), links).groupBy(*PERSON).agg(F.max("observed_at").alias("newest"))
    rows = persons.select("user_id", F.col("id").alias("person_id")).join(newest, PERSON, "left")
    old = rows.where(F.col("newest").isNull() | (F.col("newest") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.asc_nulls_first("newest"), "person_id"))
    return old.withColumn("rank", rank).where(F.col("rank") <= most)


def tick_tenants(raw: DataFrame, watermarks: DataFrame, as_of) -> DataFrame:
    """Tenants whose newest row came in after their watermark, with the new watermark."""
    newest = raw.groupBy("user_id").agg(F.max("ingested_at").alias("newest"))
    due = newest.join(watermarks, "user_id", "left").where("last_tick_at IS NULL OR newest > last_tick_at")
    return due.select("user_id", "newest", F.lit(as_of).cast("timestamp").alias("last_tick_at"))


def upcoming_meetings(meetings: DataFrame, horizon_hours: int, as_of) -> DataFrame:
    hours, when = _limit(horizon_hours, 720), F.lit(as_of).cast("timestamp")
    return meetings.where((F.col("start_at") >= when) & (F.col("start_at") < when + F.expr(f"INTERVAL {hours} HOURS"))).orderBy("start_at", "meeting_id")


def eligible_meetings(events: DataFrame, self_emails: list[str]) -> DataFrame:
    """Not cancelled, out of office or all day, and with somebody else; attendees without self, rooms and bots."""
    def other(email: Column) -> Column:
        low = F.lower(email)
        return ~low.isin(*[e.lower() for e in self_emails]) & ~low.contains("resource.calendar") & ~N.is_bot_email(low)

    kept = events.withColumn("attendees", F.filter("attendees", lambda a: F.coalesce(other(a["email"]), F.lit(False))))
    off = F.coalesce(F.lower("status") == "cancelled", F.lit(False)) | F.coalesce(F.col("event_type") == "outOfOffice", F.lit(False)) | F.coalesce("all_day", F.lit(False))
    return kept.where(~off & (F.size("attendees") > 0))


def meeting_context(meetings: DataFrame, cards: DataFrame, as_of) -> DataFrame:
    """Meetings not briefed in the last 24 hours; each attendee with the person of its address, if there is one."""
    due = meetings.where(F.col("generated_at").isNull() | (F.coalesce("brief_md", F.lit("")) == "") | (F.col("generated_at") < F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 24 HOURS")))
    own = cards.select("user_id", F.explode("emails").alias("email"), "person_id", F.col("name").alias("card_name")).withColumn("email", F.lower("email"))
    own = own.groupBy("user_id", "email").agg(F.min(F.struct("person_id", "card_name")).alias("card"))
    rows = due.select("user_id", "meeting_id", "start_at", F.explode("attendees").alias("a")).withColumn("email", F.lower("a.email")).join(own, ["user_id", "email"], "left")
    who = F.struct("email", F.coalesce("card.card_name", "a.name").alias("name"), "card.person_id")
    return rows.groupBy("user_id", "meeting_id", "start_at").agg(F.array_sort(F.collect_list(who)).alias("attendees"))


def person_messages(cards: DataFrame, messages: DataFrame, lid_map: DataFrame, since=None, limit: int = 30) -> DataFrame:
    """messages (chat_jid, sender_jid, ts, text): direct ones by phone, group ones by device id or phone; newest ``limit`` each."""
    phones = cards.select("user_id", "person_id", F.explode("phones").alias("p")).withColumn("digits", F.regexp_replace("p", "[^0-9]", ""))
    by_phone = phones.select("user_id", "person_id", F.concat("digits", F.lit("@s.whatsapp.net")).alias("jid"))
    by_lid = phones.join(lid_map.select(F.col("pn").alias("digits"), "lid"), "digits").select("user_id", "person_id", F.concat("lid", F.lit("@lid")).alias("jid"))
    key = F.when(F.col("chat_jid").endswith("@g.us"), F.regexp_replace("sender_jid", r":\d+@", "@")).otherwise(F.col("chat_jid"))
    rows = messages.where(F.col("ts") >= since) if since is not None else messages
    jids = by_phone.unionByName(by_lid).distinct()
    hits = rows.withColumns({"jid": key, "head": F.substring("text", 1, 40)}).join(jids, "jid").dropDuplicates(["user_id", "person_id", "ts", "head"])
    rank = F.row_number().over(Window.partitionBy(*PERSON).orderBy(F.desc("ts"), "text"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit).drop("head")


def sender_names(messages: DataFrame, k: int = 3) -> DataFrame:
    """Names that a jid has gone by, by count, then newest."""
    counted = messages.where("trim(coalesce(sender_name, '')) <> ''").groupBy("sender_jid", F.trim("sender_name").alias("name")).agg(F.count("*").alias("n"), F.max("ts").alias("newest"))
    rank = F.row_number().over(Window.partitionBy("sender_jid").orderBy(F.desc("n"), F.desc("newest"), "name"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def backfill_emails(pairs: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (phone, email) of an address book: candidates where the phone is one person's, and counts by reason."""
    phone, email = N.canon_phone_nanp(F.col("phone")), N.canonicalize_email(F.col("email"))["canonical"]
    asked = pairs.select(phone.alias("p"), email.alias("e"))
    own = cards.select("person_id", F.explode("phones").alias("x"), "emails").withColumn("p", N.canon_phone_nanp(F.col("x")))
    known = own.where("p IS NOT NULL").groupBy("p").agg(F.min("person_id").alias("person_id"), F.count_distinct("person_id").alias("n"), F.flatten(F.collect_list("emails")).alias("emails"))
    joined = asked.join(known, "p", "left")
    reason = (
        F.when(F.col("p").isNull() | F.col("e").isNull(), "invalid").when(F.col("person_id").isNull(), "no_match").when(F.col("n") > 1, "ambiguous")
        .when(F.exists("emails", lambda x: N.canonicalize_email(x)["canonical"] == F.col("e")), "present").otherwise("candidate")
    )
    marked = joined.withColumn("reason", reason)
    return marked.where("reason = 'candidate'").select("person_id", F.col("e").alias("email")).distinct(), marked.groupBy("reason").count()


def enrichment_context(cards: DataFrame, messages: DataFrame, batch: int = 30) -> DataFrame:
    """Persons still ``other`` with a handle and a real name, their last messages cut to 200 characters, in batches."""
    name = F.coalesce("name", F.lit(""))
    real = ~name.contains("@") & ~name.rlike(r"^\+?[\d\s().-]+$") & (name != "")
    asked = cards.where((F.coalesce("category", F.lit("other")) == "other") & (F.size(F.concat("phones", "emails")) > 0) & real)
    said = messages.where("rank <= 30").groupBy(*PERSON).agg(F.array_sort(F.collect_list(F.struct("ts", F.substring("text", 1, 200).alias("text")))).alias("messages"))
    placed = numbered(asked, ["user_id"], [F.col("person_id")])
    return placed.join(said, PERSON, "left").withColumn("batch", F.floor((F.col("place") - 1) / batch).cast("long")).drop("place")


def delta_context(active: DataFrame, snaps: DataFrame, messages: DataFrame, limit: int = 30) -> DataFrame:
    """messages (person, at, text) after the person's last snapshot; persons with a snapshot and nothing new are skipped."""
    last = snaps.groupBy(*PERSON).agg(F.max("pass_at").alias("pass_at"))
    who = active.select(*PERSON).join(last, PERSON, "left")
    new = messages.join(who, PERSON).where("pass_at IS NULL OR at > pass_at")
    rank = F.row_number().over(Window.partitionBy(*PERSON).orderBy(F.desc("at"), "text"))
    kept = new.withColumn("rank", rank).where(F.col("rank") <= limit).groupBy(*PERSON).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("messages"))
    return who.join(kept, PERSON, "left").where("pass_at IS NULL OR messages IS NOT NULL")


def filter_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without business accounts and automatic texts; and the counts."""
    business, spam = N.is_business_jid(F.col("chat_jid")), N.is_spam_text(F.col("text"))
    stats = messages.agg(F.count("*").alias("total"), F.count_if(business).alias("business_filtered"), F.count_if(~business & spam).alias("spam_filtered"), F.count_if(~business & ~spam).alias("kept"))
    return messages.where(~business & ~spam), stats


def filter_calendar(events: DataFrame, as_of, self_emails: list[str], most: int = 8, ahead: int = 180) -> tuple[DataFrame, DataFrame]:
    """Personal meetings, and how many events each rule dropped."""
    others = F.size(F.filter("attendee_emails", lambda e: ~F.lower(e).isin(*[x.lower() for x in self_emails])))
    reason = (
        F.when(N.is_auto_event(F.col("summary"), F.size("attendee_emails")), "auto")
        .when(F.col("start_at").isNull() | (F.col("start_at") > F.lit(as_of).cast("timestamp") + F.expr(f"INTERVAL {ahead} DAYS")), "far_future")
        .when(others > most, "org_wide").otherwise("kept")
    )
    marked = events.withColumn("reason", reason)
    return marked.where("reason = 'kept'").drop("reason"), marked.groupBy("reason").count()


def filter_members(members: DataFrame) -> DataFrame:
    return members.where(N.is_real_human(F.coalesce("real_name", "name"), F.col("is_bot"), F.col("member_id")))
