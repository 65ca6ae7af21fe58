"""Reports and rollups over ledger, cards, messages and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieledger.functions.normalize import safety_drop_reason
from tieledger.functions.scoring import days_between
from tieledger.operators.cards import PERSON, person_observations
from tieledger.operators.intake import payload_map
from tieledger.operators.numbering import numbered


def _category(obs: DataFrame, links: DataFrame) -> DataFrame:
    rows = person_observations(obs.where("kind = 'person'"), links).withColumn("category", F.element_at(payload_map(F.col("payload")), "category"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*PERSON).orderBy(F.desc("observed_at"), F.desc("id"))))


def category_distribution(obs: DataFrame, links: DataFrame) -> DataFrame:
    rows = person_observations(obs.where("kind = 'person'"), links).withColumn("category", F.coalesce(F.element_at(payload_map(F.col("payload")), "category"), F.lit("__none__")))
    newest = rows.groupBy(*PERSON).agg(F.max_by("category", F.struct("observed_at", "id")).alias("category"))
    return newest.groupBy("user_id", "category").agg(F.count("*").alias("n"))


def ledger_metrics(obs: DataFrame, links: DataFrame, persons: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(user_id, metric, n): observations by kind, persons, links, persons without person rows, edges by type."""
    parts = [
        obs.groupBy("user_id", F.concat(F.lit("observations:"), "kind").alias("metric")).agg(F.count("*").alias("n")),
        persons.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("metric", F.lit("persons")),
        links.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("metric", F.lit("links")),
    ]
    with_rows = person_observations(obs.where("kind = 'person'"), links).select(*PERSON)
    bare = persons.withColumnRenamed("id", "person_id").join(with_rows, PERSON, "left_anti")
    parts.append(bare.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("metric", F.lit("persons_without_rows")))
    if edges is not None:
        parts.append(edges.groupBy("user_id", F.concat(F.lit("edges:"), "type").alias("metric")).agg(F.count("*").alias("n")))
    out = parts[0].select("user_id", "metric", "n")
    for more in parts[1:]:
        out = out.unionByName(more.select("user_id", "metric", "n"))
    return out


def run_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two reports of ledger_metrics -> before, after and change of each metric."""
    b, a = before.withColumnRenamed("n", "before"), after.withColumnRenamed("n", "after")
    both = b.join(a, ["user_id", "metric"], "full_outer").na.fill(0, ["before", "after"])
    return both.withColumn("change", F.col("after") - F.col("before"))


def promoted_persons(obs: DataFrame, links: DataFrame) -> DataFrame:
    """Persons whose newest row has a category and whose second newest was ``other``."""
    rows = _category(obs, links).where("n <= 2").groupBy(*PERSON).agg(F.max(F.when(F.col("n") == 1, F.col("category"))).alias("now"), F.max(F.when(F.col("n") == 2, F.col("category"))).alias("was"))
    return rows.where("was = 'other' AND now <> 'other'")


def name_quality(cards: DataFrame) -> DataFrame:
    reason = safety_drop_reason(F.col("name"))
    counts = cards.groupBy("user_id", F.coalesce(reason, F.lit("real")).alias("quality")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))


def duplicate_handles(cards: DataFrame) -> DataFrame:
    own = cards.select("user_id", "person_id", F.explode("phones").alias("phone"))
    return own.groupBy("user_id", "phone").agg(F.count_distinct("person_id").alias("persons")).where("persons > 1")


def rollup_contacts(signals: DataFrame) -> DataFrame:
    """signals (user_id, name, source, at, score, text) -> sources, count, last time, score with bonus, three texts.

    A contact that is only known from direct messages needs two of them.
    """
    text = F.struct(F.col("at"), F.col("text"))
    rows = signals.groupBy("user_id", "name").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("interactions"), F.max("at").alias("last_at"), F.sum("score").alias("raw"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), text)), asc=False), 1, 3).alias("newest"),
    )
    rows = rows.where((F.size("sources") > 1) | (F.get("sources", F.lit(0)) != "dm") | (F.col("interactions") >= 2))
    return rows.withColumn("score", F.col("raw") + F.least(F.col("interactions") * 0.02, F.lit(1.0))).withColumn("samples", F.col("newest.text")).drop("newest")


def classify_contacts(contacts: DataFrame, domains: DataFrame, team: DataFrame, family_hint: str) -> DataFrame:
    """contacts (name, email_domain, sources, interactions), domains (email_domain, category, company), team (name): first rule wins."""
    known = contacts.join(domains.withColumnsRenamed({"category": "dc", "company": "company"}), "email_domain", "left").join(team.select("name", F.lit(True).alias("in_team")), "name", "left")
    phone_like = F.col("name").rlike(r"^\+?[\d\s().-]{6,}$")
    n = F.col("interactions")
    category = (
        F.when(F.col("dc").isNotNull(), F.col("dc"))
        .when(F.col("in_team"), "team")
        .when(F.lower("name").rlike(family_hint), "friend")
        .when((n <= 1) & F.col("email_domain").isNull(), "other")
        .when(F.size("sources") >= 2, "needs_review")
        .when((n >= 3) & phone_like, F.when(n >= 10, "needs_review").otherwise("other"))
        .when(n >= 3, "needs_review")
        .otherwise("other")
    )
    return known.withColumn("category", category).drop("dc", "in_team")


def dedup_interactions(df: DataFrame) -> DataFrame:
    """First of each set of participants and channel, by time then id."""
    key = F.array_join(F.array_sort(F.array_distinct("participants")), "|")
    rank = F.row_number().over(Window.partitionBy("user_id", "key", "channel").orderBy("observed_at", "id"))
    return df.withColumn("key", key).withColumn("n", rank).where("n = 1").drop("n")


def chunk(df: DataFrame, order: str, size: int = 30) -> DataFrame:
    """Numbers of chunks of a tenant's rows in order."""
    return numbered(df, ["user_id"], [F.col(order)]).withColumn("chunk", F.floor((F.col("place") - 1) / size).cast("long")).drop("place")


def collapse_recurring(events: DataFrame) -> DataFrame:
    """events (user_id, id, summary, start_at, attendees): a regular series becomes its newest row with cadence and bounds."""
    title = F.regexp_replace(F.regexp_replace(F.coalesce("summary", F.lit("")), r"\d{4}[-/]\d{2}[-/]\d{2}", ""), r"\b\d+\b", "")
    title = F.regexp_replace(F.lower(F.trim(title)), r"\s+", " ")
    keyed = events.withColumn("series", F.sha1(F.concat_ws("|", F.array_join(F.array_sort(F.array_distinct(F.transform("attendees", lambda a: F.lower(a)))), ","), title)))
    w = Window.partitionBy("user_id", "series").orderBy("start_at", "id")
    gaps = keyed.withColumn("gap", F.unix_micros("start_at") - F.unix_micros(F.lag("start_at").over(w)))
    per = gaps.groupBy("user_id", "series").agg(
        F.count("*").alias("occurrences"), F.sort_array(F.collect_list("gap")).alias("gaps"), F.min("start_at").alias("first_seen"), F.max("start_at").alias("last_seen"),
        F.max(F.struct("start_at", "id")).alias("newest"),
    )
    median = F.element_at("gaps", F.floor(F.size("gaps") / 2).cast("int") + 1)
    per = per.where("occurrences >= 3").withColumn("median", median).withColumn("even", F.size(F.filter("gaps", lambda g: (g >= 0.5 * F.col("median")) & (g <= 1.5 * F.col("median")))))
    per = per.where(F.col("even") >= F.size("gaps") * 0.6)
    days = F.col("median") / 86_400_000_000.0
    cadence = F.when(days < 1.5, "daily").when(days < 5, F.concat(F.lit("every "), F.bround(days, 0).cast("int").cast("string"), F.lit(" days"))).when(days < 8, "weekly").when(days < 16, "biweekly").otherwise("monthly")
    per = per.select("user_id", "series", cadence.alias("cadence"), "occurrences", "first_seen", "last_seen", F.col("newest.id").alias("newest_id"))
    out = keyed.join(per, ["user_id", "series"], "left").where("cadence IS NULL OR id = newest_id")
    return out.withColumn("recurring", F.col("cadence").isNotNull()).drop("newest_id")


def dm_quality(messages: DataFrame) -> DataFrame:
    """messages (chat_jid, from_me, text): reciprocity times share of messages with text."""
    rows = messages.groupBy("chat_jid").agg(F.count_if(F.col("from_me") == 1).alias("own"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("texts"), F.count("*").alias("n"))
    other = F.col("n") - F.col("own")
    balance = F.least("own", other) / F.greatest("own", other)
    return rows.withColumn("quality", (0.3 + 0.7 * balance) * (0.5 + 0.5 * F.col("texts") / F.col("n")))


def channel_stats(raw: DataFrame, phone_map: DataFrame, as_of) -> DataFrame:
    """Per person and channel: counts, times, reply ratio, last preview, days since, both directions."""
    rows = raw.where("phone IS NOT NULL").join(phone_map, ["user_id", "phone"]).groupBy(*PERSON, F.col("source").alias("channel"))
    out = rows.agg(
        F.count("*").alias("message_count"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.count_if(F.col("direction") == "out").alias("outgoing"),
        F.count_if(F.col("direction") == "in").alias("incoming"), F.max_by("body", F.struct("occurred_at", "source_event_id")).alias("last_preview"),
    )
    since = F.floor(days_between(F.lit(as_of).cast("timestamp"), F.col("last_at"))).cast("long")
    return out.withColumns({"reply_ratio": F.round(F.col("outgoing") / F.col("message_count"), 2), "days_since": since, "bidirectional": (F.col("outgoing") > 0) & (F.col("incoming") > 0)})


def rule_topics(messages: DataFrame, stopwords: DataFrame, n: int = 10) -> DataFrame:
    """messages (user_id, person_id, text), stopwords (token): the most frequent words of four letters and more."""
    tokens = messages.select(*PERSON, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), 0)).alias("token"))
    counts = tokens.join(stopwords, "token", "left_anti").groupBy(*PERSON, "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*PERSON).orderBy(F.desc("n"), "token"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def merge_topics(parts: DataFrame, least: float = 0.15, most: int = 20) -> DataFrame:
    """Weights of all runs added, the heaviest of a person set to 1."""
    sums = parts.groupBy(*PERSON, "topic").agg(F.sum("weight").alias("w")).withColumn("weight", F.col("w") / F.max("w").over(Window.partitionBy(*PERSON))).drop("w")
    rank = F.row_number().over(Window.partitionBy(*PERSON).orderBy(F.desc("weight"), "topic"))
    return sums.where(F.col("weight") >= least).withColumn("rank", rank).where(F.col("rank") <= most)


def topic_summary(persons: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persons per topic; and how many persons have so many topics."""
    per_topic = topics.groupBy("user_id", "topic").agg(F.count_distinct("person_id").alias("persons"))
    counts = persons.select(*PERSON).join(topics.groupBy(*PERSON).agg(F.count("*").alias("n")), PERSON, "left").na.fill(0, ["n"])
    bucket = F.when(F.col("n") == 0, "0").when(F.col("n") <= 3, "1-3").when(F.col("n") <= 6, "4-6").when(F.col("n") <= 10, "7-10").when(F.col("n") <= 15, "11-15").otherwise("16+")
    return per_topic, counts.groupBy("user_id", bucket.alias("bucket")).agg(F.count("*").alias("persons"))


def bucket_profile(manifest: DataFrame) -> DataFrame:
    """Combinations of sources: how many humans, how many handles each."""
    flags = ("wa_dm", "wa_contact", "wa_group", "google_contact", "gmail_from", "gmail_to_cc")
    combo = F.concat_ws("+", *[F.when(F.col(f), F.lit(f)) for f in flags])
    size = F.size("phones") + F.size("emails") + F.size("lids")
    return manifest.groupBy(combo.alias("sources")).agg(F.count("*").alias("humans"), F.percentile(size, 0.5).alias("p50"), F.percentile(size, 0.95).alias("p95"), F.max(size).alias("largest"))


def thread_interactions(messages: DataFrame) -> DataFrame:
    """One interaction per thread with all who took part."""
    return messages.groupBy("user_id", "thread_id").agg(F.array_sort(F.collect_set("person_id")).alias("participants"), F.count("*").alias("message_count"), F.max("occurred_at").alias("observed_at"))


def thread_concentration(raw: DataFrame) -> DataFrame:
    """Fewest threads that hold 50 % and 80 % of a tenant's rows, and the share of threads with one row."""
    threads = raw.where("thread_id IS NOT NULL").groupBy("user_id", "thread_id").agg(F.count("*").alias("n"))
    totals = threads.groupBy("user_id").agg(F.sum("n").alias("total"))
    run = numbered(threads, ["user_id"], [F.desc("n"), F.col("thread_id")], "n").join(totals, "user_id")
    need: Column = lambda share: F.count_if(F.col("before") < share * F.col("total"))
    return run.groupBy("user_id").agg(need(0.5).alias("threads_50"), need(0.8).alias("threads_80"), (F.count_if(F.col("n") == 1) / F.count("*")).alias("single_share"))
