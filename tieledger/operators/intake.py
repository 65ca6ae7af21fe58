"""Validation, projections into the ledger, and idempotent writes.  First write wins unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieledger.functions import normalize as N

SOURCES = ("whatsapp", "gmail", "calendar", "slack", "linear")
KINDS = ("interaction", "note", "person", "correction", "merge", "split")
FIELDS = ("name", "company", "title", "category", "relationship_to_me", "relationship_strength", "phones", "emails")


def _split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def validate_raw_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows with defaults filled and the preview cut to 160 characters; rejected rows with the first reason."""
    reason = (
        F.when(F.col("source").isNull() | ~F.col("source").isin(*SOURCES), "source")
        .when(F.coalesce(F.length("source_event_id"), F.lit(0)) == 0, "source_event_id")
        .when(F.length("source_event_id") > 512, "source_event_id")
        .when(F.col("occurred_at").isNull(), "occurred_at")
        .when(F.col("direction").isNotNull() & ~F.col("direction").isin("in", "out"), "direction")
        .when(F.length("body_preview") > 512, "body_preview")
    )
    valid, rejected = _split(df, reason)
    valid = valid.withColumn("body_preview", N.safe_slice(N.clean_text(F.col("body_preview")), 160))
    for c in ("participant_phones", "participant_emails"):
        if c in df.columns:
            valid = valid.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    if "attachments_present" in df.columns:
        valid = valid.withColumn("attachments_present", F.coalesce("attachments_present", F.lit(False)))
    return valid, rejected


def payload_map(payload: Column) -> Column:
    """Keys of a JSON object to text; an explicit null stays a key with a null value, nested values stay JSON text."""
    return F.from_json(payload, "map<string,string>")


def with_observation_reason(df: DataFrame) -> DataFrame:
    """With ``reason``, the first rule that a row breaks, or null: envelope rules, then those of the kind's payload.

    The payload is parsed once, as a column that all rules look into.
    """
    p = F.col("__payload_map")
    text = lambda key: F.coalesce(F.element_at(p, key), F.lit(""))
    needs = {
        "interaction": ("channel", "summary"),
        "note": ("target_person_id", "content"),
        "person": ("name",),
        "correction": ("target_person_id", "field"),
        "merge": ("person_id",),
        "split": ("person_id", "reason"),
    }
    missing = reduce(lambda a, b: a | b, [(F.col("kind") == k) & reduce(lambda x, y: x | y, [text(c) == "" for c in cs]) for k, cs in needs.items()])
    ids = F.when(F.col("kind") == "merge", text("merged_observation_ids")).when(F.col("kind") == "split", text("split_off_observation_ids"))
    reason = (
        F.when(F.coalesce(F.col("observer"), F.lit("")) == "", "observer")
        .when(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS), "kind")
        .when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "confidence")
        .when(~F.coalesce(F.length("evidence_pointer"), F.lit(0)).between(1, 512), "evidence_pointer")
        .when(~F.coalesce(F.length("reasoning"), F.lit(0)).between(1, 2000), "reasoning")
        .when(F.col("observed_at").isNull(), "observed_at")
        .when(p.isNull(), "payload")
        .when(missing, "payload")
        .when((F.col("kind") == "correction") & ~text("field").isin(*FIELDS), "field")
        .when(ids.isin("", "[]"), "ids")
    )
    return df.withColumn("__payload_map", payload_map(F.col("payload"))).withColumn("reason", reason).drop("__payload_map")


def validate_observations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows; rejected rows with the first reason."""
    marked = with_observation_reason(df)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def messages_to_raw_events(df: DataFrame) -> DataFrame:
    """Rows of the message store -> raw events; a body is the first text that is not empty."""
    digits = F.regexp_extract("sender_jid", r"^(\d+)@s\.whatsapp\.net$", 1)
    mine = F.col("from_me") == 1
    body = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("text", "display_text", "media_caption")])
    some = F.array(F.struct(F.col("sender_jid").alias("jid"), F.col("sender_name").alias("name")))
    phones = F.when(~mine & (digits != ""), F.array(F.concat(F.lit("+"), digits)))
    return df.select(
        *[c for c in ("user_id",) if c in df.columns],
        F.lit("whatsapp").alias("source"),
        F.concat_ws("|", "chat_jid", "msg_id").alias("source_event_id"),
        F.timestamp_seconds("ts").alias("occurred_at"),
        F.when(mine, "out").otherwise("in").alias("direction"),
        F.col("chat_jid").alias("thread_id"),
        F.when(~mine & F.col("sender_jid").isNotNull(), some).otherwise(F.array().cast("array<struct<jid:string,name:string>>")).alias("participants_raw"),
        F.coalesce(phones, F.array().cast("array<string>")).alias("participant_phones"),
        N.safe_slice(N.clean_text(body), 160).alias("body_preview"),
        F.col("media_type").isNotNull().alias("attachments_present"),
    )


def project_interactions(raw: DataFrame, self_name: str = "self") -> DataFrame:
    """Direct raw events (with phone, sender_name, body) -> interaction observations with pointers that never change."""
    peer = F.when(F.col("sender_name").isNull() | F.lower("sender_name").isin("", "me"), F.col("phone")).otherwise(F.col("sender_name"))
    preview = F.coalesce(F.nullif("body", F.lit("")), F.lit("(no preview)"))
    summary = F.concat(F.when(F.col("direction") == "out", "Outbound").otherwise("Inbound"), F.lit(" WhatsApp message: "), preview)
    direct = raw.where((F.col("source") == "whatsapp") & F.col("phone").isNotNull() & F.col("occurred_at").isNotNull() & ~F.coalesce(F.col("thread_id").endswith("@g.us"), F.lit(False)))
    payload = F.to_json(F.struct(F.array(F.lit(self_name), peer).alias("participants"), F.lit("whatsapp").alias("channel"), summary.alias("summary"), F.lit("direct message").alias("topic"), F.lit("neutral").alias("sentiment")))
    return direct.select(
        "user_id", F.lit("interaction").alias("kind"), F.lit("projector").alias("observer"), F.col("occurred_at").alias("observed_at"),
        F.concat(F.lit("whatsapp://message/"), "source_event_id").alias("evidence_pointer"), F.lit(1.0).cast("decimal(4,3)").alias("confidence"),
        F.lit("Projected from a raw event.").alias("reasoning"), peer.alias("peer"), summary.alias("summary"), payload.alias("payload"), "phone",
    )


def projection_stats(raw: DataFrame, phone_map: DataFrame, self_phone: str) -> DataFrame:
    """Why raw events are not projected: group, no phone, self, unresolved; else projected."""
    known = phone_map.select("user_id", "phone", F.lit(True).alias("known"))
    reason = (
        F.when(F.coalesce(F.col("thread_id").endswith("@g.us"), F.lit(False)), "group")
        .when(F.col("phone").isNull(), "no_phone")
        .when(F.col("phone") == self_phone, "self")
        .when(F.col("known").isNull(), "unresolved")
        .otherwise("projected")
    )
    return raw.join(known, ["user_id", "phone"], "left").groupBy("user_id", reason.alias("reason")).count()


def manifest_to_observations(manifest: DataFrame, scheme: str, observer: str) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.split_part(F.get("emails", F.lit(0)), F.lit("@"), F.lit(1)), F.get("phones", F.lit(0)), F.lit("unknown"))
    flags = [F.when(F.col(f"source_provenance.{f}"), F.lit(f)) for f in ("wa_dm", "wa_contact", "wa_group", "gmail_from", "google_contact")]
    sources = F.coalesce(F.nullif(F.concat_ws("+", *flags), F.lit("")), F.lit("unknown"))
    return manifest.select(
        F.concat(F.lit(f"{scheme}://"), "id").alias("evidence_pointer"), F.lit("person").alias("kind"), F.lit(observer).alias("observer"),
        F.col("first_seen").alias("observed_at"), F.lit(1.0).cast("decimal(4,3)").alias("confidence"), F.concat(F.lit("Rules only, from "), sources).alias("reasoning"),
        F.to_json(F.struct(name.alias("name"), "phones", "emails", F.lit("other").alias("category"))).alias("payload"), name.alias("name"),
    )


def activities_to_observations(df: DataFrame) -> DataFrame:
    """(person_id, type, title, notes, source, occurred_at) -> interaction observations."""
    channel = F.when(F.col("type") == "meeting", "meeting").otherwise("slack")
    summary = F.coalesce(F.nullif("notes", F.lit("")), "title")
    pointer = F.concat(F.lit("activity://"), N.slug(F.col("source")), F.lit("/"), F.col("person_id"), F.lit("/"), N.slug(F.col("title"), 96))
    return df.withColumns({"kind": F.lit("interaction"), "channel": channel, "summary": summary, "evidence_pointer": pointer}).withColumn(
        "payload", F.to_json(F.struct("channel", "summary", F.col("person_id").alias("target_person_id"), F.col("type").alias("activity_type"), "title"))
    )


def notes_to_observations(df: DataFrame) -> DataFrame:
    pointer = F.concat(F.lit("note://"), F.col("person_id"), F.lit("/"), F.unix_seconds("noted_at").cast("string"))
    payload = F.to_json(F.struct(F.col("person_id").alias("target_person_id"), F.col("content"), F.lit("manual").alias("source")))
    return df.withColumns({"kind": F.lit("note"), "evidence_pointer": pointer, "payload": payload})


def patches_to_corrections(patches: DataFrame, cards: DataFrame) -> DataFrame:
    """patches (user_id, person_id, fields map<string,string>) -> one correction for each field that differs from the card."""
    wanted = patches.select("user_id", "person_id", F.explode("fields").alias("field", "new_value"))
    shown = cards.select("user_id", "person_id", F.create_map(*[x for c in FIELDS[:5] for x in (F.lit(c), F.col(c).cast("string"))]).alias("now"))
    joined = wanted.join(shown, ["user_id", "person_id"]).withColumn("old_value", F.element_at("now", F.col("field")))
    return joined.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).drop("now").withColumn("kind", F.lit("correction"))


def emails_to_corrections(emails: DataFrame, cards: DataFrame) -> DataFrame:
    """emails (user_id, person_id, email): the card's list with the address appended, where it is new."""
    joined = emails.join(cards.select("user_id", "person_id", F.col("emails").alias("old_value")), ["user_id", "person_id"])
    return joined.select("user_id", "person_id", F.lit("emails").alias("field"), "old_value", F.array_union("old_value", F.array(F.lower(F.trim("email")))).alias("new_value"))


def with_dedup_key(df: DataFrame) -> DataFrame:
    """sha256 of kind, pointer and, for corrections, target, field and new value."""
    p = payload_map(F.col("payload"))
    tail = F.when(F.col("kind") == "correction", F.concat_ws(":", *[F.coalesce(F.element_at(p, k), F.lit("")) for k in ("target_person_id", "field", "new_value")])).otherwise("")
    return df.withColumn("dedup_key", F.sha2(F.concat_ws(":", "kind", "evidence_pointer", tail), 256))


def _ingest(existing: DataFrame | None, batch: DataFrame, key: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    first = batch.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__n = 1").drop("__n")
    new = first if existing is None else first.join(existing.select(*key), key, "left_anti")
    total = batch.agg(F.count("*").alias("total")).crossJoin(new.agg(F.count("*").alias("inserted")))  # two single rows
    return new, total.select("inserted", (F.col("total") - F.col("inserted")).alias("duplicates"))


def ingest_raw_events(existing: DataFrame | None, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows by (user_id, source, source_event_id), and counts; ``seq`` is the order of arrival."""
    return _ingest(existing, batch, ["user_id", "source", "source_event_id"], "seq")


def ingest_observations(existing: DataFrame | None, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _ingest(existing, with_dedup_key(batch), ["user_id", "dedup_key"], "seq")


def upsert_lid_bridge(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Newest phone (by seq) and greatest last_seen of each lid."""
    new = batch.withColumns({"lid": F.trim("lid"), "phone": F.trim("phone")}).where("lid <> '' AND phone <> ''")
    every = new.select("user_id", "lid", "phone", "last_seen", "seq")
    if existing is not None:
        every = every.unionByName(existing.select("user_id", "lid", "phone", "last_seen", F.lit(-1).cast("long").alias("seq")))
    return every.groupBy("user_id", "lid").agg(F.max_by("phone", "seq").alias("phone"), F.max("last_seen").alias("last_seen"))


def replace_topics(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """All topics of the batch's persons give way; the last duplicate wins."""
    clean = batch.withColumns({"topic": F.lower(F.trim("topic")), "weight": F.coalesce("weight", F.lit(0.0))}).where("topic <> ''")
    last = clean.groupBy("user_id", "person_id", "topic").agg(F.max_by("weight", "seq").alias("weight"))
    if existing is None:
        return last
    kept = existing.join(batch.select("user_id", "person_id").distinct(), ["user_id", "person_id"], "left_anti")
    return kept.select("user_id", "person_id", "topic", "weight").unionByName(last)


def upsert_meetings(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Newest values of each meeting; an empty brief keeps the former one."""
    cols = ["title", "start_at", "end_at", "brief_md"]
    every = batch.select("user_id", "meeting_id", *cols, "seq")
    if existing is not None:
        every = every.unionByName(existing.select("user_id", "meeting_id", *cols, F.lit(-1).cast("long").alias("seq")))
    briefed = F.when(F.coalesce("brief_md", F.lit("")) != "", F.col("seq"))
    return every.groupBy("user_id", "meeting_id").agg(*[F.max_by(c, "seq").alias(c) for c in cols[:3]], F.max_by("brief_md", briefed).alias("brief_md"))


def append_snapshots(existing: DataFrame | None, batch: DataFrame, persons: DataFrame) -> DataFrame:
    """Snapshots of known persons with a known kind of pass."""
    good = batch.where(F.col("pass_kind").isin("enricher", "resolver", "summary", "correction")).join(persons.select("user_id", F.col("id").alias("person_id")), ["user_id", "person_id"], "left_semi")
    good = good.withColumns({"card_state": F.coalesce("card_state", F.lit("{}")), "diff_summary": F.coalesce("diff_summary", F.lit(""))})
    return good if existing is None else existing.unionByName(good)


def append_merge_audit(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    good = batch.where(F.col("source").isin("auto", "llm", "user") & F.col("confidence").between(0, 1))
    return good if existing is None else existing.unionByName(good)


def active_merges(audit: DataFrame) -> DataFrame:
    return audit.where("reverted_at IS NULL").orderBy(F.desc("applied_at"), "id")


def import_contacts_csv(df: DataFrame) -> DataFrame:
    """(user_id, name, company, email, category) rows -> person observations; nameless rows go."""
    name, mail = F.trim("name"), F.nullif(F.lower(F.trim("email")), F.lit(""))
    rows = df.withColumns({"name": name, "email": mail, "company": F.nullif(F.trim("company"), F.lit("")), "category": F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("other"))})
    rows = rows.where(F.coalesce("name", F.lit("")) != "")
    observation = F.sha2(F.concat_ws("|", "user_id", "name", F.coalesce("email", F.lit(""))), 256)
    payload = F.to_json(F.struct("name", "company", "category", F.array_compact(F.array("email")).alias("emails")), {"ignoreNullFields": "false"})
    return rows.withColumns({"id": observation, "kind": F.lit("person"), "evidence_pointer": F.concat(F.lit("csv://"), observation), "payload": payload})
