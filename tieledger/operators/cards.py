"""Folding the ledger to one card per person, and reading cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieledger.functions.names import similar_text
from tieledger.functions.scoring import days_between
from tieledger.operators.intake import payload_map
from tieledger.sources.tables import cut
from tieledger.sources.versions import Versions

PERSON = ["user_id", "person_id"]


def person_observations(obs: DataFrame, links: DataFrame) -> DataFrame:
    """Observations with the person they are linked to."""
    on = links.select("user_id", "person_id", F.col("observation_id").alias("id"))
    return obs.join(on, ["user_id", "id"])


def _json_type(payload: Column, path: str) -> Column:
    """VOID for JSON null, null for an absent key, else the type."""
    return F.schema_of_variant(F.variant_get(payload, path, "variant"))


#: Fields of a card that hold one value, and lists.
_FIELDS, _LISTS = ("name", "category", "relationship_to_me", "company", "title", "relationship_strength"), ("phones", "emails")


def fold_states(rows: DataFrame) -> DataFrame:
    """Observations with their person -> one mergeable state per person.

    A field is a register: its value with the order of the row that set it last.  A list has the order of its last reset and the
    items at or behind it, each with its order and place.  ``merge_states`` of the states of any split of the rows, in
    any order, is the state of all of them.
    """
    needs = F.col("kind").isin("person", "correction", "interaction")
    slim = rows.select(*PERSON, "id", "observed_at", "ingested_at", "kind", F.try_parse_json(F.when(needs, F.col("payload"))).alias("p")).withColumn("ord", F.struct("observed_at", "ingested_at", "id"))
    text = lambda path: F.variant_get("p", path, "string")
    is_person, field = F.col("kind") == "person", F.when(F.col("kind") == "correction", text("$.field"))
    new_type = _json_type(F.col("p"), "$.new_value")
    new_text = F.when(new_type == "STRING", text("$.new_value"))

    def register(sets: Column, value: Column, name: str) -> Column:
        return F.max(F.when(sets, F.struct("ord", value.alias("v")))).alias(name)

    def plain(name: str) -> Column:
        """Set by a non-empty string of a person row, or any string of a correction."""
        own = F.when(_json_type(F.col("p"), f"$.{name}") == "STRING", text(f"$.{name}"))
        sets = (is_person & (F.coalesce(own, F.lit("")) != "")) | ((field == name) & (new_type == "STRING"))
        return register(sets, F.when(is_person, own).otherwise(new_text), name)

    def nullable(name: str, from_person: bool = True) -> Column:
        """Set by a key that is there, as a string or null; empty counts as null."""
        kind = _json_type(F.col("p"), f"$.{name}")
        sets = (field == name) & new_type.isin("STRING", "VOID")
        value = new_text
        if from_person:
            sets = sets | (is_person & kind.isin("STRING", "VOID"))
            value = F.when(is_person, F.when(kind == "STRING", text(f"$.{name}"))).otherwise(new_text)
        return register(sets, F.nullif(value, F.lit("")), name)

    def items(name: str) -> list[Column]:
        mine = F.when(is_person, F.from_json(text(f"$.{name}"), "array<string>")).when((field == name) & new_type.startswith("ARRAY"), F.from_json(text("$.new_value"), "array<string>"))
        tagged = F.transform(mine, lambda v, i: F.struct(F.col("ord").alias("ord"), i.alias("pos"), v.alias("v")))
        reset = F.max(F.when((field == name) & new_type.startswith("ARRAY"), F.col("ord")))
        return [F.flatten(F.collect_list(tagged)).alias(name), reset.alias(f"{name}_reset")]

    get = lambda k: F.nullif(text(f"$.{k}"), F.lit(""))
    newest = F.struct(F.coalesce(get("activity_type"), get("channel"), F.lit("interaction")).alias("type"), F.coalesce(get("title"), get("summary")).alias("title"), F.col("observed_at").alias("occurred_at"))
    is_act = F.col("kind") == "interaction"
    return _behind_reset(slim.groupBy(*PERSON).agg(
        plain("name"), plain("category"), plain("relationship_to_me"), nullable("company"), nullable("title"), nullable("relationship_strength", False), *items("phones"), *items("emails"),
        F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("updated_at"), F.count_if(is_act).alias("activity_count"), F.count_if(is_person).alias("person_rows"), register(is_act, newest, "last_activity"),
    ))


def _behind_reset(states: DataFrame) -> DataFrame:
    """States without the items that a reset cleared."""
    def kept(name: str) -> Column:
        reset = F.col(f"{name}_reset")
        return F.array_sort(F.filter(name, lambda x: reset.isNull() | (x["ord"] >= reset)))

    return states.withColumns({name: kept(name) for name in _LISTS})


def merge_states(*states: DataFrame) -> DataFrame:
    """States of the same persons, of different rows each, as one."""
    every = states[0]
    for more in states[1:]:
        every = every.unionByName(more)
    return _behind_reset(every.groupBy(*PERSON).agg(
        *[F.max(c).alias(c) for c in (*_FIELDS, "last_activity", *[f"{name}_reset" for name in _LISTS], "updated_at")],
        *[F.flatten(F.collect_list(name)).alias(name) for name in _LISTS], F.min("first_seen").alias("first_seen"),
        *[F.sum(c).alias(c) for c in ("activity_count", "person_rows")],
    ))


def _joined_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """``merge_states`` of two, each with one state a person at most: they lie beside each other, so nothing is aggregated."""
    x, y = old.alias("x"), new.alias("y")
    both = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in PERSON], "full")
    two = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
    none = lambda name: F.array().cast(old.schema[name].dataType)
    most = [F.greatest(*two(c)).alias(c) for c in (*_FIELDS, "last_activity", *[f"{name}_reset" for name in _LISTS], "updated_at")]
    lists = [F.concat(*[F.coalesce(c, none(name)) for c in two(name)]).alias(name) for name in _LISTS]
    sums = [F.coalesce(F.col(f"x.{c}") + F.col(f"y.{c}"), *two(c)).alias(c) for c in ("activity_count", "person_rows")]
    keys = [F.coalesce(*two(c)).alias(c) for c in PERSON]
    return _behind_reset(both.select(*keys, *most, *lists, F.least(*two("first_seen")).alias("first_seen"), *sums)).select(*old.columns)


def finish_cards(states: DataFrame, as_of) -> DataFrame:
    """The cards that states stand for."""
    last = F.col("last_activity.v")
    ago = F.greatest(F.lit(0), F.floor(days_between(F.lit(as_of).cast("timestamp"), last["occurred_at"]))).cast("long")
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(F.array_distinct(F.transform(name, lambda x: x["v"])), empty).alias(name) for name in _LISTS]
    value = lambda c: F.col(f"{c}.v").alias(c)
    return states.select(
        *PERSON, value("name"), value("company"), value("title"), value("category"), F.coalesce("relationship_to_me.v", F.lit("")).alias("relationship_to_me"), value("relationship_strength"), *lists, "first_seen", "updated_at",
        F.coalesce("activity_count", F.lit(0)).cast("long").alias("activity_count"), last.alias("last_activity"), F.when(last.isNotNull(), ago).alias("days_ago"), "person_rows",
    )


def fold_person_cards(obs: DataFrame, links: DataFrame, as_of) -> DataFrame:
    """One card per person by one aggregation: each field takes the newest row that sets it.

    Rows that do not set a field get no ordering and are left out.  A correction of a list clears it; of the
    items behind the last one the first occurrence of each stays.  The ledger is joined to its links once, payloads are parsed
    once, and all kinds of rows go through the one aggregation.
    """
    needs = F.col("kind").isin("person", "correction", "interaction")
    slim = obs.select("user_id", "id", "observed_at", "ingested_at", "kind", F.when(needs, F.col("payload")).alias("payload"))
    return finish_cards(fold_states(person_observations(slim, links)), as_of)


def advance_cards(versions: Versions, obs: DataFrame, links: DataFrame, token: str | None = None, again: DataFrame | None = None, ledger: DataFrame | None = None, all_links: DataFrame | None = None) -> DataFrame:
    """Adds new rows to stored states -> all states.

    ``obs`` and ``links`` are what is new: links of pairs that were not linked before, and the observations they name, old ones among them.
    Where a link went, a state cannot give its rows back: ``again`` (user_id, person_id) names such persons, whose
    states are folded anew from ``ledger`` and ``all_links``.  Old and new states meet in one join by person, each made and read once.
    A call that is repeated with its token changes nothing.
    """
    before = versions.latest()
    if token is not None and before is not None and before.token == token:
        return versions.read("states", before)
    new = fold_states(person_observations(obs, links))
    old = versions.read("states", before)
    if again is not None:
        again = again.select(*PERSON).distinct()
        anew = fold_states(person_observations(ledger, all_links.join(again, PERSON, "left_semi")))
        new = new.join(again, PERSON, "left_anti").unionByName(anew)
        old = old if old is None else old.join(again, PERSON, "left_anti")
    if old is not None:
        new = _joined_states(old, new)
    return versions.read("states", versions.commit({"states": new}, token))


def card_rows(obs: DataFrame, links: DataFrame, tail: int = 50) -> DataFrame:
    """All person and correction rows, the newest ``tail`` interactions and notes of a person."""
    rows = person_observations(obs, links)
    newest = Window.partitionBy(*PERSON, "kind").orderBy(F.desc("observed_at"), F.desc("id"))
    tails = rows.where("kind IN ('interaction', 'note')").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= tail).drop("n")
    return rows.where("kind IN ('person', 'correction')").unionByName(tails)


def assemble_cards(rows: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """The document form: newest 20 interactions, 10 notes, 10 corrections in order, totals, last touch and a summary."""
    p = payload_map(F.col("payload"))
    get = lambda k: F.nullif(F.element_at(p, F.lit(k)), F.lit(""))
    entry = F.struct("observed_at", "id", F.coalesce(get("summary"), get("content"), get("field")).alias("text"))

    def last(kind: str, n: int) -> Column:
        return F.reverse(F.slice(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, entry)), asc=False), 1, n))

    def newest(key: str) -> Column:
        return F.max_by(get(key), F.when((F.col("kind") == "person") & get(key).isNotNull(), F.struct("observed_at", "id")))

    cards = rows.groupBy(*PERSON).agg(
        newest("name").alias("name"), newest("company").alias("company"), newest("title").alias("title"), newest("relationship_to_me").alias("relationship"),
        last("interaction", 20).alias("interactions"), last("note", 10).alias("recent_notes"), last("correction", 10).alias("recent_corrections"),
        F.count("*").alias("total"), F.max(F.when(F.col("kind") == "interaction", F.col("observed_at"))).alias("last_touch"),
    )
    latest = F.element_at(F.col("interactions.text"), -1)
    cards = cards.withColumn("__last", F.when(F.size("interactions") > 0, latest))
    own = F.concat_ws(" · ", "relationship", F.when(~similar_text(F.col("relationship"), F.col("__last")), F.col("__last")))
    if summaries is None:
        return cards.withColumn("one_paragraph_summary", F.nullif(own, F.lit(""))).drop("__last")
    cards = cards.join(summaries.select(*PERSON, F.nullif("headline", F.lit("")).alias("headline")), PERSON, "left")
    return cards.withColumn("one_paragraph_summary", F.coalesce("headline", F.nullif(own, F.lit("")))).drop("__last", "headline")


def enriched_persons(cards: DataFrame) -> DataFrame:
    said = F.coalesce("relationship_to_me", F.lit(""))
    return cards.where((F.coalesce("category", F.lit("other")) != "other") | ((said != "") & ~said.like("Appears in%")))


def search_persons(cards: DataFrame, phone: str | None = None, email: str | None = None, name: str | None = None, limit: int = 10) -> DataFrame:
    """By exactly one of phone, e-mail and part of the name; ordered by name, nulls last."""
    if sum(x is not None for x in (phone, email, name)) != 1:
        raise ValueError("exactly one criterion")
    if phone is not None:
        hit = F.array_contains("phones", phone)
    elif email is not None:
        hit = F.exists("emails", lambda x: F.lower(x) == email.lower())
    else:
        hit = F.contains(F.lower("name"), F.lit(name.lower()))
    return cards.where(hit).orderBy(F.asc_nulls_last("name"), "person_id").limit(max(1, min(50, limit)))


def name_tokens_of(cards: DataFrame) -> DataFrame:
    """(user_id, token, person_id, name): whole names and their words, in lower case."""
    low = F.lower("name")
    return cards.where("name IS NOT NULL").select("user_id", F.explode(F.array_distinct(F.concat(F.array(low), F.split(low, r"\s+")))).alias("token"), "person_id", "name").where("token <> ''")


def match_by_prefix(cards: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """queries (user_id, query): cards whose name or a token of it begins with the query; the first by name.

    Tokens meet queries by as many first letters as the query has, for each length of a query there is, so keys are whole queries.
    Those that are asked for are cut to the first ``limit`` where they are, before any are brought together.
    """
    asked = cut(queries.select("user_id", F.lower(F.trim("query")).alias("query")).where("query <> ''").distinct())
    lengths = sorted(r[0] for r in asked.select(F.length("query")).distinct().collect())  # as many as there are lengths of a typed query
    if not lengths:
        lengths = [1]
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("token")), lambda n: F.substr("token", F.lit(1), n))
    hits = name_tokens_of(cards).select("user_id", F.explode(heads).alias("query"), "person_id", "name").join(asked, ["user_id", "query"], "left_semi").distinct()
    rank = F.row_number().over(Window.partitionBy("user_id", "query").orderBy("name", "person_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit)


def write_name_index(cards: DataFrame, path: str, files: int | None = None) -> None:
    """The tokens of names in ranges of (tenant, token), sorted, so that the statistics of files and of their parts tell where a prefix is."""
    tokens = name_tokens_of(cards)
    ranged = tokens.repartitionByRange(files, "user_id", "token") if files else tokens.repartitionByRange("user_id", "token")
    ranged.sortWithinPartitions("user_id", "token").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(path)


def indexed_prefix(spark: SparkSession, path: str, user_id: str, prefix: str, limit: int = 8) -> DataFrame:
    """One query of ``match_by_prefix`` from the index: a range of it, which is pushed down to the scan."""
    low = prefix.strip().lower()
    if not low:
        raise ValueError("an empty prefix")
    rows = spark.read.parquet(path).where((F.col("user_id") == user_id) & (F.col("token") >= low) & F.startswith("token", F.lit(low)))
    after = low[:-1] + chr(ord(low[-1]) + 1) if ord(low[-1]) < 0xD7FF else None
    rows = rows.where(F.col("token") < after) if after else rows
    return rows.select("user_id", "person_id", "name").distinct().orderBy("name", "person_id").limit(limit)


def persons_by_email(cards: DataFrame, emails: DataFrame) -> DataFrame:
    own = cards.select("user_id", "person_id", F.explode("emails").alias("email")).withColumn("email", F.lower(F.trim("email")))
    asked = emails.select("user_id", F.lower(F.trim("email")).alias("email")).distinct()
    return own.join(asked, ["user_id", "email"]).groupBy("user_id", "email").agg(F.min("person_id").alias("person_id"))


def top_topics(topics: DataFrame, n: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*PERSON).orderBy(F.desc("weight"), "topic"))
    return topics.withColumn("rank", rank).where(F.col("rank") <= n)


def snapshot_history(snaps: DataFrame, n: int = 20) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*PERSON).orderBy(F.desc("pass_at"), F.desc("id")))
    return snaps.withColumn("rank", rank).where(F.col("rank") <= n)


def latest_summary(snaps: DataFrame) -> DataFrame:
    return snapshot_history(snaps.where("pass_kind = 'summary'"), 1).drop("rank")
