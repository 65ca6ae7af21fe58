"""Reading exports: the local message store, mail, address book and observation lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieledger.operators.intake import with_observation_reason
from tieledger.sources.tables import cut

MAIL = "id string, threadId string, internalDate string, labelIds array<string>, payload struct<headers:array<struct<name:string,value:string>>>"
BOOK = (
    "connections array<struct<names:array<struct<displayName:string,unstructuredName:string>>,"
    "phoneNumbers:array<struct<canonicalForm:string,value:string>>,emailAddresses:array<struct<value:string>>>>"
)
OBSERVATION = (
    "user_id string, id string, observed_at timestamp, ingested_at timestamp, observer string, kind string, evidence_pointer string, "
    "confidence decimal(4,3), reasoning string, payload string, seq long"
)


def with_chats(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """Messages with the kind of their chat; a group's own name comes before the one on the message."""
    c = chats.select(F.col("jid").alias("chat_jid"), F.col("kind"), F.col("name").alias("__name"))
    joined = messages.join(c, "chat_jid", "left")
    return joined.withColumn("chat_name", F.when(F.col("kind") == "group", F.coalesce("__name", "chat_name")).otherwise(F.coalesce("chat_name", "__name"))).drop("__name")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return with_chats(spark.read.parquet(f"{path}/messages.parquet"), spark.read.parquet(f"{path}/chats.parquet"))


def header_map(headers: Column) -> Column:
    """Header values by lower-cased name; of repeated headers the last stays."""
    pairs = F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("key"), h["value"].alias("value")))
    keys = F.array_distinct(F.transform(F.filter(pairs, lambda x: x["key"].isNotNull()), lambda x: x["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda x: x["key"] == k), -1)["value"]))


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """Mail lines; a line that is no JSON of this shape is skipped."""
    rows = spark.read.schema(MAIL).option("mode", "DROPMALFORMED").json(path)
    return rows.where("id IS NOT NULL").select("id", F.col("threadId").alias("thread_id"), F.timestamp_millis(F.col("internalDate").try_cast("long")).alias("sent_at"), F.col("labelIds").alias("labels"), header_map(F.coalesce("payload.headers", F.array().cast("array<struct<name:string,value:string>>"))).alias("headers"))


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of an address book document: name, phones, emails."""
    book = spark.read.schema(BOOK).option("multiLine", True).json(path).select(F.explode("connections").alias("c"))
    name = F.coalesce(F.get("c.names", F.lit(0))["displayName"], F.get("c.names", F.lit(0))["unstructuredName"])
    phones = F.transform(F.coalesce("c.phoneNumbers", F.array().cast("array<struct<canonicalForm:string,value:string>>")), lambda x: F.coalesce(x["canonicalForm"], x["value"]))
    emails = F.transform(F.coalesce("c.emailAddresses", F.array().cast("array<struct<value:string>>")), lambda x: x["value"])
    return book.select(name.alias("name"), phones.alias("phones"), emails.alias("emails"))


def check_observation_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lines (line_no, value) -> valid rows, rejects (line_no, reason), and a summary row."""
    parsed = lines.where(F.trim("value") != "").select("line_no", F.from_json("value", OBSERVATION).alias("o"), "value")
    payload = F.coalesce(F.to_json(F.from_json(F.get_json_object("value", "$.payload"), "map<string,string>"), {"ignoreNullFields": "false"}), F.lit(None).cast("string"))
    flat = parsed.select("line_no", "o.*", F.get_json_object("value", "$").isNull().alias("broken"), F.get_json_object("value", "$.payload").alias("__payload"), payload.alias("__map"))
    flat = flat.withColumn("payload", F.when(F.col("__map").isNotNull(), F.col("__payload"))).drop("__payload", "__map")
    # lines are read and parsed once; valid rows, rejects and the summary are made from what is written here
    marked = with_observation_reason(flat)
    marked = cut(marked.withColumn("reason", F.when(F.col("broken"), "json").otherwise(F.col("reason"))).drop("broken"))
    valid, rejects = marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").select("line_no", "reason")
    summary = marked.agg(F.count("*").alias("total_lines"), F.count_if(F.col("reason").isNull()).alias("would_insert_count"), F.count("reason").alias("would_fail"))
    return valid, rejects, summary


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines of text files with their place in their file, from 1; files are read split.

    Rows of a split are numbered as they are read.  One row for each split, with its first number and its count, is enough to know how many
    lines come before it, so the lines themselves are not moved.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r$", "").alias("value"))
    splits = lines.groupBy("file", "block").agg(F.min("n").alias("first"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select("file", "block", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    return lines.join(begins, ["file", "block"]).select("file", (F.col("n") - F.col("first") + F.col("before") + 1).alias("line_no"), "value")


def read_observations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A line's number is its place in its file."""
    return check_observation_lines(read_lines(spark, path).select("line_no", "value"))
