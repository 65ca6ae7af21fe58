"""Incremental intake with Structured Streaming.

Which keys are there is state of the stream, looked up by key in a state store; no batch reads the table.  A batch writes to partitions that
carry its number, so a batch that is run again replaces its own rows and changes nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tieledger.operators.activity import delta_context, persons_active_since, tick_tenants
from tieledger.operators.intake import project_interactions, with_dedup_key
from tieledger.operators.links import link_events
from tieledger.sources.versions import Versions

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Files of a load in a partition of a table: a tenant's rows are not written by one task.
FILES = 8


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def first_of_key(stream: DataFrame, key: list[str], known: DataFrame | None = None) -> DataFrame:
    """The stream without rows whose key came before, in this stream or in ``known``, a stream of the same columns; for update mode.

    Of a key's first batch the row of least ``seq`` is let through.  One streaming aggregation: a key is new where the first and the last batch that it was seen
    in are one, by the time that Spark notes for a batch and keeps when it is run again.  So the state is in RocksDB, a value for each key.
    """
    rows = stream.withColumn("__known", F.lit(False))
    if known is not None:
        rows = rows.unionByName(known.withColumn("__known", F.lit(True)), allowMissingColumns=True)
    rest = [c for c in stream.columns if c not in key]
    order = F.struct(F.col("seq").isNull(), "seq")
    seen = rows.withColumn("__at", F.current_timestamp()).groupBy(*key).agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), F.max("__known").alias("__known"), F.min_by(F.struct(*rest), order).alias("__row"))
    return seen.where("__first = __last AND NOT __known").select(*[F.col(c) if c in key else F.col(f"__row.{c}") for c in stream.columns])


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool, mode: str = "append") -> StreamingQuery:
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKS)  # a query keeps what is set when it starts
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        conf.set(_PROVIDER, before)


def _load(checkpoint: str, number: int) -> str:
    """The name of a batch's rows: of its checkpoint and number."""
    return f"{_loads(checkpoint)}{number:09d}"


def _loads(checkpoint: str) -> str:
    return f"{hashlib.sha1(checkpoint.encode()).hexdigest()[:12]}-"


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to the end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _known(stream: DataFrame, key: list[str], path: str, checkpoint: str) -> DataFrame:
    """The keys that a table held when the checkpoint was new, as a stream that gives them once, with the first batch.

    They are written beside the checkpoint before its first batch.  What a first batch that failed left in the table is not among them.
    """
    spark, seeds = stream.sparkSession, f"{checkpoint.rstrip('/')}-known"
    fields = [stream.schema[c] for c in key]
    if not _whole(spark, seeds):
        table = existing(spark, path)
        none = spark.createDataFrame([], T.StructType(fields))
        keys = none if table is None else table.where(~F.col("load").startswith(_loads(checkpoint))).select(*[F.col(f.name).cast(f.dataType) for f in fields])
        keys.write.mode("overwrite").parquet(seeds)
    return spark.readStream.schema(T.StructType(fields)).parquet(seeds)


def _write(rows: DataFrame, path: str, load: str, by: list[str]) -> None:
    """Rows of a load, in place of those that a former try of it left."""
    spread = F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t]), F.lit(FILES))
    parts = rows.withColumn("load", F.lit(load)).repartition(*by, spread)
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "load").parquet(path)


def _loaded(batch: DataFrame, path: str, load: str) -> DataFrame | None:
    """The rows of a load; no other folder of the table is opened."""
    try:
        return batch.sparkSession.read.schema(batch.schema).option("basePath", path).parquet(f"{path}/user_id=*/kind=*/load={load}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # a batch without new rows


def stream_raw_events(stream: DataFrame, table_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Late and repeated rows never change what is there: each batch adds the keys that no batch had, at ``user_id / source / load``.

    Under a new checkpoint the keys of the table are the first state.
    """
    key = ["user_id", "source", "source_event_id"]
    rows = first_of_key(stream, key, _known(stream, key, table_path, checkpoint))
    return _start(rows, lambda batch, n: _write(batch, table_path, _load(checkpoint, n), ["user_id", "source"]), checkpoint, once, "update")


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Alternative with bounded state: repeats within the delay are dropped, without looking at the table."""
    return stream.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["user_id", "source", "source_event_id"])


def stream_observations(stream: DataFrame, table_path: str, links_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """The ledger grows by new keys, and so do the link events of the new rows; both are written under the batch's load."""

    def each(batch: DataFrame, number: int) -> None:
        load = _load(checkpoint, number)
        _write(batch, table_path, load, ["user_id", "kind"])
        # the links are those of the rows as written, so that the batch is worked out once
        new = _loaded(batch, table_path, load)
        if new is not None:
            _write(link_events(new), links_path, load, ["user_id"])

    keyed, key = with_dedup_key(stream), ["user_id", "dedup_key"]
    rows = first_of_key(keyed, key, _known(keyed, key, table_path, checkpoint))
    return _start(rows, each, checkpoint, once, "update")


def observer_tick(raw: DataFrame, watermarks: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Tenants that are due, and all watermarks after this tick."""
    due = tick_tenants(raw, watermarks, as_of)
    moved = watermarks.join(due.select("user_id"), "user_id", "left_anti").unionByName(due.select("user_id", "last_tick_at"))
    return due, moved


def _moved(marks: DataFrame | None, seen: DataFrame | None) -> DataFrame:
    """Watermarks (user_id, seen_at, last_tick_at, since) after rows were seen (user_id, seen_at); nothing ticks."""
    parts = []
    if marks is not None:
        parts.append(marks.select("user_id", "seen_at", "last_tick_at"))
    if seen is not None:
        parts.append(seen.select("user_id", "seen_at", F.lit(None).cast("timestamp").alias("last_tick_at")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.groupBy("user_id").agg(F.max("seen_at").alias("seen_at"), F.max("last_tick_at").alias("last_tick_at")).withColumn("since", F.lit(None).cast("timestamp"))


def stream_ticks(stream: DataFrame, path: str, checkpoint: str, as_of, known: DataFrame | None = None) -> DataFrame:
    """One run of the tick over what was ingested since the last: (user_id, since, last_tick_at) of tenants that are due, each once.

    The stream (user_id, ingested_at) gives only rows that no run had.  Of a tenant the newest time seen and the last tick are kept at ``path``; a batch
    commits them under its number, and the run's ticks are part of the version that moves the watermarks, so a run that fails
    is either not there or whole.  A tenant is due if it was seen after its last tick; one without a tick is due at once.  ``known`` (user_id, last_tick_at): the
    watermarks to begin with.
    """
    spark, versions = stream.sparkSession, Versions(stream.sparkSession, path)
    if known is not None and versions.latest() is None:
        versions.commit({"marks": known.select("user_id", F.lit(None).cast("timestamp").alias("seen_at"), "last_tick_at", F.lit(None).cast("timestamp").alias("since"))}, "known")

    def each(batch: DataFrame, number: int) -> None:
        seen = batch.groupBy("user_id").agg(F.max("ingested_at").alias("seen_at"))
        versions.commit({"marks": _moved(versions.read("marks"), seen)}, _load(checkpoint, number))

    _start(stream.select("user_id", "ingested_at"), each, checkpoint, True).awaitTermination()
    marks = versions.read("marks")
    if marks is None:
        return spark.createDataFrame([], "user_id string, since timestamp, last_tick_at timestamp")
    now = F.lit(as_of).cast("timestamp")
    due = (F.col("seen_at") > F.coalesce("last_tick_at", F.timestamp_seconds(F.lit(0)))) & (F.coalesce("last_tick_at", F.timestamp_seconds(F.lit(0))) < now)
    ticked = marks.select("user_id", "seen_at", F.when(due, now).otherwise(F.col("last_tick_at")).alias("last_tick_at"), F.when(due, F.coalesce("last_tick_at", F.timestamp_seconds(F.lit(0)))).alias("since"))
    done = versions.commit({"marks": ticked}, f"tick-{as_of}")
    return versions.read("marks", done).where("since IS NOT NULL").select("user_id", "since", "last_tick_at")


def watermarks(spark: SparkSession, path: str) -> DataFrame | None:
    """(user_id, last_tick_at) of all tenants that ticked."""
    marks = Versions(spark, path).read("marks")
    return marks and marks.where("last_tick_at IS NOT NULL").select("user_id", "last_tick_at")


def stream_interactions(stream: DataFrame, table_path: str, links_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """New raw events become interaction observations; the pointer is the key, so running again adds none."""
    rows = project_interactions(stream).withColumns({"seq": F.unix_micros("observed_at"), "ingested_at": F.col("observed_at"), "id": F.sha2("evidence_pointer", 256)})
    return stream_observations(rows, table_path, links_path, checkpoint, once)


def thread_stats(stream: DataFrame) -> DataFrame:
    """Count, first and last time of each direct thread, kept up to date; for update mode."""
    direct = stream.where("source = 'whatsapp' AND thread_id LIKE '%@s.whatsapp.net'")
    return direct.groupBy("user_id", "thread_id").agg(F.count("*").alias("message_count"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def stream_thread_stats(stream: DataFrame, table_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch writes the changed threads to a folder of its own number; the newest number of a thread counts."""

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return _start(thread_stats(stream), each, checkpoint, once, "update")


def daily_delta(obs: DataFrame, links: DataFrame, snaps: DataFrame, messages: DataFrame, as_of) -> DataFrame:
    """Persons active in the last day, with what is new since their last snapshot."""
    since = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 DAY")
    return delta_context(persons_active_since(obs, links, snaps, since, False, as_of), snaps, messages)
