"""Job states, progress and ingestion as streams.

State is kept per key and is a few fields, however many events a key has. Events must come in order of time within a key
across batches; inside a batch they are sorted. Checkpoints lie where the caller says, so that a query started again goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathomline.functions import status as S
from fathomline.operators.chunking import ChunkConfig, word_chunks
from fathomline.operators.jobs import advanced, first_state, milestones
from fathomline.sources.sinks import stable_id
from fathomline.storage import children

_STATE = "status string, progress double, started_at timestamp, completed_at timestamp, error string, n_events long"
_OUT = f"key string, {_STATE}"


def states(events: DataFrame) -> DataFrame:
    """A stream of (key, status, progress, started_at, completed_at, error, n_events) after each batch, from events (key, id, at, kind, value, message)."""

    def fold(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else first_state()
        rows = pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")
        for r in rows.itertuples(index=False):
            held = advanced(held, r.kind, r.at, None if pd.isna(r.value) else float(r.value), None if pd.isna(r.message) else r.message)
        held = [None if x is pd.NaT else x for x in held]
        state.update(tuple(held))
        frame = pd.DataFrame([[key[0], *held]], columns=["key", "status", "progress", "started_at", "completed_at", "error", "n_events"])
        yield frame.astype({"started_at": "datetime64[us]", "completed_at": "datetime64[us]"})

    ok = events.where(F.col("key").isNotNull() & F.col("kind").isNotNull() & F.col("at").isNotNull())
    return ok.groupBy("key").applyInPandasWithState(fold, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream over all that is there now, each batch through handle. With the checkpoint of an earlier run it goes on behind that."""
    query = stream.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_states(events: DataFrame, folder: str) -> DataFrame:
    """The last state of each key once a stream of events has been drained. Each batch is a part of a table in folder; the last update of a key counts."""
    spark = events.sparkSession
    schema = states(events).schema

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/states/batch={batch}")

    drain(states(events), write, f"{folder}/checkpoint")
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/states")
    return rows.groupBy("key").agg(F.max_by(F.struct(*schema.names[1:7]), "batch").alias("s")).select("key", "s.*")


def ingest(documents: DataFrame, path: str, config: ChunkConfig = ChunkConfig()) -> None:
    """Chunk a stream of documents (id, tenant_id, text) and append the chunks to a table, path/chunks.

    Ids are made of document and index: a batch that is written again after a failure is recognised by its batch number.
    """

    def write(df: DataFrame, batch: int) -> None:
        rows = word_chunks(df, config).select(stable_id(F.col("id"), F.col("chunk_index")).alias("id"), "tenant_id", F.col("id").alias("file_id"), "chunk_index", "chunk_text", "token_count")
        rows.write.mode("overwrite").parquet(f"{path}/chunks/batch={batch}")

    drain(documents, write, f"{path}/checkpoint")


def work_queue(jobs: DataFrame, handle: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Work through a stream of jobs and give the events that came of it: a durable queue.

    jobs: (id, file_id, job_type, status, created_at). handle takes a batch's pending jobs (id, file_id, job_type), once each,
    and gives (id, error): null for success. Each job starts, passes its milestones and completes or fails; the events are
    written by batch under path, beside the checkpoint, so that a queue that is opened again goes on behind the last batch
    and a batch that is repeated writes the same events.
    """
    spark = jobs.sparkSession

    def work(df: DataFrame, batch: int) -> None:
        waiting = df.where((S.normal(F.col("status")) == "pending") & F.col("id").isNotNull()).dropDuplicates(["id"])
        begun = waiting.select(F.col("id").alias("key"), F.coalesce("created_at", F.timestamp_micros(F.lit(0))).alias("at"), "job_type")
        ends = handle(waiting.select("id", "file_id", "job_type")).groupBy(F.col("id").alias("key")).agg(F.min("error").alias("message"))
        done = begun.join(ends, "key").select("key", F.lit(99).cast("bigint").alias("id"), (F.col("at") + F.make_dt_interval(secs=F.lit(60))).alias("at"), F.when(F.col("message").isNull(), "complete").otherwise("fail").alias("kind"), F.lit(None).cast("double").alias("value"), "message")
        milestones(begun).unionByName(done).write.mode("overwrite").parquet(f"{path}/events/batch={batch}")

    drain(jobs, work, f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/events").drop("batch") if children(spark, f"{path}/events") else milestones(spark.createDataFrame([], "key string, at timestamp, job_type string"))


def watch(updates: DataFrame, wanted: DataFrame) -> DataFrame:
    """What a watcher of jobs is told: the updates of states (key, batch, status, progress, error) up to the first terminal one.

    wanted: (key). A key without any update is told once, as the event 'error' with the message not found; others are events 'status'.
    """
    asked = wanted.where(F.col("key").isNotNull()).select("key").distinct()
    mine = updates.join(asked, "key", "left_semi")
    end = F.min(F.when(S.is_terminal(F.col("status")), F.col("batch"))).over(Window.partitionBy("key"))
    shown = mine.withColumn("_end", end).where(F.col("_end").isNull() | (F.col("batch") <= F.col("_end")))
    told = shown.select("key", F.lit("status").alias("event"), F.col("batch").cast("int").alias("batch"), "status", "progress", F.col("error").alias("message"))
    absent = asked.join(mine.select("key").distinct(), "key", "left_anti")
    none = lambda t: F.lit(None).cast(t)
    return told.unionByName(absent.select("key", F.lit("error").alias("event"), none("int").alias("batch"), none("string").alias("status"), none("double").alias("progress"), F.lit("not found").alias("message")))


def updates_of(events: DataFrame, folder: str) -> DataFrame:
    """All updates of states (key, status, ..., batch) that a stream of events gives, batch by batch."""
    latest_states(events, folder)
    return events.sparkSession.read.parquet(f"{folder}/states")


def active_snapshots(updates: DataFrame) -> DataFrame:
    """(batch, n_pending, n_processing): after each batch, the jobs that are active, from updates (key, batch, status).

    An update is counted in from its batch and out from its key's next one, so that no batch's whole state is built.
    """
    later = F.lead("batch").over(Window.partitionBy("key").orderBy("batch"))
    spans = updates.select("key", "status", F.col("batch").alias("since"), later.alias("until")).where(F.col("status").isin("pending", "processing"))
    sign = spans.select("status", F.explode(F.array(F.struct(F.col("since").alias("batch"), F.lit(1).alias("n")), F.struct(F.col("until").alias("batch"), F.lit(-1).alias("n")))).alias("x")).where("x.batch is not null")
    changes = sign.groupBy(F.col("x.batch").alias("batch")).agg(*(F.sum(F.when(F.col("status") == s, F.col("x.n")).otherwise(0)).alias(s) for s in ("pending", "processing")))
    every = updates.select("batch").distinct().join(changes, "batch", "left")
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # one row a batch
    return every.select("batch", *(F.sum(F.coalesce(s, F.lit(0))).over(upto).cast("bigint").alias(f"n_{s}") for s in ("pending", "processing")))


def read_stream(spark: SparkSession, root: str, table: str, per_batch: int = 1) -> DataFrame:
    """A table's files as a stream of per_batch files at a time."""
    schema = spark.read.parquet(f"{root}/{table}.parquet").schema
    # a pattern matches a single file as well as a folder of files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{root}/{table}.parque[t]")
