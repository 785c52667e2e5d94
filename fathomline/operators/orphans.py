"""References to records that do not exist, as keyed state on disk that is advanced by deltas.

The state (``OrphanStore``) is a folder of three tables, in buckets:

- keys, by target table and normalised key: does the key exist, since when, and is it in the log of deletions
- references, by the key they name: one row per referring row with its verdict
- rows, by ref_table and row_id: which key a referring row names, so that a row that comes again replaces what it said

``advance`` takes a delta of new references, arriving parents and deletions. New references probe the keys, which are the
parents' index; arriving parents resolve references that waited for them; deletions reopen them. Only buckets that hold a key
or row of the delta are read and written again; all others stay the files they are. So a delta costs as much as the buckets it
touches, at most all. A delta has a number; one that was applied already, as after a restart, is passed over. The manifest,
which says the files of each bucket, is written last, so that a delta that fails half-way changes nothing. ``snapshot`` counts
the open cases. ``judged`` is the same verdict without state, which the tests compare with.

Nulls and blanks: a reference with a null or blank key is no case and is not kept. A key that is no UUID can match
nothing and is 'missing'. A repeated row_id counts once (its smallest key and time). A null time gives month 'unknown'
and never 'late'. Empty tables give empty results; other columns of the inputs are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.keys import is_blank, uuid_key
from fathomline.operators.skew import left_join
from fathomline.storage import children, read_text, remove, stage, write_text


@dataclass(frozen=True)
class Reference:
    """What refers to what: table and key column of the referring rows, their time, and the table referred to."""

    table: str
    key: str
    time: str
    target: str


REFERENCES = (
    Reference("chunk_embeddings", "content_chunk_id", "generated_at", "content_chunks"),
    Reference("processing_jobs", "file_id", "created_at", "files"),
    Reference("file_assets", "file_id", "created_at", "files"),
)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def as_references(rows: DataFrame, spec: Reference) -> DataFrame:
    """(ref_table, row_id, target, key, written, ref_time) of the rows whose key isn't blank, once per row_id."""
    picked = rows.where(~is_blank(F.col(spec.key))).select(F.col("id").alias("row_id"), F.col(spec.key).alias("written"), F.col(spec.time).cast("timestamp").alias("ref_time"))
    one = picked.groupBy("row_id").agg(F.min(F.struct("written", "ref_time")).alias("v")).select("row_id", "v.written", "v.ref_time")
    return one.select(F.lit(spec.table).alias("ref_table"), "row_id", F.lit(spec.target).alias("target"), uuid_key(F.col("written")).alias("key"), "ref_time")


def as_parents(rows: DataFrame, target: str) -> DataFrame:
    keyed = rows.select(F.lit(target).alias("target"), uuid_key(F.col("id")).alias("key"), F.col("created_at").cast("timestamp").alias("created_at"))
    return keyed.where(F.col("key").isNotNull()).groupBy("target", "key").agg(F.min("created_at").alias("created_at"))


def as_deleted(log: DataFrame) -> DataFrame:
    return log.select(F.lower(F.trim("ref_table")).alias("target"), uuid_key(F.col("key_id")).alias("key")).where(F.col("key").isNotNull() & F.col("target").isNotNull()).distinct()


def verdict(known: Column, created: Column, deleted: Column, time: Column) -> Column:
    """The kind of orphan, or null."""
    return F.when(known & (created > time), F.lit("late")).when(known, F.lit(None).cast("string")).when(deleted, F.lit("deleted")).otherwise(F.lit("missing"))


def probe(references: DataFrame, index: DataFrame) -> DataFrame:
    """The references with orphan_kind. index: (target, key, known, created_at, gone), one row per key.

    A probe never multiplies rows; hot keys are joined apart (see skew.left_join).
    """
    probed = left_join(references, index.select("target", "key", "known", "created_at", "gone"), ["target", "key"])
    kind = verdict(F.coalesce("known", F.lit(False)), F.col("created_at"), F.coalesce("gone", F.lit(False)), F.col("ref_time"))
    return probed.select("ref_table", "row_id", "target", "key", "ref_time", kind.alias("orphan_kind"))


def judged(references: list[DataFrame], parents: list[DataFrame], deleted: DataFrame) -> DataFrame:
    """The verdict on whole tables, without state."""
    parents = _union(parents)
    index = parents.select("target", "key", F.lit(True).alias("known"), "created_at").unionByName(deleted.select("target", "key", F.lit(None).cast("boolean").alias("known"), F.lit(None).cast("timestamp").alias("created_at")).withColumn("gone", F.lit(True)), allowMissingColumns=True)
    index = index.groupBy("target", "key").agg(F.max("known").alias("known"), F.min("created_at").alias("created_at"), F.max("gone").alias("gone"))
    return probe(_union(references), index)


SCHEMAS = {
    "keys": "target string, key string, known boolean, created_at timestamp, gone boolean, bucket int",
    "references": "ref_table string, row_id string, target string, key string, ref_time timestamp, orphan_kind string, bucket int",
    "rows": "ref_table string, row_id string, target string, key string, bucket int",
}


class OrphanStore:
    """The state in a folder. Opened again, it goes on from the last delta that was written.

    buckets: how many there are of each table, fixed when the folder is new. That many files are named by the driver at most.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path
        done = [int(x) for x in children(spark, f"{path}/manifest") if x.isdigit()]
        self.last = max(done, default=-1)
        #: The delta that wrote each bucket last.
        self.versions: dict[tuple[str, int], int] = {}
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if done:
            said = json.loads(read_text(spark, f"{path}/manifest/{self.last}"))  # at most 3 x buckets numbers
            self.versions = {(t, b): v for t, b, v in said["versions"]}
            self.buckets = said["buckets"]

    def bucket(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def key_bucket(self) -> Column:
        """By key; what has none waits for nothing and is spread by its row."""
        return F.when(F.col("key").isNull(), self.bucket("ref_table", "row_id")).otherwise(self.bucket("target", "key"))

    def table(self, name: str, among: set[int] | None = None) -> DataFrame:
        """A table of the state, or of it the given buckets."""
        paths = [f"{self.path}/{name}/{v}/bucket={b}" for (t, b), v in self.versions.items() if t == name and (among is None or b in among)]
        columns = SCHEMAS[name].rpartition(", bucket")[0]
        return self.spark.read.schema(columns).parquet(*paths) if paths else self.spark.createDataFrame([], columns)

    @property
    def references(self) -> DataFrame:
        return self.table("references")

    def _numbers(self, *parts: DataFrame) -> set[int]:
        """The buckets that occur: at most self.buckets numbers."""
        return {r["bucket"] for r in _union([p.select("bucket").distinct() for p in parts]).distinct().collect()}

    def advance(self, number: int, references: DataFrame | None = None, parents: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Apply delta number. references: (ref_table, row_id, target, key, ref_time); parents: (target, key, created_at); deleted: (target, key).

        A key that arrives again after its deletion exists; a key in deleted that isn't in parents of the same delta exists
        no more, and its references are reopened.
        """
        if number <= self.last:
            return
        written: dict[tuple[str, int], int] = {}
        changed = []  # what the delta says of keys
        if parents is not None:
            changed.append(parents.select("target", "key", F.lit(True).alias("arrives"), "created_at", F.lit(None).cast("boolean").alias("leaves")))
        if deleted is not None:
            changed.append(deleted.select("target", "key", F.lit(None).cast("boolean").alias("arrives"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(True).alias("leaves")))
        keys = stage(_union(changed).withColumn("bucket", self.bucket("target", "key")), "delta-keys") if changed else None
        refs = stage(references.withColumn("bucket", self.key_bucket()).withColumn("row_bucket", self.bucket("ref_table", "row_id")), "delta-references") if references is not None else None

        touched = self._numbers(*(p for p in (keys, refs) if p is not None))
        if refs is not None:
            rows_touched = self._numbers(refs.select(F.col("row_bucket").alias("bucket")))
            named = self.table("rows", rows_touched)
            if any(t == "rows" and b in rows_touched for t, b in self.versions):  # rows that came before may have named another key
                moved = named.join(refs.select("ref_table", "row_id"), ["ref_table", "row_id"], "left_semi").withColumn("bucket", self.key_bucket())
                touched |= self._numbers(moved)
                named = named.join(refs.select("ref_table", "row_id"), ["ref_table", "row_id"], "left_anti")
            self._write(number, "rows", named.unionByName(refs.select("ref_table", "row_id", "target", "key")).withColumn("bucket", self.bucket("ref_table", "row_id")), rows_touched, written)

        index = self.table("keys", touched)
        if keys is not None:
            key_buckets = self._numbers(keys)
            index = self.table("keys", key_buckets)
            none = F.lit(None).cast("boolean")
            before = index.select("target", "key", none.alias("arrives"), F.lit(None).cast("timestamp").alias("created_at"), none.alias("leaves"), "known", F.col("created_at").alias("since"), "gone")
            both = before.unionByName(keys.drop("bucket"), allowMissingColumns=True).groupBy("target", "key").agg(*(F.max(c).alias(c) for c in ("arrives", "leaves", "known", "gone")), F.min("created_at").alias("created_at"), F.min("since").alias("since"))
            stays = F.coalesce("known", F.lit(False)) & F.coalesce(~F.col("leaves"), F.lit(True))
            index = both.select("target", "key", (stays | F.coalesce("arrives", F.lit(False))).alias("known"), F.least(F.col("created_at"), F.when(stays, F.col("since"))).alias("created_at"), (F.coalesce("gone", F.lit(False)) | F.coalesce("leaves", F.lit(False))).alias("gone"))
            self._write(number, "keys", index.withColumn("bucket", self.bucket("target", "key")), key_buckets, written)
            index = self._read(number, "keys", key_buckets, written).unionByName(self.table("keys", touched - key_buckets))

        waiting = self.table("references", touched).drop("orphan_kind")
        if refs is not None:
            if any(t == "references" and b in touched for t, b in self.versions):
                waiting = waiting.join(refs.select("ref_table", "row_id"), ["ref_table", "row_id"], "left_anti").select(*waiting.columns)
                waiting = waiting.unionByName(refs.select(*waiting.columns))
            else:
                waiting = refs.select(*waiting.columns)
        if refs is not None or any(t == "references" and b in touched for t, b in self.versions):
            self._write(number, "references", probe(waiting, index).withColumn("bucket", self.key_bucket()), touched, written)

        self.versions |= written
        write_text(self.spark, f"{self.path}/manifest/{number}", json.dumps({"buckets": self.buckets, "versions": [(t, b, v) for (t, b), v in sorted(self.versions.items())]}))
        self.last = number

    def vacuum(self) -> None:
        """Remove the files of buckets that a later delta has written anew. Not while another reader holds the state."""
        for name in SCHEMAS:
            for version in children(self.spark, f"{self.path}/{name}"):
                for part in children(self.spark, f"{self.path}/{name}/{version}"):
                    if part.startswith("bucket=") and str(self.versions.get((name, int(part[7:])))) != version:
                        remove(self.spark, f"{self.path}/{name}/{version}/{part}")

    def _write(self, number: int, name: str, rows: DataFrame, among: set[int], written: dict[tuple[str, int], int]) -> None:
        """Write rows as the new state of the buckets among, as few files a bucket as its size asks for."""
        path = f"{self.path}/{name}/{number}"
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        there = {int(x.partition("=")[2]) for x in children(self.spark, path) if x.startswith("bucket=")}
        for b in among:
            if b in there:
                written[name, b] = number
            else:
                self.versions.pop((name, b), None)

    def _read(self, number: int, name: str, among: set[int], written: dict[tuple[str, int], int]) -> DataFrame:
        paths = [f"{self.path}/{name}/{number}/bucket={b}" for b in among if (name, b) in written]
        columns = SCHEMAS[name].rpartition(", bucket")[0]
        return self.spark.read.schema(columns).parquet(*paths) if paths else self.spark.createDataFrame([], columns)


def month(time: Column) -> Column:
    """YYYY-MM in UTC, whatever the session's zone; 'unknown' for null."""
    utc = F.to_utc_timestamp(time, F.current_timezone())
    return F.coalesce(F.date_format(utc, "yyyy-MM"), F.lit("unknown"))


def open_cases(references: DataFrame) -> DataFrame:
    """(ref_table, row_id, orphan_kind, ref_month) of every orphan among judged references."""
    return references.where(F.col("orphan_kind").isNotNull()).select("ref_table", "row_id", "orphan_kind", month(F.col("ref_time")).alias("ref_month"))


def snapshot(references: DataFrame) -> DataFrame:
    """Open cases and all references per table, kind and month; partial counts are made before the shuffle."""
    rows = references.select("ref_table", month(F.col("ref_time")).alias("ref_month"), F.coalesce("orphan_kind", F.lit("none")).alias("orphan_kind"))
    return rows.groupBy("ref_table", "ref_month", "orphan_kind").agg(F.count(F.lit(1)).alias("n_rows"))
