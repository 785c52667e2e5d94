"""Writing tables, with ids that are the same however often a plan is run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.storage import children


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id of the parts: a recomputed or retried task writes the same rows. Nulls count as parts."""
    h = F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts))), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def append(df: DataFrame, path: str, partition: str | None = "tenant_id") -> None:
    """Append rows to a Parquet table, in folders by tenant."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


class ObjectStore:
    """Objects as rows of a table in folders by tenant: key is tenant/file. Put, get, delete and links by key.

    put adds rows of their own; of several objects with one key the last put counts. A delete is a row without bytes, so that nothing is
    rewritten; compact writes the table anew with what counts.
    """

    SCHEMA = "tenant_id string, id string, bytes binary, content_type string, version bigint"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _versions(self) -> int:
        return len([x for x in children(self.spark, self.path) if x.startswith("version=")])

    def put(self, rows: DataFrame) -> None:
        """rows: (tenant_id, id, bytes, content_type). Rows without tenant or id are left out; of rows with one key one counts."""
        n = self._versions()
        kept = rows.where(F.col("tenant_id").isNotNull() & F.col("id").isNotNull()).select("tenant_id", "id", "bytes", "content_type").dropDuplicates(["tenant_id", "id"])
        kept.write.mode("overwrite").partitionBy("tenant_id").parquet(f"{self.path}/version={n}")

    def delete(self, keys: DataFrame) -> None:
        """keys: (tenant_id, id)."""
        none = lambda t: F.lit(None).cast(t)
        self.put(keys.select("tenant_id", "id", none("binary").alias("bytes"), none("string").alias("content_type")))

    def get(self, tenant: str | None = None) -> DataFrame:
        """(key, tenant_id, id, bytes, content_type) of the objects there are; of one tenant only its folders are read."""
        if not self._versions():
            return self.spark.createDataFrame([], "key string, tenant_id string, id string, bytes binary, content_type string")
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        rows = rows if tenant is None else rows.where(F.col("tenant_id") == tenant)
        last = rows.groupBy("tenant_id", "id").agg(F.max_by(F.struct("bytes", "content_type"), "version").alias("o"))
        return last.where("o.bytes is not null").select(F.concat_ws("/", "tenant_id", "id").alias("key"), "tenant_id", "id", "o.bytes", "o.content_type")

    def compact(self, path: str) -> ObjectStore:
        """A new store at path with the objects there are."""
        out = ObjectStore(self.spark, path)
        out.put(self.get())
        return out


def link(key: Column, until: Column, secret: Column) -> Column:
    """A link to an object that holds until a time: the key, the time in seconds, and a signature of both."""
    at = until.cast("timestamp").cast("long").cast("string")
    return F.concat(key, F.lit("?until="), at, F.lit("&signature="), F.sha2(F.concat_ws("|", key, at, secret), 256))


def link_holds(url: Column, now: Column, secret: Column) -> Column:
    """Was a link made with the secret, and is it still good? False for nulls and anything else."""
    part = lambda n: F.regexp_extract(url, r"^(.*)\?until=(\d{1,18})&signature=([0-9a-f]{64})$", n)
    same = F.sha2(F.concat_ws("|", part(1), part(2), secret), 256) == part(3)
    return F.coalesce(same & (part(2).try_cast("bigint") >= now.cast("timestamp").cast("long")), F.lit(False))
