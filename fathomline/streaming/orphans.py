"""Orphan references kept up to date by a stream of deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators import orphans
from fathomline.streaming.jobs import drain


def follow(changes: DataFrame, folder: str, publish: Callable[[DataFrame, int], None]) -> orphans.OrphanStore:
    """Advance the state in folder by each batch of changes and publish a snapshot after it; gives the state.

    changes: (kind: 'reference', 'parent' or 'deleted'; ref_table, row_id, target, key, time), keys as UUIDs. State and
    checkpoint lie in folder: called again with it, the stream goes on behind its last batch, and a batch that was applied
    but not yet noted isn't applied twice.
    """
    spark = changes.sparkSession

    def step(df: DataFrame, batch: int) -> None:
        store = orphans.OrphanStore(spark, f"{folder}/state")
        of = lambda kind: df.where(F.col("kind") == kind)
        refs = of("reference").groupBy("ref_table", "row_id").agg(F.min(F.struct("target", "key", F.col("time").alias("ref_time"))).alias("v")).select("ref_table", "row_id", "v.*")
        ups = of("parent").groupBy("target", "key").agg(F.min("time").alias("created_at"))
        store.advance(batch, refs, ups, of("deleted").select("target", "key").distinct())
        publish(orphans.snapshot(store.references), batch)

    drain(changes, step, f"{folder}/checkpoint")
    return orphans.OrphanStore(spark, f"{folder}/state")
