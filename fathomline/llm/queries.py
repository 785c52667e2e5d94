"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.keys import uuid_key
from fathomline.llm import boilerplate, knn, leakage, mixing, moderation, neardup, splitting, transcripts
from fathomline.llm.oracles import ORACLES as ORACLES
from fathomline.storage import read


def _split(spark: SparkSession, root: str, only_oversized: bool) -> DataFrame:
    rows = read(spark, root, "content_chunks").select("id", "tenant_id", F.col("chunk_text").alias("text"))
    return splitting.split(rows, read(spark, root, "chunking_configs"), only_oversized)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """The chunks that are larger than the size in force, which are those that come out in several pieces."""
    return _split(spark, root, True).where("piece_no = 0").select(F.col("id").alias("content_chunk_id"))


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of all chunks, within the size in force for the tenant."""
    return _split(spark, root, False).withColumnRenamed("id", "content_chunk_id")


def _turns(spark: SparkSession, root: str) -> DataFrame:
    rows = read(spark, root, "content_chunks").select("id", uuid_key(F.col("file_id")).alias("file"), F.col("chunk_text").alias("text"))
    return transcripts.speaker_turns(rows).withColumnRenamed("id", "content_chunk_id")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """The turns of every transcript, with the number of each turn's speaker."""
    return _turns(spark, root).select("content_chunk_id", "turn_no", "speaker_no")


def p2_turns(spark: SparkSession, root: str) -> DataFrame:
    """The turns with speaker, start and spoken words."""
    return _turns(spark, root)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of chunks whose sets of three-word sequences have a similarity of at least one half."""
    rows = read(spark, root, "content_chunks").select("id", F.col("chunk_text").alias("text"))
    return neardup.pairs(rows, 3, 0.5).select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p3_classes(spark: SparkSession, root: str) -> DataFrame:
    """Each chunk's class of equal texts, with the numbers of its copies and of its near-duplicates, by five words and 0.8."""
    rows = read(spark, root, "content_chunks").select("id", F.col("chunk_text").alias("text"))
    return neardup.linked(rows).withColumnRenamed("id", "content_chunk_id").withColumnRenamed("class", "class_id")


def _pages(spark: SparkSession, root: str) -> DataFrame:
    return boilerplate.pages(read(spark, root, "content_chunks"), read(spark, root, "files"), uuid_key)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The numbers of the lines of each page's main body."""
    return boilerplate.main_lines(_pages(spark, root)).select(F.col("id").alias("content_chunk_id"), "line_no")


def p4_text(spark: SparkSession, root: str) -> DataFrame:
    """The main body of each page as one text."""
    return boilerplate.main_text(_pages(spark, root)).select(F.col("id").alias("content_chunk_id"), "text")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of embeddings of different chunks, of which one is among the other's 5 most similar, with a cosine of at least 0.9."""
    return knn.pairs(read(spark, root, "chunk_embeddings"), 5, 0.9).select(F.col("a").alias("embedding_a"), F.col("b").alias("embedding_b"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents and the evaluation items of which they hold at least a third of the words, in runs of eight or more."""
    return leakage.leaks(read(spark, root, "documents"), read(spark, root, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    """Each leaked item with its number of documents and the largest coverage, of the whole, of its question line and of what stands before it."""
    found = leakage.leaks(read(spark, root, "documents"), read(spark, root, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("coverage").alias("coverage"), F.max("question_coverage").alias("question_coverage"), F.max("answer_coverage").alias("answer_coverage"))


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """How often each text is used in each mix."""
    return mixing.mixed(read(spark, root, "documents"), read(spark, root, "source_targets"), mixing.public_vocabulary())[0]


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual share of each source in each mix."""
    return mixing.mixed(read(spark, root, "documents"), read(spark, root, "source_targets"), mixing.public_vocabulary())[1]


def _scores(spark: SparkSession, root: str) -> DataFrame:
    return moderation.scored(read(spark, root, "documents"), moderation.fit(read(spark, root, "moderation_examples")))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """The documents with an abusive, hateful or sexual passage."""
    return _scores(spark, root).where(F.col("score") >= moderation.THRESHOLD).select("doc_id")


def p9_rates(spark: SparkSession, root: str) -> DataFrame:
    """Documents, cases, their rate and the mean score of each source."""
    scores = _scores(spark, root).withColumn("source", F.coalesce(mixing.source_key(F.col("source")), F.lit("unknown")))
    case = F.sum((F.col("score") >= moderation.THRESHOLD).cast("long"))
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), case.alias("n_cases"), (case / F.count(F.lit(1))).alias("rate"), F.avg("score").alias("mean_score"))


QUERIES = {"p9_found": p9_found, "p9_rates": p9_rates, "p1_found": p1_found, "p1_pieces": p1_pieces, "p8_mix": p8_mix, "p8_shares": p8_shares, "p2_found": p2_found, "p2_turns": p2_turns, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p4_text": p4_text, "p6_found": p6_found, "p7_found": p7_found, "p7_report": p7_report}
