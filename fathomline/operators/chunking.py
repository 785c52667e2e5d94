"""The two chunkers: windows of words, and recursive splitting at ever finer separators.

Null texts give no chunks. Blank texts give no chunks; windows drop U+0000 first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import text as T

SEPARATORS = ("\n\n", "\n", " ")


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in words, the minimum in bytes. An invalid combination is replaced by the defaults."""

    size: int = 578
    overlap: int = 102
    most: int | None = None
    least_bytes: int = 10

    def checked(self) -> ChunkConfig:
        ok = self.size > 0 and 0 <= self.overlap < self.size and 0 <= self.least_bytes <= self.size
        return self if ok else ChunkConfig()


def word_chunks(docs: DataFrame, config: ChunkConfig = ChunkConfig(), text: str = "text") -> DataFrame:
    """Each row of docs with chunk_index, chunk_text and token_count, one row per window of words.

    A window starts size - overlap words after the one before; the first window that reaches the end is the last. Only the
    last can be shorter than size words, so that dropping windows of too few bytes is the same as stopping there.
    """
    c = config.checked()
    stride = c.size - c.overlap
    # blank texts have no windows; a filter on the words would be pushed down and split every text twice
    rows = docs.where(F.col(text).isNotNull()).withColumn("_words", T.words(T.sanitize(F.col(text))))
    last = F.greatest(F.lit(0), F.ceil((F.size("_words") - c.size) / F.lit(stride)).cast("int"))
    starts = F.when(F.size("_words") > 0, F.sequence(F.lit(0), last))
    some = rows.withColumn("chunk_index", F.explode(starts))
    window = F.slice("_words", F.col("chunk_index") * stride + 1, F.lit(c.size))
    out = some.withColumn("_window", window).withColumn("chunk_text", F.array_join("_window", " ")).withColumn("token_count", F.size("_window"))
    kept = out.where(F.octet_length(T.strip(F.col("chunk_text"))) >= c.least_bytes)
    if c.most is not None:
        kept = kept.where(F.col("chunk_index") < c.most)
    return kept.drop("_words", "_window")


def cut(text: str, most: int, level: int = 0) -> list[str]:
    """Pieces of at most most bytes (code points where no separator is left), which joined are the text.

    A separator stays in front of what follows it; pieces are filled greedily; one that is still too large is split by
    the next separator on its own.
    """
    if len(text.encode()) <= most:
        return [text]
    while level < len(SEPARATORS) and SEPARATORS[level] not in text:
        level += 1
    if level == len(SEPARATORS):
        return [text[k : k + most] for k in range(0, len(text), most)]
    head, *rest = text.split(SEPARATORS[level])
    out: list[str] = []
    held, size = "", 0
    for piece in [head, *(SEPARATORS[level] + x for x in rest)]:
        n = len(piece.encode())
        if held and size + n > most:
            out.append(held)
            held, size = "", 0
        held, size = held + piece, size + n
        if size > most:
            out += cut(held, most, level + 1)
            held, size = "", 0
    return [*out, held] if held else out


def pieces(text: Column, most: int) -> Column:
    """cut() as a column of arrays."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: cut(t, most), na_action="ignore")

    return split(text)


def recursive_chunks(docs: DataFrame, most: int = 2000, least_bytes: int = 10, text: str = "text") -> DataFrame:
    """Each row of docs with chunk_index, chunk_text and token_count. Too small pieces are dropped and leave gaps in the index."""
    some = docs.where(~T.is_empty(F.col(text)))
    rows = some.select("*", F.posexplode(pieces(F.col(text), most)).alias("chunk_index", "chunk_text"))
    return rows.where(F.octet_length(T.strip(F.col("chunk_text"))) >= least_bytes).withColumn("token_count", T.word_count(F.col("chunk_text")))


def pages_to_docs(docs: DataFrame) -> DataFrame:
    """One row per page of extracted documents (pages: array of structs with page_number and text), to chunk page by page."""
    return docs.select("*", F.explode("pages").alias("_page")).select("*", F.col("_page.page_number").alias("page_number"), F.col("_page.text").alias("page_text")).drop("_page", "pages")
