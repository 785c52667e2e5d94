"""Splitting oversized texts at natural boundaries, with an overlap between neighbours.

Sizes are in words, which are separated by Unicode white space. Between two words lies a boundary whose strength depends on
the white space and on what ends the word before it: paragraph, line, sentence, clause, comma, or none. A sparse table
over the strengths answers in constant time which boundary of a window is the strongest, the rightmost among equals. A
piece ends at the strongest boundary of its permissible window, and the next one starts overlap words before that end.

Nothing is lost: a piece holds the text from its first word to the first word after it, so that the pieces without their
overlaps, one after another, are the text. Cases: null texts and rows without an id give no rows; texts within the size, blank ones included, are
one piece; a word of any length is never cut. The configuration is the tenant's row with the latest update; if there is none
or it isn't valid (size below 1, overlap not below size or negative, minimum above size, nulls), the default row's. Rows
repeated under one id count once. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.skew import left_join
from fathomline.storage import spread, stage

#: Size and overlap where there is no valid default row either.
SIZE, OVERLAP = 578, 102
#: A piece that isn't the last has at least that share of the size, so that no weak text gives many small pieces.
LEAST_SHARE = 0.5
#: Tenants' configurations are broadcast up to so many (24 bytes each), and joined by shuffling beyond.
FEW_TENANTS = 500_000
#: Ids of rows that were delivered again are broadcast up to so many (40 bytes each); beyond, all rows are shuffled.
FEW_IDS = 1_000_000

# Unicode White_Space: Python's \s has four information separators in addition.
_WORD = re.compile("[^\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_PARAGRAPH = re.compile("\n[^\\S\n]*\n| ")
_SENTENCE = tuple(f"{end}{close}" for end in ".?!…。？！" for close in ("", '"', "'", ")", "”", "»", "’"))


def count_words(text: str) -> int:
    return len(_WORD.findall(text)) if _SEPARATORS.search(text) else len(text.split())


def strengths(text: str, spans: np.ndarray) -> np.ndarray:
    """The strength of the boundary after each word but the last."""
    out = np.zeros(max(len(spans) - 1, 0), np.int64)
    for k, (end, start) in enumerate(zip(spans[:-1, 1].tolist(), spans[1:, 0].tolist(), strict=True)):
        gap, last = text[end:start], text[max(0, end - 2) : end]
        if "\n" in gap or "\r" in gap or " " in gap or " " in gap:
            out[k] = 5 if _PARAGRAPH.search(gap.replace("\r\n", "\n").replace("\r", "\n")) else 4
        elif last.endswith(_SENTENCE):
            out[k] = 3
        elif last[-1:] in ";:—–":
            out[k] = 2
        elif last[-1:] == ",":
            out[k] = 1
    return out


class Strongest:
    """A sparse table of range maxima: the strongest place of a range, the rightmost among equals.

    longest: the most places of a range that is asked for; longer ranges need no levels.
    """

    def __init__(self, values: np.ndarray, longest: int | None = None) -> None:
        n = len(values)
        self.n = max(n, 1)
        kind = np.int32 if (int(values.max(initial=0)) + 1) * self.n < 1 << 31 else np.int64
        self.levels = [values.astype(kind) * kind(self.n) + np.arange(n, dtype=kind)]
        step = 1
        while 2 * step <= min(n, longest or n):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[: n - 2 * step + 1], last[step : n - step + 1]))
            step *= 2

    def place(self, low: int, high: int) -> int:
        """Of low <= place < high."""
        k = (high - low).bit_length() - 1
        return int(max(self.levels[k][low], self.levels[k][high - (1 << k)]) % self.n)


def pieces(text: str, size: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(first word, word after the last, start, end, start of what is new) of each piece; start and end are code points."""
    spans = np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)
    n = len(spans)
    if n <= size:
        return [(0, n, 0, len(text), 0)]
    table = Strongest(strengths(text, spans), size + 1)
    starts = [0, *spans[1:, 0].tolist(), len(text)]
    out, first, new = [], 0, 0
    while True:
        if n - first <= size:
            out.append((first, n, starts[first], len(text), starts[new]))
            return out
        low = first + max(overlap + 1, int(size * LEAST_SHARE), 1)
        after = table.place(low - 1, first + size) + 1  # the boundary after word k is before word k + 1
        out.append((first, after, starts[first], starts[after], starts[new]))
        first, new = after - overlap, after


def configurations(configs: DataFrame) -> DataFrame:
    """(tenant_id, size, overlap): the row in force of each tenant that has rows; null values where it isn't valid."""
    row = F.struct(F.col("updated_at").isNotNull(), "updated_at", "config_id", "chunk_size", "chunk_overlap", "min_chunk_size")
    last = configs.groupBy("tenant_id").agg(F.max(row).alias("r")).select("tenant_id", "r.*")
    valid = (F.col("chunk_size") > 0) & (F.col("chunk_overlap") >= 0) & (F.col("chunk_overlap") < F.col("chunk_size")) & (F.col("min_chunk_size") <= F.col("chunk_size"))
    return last.select("tenant_id", F.when(valid, F.col("chunk_size")).cast("int").alias("size"), F.when(valid, F.col("chunk_overlap")).cast("int").alias("overlap"))


def once(rows: DataFrame) -> DataFrame:
    """One row per id. Only rows whose id comes again are moved, as long as such ids are few; which of them is kept isn't defined."""
    again = stage(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "again")
    if again.count() > FEW_IDS:
        return rows.dropDuplicates(["id"])
    few = F.broadcast(again)
    return rows.join(few, "id", "left_anti").unionByName(rows.join(few, "id", "left_semi").dropDuplicates(["id"]))


def split(chunks: DataFrame, configs: DataFrame, only_oversized: bool = False) -> DataFrame:
    """(id, piece_no, n_pieces, n_words, start, end, new_start, text) of each chunk, in the size in force for its tenant.

    chunks: id, tenant_id, text. start and end count code points in the chunk's text; what lies from new_start to end is new.
    only_oversized: leave out chunks that are one piece.
    """
    spark = chunks.sparkSession
    force = configurations(configs)
    default = force.where(F.col("tenant_id").isNull() & F.col("size").isNotNull()).first()
    base = (default["size"], default["overlap"]) if default else (SIZE, OVERLAP)
    own = force.where(F.col("tenant_id").isNotNull() & F.col("size").isNotNull())
    rows = spread(chunks.select("id", "tenant_id", "text").where(F.col("id").isNotNull() & F.col("text").isNotNull()))
    if not only_oversized:
        rows = once(rows)
    if own.count() <= FEW_TENANTS:
        held = spark.sparkContext.broadcast({r["tenant_id"]: (r["size"], r["overlap"]) for r in own.collect()})
        rows = rows.withColumn("size", F.lit(None).cast("int")).withColumn("overlap", F.lit(None).cast("int"))
    else:
        held = spark.sparkContext.broadcast({})
        rows = left_join(rows, own, ["tenant_id"]).select("id", "tenant_id", "text", "size", "overlap")
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    named = ["id", "piece_no", "n_pieces", "n_words", "start", "end", "new_start", "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held_chars = 0
            for i, tenant, text, size, overlap in zip(*(batch.column(c).to_pylist() for c in ("id", "tenant_id", "text", "size", "overlap")), strict=True):
                size, overlap = (size, overlap) if size is not None else held.value.get(tenant, base)
                if len(text) < 2 * size or (n := count_words(text)) <= size:
                    if not only_oversized:
                        out.append((i, 0, 1, count_words(text), 0, len(text), 0, text))
                        held_chars += len(text)
                else:
                    parts = pieces(text, size, overlap)
                    out += [(i, k, len(parts), b - a, s, e, new, text[s:e]) for k, (a, b, s, e, new) in enumerate(parts)]
                    held_chars += len(text)
                if held_chars > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], named)
                    out, held_chars = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], named)

    found = rows.mapInArrow(cut, "id string, piece_no int, n_pieces int, n_words int, start int, end int, new_start int, text string")
    return found.dropDuplicates(["id", "piece_no"]) if only_oversized else found
