"""Mixing sources to target shares of all tokens, with a cap on how often a text is repeated.

Tokens are counted with a public tokenizer and summed per source. The total is the largest that every target can reach; from
it follow each source's repetition rate and, floor(rate) times plus once more with a probability of the fraction, drawn by a
hash of seed, mix, source and text, each text's number of copies. A source that can't reach its share with max_repeats
copies of each of its texts limits nothing: it is used max_repeats times, and the others keep their proportions, or, with
strict, the total shrinks until every share is met.

Copies of one text in a source are one text: it is emitted for its smallest id only, so that max_repeats holds for texts.

Cases: source spellings are compared in lower case, with blanks, dashes and underscores as one underscore; a null source has
no target. Null and empty texts have no tokens and are left out. Percentages (a mix whose shares sum to more than 1.5) are
divided by 100 and shares are normalised over the sources that have a text. Targets repeated with one spelling are added
up, with the smallest cap. Sources without a target have rate 0. Empty tables give empty results; ties don't occur.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.storage import spread, stage

SEED = 17
#: Texts are tokenised in parts of so many characters at most, cut before white space.
PART = 1 << 18


@lru_cache(4)
def tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Rows of rates, one per mix and source, that are broadcast at most.
MOST_RATES = 100_000


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and word pattern of a public tokenizer that is installed beside this library."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART:
        end = at + PART
        while end > at + PART // 2 and not (text[end].isspace() and not text[end - 1].isspace()):
            end -= 1
        yield text[at:end]
        at = end
    yield text[at:]


def source_key(source: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), r"(?U)[\s_-]+", "_")
    return F.when(bare != "", bare)


def counted(documents: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """(doc_id, source, text_hash, tokens) of every document with text; the source as key."""
    path, pattern = vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            n = [sum(len(t.encode_ordinary(p)) for p in parts(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("text_hash"), pa.array(n, pa.int64())], ["doc_id", "source", "text_hash", "tokens"])

    rows = documents.where(F.col("text").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), F.sha2("text", 256).alias("text_hash"), "text")
    return spread(rows).mapInArrow(count, "doc_id long, source string, text_hash string, tokens long")


def texts(found: DataFrame) -> DataFrame:
    """One row per source and text, with its smallest id. Partial minima are made before the shuffle."""
    return found.groupBy("source", "text_hash").agg(F.min("doc_id").alias("doc_id"), F.min("tokens").alias("tokens"))


def targets(table: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats) with shares as parts of one."""
    rows = table.where(F.col("mix_name").isNotNull() & F.col("target_share").isNotNull()).select("mix_name", source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where(F.col("source").isNotNull())
    one = rows.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    whole = one.groupBy("mix_name").agg(F.sum("target_share").alias("whole"))
    share = F.when(F.col("whole") > 1.5, F.col("target_share") / 100).otherwise(F.col("target_share"))
    return one.join(whole, "mix_name").select("mix_name", "source", share.alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))


def rates(found: DataFrame, table: DataFrame, strict: bool = True) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, source_tokens, share, total, rate) of each target that has texts.

    strict: the total is the largest at which no source needs more than max_repeats copies of its texts; otherwise the
    largest that any source can reach, with rates cut at max_repeats. share: the target over the targets that have texts.
    """
    sums = found.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    both = targets(table).join(sums, "source").where((F.col("source_tokens") > 0) & (F.col("target_share") > 0))
    whole = both.groupBy("mix_name").agg(F.sum("target_share").alias("there"))
    shared = both.join(whole, "mix_name").withColumn("share", F.col("target_share") / F.col("there"))
    reach = F.col("source_tokens") * F.col("max_repeats") / F.col("share")
    total = shared.groupBy("mix_name").agg((F.min if strict else F.max)(reach).alias("total"))
    rate = F.least(F.col("share") * F.col("total") / F.col("source_tokens"), F.col("max_repeats").cast("double"))
    return shared.join(total, "mix_name").withColumn("rate", rate).drop("there")


def copies(found: DataFrame, rated: DataFrame, seed: int = SEED) -> DataFrame:
    """(mix_name, source, doc_id, tokens, n_copies) of every text that a mix uses at least once. rated: as rates gives it.

    Rates are broadcast up to MOST_RATES, and joined by shuffling beyond.
    """
    unit = F.pmod(F.xxhash64(F.lit(seed), "mix_name", "source", "text_hash"), F.lit(1 << 40)) / float(1 << 40)
    few = rated.select("mix_name", "source", "rate", "max_repeats")
    drawn = found.join(F.broadcast(few) if few.count() <= MOST_RATES else few, "source")
    n = F.floor("rate") + (unit < F.col("rate") - F.floor("rate")).cast("long")
    return drawn.withColumn("n_copies", F.least(n, F.col("max_repeats")).cast("int")).where("n_copies > 0").select("mix_name", "source", "doc_id", "tokens", "n_copies")


def mixed(documents: DataFrame, table: DataFrame, vocabulary: tuple[str, str], strict: bool = True, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The copies of each mix, and the report (mix_name, source, target_share, actual_share, rate, tokens, n_texts, n_copies)."""
    found = stage(texts(counted(documents, vocabulary)), "texts")
    rated = stage(rates(found, table, strict), "rates")
    taken = copies(found, rated, seed)
    got = taken.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("n_copies")).alias("tokens"), F.count(F.lit(1)).alias("n_texts"), F.sum("n_copies").alias("n_copies"))
    wanted = targets(table).join(rated.select("mix_name", "source", "rate"), ["mix_name", "source"], "left")
    both = wanted.join(got, ["mix_name", "source"], "left")
    whole = got.groupBy("mix_name").agg(F.sum("tokens").alias("whole"))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    actual = F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share")
    return taken, both.join(whole, "mix_name", "left").select("mix_name", "source", "target_share", actual, zero("rate", "double"), zero("tokens", "long"), zero("n_texts", "long"), zero("n_copies", "long"))
