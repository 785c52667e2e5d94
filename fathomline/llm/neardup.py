"""Near-duplicate texts: exact set-similarity join over word n-grams, with a prefix tree.

Each text is the set of its word n-grams, ordered by one global order, rarest first; read as strings over that order, the
sets form a prefix tree. Two sets with a Jaccard similarity of at least t share at least o = ceil(t/(1+t)(a+b)) n-grams, so
that at least m of these stand at depths below a - o + m in the one and b - o + m in the other: only that deep the tree is
stored, spread over the cluster by n-gram. At each node (an n-gram, and who holds it at which depth) pairs whose remaining
length can't reach the overlap are pruned, and pairs that share fewer than m = MEET nodes in all are dropped (fewer than o,
where o is less). What is left is verified by walking a tree of each text's partners, in which partners with a common
prefix share the partial overlap and a branch ends once its remaining length can't reach the bound.

Nothing is approximate but hash equality (48 bits an n-gram, 64 bits a text's class). Only the order comes from a sketch:
occurrence counts of hashed n-grams, and of hashed words, in a table of at most 2**MAX_BITS cells of one byte and half of
that, summed over all texts in stages of MERGE tables each. Any global order gives the same result; a rarer-first one is
merely faster, and a cell that counts one proves an n-gram, or a word and all n-grams with it, unique. In a collection that is
large for the table most of a cell's count is other n-grams'. What all cells have in common is taken off then: n-grams that
stand out are still put last, and the rest is ordered by their rarest words, of which there are far fewer than n-grams. So the
work a text stays about the same beyond the table's size, which nothing switches on.

Cases: null and blank texts, rows without an id, and texts of fewer than n words are in no pair. Re-delivered rows (same id) count once.
Equal sets are one class and are joined once, whatever their number. Very long texts are hashed in blocks. Empty tables
give empty results, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.wordhash import mix, sequences, words
from fathomline.operators.skew import left_join
from fathomline.storage import spread, stage

#: The sketch that orders the n-grams has at most 2**MAX_BITS cells of a byte, and half as many for words; that is what is broadcast at most.
MAX_BITS = 25
SLICES, WORD_SLICES = 64, 32
#: Partial tables that one task sums up.
MERGE = 32
#: Texts that are sorted at once: their number fits the top byte of a sort key.
DOCS = 256
#: Postings a bucket of the tree should hold, and postings of one n-gram that one task pairs at once.
BUCKET_ROWS, NODE_ROWS = 1_000_000, 4096
#: Nodes that a pair has to share.
MEET = 4
#: Ids of texts to be verified are broadcast up to so many (40 bytes each), and joined by shuffling beyond.
FEW_IDS = 1_000_000
ID = (1 << 48) - 1
_U = np.uint64


def overlap(t: Fraction, a, b):
    """The least number of n-grams that sets of a and b share if their similarity is at least t."""
    n, d = t.numerator, t.numerator + t.denominator
    return -(-n * (a + b) // d)


def smallest_partner(t: Fraction, a):
    return -(-t.numerator * a // t.denominator)


def level(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte that keeps their order: exact up to 191, then by binary logarithm."""
    big = np.minimum(255, 192 + 4 * (np.log2(np.maximum(counts, 192)) - np.log2(192)))
    return np.where(counts < 192, counts, big).astype(np.uint8)


def count_of(levels: np.ndarray) -> np.ndarray:
    """About the count that a byte of level() stands for."""
    x = levels.astype(np.float64)
    return np.where(x < 192, x, 192 * 2 ** ((x - 192) / 4))


def rarities(levels: np.ndarray) -> np.ndarray:
    """Levels of n-grams as numbers up to 31, 2 a doubling: 0 for those that occur once, 2 or more for others.

    What the middle cell counts, and three deviations, are other n-grams' in all cells: nothing as long as the table is large enough.
    """
    counts = count_of(np.arange(256))
    middle = counts[int(np.searchsorted(np.cumsum(np.bincount(levels, minlength=256)), len(levels) // 2))]
    noise = middle + 3 * np.sqrt(middle) if middle >= 4 else 0.0
    own = np.where(counts <= 1, counts, np.maximum(2, counts - noise))
    return np.minimum(31, np.round(2 * np.log2(np.maximum(own, 1)))).astype(np.uint8)[levels]


def word_rarities(levels: np.ndarray) -> np.ndarray:
    """Levels of words as numbers up to 7, one for two doublings: 0 for those that occur once."""
    counts = count_of(np.arange(256))
    return np.where(counts <= 1, 0, np.minimum(7, 1 + np.log2(np.maximum(counts, 2)) // 2)).astype(np.uint8)[levels]


def least_count(rarity: np.ndarray) -> np.ndarray:
    """About the count that an n-gram's number of rarities() stands for."""
    return 2.0 ** (rarity.astype(np.float64) / 2)


def gaps(cells: np.ndarray, number: np.ndarray) -> tuple[bytes, bytes]:
    """Rising cells as bytes of their distances, with cells that count nothing where a distance needs more than a byte."""
    step = np.diff(cells, prepend=0)
    fill = step // 255
    at = np.arange(len(cells)) + np.cumsum(fill)
    far, counts = np.full(len(cells) + int(fill.sum()), 255, np.uint8), np.zeros(len(cells) + int(fill.sum()), np.uint8)
    far[at], counts[at] = step % 255, number
    return far.tobytes(), counts.tobytes()


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("text").to_pylist()


def sketch(texts: DataFrame, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """How often hashed n-grams and hashed words occur in all texts, as 2**bits and 2**(bits - 1) levels; texts has a column text."""
    width = bits - 6
    n_slices = SLICES + WORD_SLICES

    def count(index: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        fresh: list[np.ndarray] = []
        size = 0

        def fold() -> None:
            cells, number = np.unique(np.concatenate(fresh), return_counts=True)
            kept.append((cells, number.astype(np.uint32)))
            fresh.clear()

        def merged() -> tuple[np.ndarray, np.ndarray]:
            cells = np.concatenate([c for c, _ in kept])
            order = np.argsort(cells, kind="stable")
            cells, number = cells[order], np.concatenate([x for _, x in kept])[order]
            first = np.flatnonzero(np.diff(cells, prepend=-1))
            return cells[first], np.add.reduceat(number, first)

        def out() -> Iterator[pa.RecordBatch]:
            cells, number = merged()
            number = np.minimum(number, 255).astype(np.uint8)
            ends = np.searchsorted(cells, np.arange(n_slices + 1) << width)
            rows = [(k, index, *gaps(cells[a:b] & ((1 << width) - 1), number[a:b])) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slice", "part", "cells", "number"])

        for batch in batches:
            hashes, counts = words(_texts(batch))
            g, _, _ = sequences(hashes, counts, n)
            if len(g):
                fresh += [cells_of(g, 1 << bits), cells_of(hashes, 1 << bits - 1) + (1 << bits)]
                size += len(g) + len(hashes)
                if size > 1 << 21:
                    fold()
                    size = 0
                    if sum(len(c) for c, _ in kept) > 1 << 24:
                        yield from out()
                        kept.clear()
        if fresh:
            fold()
        if kept:
            yield from out()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return count(TaskContext.get().partitionId(), batches)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << width, np.uint32)
        for cells, number in zip(table.column("cells").to_pylist(), table.column("number").to_pylist(), strict=True):
            if cells is None:  # a sum of an earlier stage
                total += np.frombuffer(number, "<u4")
            else:
                total[np.cumsum(np.frombuffer(cells, np.uint8), dtype=np.int64)] += np.frombuffer(number, np.uint8)
        one = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("slice", "part")]
        return pa.table([*one, pa.array([None], pa.binary()), pa.array([total.tobytes()], pa.binary())], ["slice", "part", "cells", "number"])

    kind = "slice int, part int, cells binary, number binary"
    parts = texts.select("text").mapInArrow(numbered, kind)
    n_parts = texts.rdd.getNumPartitions()
    while True:
        n_parts = -(-n_parts // MERGE)
        parts = parts.withColumn("part", F.col("part") % n_parts).groupBy("slice", "part").applyInArrow(add, kind)
        if n_parts == 1:
            break
    to_level = lambda table: pa.table([table.column("slice"), pa.array([level(np.frombuffer(x.as_py(), "<u4")).tobytes() for x in table.column("number")], pa.binary())], ["slice", "levels"])
    small = parts.select("slice", "number").mapInArrow(lambda batches: (b for x in batches for b in to_level(pa.Table.from_batches([x])).to_batches()), "slice int, levels binary")
    levels = np.zeros((n_slices, 1 << width), np.uint8)
    for row in small.collect():  # 3/2 of 2**bits bytes, at most of 2**MAX_BITS
        levels[row["slice"]] = np.frombuffer(row["levels"], np.uint8)
    return levels[:SLICES].reshape(-1), levels[SLICES:].reshape(-1)


def cells_of(hashes: np.ndarray, size: int) -> np.ndarray:
    return ((hashes >> _U(16)) & _U(size - 1)).astype(np.int64)


def ordered_sets(texts: list[str | None], n: int, rarity: tuple[np.ndarray, np.ndarray] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For up to DOCS texts at once: the first text's index, all texts' ordered sets one after another, the sets' sizes.

    rarity: of n-grams and of words, by cell. An element has its place in the order in its top 16 bits (0 without rarity): the
    n-gram's rarity times 8, plus its rarest word's. In the other 48 bits it has its id.
    """
    hashes, counts = words(texts)
    ends = np.cumsum(counts)
    for first in range(0, len(texts), DOCS):
        own = counts[first : first + DOCS]
        start = int(ends[first] - counts[first])
        mine = hashes[start : start + int(own.sum())]
        g, doc, at = sequences(mine, own, n)
        key = (doc.astype(np.uint64) << _U(56)) | (g >> _U(16))
        if rarity is not None and len(g):
            word = rarity[1][cells_of(mine, len(rarity[1]))]
            least = word[at]
            for k in range(1, n):
                least = np.minimum(least, word[at + k])
            key |= (rarity[0][cells_of(g, len(rarity[0]))].astype(np.uint64) << _U(51)) | (least.astype(np.uint64) << _U(48))
        key = np.unique(key)
        yield first, key & _U((1 << 56) - 1), np.bincount((key >> _U(56)).astype(np.int64), minlength=len(own))


def classes(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, equal for equal sets; 0 for empty ones."""
    h = mix((elements & _U(ID)) * _U(0x9E3779B97F4A7C15) + _U(1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    named = mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64))
    return np.where(sizes > 0, named, _U(0)).view(np.int64)


def members(rows: DataFrame, n: int) -> DataFrame:
    """(id, class, size) of every text of at least n words; rows has the columns id and text."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for first, elements, sizes in ordered_sets(_texts(batch), n, None):
                some = np.flatnonzero(sizes > 0)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(sizes)).take(pa.array(some)), pa.array(classes(elements, sizes)[some]), pa.array(sizes[some].astype(np.int32))], ["id", "class", "size"])

    return rows.select("id", "text").mapInArrow(describe, "id string, class long, size int")


def nodes(texts: DataFrame, n: int, t: Fraction, rarity, buckets: int) -> DataFrame:
    """The upper part of the tree, as blocks of postings (who holds an n-gram at which depth) by bucket of n-grams."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            token, rank, length, name = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (mix(token) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            token, rank, length, name = token[order], rank[order], length[order], name[order]
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if b > a:
                    own, where = np.unique(name[a:b], return_index=True)
                    rows.append((k, token[a:b].astype("<u4").tobytes(), (token[a:b] >> _U(32)).astype("<u2").tobytes(), np.searchsorted(own, name[a:b]).astype("<u4" if len(own) > 65536 else "<u2").tobytes(), rank[a:b].astype("<u4" if rank[a:b].max() > 65535 else "<u2").tobytes(), own.tobytes(), length[a:b][where].astype("<i4").tobytes()))
            kinds = (pa.int32(), *[pa.binary()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "low", "high", "doc", "rank", "names", "sizes"])

        for batch in batches:
            for _, elements, sizes in ordered_sets(_texts(batch), n, rarity.value):
                starts = np.cumsum(sizes) - sizes
                rank = np.arange(len(elements)) - np.repeat(starts, sizes)
                length = np.repeat(sizes, sizes)
                high = elements >> _U(48)
                keep = np.flatnonzero((rank < length - overlap(t, length, smallest_partner(t, length)) + MEET) & (high >= 8) & (high & _U(7) > 0))  # others are unique
                if not len(keep):
                    continue
                token, rank, length, high = elements[keep] & _U(ID), rank[keep], length[keep], high[keep]
                name = np.repeat(classes(elements, sizes), sizes)[keep]
                blocks = np.maximum(1, np.ceil(least_count(high >> _U(3)) / NODE_ROWS)).astype(np.int64)
                if blocks.max() > 1:  # an n-gram that very many hold: its postings meet block by block
                    many, one = np.flatnonzero(blocks > 1), np.flatnonzero(blocks == 1)
                    own = (mix(name[many].view(np.uint64)) % blocks[many].astype(np.uint64)).astype(np.int64)
                    again = np.repeat(np.arange(len(many)), blocks[many])
                    other = np.arange(len(again)) - np.repeat(np.cumsum(blocks[many]) - blocks[many], blocks[many])
                    lo, hi = np.minimum(own[again], other), np.maximum(own[again], other)
                    split = mix(token[many][again] + mix((lo * 65536 + hi + 1).astype(np.uint64))) & _U(ID)
                    pick = np.concatenate([one, many[again]])
                    token, rank, length, name = np.concatenate([token[one], split]), rank[pick], length[pick], name[pick]
                held.append((token, rank, length, name))
                size += len(token)
                if size > 400_000:
                    yield from out()
                    held.clear()
                    size = 0
        if held:
            yield from out()

    return texts.select("text").mapInArrow(post, "bucket int, low binary, high binary, doc binary, rank binary, names binary, sizes binary")


def _met(table: pa.Table, t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of classes that meet at a node and pass the bound on remaining lengths, and the nodes they need, some at a time."""
    token, rank, length, name = [], [], [], []
    for low, high, doc, r, names, sizes in zip(*(table.column(c).to_pylist() for c in ("low", "high", "doc", "rank", "names", "sizes")), strict=True):
        x = np.frombuffer(low, "<u4").astype(np.uint64)
        token.append(x | (np.frombuffer(high, "<u2").astype(np.uint64) << _U(32)))
        own = np.frombuffer(doc, f"<u{len(doc) // len(x)}")
        rank.append(np.frombuffer(r, f"<u{len(r) // len(x)}").astype(np.int32))
        length.append(np.frombuffer(sizes, "<i4")[own])
        name.append(np.frombuffer(names, "<i8")[own])
    token, rank, length, name = map(np.concatenate, (token, rank, length, name))
    order = np.argsort(token, kind="stable")
    token = token[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    count = np.diff(np.append(first, len(token)))
    some = np.repeat(count, count) > 1
    order, after = order[some], (np.repeat(first + count, count) - np.arange(len(token)) - 1)[some]
    rank, length, name = rank[order], length[order], name[order]
    ends = np.cumsum(after)
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000)))
        n = after[at:to]
        x = np.repeat(np.arange(at, to), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        a, b = length[x], length[y]
        o = overlap(t, a.astype(np.int64), b.astype(np.int64))
        ok = (rank[x] < a - o + MEET) & (rank[y] < b - o + MEET) & (name[x] != name[y])
        x, y = name[x[ok]], name[y[ok]]
        yield np.minimum(x, y), np.maximum(x, y), np.minimum(o[ok], MEET)
        at = to


def candidates(tree: DataFrame, t: Fraction) -> DataFrame:
    """Distinct pairs (c1, c2), c1 < c2, of classes that share enough nodes to be similar."""
    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("met", pa.int64()), ("need", pa.int64())])

    def meet(table: pa.Table) -> pa.Table:
        out = []
        for a, b, need in _met(table, t):
            order = np.lexsort((b, a))
            a, b, need = a[order], b[order], need[order]
            first = np.flatnonzero((np.diff(a, prepend=0) != 0) | (np.diff(b, prepend=0) != 0) | (np.arange(len(a)) == 0))
            out.append(pa.table([pa.array(x) for x in (a[first], b[first], np.diff(np.append(first, len(a))), need[first])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    # a pair in two of a split n-gram's blocks may be counted more than once, which drops nothing
    met = tree.groupBy("bucket").applyInArrow(meet, "c1 long, c2 long, met long, need long")
    return met.groupBy("c1", "c2").agg(F.sum("met").alias("met"), F.first("need").alias("need")).where(F.col("met") >= F.col("need")).select("c1", "c2")


def _similar(own: np.ndarray, partners: list[tuple[int, np.ndarray]], t: Fraction) -> Iterator[tuple[int, int]]:
    """(partner, overlap) of the partners similar to own, by a walk through the prefix tree of the partners' sets.

    The partners are visited in the tree's order; one that shares a prefix with the one before it starts with the partial
    overlap at the end of that prefix. A branch is left once what remains of either set can't reach the overlap.
    """
    last, partial = np.zeros(0, np.uint64), np.zeros(1, np.int64)
    for name, theirs in sorted(partners, key=lambda p: p[1].tobytes()):
        m = min(len(last), len(theirs), len(partial) - 1)
        differ = np.flatnonzero(last[:m] != theirs[:m])
        depth = int(differ[0]) if len(differ) else m
        need = int(overlap(t, len(own), len(theirs)))
        sums, reached = [partial[: depth + 1]], int(partial[depth])
        alive = reached + len(theirs) - depth >= need
        while alive and depth < len(theirs):
            step = theirs[depth : depth + 64]
            place = np.searchsorted(own, step)
            hit = own[np.minimum(place, len(own) - 1)] == step
            sums.append(reached + np.cumsum(hit))
            reached = int(sums[-1][-1])
            depth += len(step)
            alive = reached + min(len(theirs) - depth, len(own) - int(np.searchsorted(own, step[-1], "right"))) >= need
        last, partial = theirs, np.concatenate(sums)
        if alive and reached >= need:
            yield name, reached


def verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (c1, c2) whose similarity is at least t, with their overlap and sizes. sets: (class, elements)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1, c2 = batch.column("c1").to_pylist(), batch.column("c2").to_pylist()
            s1, s2 = batch.column("s1"), batch.column("s2")
            out, at = [], 0
            while at < len(c1):
                to = at
                while to < len(c1) and c1[to] == c1[at]:
                    to += 1
                own = np.frombuffer(s1[at].as_py(), np.uint64)
                out += [(c1[at], name, found, len(own)) for name, found in _similar(own, [(c2[k], np.frombuffer(s2[k].as_py(), np.uint64)) for k in range(at, to)], t)]
                at = to
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["c1", "c2", "shared", "size1"])

    both = pairs.join(sets.select(F.col("class").alias("c1"), F.col("elements").alias("s1")), "c1").join(sets.select(F.col("class").alias("c2"), F.col("elements").alias("s2")), "c2")
    return both.sortWithinPartitions("c1").mapInArrow(walk, "c1 long, c2 long, shared long, size1 long")


def element_sets(rows: DataFrame, n: int, rarity) -> DataFrame:
    """(class, elements) of each text: its ordered set as bytes."""

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, elements, sizes in ordered_sets(_texts(batch), n, rarity.value):
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(classes(elements, sizes)), pa.array([elements[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)], pa.binary())], ["class", "elements"])

    return rows.select("text").mapInArrow(blobs, "class long, elements binary")


def similar_classes(rows: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Members (id, class, size) and links (c1, c2) between different classes with a similarity of at least threshold.

    rows has the columns id and text.
    """
    t = Fraction(threshold).limit_denominator(1000)
    rows = spread(rows.select("id", "text").where(F.col("id").isNotNull() & F.col("text").isNotNull()))
    spark = rows.sparkSession
    count = rows.count()
    bits = min(MAX_BITS, max(16, (128 * count).bit_length()))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 64 * count // BUCKET_ROWS)
    grams, single = sketch(rows, n, bits)
    rarity = spark.sparkContext.broadcast((rarities(grams), word_rarities(single)))
    who = stage(members(rows, n).distinct(), "members")
    left = stage(candidates(nodes(rows, n, t, rarity, buckets), t), "close")
    close = left.select(F.col("c1").alias("class")).unionByName(left.select(F.col("c2").alias("class"))).distinct()
    ids = stage(who.join(close, "class", "left_semi").groupBy("class").agg(F.min("id").alias("id")).select("id"), "ids")
    ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    sets = element_sets(rows.join(ids, "id", "left_semi"), n, rarity).dropDuplicates(["class"])
    links = stage(verified(left, sets, t).select("c1", "c2"), "links")
    return who, links


def linked(rows: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, class, n_copies, n_links): of each text its class of equal sets, that class's texts, and similar texts of other classes.

    Copies aren't expanded into pairs.
    """
    who, links = similar_classes(rows, n, threshold)
    sizes = who.groupBy("class").agg(F.count(F.lit(1)).alias("n_copies"))
    both = links.select(F.col("c1").alias("class"), F.col("c2").alias("other")).unionByName(links.select(F.col("c2").alias("class"), F.col("c1").alias("other")))
    theirs = both.join(sizes.select(F.col("class").alias("other"), F.col("n_copies").alias("n")), "other").groupBy("class").agg(F.sum("n").alias("n_links"))
    described = stage(sizes.join(theirs, "class", "left"), "described")
    return left_join(who.select("id", "class"), described, ["class"]).select("id", "class", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def pairs(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """Every pair of ids (a < b) whose texts are that similar, equal texts included."""
    who, links = similar_classes(rows, n, threshold)
    own = who.select("id", "class")
    a, b = own.select(F.col("id").alias("x"), F.col("class").alias("c1")), own.select(F.col("id").alias("y"), F.col("class").alias("c2"))
    across = links.join(a, "c1").join(b, "c2").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    several = own.groupBy("class").count().where("count > 1").select("class")
    copies = own.join(several, "class", "left_semi")
    same = copies.select(F.col("id").alias("a"), "class").join(copies.select(F.col("id").alias("b"), "class"), "class").where("a < b").select("a", "b")
    return across.unionByName(same)
