"""The k most similar vectors of every vector: randomly rotated one-bit codes, estimates with error bounds, and reranking.

Vectors are compared by cosine within a group (model, version and length). Each vector is put into the CELLS nearest of the
cells of its group; a cell is the neighbourhood of a centre, and centres are a hash sample of the vectors themselves, so
that dense regions get more of them. Centres so near that the cells between them would cut a dense region are joined, with
all that are linked through others, to one cell. Two vectors meet if they share a cell. In a cell, residuals to its mean are rotated and
kept as one bit a dimension with two correction scalars; from packed bits, inner products are estimated with an error
bound, and only vectors whose upper bound reaches the threshold are compared exactly, and where these are many, only those
whose upper bound reaches the k-th largest of the lower bounds.

Bounds: the centres of all groups together are at most MAX_CENTRES, and are what is broadcast. A cell that holds more
than CELL_MOST vectors is split into blocks that meet pairwise, so that no task gets an unbounded group. Equal vectors are
collapsed first and expanded last: of each, only as many ids are kept as can be an answer.

Cases: null, empty and all-zero vectors, vectors with a null, NaN or infinity, and null keys take no part. Rows repeated
under an id count once. Ties are broken by id. Groups of a single vector give no pair. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.keys import trimmed, uuid_key
from fathomline.storage import stage

#: Vectors a cell should be the nearest of, cells a vector is put into, and the most centres there are.
CELL_ROWS, CELLS, MAX_CENTRES = 400, 3, 65_536
#: Centres are joined if, seen from centres that are that similar, pairs at the threshold have residuals of less than this cosine.
LINKED = 2 / 3
#: From that share of candidate pairs on, they are pruned by the k-th best of a row, too.
DENSE = 0.05
#: A cell with more rows is split into blocks of that many.
CELL_MOST = 8192
#: Standard errors of an estimate that the bound allows for.
ERRORS = 3.5
#: What is added to an estimate for the rounding of queries to four bits; distance to a centre below which bounds mean nothing.
SLACK, NEAR = 0.02, 1e-4
SEED = 20240229


def usable(vector: Column) -> Column:
    """True for vectors that are not null, not empty, finite throughout and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(rows: DataFrame) -> DataFrame:
    """(id, owner, grp, vid, vector) of the usable embeddings. owner: the chunk's key as UUID, else as written; vid names a group's vector."""
    own = F.coalesce(uuid_key(F.col("content_chunk_id")), F.lower(trimmed(F.col("content_chunk_id"))))
    group = F.xxhash64(F.col("model_name"), F.col("model_version"), F.col("model_version").isNull(), F.size("embedding"))
    kept = rows.where(F.col("content_chunk_id").isNotNull() & F.col("id").isNotNull() & usable(F.col("embedding")))
    return kept.select("id", own.alias("owner"), group.alias("grp"), F.col("embedding").cast("array<float>").alias("vector")).withColumn("vid", F.xxhash64("grp", "vector"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    return np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))[0].astype(np.float32)


class Codes:
    """One-bit codes of unit vectors around a centre.

    A vector o has the residual r = |o - c| and the bits of the rotated direction; s is the inner product of the
    direction with its code, the second correction scalar.
    """

    def __init__(self, x: np.ndarray, centre: np.ndarray) -> None:
        d = x.shape[1]
        y = (x - centre) @ rotation(d)
        self.norm = np.linalg.norm(y, axis=1)
        self.unit = y / np.maximum(self.norm, 1e-12)[:, None]
        self.bits = np.packbits(self.unit > 0, axis=1)
        pad = -self.bits.shape[1] % 8
        self.bits = np.ascontiguousarray(np.pad(self.bits, ((0, 0), (0, pad)))).view(np.uint64)
        self.scale = np.maximum(np.abs(self.unit).sum(1) / math.sqrt(d), 1e-6)
        self.error = np.sqrt(np.maximum(0, 1 - self.scale**2)) / self.scale / math.sqrt(max(d - 1, 1))
        self.d = d

    def planes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries as four bit planes: the packed planes, the step and the lowest value of each."""
        low, high = self.unit.min(1), self.unit.max(1)
        step = np.maximum((high - low) / 15, 1e-12)
        level = np.rint((self.unit - low[:, None]) / step[:, None]).astype(np.uint8)
        packed = []
        for k in range(4):
            p = np.packbits((level >> k) & 1, axis=1)
            packed.append(np.ascontiguousarray(np.pad(p, ((0, 0), (0, -p.shape[1] % 8)))).view(np.uint64))
        return np.stack(packed), step, low

    def reaching(self, rows: slice, planes: tuple[np.ndarray, np.ndarray, np.ndarray], least: float) -> np.ndarray:
        """For these rows, as queries, which rows have an upper bound of the cosine of at least least.

        With a = |q - c| and b = |o - c|, cos = 1 - (a a + b b - 2 a b inner) / 2, so that the bound holds from some inner
        product on, and, as the estimate is linear in the popcount of q's levels under o's bits, from some popcount on.
        That popcount is a sum of five products of a number of q and a number of o: one matrix product of depth five.
        """
        packed, step, low = planes
        d = self.d
        step, low, a, b = step[rows], low[rows], np.maximum(self.norm[rows], 1e-9), np.maximum(self.norm, 1e-9)
        levels = sum(np.bitwise_count(packed[k, rows]).sum(1, dtype=np.int64) << k for k in range(4))
        q_sum = step * levels + d * low
        half = math.sqrt(d) * self.scale / 2
        left = np.stack([(a * a - 2 * (1 - least)) / (2 * a), 1 / (2 * a), np.ones_like(a), q_sum / 2, -low]) / step
        right = np.stack([half / b, half * b, -half * (ERRORS * self.error + SLACK), np.ones_like(b), np.bitwise_count(self.bits).sum(1, dtype=np.int64)])
        need = left.T.astype(np.float32) @ right.astype(np.float32)
        dot = np.zeros(need.shape, np.uint16)
        for w in range(self.bits.shape[1]):
            bits = self.bits[None, :, w]
            under = lambda k: np.bitwise_count(packed[k, rows, w][:, None] & bits)  # noqa: E731, B023
            # counts of a word are at most 64, so that three times that fits a byte
            dot += (under(0) + (under(1) << 1)).astype(np.uint16) + ((under(2) + (under(3) << 1)).astype(np.uint16) << 2)
        return (dot >= need) | (a < NEAR)[:, None] | (b < NEAR)[None, :]


    def bounds(self, rows: slice, planes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For these rows, as queries, estimates of the cosines with all rows, and what they may be off by."""
        packed, step, low = planes
        d = self.d
        step, low, a = step[rows], low[rows], self.norm[rows]
        dot = np.zeros((len(a), len(self.bits)), np.float32)
        for k in range(4):
            for w in range(self.bits.shape[1]):
                dot += np.bitwise_count(packed[k, rows, w][:, None] & self.bits[None, :, w]) * np.float32(1 << k)
        levels = sum(np.bitwise_count(packed[k, rows]).sum(1, dtype=np.int64) << k for k in range(4))
        ones = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        # the rotated query under the code's signs: twice its sum under the set bits without its whole sum
        under = 2 * (step[:, None] * dot + low[:, None] * ones) - (step * levels + d * low)[:, None]
        inner = under / (math.sqrt(d) * self.scale)
        both = np.outer(a, self.norm)
        off = both * (ERRORS * self.error + SLACK / self.scale)
        off[(a < NEAR)[:, None] | (self.norm < NEAR)[None, :]] = 2
        return 1 - (a[:, None] ** 2 + self.norm**2) / 2 + both * inner, off


def chosen(q: np.ndarray, theirs: np.ndarray, cosine: np.ndarray, k: int, each: int) -> np.ndarray:
    """Which of the links are among each query's k best, of which each chunk (theirs) counts at most each times; ties are kept."""
    order = np.lexsort((-cosine, theirs, q))
    a, t, c = q[order], theirs[order], cosine[order]
    first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(t, prepend=-1) != 0))
    size = np.diff(np.append(first, len(a)))
    counted = np.arange(len(a)) - np.repeat(first, size) < each
    kept = counted | (c >= np.repeat(c[np.minimum(first + each, first + size) - 1], size))
    again = np.lexsort((-c, a))
    a, c = a[again], c[again]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    size = np.diff(np.append(first, len(a)))
    so_far = np.cumsum(counted[again])
    so_far -= np.repeat(so_far[first] - counted[again][first], size)
    last = np.full(len(first), -np.inf)
    at_k = np.flatnonzero(counted[again] & (so_far == k))
    last[np.searchsorted(first, at_k, "right") - 1] = c[at_k]
    out = np.zeros(len(q), bool)
    out[order[again]] = kept[again] & (c >= np.repeat(last, size))
    return out


def neighbours(x: np.ndarray, centre: np.ndarray, own: np.ndarray, k: int, each: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, other, cosine) of each row's up to k best others with a cosine of at least least, each chunk's counted at most each times.

    own: a name of the only chunk that a vector belongs to, 0 for several; vectors of one chunk don't meet.
    """
    theirs = np.unique(own, return_inverse=True)[1]
    theirs = np.where(own == 0, len(x) + np.arange(len(x)), theirs)
    codes = Codes(x, centre)
    planes = codes.planes()
    height = max(1, 2_000_000 // len(x))
    for at in range(0, len(x), height):
        rows = slice(at, min(at + height, len(x)))
        reach = codes.reaching(rows, planes, least - 1e-6)
        single = np.flatnonzero(own[rows] != 0)
        if len(x) > k and len(single) and reach.mean() > DENSE:
            # rows of one chunk see no others of it, so that their k best are among the k best of all: none of which is
            # less than the k-th largest of what the others are at least
            estimate, off = codes.bounds(rows, planes)
            least_of = np.where(own[rows][single][:, None] == own[None, :], -2, (estimate - off)[single])
            reach[single] &= (estimate + off)[single] >= np.partition(least_of, len(x) - k, axis=1)[:, len(x) - k, None]
        q, o = np.nonzero(reach)
        q += at
        differ = (q != o) & ((own[q] != own[o]) | (own[q] == 0))
        q, o = q[differ], o[differ]
        cosine = np.empty(len(q), np.float32)
        for i in range(0, len(q), 500_000):
            cosine[i : i + 500_000] = np.einsum("ij,ij->i", x[q[i : i + 500_000]], x[o[i : i + 500_000]])
        good = cosine >= least - 1e-6
        q, o, cosine = q[good], o[good], cosine[good]
        best = chosen(q, theirs[o], cosine, k, each)
        yield q[best], o[best], cosine[best]


def centres(distinct: DataFrame) -> dict[int, np.ndarray]:
    """The centres of each group: a hash sample of its vectors, about one in CELL_ROWS, at most MAX_CENTRES in all."""
    sizes = {r["grp"]: r["n"] for r in distinct.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # groups: models, versions and lengths
    total = sum(sizes.values())
    share = min(1 / CELL_ROWS, MAX_CENTRES / 2 / max(total, 1))
    wanted = {g: math.ceil(n * share) for g, n in sizes.items()}
    many = {g for g, n in wanted.items() if n > 1}
    out: dict[int, np.ndarray] = {}
    if many:
        cut = int(share * 2**32)
        drawn = distinct.where(F.col("grp").isin(*many) & (F.pmod(F.xxhash64("vid", F.lit(SEED)), F.lit(2**32)) < cut)).select("grp", "vid", "vector").orderBy("grp", "vid").limit(MAX_CENTRES).toArrow()
        groups = drawn.column("grp").to_numpy()
        for g in many & set(groups.tolist()):
            out[g] = matrix(drawn.filter(pa.array(groups == g)).column("vector"))
    return out


def joined(c: np.ndarray, least: float) -> np.ndarray:
    """Each centre's cell: the first centre that it is linked with, through any number of others."""
    near = (least - LINKED) / (1 - LINKED)
    n = len(c)
    cell = np.arange(n)
    linked = np.concatenate([((c[i : i + 512] @ c.T) >= near).sum(1) > 1 for i in range(0, n, 512)])
    left = np.flatnonzero(linked)
    while len(left):
        start, front, left = left[0], left[:1], left[1:]
        while len(front):
            hit = np.zeros(len(left), bool)
            for i in range(0, len(front), 512):
                hit |= ((c[front[i : i + 512]] @ c[left].T) >= near).any(0)
            front, left = left[hit], left[~hit]
            cell[front] = start
    return cell


def assigned(distinct: DataFrame, found: dict[int, np.ndarray], least: float) -> DataFrame:
    """(grp, cell, vid, own, vector), at most CELLS rows of each vector; groups without centres are one cell."""
    held = distinct.sparkSession.sparkContext.broadcast({g: (c, joined(c, least)) for g, c in found.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("grp").to_numpy()
            for g in np.unique(groups):
                part = batch.filter(pa.array(groups == g))
                c, cells = held.value.get(int(g), (None, None))
                if c is None:
                    cell, row = np.zeros(len(part), np.int32), np.arange(len(part))
                else:
                    m = min(CELLS, len(c))
                    near = matrix(part.column("vector")) @ c.T
                    best = np.argpartition(-near, m - 1, axis=1)[:, :m]
                    once = np.unique(np.stack([np.repeat(np.arange(len(part)), m), cells[best.reshape(-1)]], 1), axis=0)
                    cell, row = once[:, 1].astype(np.int32), once[:, 0]
                for i in range(0, len(row), 20_000):
                    some = part.take(pa.array(row[i : i + 20_000]))
                    yield pa.RecordBatch.from_arrays([some.column("grp"), pa.array(cell[i : i + 20_000]), some.column("vid"), some.column("own"), some.column("vector")], ["grp", "cell", "vid", "own", "vector"])

    return distinct.select("grp", "vid", "own", "vector").mapInArrow(place, "grp long, cell int, vid long, own long, vector array<float>")


def _split(cells: DataFrame) -> DataFrame:
    """With columns part and block: rows of a cell that is too large go to each pair of blocks that theirs is in."""
    large = cells.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_MOST)
    # fewer than CELLS * rows / CELL_MOST cells can be that large, and there are no more cells than centres
    marked = cells.join(F.broadcast(large.select("grp", "cell", F.ceil(F.col("n") / F.lit(CELL_MOST)).cast("int").alias("blocks"))), ["grp", "cell"], "left")
    block = F.pmod(F.xxhash64("vid"), F.coalesce("blocks", F.lit(1))).cast("int")
    spread = marked.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return spread.withColumn("part", F.least("block", "other") * 65536 + F.greatest("block", "other")).drop("other", "blocks", "block")


def nearest(distinct: DataFrame, k: int, each: int, least: float) -> DataFrame:
    """(vid, other, cosine): for each vector its k most similar others, ties with the k-th included, of at least least.

    Of the others that belong to one chunk only, at most each count, so that no chunk fills the k.

    distinct: (grp, vid, own, vector) with different vectors in a group; own: their only chunk, 0 for several.
    """
    found = centres(distinct)

    def search(key: tuple, table: pa.Table) -> pa.Table:
        x = matrix(table.column("vector"))
        vid = table.column("vid").to_numpy()
        # codes are of residuals to the cell's mean, so that unrelated vectors of a cell have inner products about 0
        centre = x.mean(0) if len(x) > 2 else np.zeros(x.shape[1], np.float32)
        own = table.column("own").to_numpy()
        parts = list(neighbours(x, centre, own, k, each, least))
        q, o, cosine = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.table({"vid": vid[q], "other": vid[o], "theirs": np.where(own == 0, vid, own)[o], "cosine": cosine})

    cells = _split(assigned(distinct, found, least))
    links = cells.groupBy("grp", "cell", "part").applyInArrow(search, "vid long, other long, theirs long, cosine float")
    once = links.repartition("vid").groupBy("vid", "other", "theirs").agg(F.max("cosine").alias("cosine"))
    of_chunk = Window.partitionBy("vid", "theirs").orderBy(F.desc("cosine"))
    rows = once.withColumn("counted", (F.row_number().over(of_chunk) <= each).cast("int")).withColumn("r", F.rank().over(of_chunk)).where(F.col("r") <= each)
    # before a link come the counted ones with a larger cosine: those up to its cosine without those of its cosine
    before = F.sum("counted").over(Window.partitionBy("vid").orderBy(F.desc("cosine"))) - F.sum("counted").over(Window.partitionBy("vid", "cosine"))
    return rows.withColumn("before", before).where(F.col("before") < k).select("vid", "other", "cosine")


def most_similar(rows: DataFrame, k: int, least: float) -> DataFrame:
    """(id, other, cosine): each embedding's k most similar ones of other chunks, where the cosine is at least least.

    Of each vector 2 k others are sought, of which at most k count that belong to one chunk alone: without the asking
    chunk's, k are left.
    """
    found = vectors(rows)
    single = F.when(F.min("chunk") == F.max("chunk"), F.min("chunk")).otherwise(F.lit(0))
    distinct = stage(found.withColumn("chunk", F.xxhash64("owner")).groupBy("grp", "vid").agg(F.first("vector").alias("vector"), single.alias("own")), "vectors")
    every = stage(found.select("id", "owner", "vid").dropDuplicates(["id"]), "embeddings")
    links = nearest(distinct, 2 * k, k, least)
    # of the ids with one vector, first at most k a chunk and then the first 2 k: without any one chunk's, k are left
    kept = every.select("vid", "owner", "id").withColumn("a", F.row_number().over(Window.partitionBy("vid", "owner").orderBy("id"))).where(F.col("a") <= k)
    kept = kept.withColumn("b", F.row_number().over(Window.partitionBy("vid").orderBy("id"))).where(F.col("b") <= 2 * k)
    answers = kept.select(F.col("vid").alias("other"), F.col("owner").alias("theirs"), F.col("id").alias("answer"))
    several = every.groupBy("vid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vid", F.col("vid").alias("other"), F.lit(1.0).cast("float").alias("cosine"))
    asked = every.select("vid", "owner", "id").join(links.unionByName(several), "vid").join(answers, "other").where(F.col("owner") != F.col("theirs"))
    best = asked.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "answer"))).where(F.col("r") <= k)
    return best.select("id", F.col("answer").alias("other"), "cosine")


def pairs(rows: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs of ids (a < b) of which one is among the other's k most similar, with a cosine of at least least."""
    found = most_similar(rows, k, least)
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
