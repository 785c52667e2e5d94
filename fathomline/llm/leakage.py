"""Held-out evaluation passages inside a training corpus: a BM25 index of the items, searched by block-max WAND.

The index holds the evaluation items, whose number is bounded and checked; the corpus is the stream of queries and is
neither shuffled nor sampled. Terms are pairs of neighbouring words. An item's threshold is the least BM25 score of the pairs
of any RUN words in a row of it: a passage that holds such a run scores as much, so nothing that counts is lost. Impacts are
divided by their item's threshold, which makes it 1 for all items. RUN words of a document whose terms' greatest impacts sum up
to less than 1 hold no run of any item. A query is a passage without such words: as many words in a row of a document as there
are whose every RUN could reach the threshold. A search has cursors over the postings of their terms, a pivot by the terms' greatest impacts, and stored bounds of blocks of postings, by which cursors
skip to the end of blocks that can't reach the threshold. What is retrieved is verified on the words of the whole document:
the share of the item's words that lie in runs of at least RUN words which also occur consecutively in the document, for the
item as a whole, and for its question line and what stands before it apart.

Cases: null and blank texts and rows without an id leak nothing; items of fewer than RUN words can't leak; equal items and equal documents are
reported each; an empty table gives an empty result. Repeated rows of one id and text are reported once. Extra columns are
ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.llm.wordhash import sequences, words
from fathomline.storage import spread

RUN = 8
K1, B = 1.2, 0.75
#: Items in a block of a posting list.
BLOCK = 16
#: The items are collected and broadcast as an index; more than this many bytes of their text is refused.
MOST_BYTES = 256 << 20


@dataclass
class Index:
    """items: ids; terms: rising hashes of pairs of words; starts: each term's first posting; most: its greatest impact.

    Postings: item, impact. Blocks of postings: bound, the greatest impact, and end, the last item; first_block of each term.
    runs: each item's runs of RUN words; question: the words before its question line.
    """

    items: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    most: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    first_block: np.ndarray
    bound: np.ndarray
    end: np.ndarray
    runs: list[np.ndarray]
    question: np.ndarray


def build(ids: list[int], texts: list[str | None]) -> Index:
    """The index of the items."""
    hashes, counts = words(texts)
    asked = [t.find("\nQ:") for t in map(lambda t: t or "", texts)]
    _, before = words([t[:a] if t and a >= 0 else t for t, a in zip(texts, asked, strict=True)])
    run, owner, at = sequences(hashes, counts, RUN)
    runs = [run[owner == i] for i in range(len(ids))]
    pair, of, place = sequences(hashes, counts, 2)
    keys, own, tf = np.unique(np.stack([pair, of.astype(np.uint64)], 1), axis=0, return_inverse=True, return_counts=True) if len(pair) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    posting = np.zeros(len(hashes), np.int64)  # of the pair that starts at a word
    posting[place] = own.reshape(-1)
    _, df = np.unique(keys[:, 0], return_counts=True)
    n, mean = len(ids), max(1.0, float(np.mean(counts)) if len(counts) else 1.0)
    item = keys[:, 1].astype(np.int64)
    norm = K1 * (1 - B + B * counts[item] / mean)
    impact = np.repeat(np.log(1 + (n - df + 0.5) / (df + 0.5)), df) * tf * (K1 + 1) / (tf + norm)
    threshold = np.full(n, np.inf)
    if len(at):  # of each run, the sum over its different pairs
        held = np.sort(posting[at[:, None] + np.arange(RUN - 1)], 1)
        score = impact[held].sum(1, where=np.diff(held, axis=1, prepend=-1) != 0)
        np.minimum.at(threshold, owner, score)
    keep = np.isfinite(threshold[item])
    keys, item, impact = keys[keep], item[keep], impact[keep] / (threshold[item[keep]] * (1 - 1e-9))
    terms, starts, sizes = np.unique(keys[:, 0], return_index=True, return_counts=True)
    blocks = -(-sizes // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
    begins = np.repeat(starts, blocks) + BLOCK * (np.arange(first_block[-1]) - np.repeat(first_block[:-1], blocks))
    ends = np.minimum(begins + BLOCK, np.repeat(starts + sizes, blocks))
    bound = np.maximum.reduceat(impact, begins) if len(begins) else np.zeros(0)
    most = np.maximum.reduceat(impact, starts) if len(starts) else np.zeros(0)
    return Index(np.asarray(ids, np.int64), counts, terms, np.append(starts, len(item)), most, item, impact, first_block, bound, item[ends - 1], runs, before)


class Cursor:
    """A place in one term's postings, and the blocks of them."""

    def __init__(self, index: Index, term: int) -> None:
        a, b = index.starts[term], index.starts[term + 1]
        c, d = index.first_block[term], index.first_block[term + 1]
        self.item, self.impact, self.at = index.item[a:b], index.impact[a:b], 0
        self.bound, self.end, self.most = index.bound[c:d], index.end[c:d], float(index.most[term])

    @property
    def now(self) -> float:
        return self.item[self.at] if self.at < len(self.item) else math.inf

    def block(self, item: int) -> tuple[float, float]:
        """The bound of the block in which item would be, and that block's last item."""
        k = int(np.searchsorted(self.end, item))
        return (float(self.bound[k]), float(self.end[k])) if k < len(self.end) else (0.0, math.inf)

    def seek(self, item: float) -> int:
        """Go to the first posting that isn't before item. Gives the number of blocks that were passed over unread."""
        before = self.at
        self.at += int(np.searchsorted(self.item[self.at :], item))
        return max(0, self.at // BLOCK - before // BLOCK - 1)


@dataclass
class Work:
    """What a search has done."""

    scored: int = 0
    skipped_blocks: int = 0
    skips: int = 0


def wand(index: Index, terms: np.ndarray, work: Work | None = None) -> Iterator[tuple[int, float]]:
    """(item, score) of the items whose score for these terms (places in index.terms) is at least 1."""
    work = work or Work()
    cursors = [Cursor(index, t) for t in terms.tolist()]
    while True:
        cursors = sorted((c for c in cursors if c.now < math.inf), key=lambda c: c.now)
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += c.most
            if total >= 1:
                pivot = k
                break
        if pivot < 0:
            return
        item = int(cursors[pivot].now)
        while pivot + 1 < len(cursors) and cursors[pivot + 1].now == item:
            pivot += 1
        near = cursors[: pivot + 1]
        blocks = [c.block(item) for c in near]
        if sum(b for b, _ in blocks) < 1:  # no item up to the end of the first of these blocks can reach it
            after = min(min(e for _, e in blocks) + 1, cursors[pivot + 1].now if pivot + 1 < len(cursors) else math.inf)
            work.skips += 1
            work.skipped_blocks += sum(c.seek(after) for c in near)
        elif near[0].now == item:
            score = sum(float(c.impact[c.at]) for c in near)
            work.scored += 1
            if score >= 1:
                yield item, score
            for c in near:
                c.at += 1
        else:
            work.skipped_blocks += sum(c.seek(item) for c in near)


def passages(index: Index, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text, terms) of the longest passages of texts, given their words, of which the terms of every RUN words can reach the threshold."""
    pair, _, place = sequences(hashes, counts, 2)
    if not len(pair) or not len(index.terms):
        return
    term = np.minimum(np.searchsorted(index.terms, pair), len(index.terms) - 1)
    known = index.terms[term] == pair
    at_word = np.full(len(hashes) + 1, -1)
    at_word[place[known]] = term[known]
    sums = np.concatenate([[0.0], np.cumsum(np.where(at_word >= 0, index.most[at_word], 0.0))])
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - RUN + 1
    whole = owner[: max(n, 0)] == owner[RUN - 1 :]
    reach = np.flatnonzero(whole & (sums[RUN - 1 : RUN - 1 + len(whole)] - sums[: len(whole)] >= 1))  # where such runs start
    if not len(reach):
        return
    apart = np.flatnonzero((np.diff(reach) > 1) | (np.diff(owner[reach]) > 0)) + 1
    for a, b in zip(reach[np.concatenate([[0], apart])].tolist(), reach[np.concatenate([apart, [len(reach)]]) - 1].tolist(), strict=True):
        terms = np.unique(at_word[a : b + RUN - 1])
        yield int(owner[a]), terms[terms >= 0]


def covered(runs: np.ndarray, held: np.ndarray, length: int) -> np.ndarray:
    """Which of the item's words lie in a run that the document holds; held: the document's runs, sorted."""
    place = np.searchsorted(held, runs)
    hit = np.flatnonzero(held[np.minimum(place, len(held) - 1)] == runs) if len(held) else np.zeros(0, np.int64)
    marks = np.zeros(length + 1, np.int32)
    np.add.at(marks, hit, 1)
    np.add.at(marks, hit + RUN, -1)
    return np.cumsum(marks)[:length] > 0


def leaks(documents: DataFrame, items: DataFrame, share: float = 1 / 3) -> DataFrame:
    """(doc_id, item_id, score, coverage, question_coverage, answer_coverage) of each document and the items of which it holds that share.

    documents: doc_id long and text; items: item_id long and text. score is the best passage's, 1 for an item's threshold.
    question_coverage is null for items without a question, answer_coverage is that of the words before it.
    """
    spark = documents.sparkSession
    size = items.selectExpr("coalesce(sum(octet_length(text)), 0) AS b").first()["b"]
    if size > MOST_BYTES:
        raise ValueError(f"the items have {size} bytes of text; an index of more than {MOST_BYTES} isn't broadcast: search them in parts")
    rows = items.select("item_id", "text").where("item_id IS NOT NULL").distinct().collect()
    held = spark.sparkContext.broadcast(build([r["item_id"] for r in rows], [r["text"] for r in rows]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        for batch in batches:
            if not len(index.terms):
                return
            hashes, counts = words(batch.column("text").to_pylist())
            best: dict[tuple[int, int], float] = {}
            for doc, terms in passages(index, hashes, counts):
                for item, score in wand(index, terms):
                    best[doc, item] = max(score, best.get((doc, item), 0.0))
            ends = np.cumsum(counts)
            out, of, held_runs = [], -1, np.zeros(0, np.uint64)
            for (doc, item), score in sorted(best.items()):
                if doc != of:
                    of = doc
                    held_runs = np.unique(sequences(hashes[ends[doc] - counts[doc] : ends[doc]], counts[doc : doc + 1], RUN)[0])
                mark = covered(index.runs[item], held_runs, int(index.lengths[item]))
                if 0 < mark.sum() >= len(mark) * share - 1e-9:
                    answer, asked = np.split(mark, [int(index.question[item])])
                    out.append((doc, int(index.items[item]), score, float(mark.mean()), float(asked.mean()) if len(asked) else None, float(answer.mean()) if len(answer) else None))
            if out:
                doc, *rest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), *[pa.float64()] * 4), strict=True))], ["doc_id", "item_id", "score", "coverage", "question_coverage", "answer_coverage"])

    found = spread(documents.selectExpr("cast(doc_id AS long) AS doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")).mapInArrow(search, "doc_id long, item_id long, score double, coverage double, question_coverage double, answer_coverage double")
    return found.dropDuplicates(["doc_id", "item_id"])
