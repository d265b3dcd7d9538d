"""Operator 13: ranked lexical search, accumulators of short lists with document-at-a-time skipping over long ones.

The documents are the index's partitions: no postings are shuffled.

1. One pass over the documents keeps, for each, its length and the counts of the terms that some item asks for;
   the sizes of the corpus and the document frequencies are sums over that table.
2. Each task walks through its documents in blocks.  The postings of a block are sorted by term, and weighted
   once for all items.  For each item
   * the lists with few postings in the block are summed into accumulators (term at a time);
   * the accumulators are one more list of the document-at-a-time part: they have a largest sum per range of
     documents, as each long list has a largest weight per range;
   * ranges whose bounds together do not reach the item's k-th best score so far are skipped; the long lists are
     read in falling order of their bound over the ranges that are left, and after each list the ranges whose
     sums and remaining bounds fall short are dropped too;
   * documents at or above the k-th best score go into the item's k best of the task, which tighten the bound
     for the blocks that follow.
3. A window keeps the k best of the tasks' results for each item.

Scores are integers and bounds are sums of integers, so skipping loses no document, ties included.

Rules: terms are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case; they are compared by
64-bit hashes.  Null and empty texts have no terms: such documents do not count, such items have no result.  A
term that an item repeats counts as often.  Equal scores are ordered by key, null keys last; rows with the same
key are documents of their own, as are rows with the same text.  Items with the same id are searched one by one.
Extra columns are ignored.  Without documents or items there are no rows.

Items are searched in groups of at most ``GROUP_TERMS`` terms (one item at least), each a pass of its own: what
goes to the tasks is bounded, however many items there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .words import TERM_WORDS, chunks, tidy

TOP, BLOCK, RANGE, SHORT = 20, 4096, 64, 256
GROUP_TERMS = 1 << 18
_LAST = np.iinfo(np.int64).max


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in chunks(batch.column(0), TERM_WORDS):
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(w.first, w.n), pa.ListArray.from_arrays(
                pa.array(w.offsets.astype(np.int32)), pa.array(w.hashes.view(np.int64)))], names=["item", "terms"])


def _counts(vocabulary: np.ndarray):
    """Per document: its terms in all, and (place in the vocabulary, occurrences) of those asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column(0), TERM_WORDS):
                place = np.minimum(np.searchsorted(vocabulary, w.hashes), len(vocabulary) - 1)
                at = np.flatnonzero(vocabulary[place] == w.hashes)
                row = np.searchsorted(w.offsets, at, "right") - 1
                cell, tf = np.unique(row * len(vocabulary) + place[at], return_counts=True)
                bounds = pa.array(np.searchsorted(cell, np.arange(w.n + 1) * len(vocabulary)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(w.first, w.n), pa.array(np.diff(w.offsets)),
                    pa.ListArray.from_arrays(bounds, pa.array((cell % len(vocabulary)).astype(np.int32))),
                    pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32)))], names=["key", "n", "terms", "tf"])
    return run


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) per term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Lists:
    """The postings of a block of documents, by term, with their weights and the largest weight per range."""

    def __init__(self, n: np.ndarray, docs: np.ndarray, terms: np.ndarray, tf: np.ndarray, weight: np.ndarray, corpus: tuple[int, int]):
        documents, length = corpus
        m = 75 + 25 * n * documents // length
        value = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[docs]))
        order = np.argsort(terms, kind="stable")  # documents stay in order within a term
        self.docs, self.values, self.ranges = docs[order], value[order], -(-len(n) // RANGE)
        sizes = np.bincount(terms, minlength=len(weight))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.tops: dict[int, np.ndarray] = {}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[term], self.ends[term]
        return self.docs[a:b], self.values[a:b]

    def top(self, term: int) -> np.ndarray:
        """The largest weight of a term in each range of documents."""
        if term not in self.tops:
            docs, values = self.of(term)
            out = np.zeros(self.ranges, np.int64)
            np.maximum.at(out, docs // RANGE, values)
            self.tops[term] = out
        return self.tops[term]


def scan(lists: Lists, item: tuple[np.ndarray, np.ndarray], least: int, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a block that score at least ``least`` (and above 0) for an item, given as distinct
    terms and their repeats."""
    terms, times = item
    sizes = lists.ends[terms] - lists.starts[terms]
    total = np.zeros(lists.ranges * RANGE, np.int64)
    for t, k in zip(terms[(sizes > 0) & (sizes <= short)].tolist(), times[(sizes > 0) & (sizes <= short)].tolist()):
        docs, values = lists.of(t)
        total[docs] += values * k
    least = max(least, 1)
    bound = total.reshape(-1, RANGE).max(1)  # of the accumulators, as of one more list
    long = [(lists.top(t) * k, t, k) for t, k in zip(terms[sizes > short].tolist(), times[sizes > short].tolist())]
    long.sort(key=lambda x: (-int(x[0].max()), x[1]))
    rest = sum((x[0] for x in long), np.zeros(lists.ranges, np.int64))
    live = bound + rest >= least
    for top, t, k in long:
        if not live.any():
            break
        docs, values = lists.of(t)
        inside = live[docs // RANGE]
        total[docs[inside]] += values[inside] * k
        rest = rest - top
        live &= total.reshape(-1, RANGE).max(1) + rest >= least
    ranges = np.flatnonzero(live)
    at = (ranges[:, None] * RANGE + np.arange(RANGE)).ravel()
    at = at[total[at] >= least]
    return at, total[at]


def best(keys: np.ndarray, none: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores; equal scores by key, null keys last."""
    return np.lexsort((keys, none, -scores))[:top]


def _search(items: list[tuple[int, np.ndarray, np.ndarray]], weight: np.ndarray, corpus: tuple[int, int], top: int, block: int, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {i: (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for i, _, _ in items}
        for batch in batches:
            for first in range(0, batch.num_rows, block):
                part = batch.slice(first, block)
                terms, tf = part.column(2), part.column(3)
                bounds = terms.offsets.to_numpy()
                docs = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                pick = [c.values.to_numpy()[bounds[0]:bounds[-1]].astype(np.int64) for c in (terms, tf)]
                lists = Lists(part.column(1).to_numpy().astype(np.int64), docs, *pick, weight, corpus)
                none = part.column(0).is_null().to_numpy(zero_copy_only=False)
                keys = part.column(0).fill_null(_LAST).to_numpy().astype(np.int64)
                for i, own, times in items:
                    held = found[i]
                    at, score = scan(lists, (own, times), int(held[2][-1]) if len(held[2]) == top else 1, short)
                    if len(at):
                        joined = [np.concatenate(x) for x in zip(held, (keys[at], none[at], score))]
                        take = best(*joined, top)
                        found[i] = tuple(x[take] for x in joined)
        counts = [len(found[i][0]) for i, _, _ in items]
        if sum(counts):
            keys, none, scores = (np.concatenate([found[i][k] for i, _, _ in items]) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([i for i, _, _ in items], np.int64), counts)), pa.array(keys, mask=none), pa.array(scores)],
                                             names=["item", "key", "score"])
    return run


def _groups(items: DataFrame, limit: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items and their terms, in groups of at most ``limit`` terms; an item over it is a group."""
    held, size = [], 0
    for r in items.toLocalIterator():
        terms = np.array(r["terms"], np.int64).view(np.uint64)
        if held and size + len(terms) > limit:
            yield held
            held, size = [], 0
        held.append((r["item"], terms))
        size += len(terms)
    if held:
        yield held


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           block: int = BLOCK, short: int = SHORT, group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item, rank, key, score) of the ``top`` best documents of each item; the key is an integer column."""
    kind = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    asked = written(queries.select(F.col(f"`{item}`").alias("id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text")).withColumn("item", F.monotonically_increasing_id()))
    terms = written(asked.select("text", "item").mapInArrow(tidy(_item_terms), "item bigint, terms array<bigint>").where(F.size("terms") > 0))
    texts = bounded_batches(docs).select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{key}`").cast("long").alias("key"))
    found = None
    for group in _groups(terms, group_terms):
        vocabulary = np.unique(np.concatenate([t for _, t in group]))
        index = written(texts.mapInArrow(tidy(_counts(vocabulary)), "key bigint, n bigint, terms array<int>, tf array<int>").where("n > 0"))
        sums = index.agg(F.count("n").alias("documents"), F.sum("n").alias("length")).first()
        if not sums["documents"]:
            break
        df = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the vocabulary
            df[r["t"]] = r["count"]
        each = [(i, *np.unique(np.searchsorted(vocabulary, t), return_counts=True)) for i, t in group]
        run = _search(each, weights(df, sums["documents"]), (sums["documents"], sums["length"]), top, block, short)
        part = index.mapInArrow(tidy(run), "item bigint, key bigint, score bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item bigint, key bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("id", "item"), "item").select(F.col("id").alias(item), "rank", F.col("key").cast(kind).alias(key), "score")
