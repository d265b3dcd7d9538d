"""Operator 10: benchmark passages in training text, found by spaced seeds.

A window of ``window`` words of a benchmark item is held against every window
of the documents at the same alignment (substitutions only).  Two windows
match when at least ``similarity`` of their places hold the same word, so up
to ``e = window - ceil(similarity * window)`` places may differ.

Seeds: the places of a window are dealt into ``e + 2`` blocks (place modulo
``e + 2``).  Each pair of blocks is one fixed mask; the seed is the hash of
the words at its places and ignores all others.  Substitutions at ``e``
places touch at most ``e`` blocks, so some mask is left untouched: every
matching window shares a seed with the item, and none is missed.

1. Seeds of the benchmark are a table; a bitmap of fixed largest size
   (a Bloom filter) of them goes to the tasks that read the documents.
2. One pass over the documents keeps the words of rows with a seed in the
   bitmap.  The join of these seeds with the benchmark's is a Spark equi-join.
3. Each (row, item, diagonal) is verified on the words around the hit: the
   matching windows on that diagonal give the passage.

Rules: words are runs of letters, digits and non-ASCII characters in lower
case.  Items of fewer than ``window`` words are one window as a whole; those
of fewer than ``min_words`` words count only where every word is the same (a
substitution would leave too little), through the same join with one seed of
all their words.  Items without a word and null texts are never found.
Items with the same words are one class, reported by the smallest item_id;
``item_classes`` has the membership.  Repeated document rows and ids give a
result each.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bitmap, probe
from .common import bounded_batches, written
from .words import _ODD, LETTER_WORDS, Words, chunks, mix, tidy

WINDOW, MIN_WORDS, SIMILARITY = 13, 8, 0.8


def need(window: int, similarity: float) -> int:
    """Equal places that two windows need."""
    return math.ceil(similarity * window - 1e-9)


def tolerance(size: int, min_words: int, similarity: float) -> float:
    """The similarity asked of windows of ``size`` words."""
    return similarity if size >= min_words else 1.0


def seeds(words: Words, window: int, similarity: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """(first word of every window inside a row, one array of seeds per mask)."""
    h = words.hashes
    count = len(h) - window + 1
    if count <= 0:
        return np.zeros(0, np.int64), []
    row_end = np.repeat(words.offsets[1:], np.diff(words.offsets))
    at = np.flatnonzero(np.arange(count) + window <= row_end[:count])
    blocks = window - need(window, similarity) + 2
    sums = [np.zeros(count, np.uint64) for _ in range(blocks)]
    for k in range(window):
        sums[k % blocks] += h[k:k + count] * _ODD[k]
    sums = [s[at] for s in sums]
    return at, [mix(sums[a] + sums[b] + np.uint64((window << 16) + (a << 8) + b)) for a, b in combinations(range(blocks), 2)]


def item_classes(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, class_id): items with the same words share the smallest item_id of them."""
    ids = _item_words(benchmark, item, text)
    small = ids.groupBy("words").agg(F.min("item_id").alias("class_id"))
    return ids.join(small, "words").select("item_id", "class_id")


def _word_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in chunks(batch.column(1), LETTER_WORDS):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n), pa.ListArray.from_arrays(
                pa.array(w.offsets.astype(np.int32)), pa.array(w.hashes.view(np.int64)))], names=["item_id", "words"])


def _item_words(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    rows = benchmark.select(F.col(f"`{item}`").alias("item_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(_word_arrays, f"item_id {rows.schema['item_id'].dataType.simpleString()}, words array<bigint>")


def _array_words(column: pa.ListArray) -> Words:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy().view(np.uint64)[offsets[0]:offsets[-1]]
    none = np.zeros(0, np.int64)
    return Words(0, values, none, none, offsets.astype(np.int64) - offsets[0], none, none)


def _item_seeds(window: int, min_words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            for size in range(1, window + 1):
                rows = np.flatnonzero(lengths >= window if size == window else lengths == size)
                if not len(rows):
                    continue
                words = _array_words(lists.take(pa.array(rows)))
                at, each = seeds(words, size, tolerance(size, min_words, similarity))
                row = np.searchsorted(words.offsets, at, "right") - 1
                ids = batch.column(0).take(pa.array(rows[row]))
                for s in each:
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), ids, pa.array((at - words.offsets[row]).astype(np.int32)),
                                                      pa.array(np.full(len(at), size, np.int32))], names=["seed", "item_id", "place", "size"])
    return run


def _document_hits(bits: np.ndarray, sizes: list[int], min_words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column(1), LETTER_WORDS):
                found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for size in sizes:
                    at, each = seeds(w, size, tolerance(size, min_words, similarity))
                    for s in each:
                        k = probe(bits, s)
                        found.append(s[k])
                        places.append(at[k])
                found, places = np.concatenate(found), np.concatenate(places)
                if not len(found):
                    continue
                order = np.argsort(places, kind="stable")
                found, places = found[order], places[order]
                row = np.searchsorted(w.offsets, places, "right") - 1
                rows, first = np.unique(row, return_index=True)
                bounds = pa.array(np.append(first, len(row)).astype(np.int32))
                sizes_of = np.diff(w.offsets)[rows]
                ends = np.cumsum(sizes_of)
                flat = np.repeat(w.offsets[rows] - (ends - sizes_of), sizes_of) + np.arange(int(ends[-1]))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(w.first + rows)),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(w.hashes[flat].view(np.int64))),
                    pa.ListArray.from_arrays(bounds, pa.array(found.view(np.int64))),
                    pa.ListArray.from_arrays(bounds, pa.array((places - w.offsets[row]).astype(np.int32)))],
                    names=["doc_id", "words", "seeds", "places"])
    return run


def passage(text: np.ndarray, item: np.ndarray, window: int, similarity: float) -> tuple[int, int, int] | None:
    """(start, end, equal words) of the stretch covered by matching windows of two aligned sequences."""
    equal = np.concatenate([[0], np.cumsum(text == item)])
    good = np.flatnonzero(equal[window:] - equal[:-window] >= need(window, similarity)) if len(text) >= window else []
    if not len(good):
        return None
    covered = np.zeros(len(text) + 1, np.int64)
    np.add.at(covered, good, 1)
    np.add.at(covered, good + window, -1)
    inside = np.cumsum(covered[:-1]) > 0
    return int(good[0]), int(good[-1] + window), int(((text == item) & inside).sum())


def _verify(window: int, min_words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(4), batch.column(5))]
            kept, spans = [], []
            shift, low = batch.column(3).to_numpy(), batch.column(6).to_numpy()
            for i in range(batch.num_rows):
                part, item = (v[o[i]:o[i + 1]] for o, v in lists)
                skip = int(low[i] - shift[i])  # words of the item before the part
                got = passage(part, item[skip:skip + len(part)], min(window, len(item)), tolerance(len(item), min_words, similarity))
                if got:
                    kept.append(i)
                    spans.append((got[0] + int(low[i]), got[1] + int(low[i]), got[2], len(item)))
            some = np.array(spans, np.int64).reshape(-1, 4)
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take),
                                              *(pa.array(some[:, k].copy()) for k in range(4))],
                                             names=["rid", "doc_id", "item_id", "start_word", "end_word", "equal_words", "item_words"])
    return run


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
         window: int = WINDOW, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, least_item: int = 1) -> DataFrame:
    """One row per document row and item class that it holds a passage of: the words of the
    longest passage (start, end), its equal words and the item's length in words.
    Items of fewer than ``least_item`` words are left out."""
    key_type, item_type = (d.select(F.col(f"`{c}`")).schema[0].dataType.simpleString() for d, c in ((docs, key), (benchmark, item)))
    items = written(_item_words(benchmark, item, item_text).where(F.size("words") >= max(1, least_item)).groupBy("words").agg(F.min("item_id").alias("item_id")))
    table = written(items.select("item_id", "words").mapInArrow(
        _item_seeds(window, min_words, similarity), f"seed bigint, item_id {item_type}, place int, size int").distinct())
    said = table.groupBy("size").count().collect()
    sizes = sorted(r["size"] for r in said)
    bits = bitmap(table, "seed", sum(r["count"] for r in said))

    rows = bounded_batches(docs).select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    hits = rows.mapInArrow(tidy(_document_hits(bits, sizes, min_words, similarity)), f"doc_id {key_type}, words array<bigint>, seeds array<bigint>, places array<int>")
    hits = written(hits.withColumn("rid", F.monotonically_increasing_id()))

    pairs = hits.select("rid", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("rid", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"))
    pairs = pairs.join(table, "seed").select("rid", "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct()
    sizes_of = items.select("item_id", "words", F.size("words").alias("n"))
    pairs = written(pairs).join(sizes_of.select("item_id", "n"), "item_id")
    low = F.greatest(F.col("shift"), F.lit(0))
    parts = pairs.join(hits.select("rid", "doc_id", "words"), "rid").select(
        "rid", "doc_id", "item_id", "shift", F.slice("words", low + 1, F.col("shift") + F.col("n") - low).alias("part"), low.alias("low"))
    both = parts.join(sizes_of.select("item_id", "words"), "item_id").select("rid", "doc_id", "item_id", "shift", "part", "words", "low")
    found = both.mapInArrow(_verify(window, min_words, similarity), f"rid bigint, doc_id {key_type}, item_id {item_type}, start_word bigint, end_word bigint, equal_words bigint, item_words bigint")
    best = found.groupBy("rid", "item_id").agg(F.max(F.struct("equal_words", (-F.col("start_word")).alias("before"), "end_word", "item_words", "doc_id")).alias("b"))
    return best.select(F.col("b.doc_id").alias(key), "item_id", (-F.col("b.before")).alias("start_word"), "b.end_word", "b.equal_words", "b.item_words")
