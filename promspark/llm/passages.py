"""Operator 1: repeated passages of documents by collinear chaining.

1. Seeds: of the k-word runs of a text, the one with the smallest hash in each
   window of ``window`` runs (a minimizer).  An unbroken shared stretch of
   ``k + window - 1`` words always shares a seed.  Texts with the same words
   are one text from the start.
2. Equal seeds meet by a shuffle on the seed.  Each occurrence is matched with
   the first occurrence of its seed in another text, never with all of them,
   so every repeated seed has a match and matches stay linear in the seeds.  A
   seed that FREQUENT texts of one block of a reading task have is matched
   inside that block, and two of these texts stand for the block in the seed's
   own group; so the blocks bound the size of every group.
3. Per pair of texts, matches on one diagonal are joined to segments, and the
   segments are chained in order on both sides: a chain scores its matched
   words less the gaps, and a Fenwick tree over the other text's places holds
   the best chain that ends before a segment.
4. Chains, those of one seed too, are aligned on the words of both texts: gaps
   by their longest common subsequence, ends by extension.  Stretches of at
   least LEAST_ALIGNED words that agree in SIMILARITY of them count.
5. Aligned stretches of a text, whichever texts they came from, are merged;
   merged stretches of at least ``least`` words are its repeated passages.

Rules: words are runs of letters, digits and non-ASCII characters in lower
case.  Null, empty and short texts have no passage.  Documents with the same
words repeat as a whole.  Repeats within one text alone do not count.  Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import bitmap, probe
from .common import bounded_batches, written
from .words import LETTER_WORDS, Words, chunks, mix, ngrams, tidy

K, WINDOW = 5, 2
LEAST, LEAST_ALIGNED, SIMILARITY = 40, 12, 0.8
GAP_COST, LARGEST_GAP, REACH, JOIN_GAP, NEAR = 0.3, 16, 24, 8, 12
BLOCK_SEEDS, FREQUENT = 1 << 20, 32


def text_names(words: Words) -> np.ndarray:
    """64 bits of the word sequence of each row."""
    place = np.arange(len(words.hashes)) - np.repeat(words.offsets[:-1], np.diff(words.offsets))
    total = np.append(np.zeros(1, np.uint64), np.cumsum(mix(words.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64))
    return mix(total[words.offsets[1:]] - total[words.offsets[:-1]]).view(np.int64)


def minimizers(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(seed, word index of its first word), at most one per place."""
    h, at = ngrams(words, K)
    if not len(h):
        return h, at
    row = np.searchsorted(words.offsets, at, "right") - 1
    first = np.searchsorted(at, words.offsets[:-1])[row]  # the row's first run, as an index of h
    last = np.append(np.searchsorted(row, row, "right"), 0)[:-1] - 1
    index = np.arange(len(h))
    best = index.copy()  # the smallest run of the window that begins here
    for k in range(1, WINDOW):
        other = np.minimum(index + k, last)
        best = np.where(h[other] < h[best], other, best)
    full = (index + WINDOW - 1 <= last) | (index == first)  # a short row has one window
    chosen = np.unique(best[full])
    return h[chosen], at[chosen]


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def said(held: list) -> pa.RecordBatch:
        seed, name, place = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(seed)
        at = np.flatnonzero(np.append(True, seed[order][1:] != seed[order][:-1]))
        size = np.diff(np.append(at, len(seed)))
        order = order[np.repeat(size >= FREQUENT, size)]  # fewer places are fewer texts
        rank, often = np.zeros(len(seed), np.int64), np.zeros(len(seed), bool)
        if len(order):
            order = order[np.lexsort((name[order], seed[order]))]
            size = size[size >= FREQUENT]
            at = np.cumsum(size) - size
            new = np.append(True, name[order][1:] != name[order][:-1])
            new[at] = True
            texts = np.cumsum(new)
            rank[order] = texts - np.repeat(texts[at], size)  # of the text among those of its seed
            often[order] = np.repeat(texts[at + size - 1] - texts[at] + 1 >= FREQUENT, size)
        # a block's frequent seeds get a name of their own: they are matched among themselves; the first
        # two texts have them under their own name too, for texts of other blocks to be matched with
        block = mix(np.array([np.bitwise_xor.reduce(mix(name.view(np.uint64) + seed))], np.uint64))[0]
        both = np.flatnonzero(often & (rank < 2))
        seed = np.append(np.where(often, mix(seed + block), seed), seed[both])
        name, place = np.append(name, name[both]), np.append(place, place[both])
        return pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(name), pa.array(place.astype(np.int32))], names=["seed", "text", "place"])

    held, size, seen = [], 0, set()
    for batch in batches:
        for w in chunks(batch.column(0), LETTER_WORDS):
            seed, at = minimizers(w)
            names = text_names(w)
            new = np.array([n not in seen and not seen.add(n) for n in names.tolist()], bool)
            if len(seen) > BLOCK_SEEDS:
                seen.clear()
            row = np.searchsorted(w.offsets, at, "right") - 1
            kept = new[row]
            held.append((seed[kept], names[row[kept]], (at - w.offsets[row])[kept]))
            size += int(kept.sum())
            if size >= BLOCK_SEEDS:
                yield said(held)
                held, size = [], 0
    if size:
        yield said(held)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut only where the first ``keys`` columns change."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
        if size >= least:
            columns = [np.concatenate(c) for c in zip(*held)]
            same = np.ones(size, bool)
            for c in columns[:keys]:
                same &= c == c[-1]
            whole = size - int(np.argmin(same[::-1])) if not same.all() else 0
            if whole:
                yield [c[:whole] for c in columns]
            held, size = [[c[whole:] for c in columns]], size - whole
    if size:
        yield [np.concatenate(c) for c in zip(*held)]


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by seed: each is matched with the first row of another text, by text and place."""
    for seed, text, place in _whole_groups(batches, 1):
        new = seed[1:] != seed[:-1]
        more = np.flatnonzero(~(np.append(True, new) & np.append(new, True)))  # a seed of one row has no match
        if not len(more):
            continue
        more = more[np.lexsort((place[more], text[more], seed[more]))]
        seed, text, place = seed[more], text[more], place[more]
        keep = np.append(True, (seed[1:] != seed[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1]))
        seed, text, place = seed[keep], text[keep], place[keep]
        run = np.flatnonzero(np.append(True, (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])))  # one text's places of a seed
        size = np.diff(np.append(run, len(seed)))
        head = np.flatnonzero(np.append(True, seed[run][1:] != seed[run][:-1]))  # runs that begin a seed
        first = np.repeat(head, np.diff(np.append(head, len(run))))
        own = np.arange(len(run))
        other = np.where(own != first, first, np.where(np.append(first[1:], -1) == first, own + 1, -1))  # the run to match with
        # the places of a text meet those of the other in order, so that text of one repeated word lines up
        rank = np.arange(len(seed)) - np.repeat(run, size)
        partner = np.repeat(np.where(other >= 0, run[other], -1), size)
        partner = np.where(partner >= 0, partner + rank % np.repeat(size[other], size), -1)
        group = np.repeat(run[first], size)
        # a row of the first text is matched from the other side, but for its further places
        some = np.flatnonzero((partner >= 0) & (np.arange(len(seed)) != group))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (text[some], text[partner[some]], place[some], place[partner[some]])], names=["x", "y", "i", "j"])


class Fenwick:
    """Largest value up to a place."""

    def __init__(self, size: int):
        self.best = [(-1e18, -1)] * (size + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place]:
                self.best[place] = value
            place += place & -place

    def largest(self, place: int) -> tuple[float, int]:
        """Over places up to and including ``place``."""
        place, out = place + 1, (-1e18, -1)
        while place > 0:
            if self.best[place] > out:
                out = self.best[place]
            place -= place & -place
        return out


def segments(pair: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, (i, j, words)) of matches joined along their diagonals, where they touch or nearly do; sorted by pair."""
    d = j - i
    order = np.lexsort((i, d, pair))
    pair, i, j, d = pair[order], i[order], j[order], d[order]
    new = np.append(True, (pair[1:] != pair[:-1]) | (d[1:] != d[:-1]) | (i[1:] - i[:-1] > NEAR))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(i)) - 1
    return pair[at], np.stack([i[at], j[at], i[last] + K - i[at]], axis=1)


def chains(parts: np.ndarray) -> list[list[int]]:
    """Chains of segments in order on both sides, best first; each segment is in one at most.

    The score of a chain that ends with a segment is its words less GAP_COST per word of the gaps on
    both sides.  As the cost adds up over places, score + cost * (end places) can be compared at once:
    the tree over the ends in the other text gives the best chain to go on from."""
    order = np.lexsort((parts[:, 1], parts[:, 0]))
    parts = parts[order]
    if len(parts) == 1:
        return [[int(order[0])]]
    ends = np.unique(parts[:, 1] + parts[:, 2])
    tree = Fenwick(len(ends))
    score, back = [0.0] * len(parts), [-1] * len(parts)
    waiting = sorted(range(len(parts)), key=lambda s: parts[s, 0] + parts[s, 2])  # by end in this text
    w = 0
    rows = parts.tolist()
    for s, (i, j, n) in enumerate(rows):
        while w < len(waiting) and rows[waiting[w]][0] + rows[waiting[w]][2] <= i:
            a, b, m = rows[waiting[w]]
            tree.put(int(np.searchsorted(ends, b + m)), (score[waiting[w]] + GAP_COST * (a + m + b + m), waiting[w]))
            w += 1
        value, before = tree.largest(int(np.searchsorted(ends, j, "right")) - 1)
        value -= GAP_COST * (i + j)
        score[s], back[s] = (n + value, before) if value > 0 else (float(n), -1)
    used, out = [False] * len(rows), []
    for s in sorted(range(len(rows)), key=lambda s: -score[s]):
        chain = []
        while s >= 0 and not used[s]:
            used[s] = True
            if chain and max(rows[chain[-1]][0] - rows[s][0] - rows[s][2], rows[chain[-1]][1] - rows[s][1] - rows[s][2]) > LARGEST_GAP:
                used[s] = False
                break
            chain.append(s)
            s = back[s]
        if chain:
            out.append([int(order[c]) for c in chain[::-1]])
    return out


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by x, y: the chains of each pair of texts, as lists of segments."""
    for x, y, i, j in _whole_groups(batches, 2):
        start = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        pair, parts = segments(np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x)))), i.astype(np.int64), j.astype(np.int64))
        begin = np.searchsorted(pair, np.arange(len(start) + 1))
        alone = begin[:-1][np.diff(begin) == 1]  # most pairs have one segment: it is their chain
        pairs, flat, sizes = [pair[alone]], [alone], [np.ones(len(alone), np.int64)]
        for k in np.flatnonzero(np.diff(begin) > 1).tolist():
            a, b = begin[k], begin[k + 1]
            found = chains(parts[a:b])
            pairs.append(np.full(len(found), k))
            flat += [a + np.array(c) for c in found]
            sizes.append(np.array([len(c) for c in found]))
        first, flat, offsets = start[np.concatenate(pairs)], np.concatenate(flat), np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(y[first]), *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(parts[flat, k].astype(np.int32))) for k in range(3))],
                                         names=["x", "y", "i", "j", "n"])


def _named_words(bits: np.ndarray):
    """(text, words as 32-bit hashes) of the texts in the bitmap, once per text and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for w in chunks(batch.column(0), LETTER_WORDS):
                names = text_names(w)
                rows = [k for k in probe(bits, names.view(np.uint64)).tolist() if names[k] not in seen and not seen.add(names[k])]
                if len(seen) > BLOCK_SEEDS:
                    seen.clear()
                low = w.hashes.astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array([low[w.offsets[k]:w.offsets[k + 1]] for k in rows], pa.list_(pa.int32()))], names=["text", "words"])
    return run


def equal_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words left in place by the cheapest alignment of two short stretches (longest common subsequence)."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b):
        same = int((a == b).sum())
        if same >= len(a) - 1:
            return same
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        up = np.append(0, np.where(b == x, row[:-1] + 1, row[1:]))
        row = np.maximum.accumulate(np.maximum(up, row))
    return int(row[-1])


SKIPS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2))


def _stretch(offsets: np.ndarray, values: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int, none: int) -> np.ndarray:
    """A row per list: ``size`` values from place ``begin`` on, forwards or backwards, and ``none`` behind them."""
    k = np.arange(int(size.max(initial=0)) + 6)
    out = np.full((len(size), len(k)), none, np.int64)
    row, col = np.nonzero(k < size[:, None])
    out[row, col] = values[offsets[row] + begin[row] + step * col]
    return out


def extended(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of a, of b, equal words) of ends that go on alike, an end a row: equal runs, with up to two words of
    either side passed over where three equal words follow.  Both have five unequal words or more behind the end."""
    width = min(a.shape[1], b.shape[1])
    i, j, same = (np.zeros(len(a), np.int64) for _ in range(3))
    on, k = np.arange(len(a)), np.arange(width)
    last_a, last_b = a.shape[1] - 1, b.shape[1] - 1
    while len(on):
        x = a[on[:, None], np.minimum(i[on][:, None] + k, last_a)]
        y = b[on[:, None], np.minimum(j[on][:, None] + k, last_b)]
        run = np.argmin(x == y, axis=1)
        i[on] += run
        j[on] += run
        same[on] += run
        go = np.zeros(len(on), bool)
        for s, t in SKIPS:
            p, q = i[on] + s, j[on] + t
            like = ~go
            for m in range(3):
                like &= a[on, np.minimum(p + m, last_a)] == b[on, np.minimum(q + m, last_b)]
            i[on[like]], j[on[like]] = p[like], q[like]
            go |= like
        on = on[go]
    return i, j, same


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains with the words around both sides: the stretches that agree."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = [(c.offsets.to_numpy().astype(np.int64), c.values.to_numpy()) for c in (batch.column(k) for k in (2, 3, 4, 5, 7))]
        from_x, from_y = batch.column(6).to_numpy(), batch.column(8).to_numpy()
        (o, i), (_, j), (_, n), (oa, a), (ob, b) = lists
        i, j, n = (v[o[0]:o[-1]].astype(np.int64) for v in (i, j, n))
        o = o - o[0]
        row = np.repeat(np.arange(batch.num_rows), np.diff(o))
        i, j = i - from_x[row], j - from_y[row]
        # matches nearly touch inside a segment: compare its words
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = a[np.repeat(oa[row] + i, n) + step] == b[np.repeat(ob[row] + j, n) + step]
        same = np.bincount(np.repeat(row, n), equal, batch.num_rows).astype(np.int64)
        s = np.flatnonzero(row[1:] == row[:-1])
        s = s[(i[s] + n[s] < i[s + 1]) & (j[s] + n[s] < j[s + 1])]
        for k in s.tolist():
            r = row[k]
            same[r] += equal_words(a[oa[r] + i[k] + n[k]:oa[r] + i[k + 1]], b[ob[r] + j[k] + n[k]:ob[r] + j[k + 1]])
        first, last = o[:-1], o[1:] - 1
        x0, y0, x1, y1 = i[first], j[first], i[last] + n[last], j[last] + n[last]
        e = extended(_stretch(oa, a, x0 - 1, x0, -1, -1 << 40), _stretch(ob, b, y0 - 1, y0, -1, -2 << 40))
        f = extended(_stretch(oa, a, x1, np.diff(oa) - x1, 1, -1 << 40), _stretch(ob, b, y1, np.diff(ob) - y1, 1, -2 << 40))
        x0, y0, x1, y1, same = x0 - e[0], y0 - e[1], x1 + f[0], y1 + f[1], same + e[2] + f[2]
        kept = np.flatnonzero((np.minimum(x1 - x0, y1 - y0) >= LEAST_ALIGNED) & (same >= SIMILARITY * np.maximum(x1 - x0, y1 - y0)))
        take, got = pa.array(kept), [(x0 + from_x)[kept], (x1 + from_x)[kept], (y0 + from_y)[kept], (y1 + from_y)[kept]]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, got)], names=["x", "y", "x0", "x1", "y0", "y1"])


def _members(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column(1), LETTER_WORDS):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n), pa.array(text_names(w)), pa.array(np.diff(w.offsets))], names=[key, "text", "n"])
    return run


def aligned(texts: DataFrame) -> DataFrame:
    """(x, y, x0, x1, y0, y1): stretches of two texts (by name, in words) that agree."""
    seeds = texts.mapInArrow(tidy(_seeds), "seed bigint, text bigint, place int").repartition("seed").sortWithinPartitions("seed")
    matches = seeds.mapInArrow(tidy(_matches), "x bigint, y bigint, i int, j int").repartition("x").sortWithinPartitions("x", "y")
    chained = written(matches.mapInArrow(tidy(_chained), "x bigint, y bigint, i array<int>, j array<int>, n array<int>"))
    named = written(chained.select("x").union(chained.select("y")).distinct().withColumnRenamed("x", "text"))
    bits = bitmap(named, "text", named.count())
    words = texts.mapInArrow(tidy(_named_words(bits)), "text bigint, words array<int>").join(named, "text", "left_semi").dropDuplicates(["text"])
    words = written(words)

    def part(side: str, place: str) -> tuple:
        low = F.greatest(F.element_at(place, 1) - REACH, F.lit(0))
        high = F.element_at(place, -1) + F.element_at("n", -1) + REACH
        return F.slice("words", low + 1, high - low).alias(f"of_{side}"), low.alias(f"from_{side}")

    near = chained.join(words.withColumnRenamed("text", "x"), "x").select("x", "y", "i", "j", "n", *part("x", "i"))
    near = near.join(words.withColumnRenamed("text", "y"), "y").select("x", "y", "i", "j", "n", "of_x", "from_x", *part("y", "j"))
    return near.mapInArrow(tidy(_aligned), "x bigint, y bigint, x0 bigint, x1 bigint, y0 bigint, y1 bigint")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """A row per document and repeated passage: its words [start_word, end_word), the document's length
    in words, and ``other_id``, the smallest key of a text that shares some of it."""
    rows = bounded_batches(docs).select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    members = written(rows.mapInArrow(_members("key"), f"key {rows.schema['key'].dataType.simpleString()}, text bigint, n bigint").where(F.col("n") >= LEAST_ALIGNED))
    classes = written(members.groupBy("text").agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.max("n").alias("n")))
    both = written(aligned(rows.select("body")))
    spans = both.select(F.col("x").alias("text"), F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("y").alias("other")).union(both.select("y", "y0", "y1", "x"))
    spans = spans.groupBy("text", "a", "b").agg(F.min("other").alias("other"))
    spans = spans.union(classes.where("copies > 1").select("text", F.lit(0).cast("long"), "n", "text"))
    order = Window.partitionBy("text").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("a") > before + JOIN_GAP, 1).when(before.isNull(), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(order))
    merged = marked.groupBy("text", "island").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"), F.max_by("other", F.col("b") - F.col("a")).alias("other"))
    merged = merged.where(F.col("end_word") - F.col("start_word") >= least)
    merged = written(merged.join(classes.select(F.col("text").alias("other"), F.col("least").alias("other_id")), "other").drop("other", "island"))
    return members.join(merged, "text").select(F.col("key").alias(key), "start_word", "end_word", F.col("n").alias("n_words"), "other_id")
